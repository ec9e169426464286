"""Tables of the engine: immutable Parquet files, and a catalog that names the files of each table.

A statement writes new files first and then a catalog of the next version, by a rename that fails where that version
exists already. So readers see the state before or after, a job that dies leaves the old state, and of two processes that
start from one version the second learns of it. Files that no catalog names any more go with vacuum().
"""

from __future__ import annotations

import copy
import json
import re
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another process has changed the database since it was read."""


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one of the session. Only a session in one process may do without: it gets one of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tarn-')}"
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/tarn/db-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.root))

    def _versions(self, db: str) -> list[int]:
        folder = self._path(f"{self.root}/{db}")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"catalog-(\d+)\.json", n)))

    def load(self, db: str) -> dict[str, Any]:
        versions = self._versions(db)
        if not versions:
            return {"schemas": ["public", "pg_catalog", "information_schema"], "tables": {}, "types": {}, "next_oid": 16384, "version": 0}
        stream = self._fs.open(self._path(f"{self.root}/{db}/catalog-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def save(self, db: str, catalog: dict[str, Any]) -> None:
        """Makes this the state of the database; Conflict where another process has saved since it was loaded."""
        version = catalog["version"] + 1
        if any(v >= version for v in self._versions(db)):
            raise Conflict(f"database {db} has been changed meanwhile")
        catalog["version"] = version
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        temporary = self._path(f"{self.root}/{db}/saving-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(catalog).encode("utf-8")))
        stream.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(temporary, self._path(f"{self.root}/{db}/catalog-{version}.json"), options)
        except Py4JJavaError as problem:
            self._fs.delete(temporary, False)
            catalog["version"] = version - 1
            raise Conflict(f"database {db} has been changed meanwhile") from problem
        for old in self._versions(db):
            if old < version - 1:
                self._fs.delete(self._path(f"{self.root}/{db}/catalog-{old}.json"), False)

    def write(self, db: str, df: DataFrame) -> list[str]:
        """The files that hold the rows, in the order of the rows."""
        path = f"{self.root}/{db}/parts/{uuid.uuid4().hex}"
        df.write.parquet(path)
        files = [f.getPath().toString() for f in self._fs.listStatus(self._path(path)) if f.getPath().getName().startswith("part-")]
        return sorted(files)

    def read(self, table: dict[str, Any], places: bool = False) -> DataFrame:
        """The rows; with places also __file (its folder and name) and __row, which name a row, and __part, the number of its file."""
        schema = schema_of(table)
        if not table["parts"]:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"__file": F.lit(""), "__row": F.lit(0).cast("long"), "__part": F.lit(0)}) if places else empty
        df = self.spark.read.schema(schema).parquet(*table["parts"])
        if not places:
            return df
        order = F.create_map(*[F.lit(x) for i, p in enumerate(table["parts"]) for x in (short(p), i)])
        df = df.select("*", F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("__file"), F.col("_metadata.row_index").alias("__row"))
        return df.withColumn("__part", order[F.col("__file")])

    def scratch(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Rows kept for the time of a statement."""
        path = f"{self.root}/rounds/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def vacuum(self, db: str, catalog: dict[str, Any]) -> int:
        """Deletes files of rows that the catalog does not name; how many. DataFrames made before may still want them."""
        named = {short(p) for t in catalog["tables"].values() for p in t["parts"]}
        folder = self._path(f"{self.root}/{db}/parts")
        gone = 0
        for part in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            files = [f.getPath() for f in self._fs.listStatus(part.getPath())]
            dead = [f for f in files if short(f.toString()) not in named and f.getName().startswith("part-")]
            gone += len(dead)
            if all(f in dead or not f.getName().startswith("part-") for f in files):
                self._fs.delete(part.getPath(), True)
            else:
                for f in dead:
                    self._fs.delete(f, False)
        self.delete(f"{self.root}/rounds")
        return gone

    def drop(self, db: str) -> None:
        self.delete(f"{self.root}/{db}")


def short(path: str) -> str:
    return "/".join(path.rsplit("/", 2)[-2:])


def schema_of(table: dict[str, Any]) -> T.StructType:
    return T.StructType([T.StructField(c["name"], T.DataType.fromDDL(c["type"])) for c in table["columns"]])


def fresh(catalog: dict[str, Any]) -> dict[str, Any]:
    return copy.deepcopy(catalog)
