"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, each on what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. ``run``
writes every stage's rows as Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from tarn.llm._shared import stored
from tarn.session import configure, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified rule reject go."""
    return quality_rules.keep(docs, table(configure(spark), sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which no word is left goes with them. n_chars follows the text."""
    configure(spark)
    left = line_dedup.cut(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return left.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    configure(spark)
    gone = stored(minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct(), "copies")
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase with its answer, go."""
    return decontaminate.clean(docs, table(configure(spark), sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in packed sequences."""
    import public_tokenizers

    configure(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Token ids are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of `documents`."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
