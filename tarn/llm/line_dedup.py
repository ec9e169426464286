"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines that hold a word are hashed. A window is `run` consecutive such lines, or fewer that have at least `words` words in
all. Of each window the line with the least hash (the leftmost of equals) is selected; the selected positions are the
fingerprints, and every repeated window is guaranteed to have one in common with its repetition. Only fingerprints are
stored, with the digests of the lines within a window of them. Positions with equal fingerprints are joined; each is
matched to the earliest position that agrees on the lines of a window, by their SHA-256, and the match is extended both
ways as far as the lines agree. Beyond a window's reach another fingerprint of the same match goes on. The lines of
matches are deleted, so of overlapping ones the union goes: the maximal later repeated runs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import discard, stored, words_of

RUN = 3
WORDS = 50
_WORD = "[^\\x20\\x09-\\x0D]"


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def _shapes(run: int, words: int | None) -> list[tuple[int, int]]:
    """How many lines of a window lie before and after its fingerprint."""
    return [(a, n - 1 - a) for n in range(1 if words is not None else run, run + 1) for a in range(n)]


def fingerprints(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(fp, doc_id, rid, i, near, shapes): the selected lines; i counts lines with a word from 0.

    near: digests of the lines from i - run + 1 to i + run - 1, null where there is none; shapes: numbers (in the order
    of _shapes) of the windows of which the line is the least.
    """
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda line: line.rlike(_WORD))
    count = (lambda x: F.lit(0)) if words is None else lambda x: F.size(words_of(x))
    at = docs.select("doc_id", _row_id().alias("rid"), lines.alias("lines")).where(F.size("lines") >= (run if words is None else 1))
    of = lambda x: F.struct(F.xxhash64(x).alias("h"), F.unhex(F.sha2(x, 256)).alias("d"), count(x).alias("w"))
    at = at.select("doc_id", "rid", F.transform("lines", of).alias("l"))

    def selected(i: Column) -> Column:
        # F.get gives null before the first and after the last line; so a window that does not exist is no shape.
        part = {k: F.get("l", i + k) for k in range(1 - run, run)}

        def least(a: int, b: int) -> Column:
            inside = F.coalesce(F.size("l") - i > b, F.lit(False)) & (i >= a)
            before = [part[0]["h"] < part[-k]["h"] for k in range(1, a + 1)]
            after = [part[0]["h"] <= part[k]["h"] for k in range(1, b + 1)]
            enough = [] if a + b + 1 == run else [sum((part[k]["w"] for k in range(-a, b + 1)), F.lit(0)) >= words]
            return reduce(and_, [*before, *after, *enough], inside)

        found = [F.when(least(a, b), F.lit(k)) for k, (a, b) in enumerate(_shapes(run, words))]
        return F.struct(i.alias("i"), part[0]["h"].alias("fp"), F.array_compact(F.array(*found)).alias("shapes"), F.array(*[part[k]["d"] for k in range(1 - run, run)]).alias("near"))

    each = F.filter(F.transform(F.sequence(F.lit(0), F.size("l") - 1), selected), lambda x: F.size(x["shapes"]) > 0)
    return at.select("doc_id", "rid", F.explode(each).alias("s")).select("s.fp", "doc_id", "rid", "s.i", "s.near", "s.shapes")


def deletions(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(doc_id, rid, drop): positions, among the lines with a word, of the lines to delete.

    A task sends one row for each key when positions are counted; joins follow stored tables, so that Spark may split
    the rows of a line that very many documents have.
    """
    place = F.struct("doc_id", "rid", "i")
    every = stored(fingerprints(docs, run, words), "fingerprints")
    shared = every.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where(F.col("lo") != F.col("hi")).select("fp")
    shared = stored(shared, "shared")
    joined = stored(every.join(shared, "fp"), "joined")
    discard(every, shared)
    shapes = _shapes(run, words)
    window = lambda a, b: F.concat(*[F.get("near", F.lit(run - 1 + k)) for k in range(-a, b + 1)])
    wide = joined.select("doc_id", "rid", "i", "near", F.explode("shapes").alias("shape"))
    wide = wide.withColumn("lines", reduce(lambda c, k: c.when(F.col("shape") == k, window(*shapes[k])), range(1, len(shapes)), F.when(F.col("shape") == 0, window(*shapes[0]))))
    # places differ, so near is never compared; it comes along with the earliest.
    first = wide.groupBy("shape", "lines").agg(F.min(F.struct("doc_id", "rid", "i", "near")).alias("first"), F.max(place).alias("last"))
    first = stored(first.where(F.struct("first.doc_id", "first.rid", "first.i") != F.col("last")).select("shape", "lines", "first"), "first")
    matched = stored(wide.join(first, ["shape", "lines"]).where(place != F.struct("first.doc_id", "first.rid", "first.i")).select("doc_id", "rid", "i", "near", F.col("first.near").alias("other")).distinct(), "matched")
    discard(joined, first)

    def reach(way: int) -> Column:
        """How many lines agree one after the other."""
        same = [F.coalesce(F.get("near", F.lit(run - 1 + way * k)) == F.get("other", F.lit(run - 1 + way * k)), F.lit(False)) for k in range(1, run)]
        return reduce(lambda n, k: F.when(same[k], 1 + n).otherwise(0), reversed(range(run - 1)), F.lit(0))

    lines = F.sequence(F.col("i") - reach(-1), F.col("i") + reach(1))
    return matched.groupBy("doc_id", "rid").agg(F.array_distinct(F.flatten(F.collect_set(lines))).alias("drop"))


def cut(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed) for each row of docs: the row as it was in one struct, the text that is left and the figures of dedup()."""
    gone = deletions(docs, run, words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), _row_id().alias("own_rid"), F.col("text").alias("own_text"))
    at = rows.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_rid") == F.col("rid")), "left").select("row", F.col("own_text").alias("text"), "drop")
    at = at.withColumn("lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORD), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    at = at.withColumn("worded", worded)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("drop", lambda k: F.get("worded", k)))
    return at.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n")).alias("text"),
        F.size("worded").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """docs with text cut, and n_lines (lines with a word) and n_removed (long) added; other columns as they were.

    Later repeated runs of `run` lines or more go, and shorter ones of at least `words` words in all (None: not these).
    Null text: no lines, stays null. Rows that share doc_id and text are one document and come out alike; a null
    doc_id sorts first. Lines without a word are never deleted, and a document that loses nothing keeps its exact text.
    Where docs has a column n_lines or n_removed, that one stays and the figure's name gets underscores before it.
    """
    names = []
    for name in ("n_lines", "n_removed"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)
    made = cut(docs, run, words)
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return made.select(*own, F.col("n_lines").alias(names[0]), F.col("n_removed").alias(names[1]))
