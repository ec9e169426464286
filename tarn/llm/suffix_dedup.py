"""Removal of byte strings that an earlier document holds, by bucket-pointer refinement of suffixes.

Suffixes are put into buckets by their first bytes, and a bucket is refined by sorting its pointers on the bucket
identifiers of other offsets: the bucket of 2m bytes at p follows from those of m bytes at p and at p + m, so identifiers
of 16 bytes are reused for 24 and 32 and those of 32 for 42 and for the 50 (LENGTH) that count. An identifier is a 64-bit
number that follows from the bytes, so every task names equal buckets alike; buckets meet in Spark's shuffles and sorts.

Only some suffixes are pointers, since a row for each byte would be about sixteen times the input in one shuffle: of the
24-byte buckets (POINTER) of a window of LENGTH bytes the one with the least identifier, the leftmost of equals.
Successive windows share a pointer, and such a run of windows is one row. Equal windows have equal pointers at equal
offsets. Runs up to the next pointer whose identifier ends with four zero bits are a segment.

1. A segment (by 128 bits over its bytes) that an earlier document has goes as a whole.
2. q-gram buckets: the pointers of other segments. Buckets of a single document are resolved.
3. They are refined by the buckets of LENGTH bytes at the first and at the last window of a run. A run whose refined
   bucket an earlier document is in goes; where all runs of a q-gram bucket stay in one refined bucket, it is resolved.
4. Other runs, of the first document of each refined bucket, are refined by the 42-byte buckets at three offsets about
   the pointer; every window holds one of the three.
5. Where another document is in that bucket too, the windows that hold it are opened, and the bucket of a window's first
   32 bytes is refined by the bucket at offset 18. Windows whose refined bucket an earlier document is in go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import discard, sliced, stored

LENGTH = 50
POINTER = 24
SIDE = 42
#: How far before a pointer the 42-byte buckets begin; a window with the pointer at offset k holds number k // 9.
_SIDES = (0, 9, 18)
#: Windows that are looked at together: bounds memory for very long texts, and changes no result.
CHUNK = 1 << 16
_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 21) - 1)
_SEGMENT = np.uint64(15)
#: Segments and pointers are compared in so many slices, one after the other, so that only a slice is in shuffle files.
SLICES = 4
#: Numbers of windows and offsets within a window are below this.
_SIX = 64


def _refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of what starts with a bucket of a and goes on with one of b."""
    x = a * _K1
    x += b
    x ^= x >> np.uint64(32)
    return x


def _buckets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 16, of POINTER and of 32 bytes at every place."""
    b = _BYTES[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        b = _refine(b[:-step], b[step:])
    b *= _K2
    return b, _refine(b[: 16 - POINTER], b[POINTER - 16 :]) * _K2, _refine(b[:-16], b[16:])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class _Buffer:
    """Pieces of texts, looked at together. A piece has at most CHUNK windows: (number of the text, its place there, place in the buffer, windows)."""

    def __init__(self) -> None:
        self.data, self.pieces, self.size = [], [], 0

    def add(self, row: int, at: int, piece: bytes) -> None:
        self.pieces.append((row, at, self.size, len(piece) - LENGTH + 1))
        self.data.append(piece)
        self.size += len(piece)

    def table(self) -> np.ndarray:
        return np.array(self.pieces, np.int64).reshape(-1, 4)


def _buffers(texts: pa.Array) -> Iterator[_Buffer]:
    made = _Buffer()
    for row, text in enumerate(texts):
        data = _bytes(text.as_py())
        for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
            made.add(row, at, data[at : at + CHUNK + LENGTH - 1])
            if made.size >= CHUNK:
                yield made
                made = _Buffer()
    if made.pieces:
        yield made


def _pieces(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """offset, offset + 1, ... for each offset, as many as its size."""
    return np.repeat(offsets - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_SEGMENTS = "seg_a long, seg_b long, start long, size long, ptrs array<long>, starts array<int>, spans array<short>, doc_id long, rid long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rid, text) -> a row for each segment, with the pointers and runs in it."""
    names = [part.split()[0] for part in _SEGMENTS.split(", ")]
    for batch in batches:
        docs, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for buffer in _buffers(batch.column(2)):
            data, table = b"".join(buffer.data), buffer.table()
            _, b, _ = _buckets(data)
            least = (b & ~_PLACE) | np.arange(len(b), dtype=np.uint64)
            for step in (1, 2, 4, 8):
                least = np.minimum(least[:-step], least[step:])
            rest = LENGTH - POINTER + 1 - 16
            place = (np.minimum(least[:-rest], least[rest:]) & _PLACE).astype(np.int64)
            window = _pieces(table[:, 2], table[:, 3])
            piece = np.repeat(np.arange(len(table)), table[:, 3])
            place = place[window]
            first = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (piece[1:] != piece[:-1])) + 1])
            size = np.diff(np.append(first, len(place)))
            ptr, of = b[place[first]], piece[first]
            start = window[first] - table[of, 2] + table[of, 1]
            spans = size * _SIX + place[first] - window[first]
            head = np.flatnonzero(((ptr & _SEGMENT) == 0) | np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(head[1:], len(first))
            low, high = window[first[head]], window[first[ends - 1]] + size[ends - 1] + LENGTH - 1
            ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(low.tolist(), high.tolist(), strict=True)), np.int64).reshape(-1, 2)
            offsets = pa.array(np.append(head, len(first)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ptr.view(np.int64), start.astype(np.int32), spans.astype(np.int16))]
            row = table[of[head], 0]
            plain = [np.ascontiguousarray(ids[:, 0]), np.ascontiguousarray(ids[:, 1]), start[head], high - low - LENGTH + 1]
            yield pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists, pa.array(docs[row]), pa.array(rids[row])], names=names)


def _of_runs(names: list[str], scale: int, of: Callable[[str, np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]):
    """(doc_id, rid, text, runs) -> rows of 64-bit numbers made from the buckets and runs of a buffer, with doc_id and rid.

    of: (data, run, where its text begins in the buffer) -> columns, and for each row the number of its run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row_of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((flat, row_of))
            flat, row_of = flat[order], row_of[order]
            starts = flat // (scale * _SIX * _SIX)
            bounds = np.searchsorted(row_of, np.arange(len(lists) + 1))
            for buffer in _buffers(batch.column(2)):
                chosen, shift = [], []
                for row, at, offset, _ in buffer.pieces:
                    own = starts[bounds[row] : bounds[row + 1]]
                    lo, hi = bounds[row] + np.searchsorted(own, [at, at + CHUNK])
                    if lo < hi:
                        chosen.append(np.arange(lo, hi))
                        shift.append(np.full(hi - lo, offset - at))
                if chosen:
                    at = np.concatenate(chosen)
                    columns, which = of(b"".join(buffer.data), flat[at], np.concatenate(shift))
                    row = row_of[at][which]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(docs[row]), pa.array(rids[row])], names=names)

    return run


def _parts(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and how far the pointer is from the first window."""
    return run // (_SIX * _SIX), run // _SIX % _SIX, run % _SIX


def _sided(offset: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a run's windows, the first that holds side k, and how many do."""
    first = np.clip(offset - (9 * k + 8), 0, size)
    return first, np.clip(offset - 9 * k + 1, 0, size) - first


def _refined(data: bytes, run: np.ndarray, shift: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each run: ptr, the buckets of its first and its last window, the 42-byte buckets (0 where no window has them), and run."""
    _, b24, b32 = _buckets(data)
    first, size, offset = _parts(run)
    first = first + shift
    last, pointer = first + size - 1, first + offset
    of = lambda at, length: _refine(b32[at], b32[at + length - 32])
    sides = [np.where(_sided(offset, size, k)[1] > 0, of(np.clip(pointer - back, 0, len(data) - SIDE), SIDE), np.uint64(0)) for k, back in enumerate(_SIDES)]
    return [b24[pointer], of(first, LENGTH), of(last, LENGTH), *sides, run], np.arange(len(run))


def _opened(data: bytes, run: np.ndarray, shift: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of runs (times four, plus the number of a side): bucket, bucket at offset 18 and place of the windows that hold that side."""
    _, _, b32 = _buckets(data)
    side = run % 4
    first, size, offset = _parts(run // 4)
    skip, n = (np.choose(side, x) for x in zip(*(_sided(offset, size, k) for k in range(len(_SIDES))), strict=True))
    window, which = _pieces(first + skip, n), np.repeat(np.arange(len(run)), n)
    at = window + shift[which]
    return [b32[at], b32[at + LENGTH - 32], window], which


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, sizes) -> the document's figures and what is left of it; of `sizes` windows from each start all bytes go."""
    for batch in batches:
        rows = []
        for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = _bytes(text.as_py())
            if not gone.is_valid:
                rows.append((doc_id, len(data), 0, [], [], hashlib.sha256(data).hexdigest()))
                continue
            spans = np.sort(gone.values.to_numpy(zero_copy_only=False))
            start = spans >> 24
            reach = np.maximum.accumulate(start + (spans & 0xFFFFFF) + LENGTH - 1)
            # A removed run begins where no earlier one reaches.
            new = np.concatenate([[True], start[1:] > reach[:-1]])
            starts, ends = start[new].tolist(), reach[np.append(new[1:], True)].tolist()
            kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
            rows.append((doc_id, len(data), len(data) - len(kept), starts, ends, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256"])


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts, ends (of the maximal removed runs, in bytes) and kept_sha256 for each row of docs.

    A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id. Null
    text is empty. Rows that share a doc_id take nothing from each other; each of them loses what an earlier document
    has. A null doc_id neither takes nor loses. Other columns are not looked at.
    """
    key = ["doc_id", "rid"]
    all_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Different texts that share a doc_id are told apart by a hash; of other rows rid is 0, which takes no room.
    own = F.xxhash64("text")
    several = stored(all_.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo < hi").select(F.col("doc_id").alias("_id")), "shared-ids")
    texts = all_.join(several, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.when(F.col("_id").isNotNull(), own).otherwise(F.lit(0).cast("long")).alias("rid"), "text")
    real = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))

    def of_runs(lists: DataFrame, names: list[str], scale: int, of, name: str) -> DataFrame:
        names = [*names, *key]
        rows = real.join(lists.groupBy(*key).agg(F.collect_set("run").alias("runs")), key).select(*key, "text", "runs")
        return stored(rows.mapInArrow(_of_runs(names, scale, of), ", ".join(f"{n} long" for n in names)), name)

    def of_two(rows: DataFrame, *by: str) -> DataFrame:
        """The values that more than one document has, and the first of these; a task sends one row for each value."""
        return rows.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*by, "lo")

    # What goes is (first window, number of windows) in one number; runs and windows are short, and a segment has at most CHUNK.
    span = lambda start, size: start * (1 << 24) + size
    # 1. Segments.
    late = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))
    gone, parts = [], []
    for segments in sliced(real.select(*key, "text").mapInArrow(_segments, _SEGMENTS), "segments", F.col("seg_a"), SLICES):
        lows = stored(of_two(segments, "seg_a", "seg_b"), "segment-lows")
        # They grow with the corpus, so they are never broadcast, and segments are dealt alike at every size.
        dealt = lows.hint("shuffle_hash")
        whole = segments.join(dealt, ["seg_a", "seg_b"]).where(late)
        gone.append(stored(whole.select(*key, span(F.col("start"), F.col("size")).alias("gone")), "whole-segments"))
        first = segments.join(dealt, ["seg_a", "seg_b"], "left").where(~late).select(*key, "starts", "spans", F.posexplode("ptrs").alias("i", "ptr"))
        run = F.get("starts", F.col("i")).cast("long") * (_SIX * _SIX) + F.get("spans", F.col("i"))
        parts.append(sliced(first.select("ptr", run.alias("run"), *key), "pointers", F.col("ptr"), SLICES))
        discard(segments, lows)
    # 2. q-gram buckets.
    found = []
    for same in zip(*parts, strict=True):
        pointers = reduce(DataFrame.union, same)
        shared = stored(of_two(pointers, "ptr").select("ptr"), "buckets")
        found.append(stored(pointers.join(shared, "ptr").select(*key, "run"), "met"))
        discard(*same, shared)
    met = reduce(DataFrame.union, found)
    # 3. Refined by the buckets of the first and the last window.
    sides = [f"side_{k}" for k in range(len(_SIDES))]
    refined = of_runs(met, ["ptr", "first", "last", *sides, "run"], 1, _refined, "refined")
    discard(*found)
    bucket = ["ptr", "first", "last", "span"]
    spanned = refined.withColumn("span", F.col("run") % (_SIX * _SIX))
    lows = stored(spanned.groupBy(*bucket).agg(F.min("doc_id").alias("lo")), "lows")
    open_ = lows.groupBy("ptr").agg(F.count("*").alias("n")).where("n > 1").select("ptr", F.lit(True).alias("open"))
    marked = stored(lows.join(open_, "ptr", "left"), "marked")
    discard(lows)
    judged = stored(spanned.join(marked, bucket).where("doc_id > lo OR open").select(*key, "ptr", *sides, "run", late.alias("late")), "judged")
    discard(refined, marked)
    gone.append(stored(judged.where("late").select(*key, span(F.expr(f"run DIV {_SIX * _SIX}"), F.expr(f"run DIV {_SIX} % {_SIX}")).alias("gone")), "whole-runs"))
    # 4. Refined by the buckets about the pointer.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("side")) for k, c in enumerate(sides)]))
    sided = judged.where("NOT late").select(*key, "ptr", "run", each.alias("s")).select(*key, "ptr", "run", "s.*").where("side <> 0")
    both = stored(of_two(sided, "ptr", "k", "side").drop("lo"), "sides")
    chosen = stored(sided.join(both, ["ptr", "k", "side"]).select(*key, (F.col("run") * 4 + F.col("k")).alias("run")), "chosen")
    discard(judged, both)
    # 5. Windows, refined by the bucket at offset 18.
    windows = of_runs(chosen, ["at", "more", "window"], 4, _opened, "windows")
    discard(chosen)
    early = stored(of_two(windows, "at", "more"), "early")
    gone.append(stored(windows.join(early, ["at", "more"]).where("doc_id > lo").select(*key, span(F.col("window"), F.lit(1)).alias("gone")), "late-windows"))
    discard(windows, early)
    listed = reduce(DataFrame.union, gone).groupBy(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid")).agg(F.collect_set("gone").alias("gone"))
    listed = stored(listed, "gone")
    discard(*gone)
    left = texts.join(listed, (texts["doc_id"] == listed["_doc"]) & (texts["rid"] == listed["_rid"]), "left").select("doc_id", "text", "gone")
    return left.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string")
