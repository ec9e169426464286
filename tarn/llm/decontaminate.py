"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. Benchmark passages become TF-IDF rows; a randomised SVD, whose two passes over the rows are distributed, gives the
   latent space. Only directions that benchmark passages span can add to a cosine with one of them, so the space is
   fitted on exactly those rows, in blocks of items.
3. Every window of every document is compared with all items, each at windows of about its own length. What a word adds
   to the product of projections is looked up, so windows are differences of running sums. The most that a word adds to
   any item bounds all cosines of a window at once; items are only gone through where that bound reaches the limit, so
   no candidate is lost.
4. Candidates are confirmed on words: a longest common subsequence over most of the item is a leak; one over about half
   of it is a paraphrase, and a leak if the item's answer (its last sentence, or last words) is there as well.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._shared import stored

#: Hashed words: a table of so many document frequencies goes to every task, whatever the corpus.
FEATURES = 1 << 18
#: Most items that share a latent space; no more than the rank of the space, so it holds each exactly.
BLOCK_ITEMS = 400
#: Blocks that share a pass over the documents; a task holds about 5 MB for each.
PASS_BLOCKS = 16
#: Blocks that are numbered together in one task.
SHARD_BLOCKS = 64
REMEMBERED = 400_000
_SEPARATE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Limits:
    """cosine: of candidates; leak, paraphrase, answer: least shares of words in common order; step: words between windows."""

    cosine: float = 0.4
    leak: float = 0.7
    paraphrase: float = 0.5
    answer: float = 0.8
    rank: int = 256
    step: int = 8


class _Features(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) % FEATURES
        return value


def words(text: str | None) -> list[bytes]:
    """ASCII letters are lower-cased; other ASCII than letters and digits separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def _features(found: Collection[bytes], known: _Features) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, total, n = _Features(), np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            # A feature that two words of a text share counts once, since repeated indices add once.
            total[_features(set(words(text.as_py())), known)] += 1
            n += 1
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], n))], names=["feature", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each hashed word over all documents; FEATURES numbers, however many documents there are."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    df = np.zeros(FEATURES)
    total = float(rows["n"][rows["feature"] == -1].sum())
    real = rows[rows["feature"] >= 0]
    df[real["feature"].to_numpy()] = real["n"].to_numpy()
    return np.log((total + 1.0) / (df + 0.5)).clip(0.05).astype(np.float32)


def _weights(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.unique(found, return_counts=True)
    return own, n * idf[own].astype(np.float64)


def _sketch(idf: np.ndarray, vocabulary: np.ndarray, factor: np.ndarray | None, rank: int, project: bool):
    """Of the rows a of each partition: the sum of outer(a, a @ factor), or with project the Gram matrix of a @ factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        by = factor if factor is not None else np.random.default_rng(7).standard_normal((len(vocabulary), rank))
        total = np.zeros((rank, rank) if project else (len(vocabulary), rank))
        for batch in batches:
            for text in batch.column(0):
                own, w = _weights(_features(words(text.as_py()), known), idf)
                if len(own):
                    at = np.searchsorted(vocabulary, own)
                    y = w @ by[at]
                    if project:
                        total += np.outer(y, y)
                    else:
                        total[at] += w[:, None] * y
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

    return run


def latent_space(items: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (a row for each word of the vocabulary) of the items' TF-IDF matrix, by randomised SVD.

    Both passes over the items run as Spark tasks; the driver adds up one matrix of bounded size for each of them.
    """

    def summed(run, shape: tuple[int, int]) -> np.ndarray:
        total = np.zeros(shape)
        for row in items.select("text").mapInArrow(run, "part binary").toLocalIterator():
            total += np.frombuffer(row["part"], "<f8").reshape(shape)
        return total

    q, _ = np.linalg.qr(summed(_sketch(idf, vocabulary, None, rank, False), (len(vocabulary), rank)))
    values, turned = np.linalg.eigh(summed(_sketch(idf, vocabulary, q, q.shape[1], True), (q.shape[1], q.shape[1])))
    good = values > 1e-9 * max(values.max(initial=0.0), 1e-30)
    return (q @ turned[:, good]).astype(np.float32)


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel in the length of a."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(text: str | None) -> list[bytes]:
    """The last sentence of three words or more, but no more than the last half; else the last five words."""
    whole = words(text)
    for part in reversed(re.split(r"(?<=[.!?])\s+", text or "")):
        own = words(part)
        if len(own) >= 3:
            return own if 2 * len(own) <= len(whole) else whole[-5:]
    return whole[-5:]


_FOUND = "doc_id long, item_id long, cosine double, lcs long, item_words long, answer_lcs long, answer_words long, first_word long, kind string"


class _Block:
    """Items that share a latent space, and what a word adds to the product with each of them."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], idf: np.ndarray, vocabulary: np.ndarray, space: np.ndarray, step: int) -> None:
        known = _Features()
        self.items = items
        self.column = np.full(FEATURES + 1, len(vocabulary), np.int32)
        self.column[vocabulary] = np.arange(len(vocabulary))
        latent = np.zeros((len(items), space.shape[1]), np.float32)
        groups: dict[int, list[int]] = {}
        for k, (_, own, _) in enumerate(items):
            f, w = _weights(_features(own, known), idf)
            latent[k] = (w.astype(np.float32) @ space[self.column[f]]) / np.sqrt((w**2).sum())
            groups.setdefault(-(-len(own) // step) + 1, []).append(k)
        self.groups = sorted(groups.items())
        # What one occurrence of a word adds to the product with each item; the last row is for all other words.
        self.adds = np.vstack([(idf[vocabulary, None] * space) @ latent.T, np.zeros((1, len(items)), np.float32)])
        self.most = np.stack([self.adds[:, members].max(axis=1).clip(0.0) for _, members in self.groups], axis=1)

    def candidates(self, features: np.ndarray, spent: np.ndarray, last: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, cells of a window, first cells of the windows whose cosine is at least `least`, those cosines).

        features: (cells, step); spent: energy before each cell, and in all; last: where the text of a cell ends.
        """
        n_cells = len(features)
        col = self.column[features]
        starts = np.arange(n_cells)
        bounds = np.zeros((n_cells + 1, len(self.groups)))
        np.cumsum(self.most[col].sum(axis=1), axis=0, out=bounds[1:])
        reached = []
        needed = np.zeros(n_cells + 1, np.int64)
        for g, (size, _) in enumerate(self.groups):
            ends = np.minimum(starts + size, last)
            norm = np.sqrt(np.maximum(spent[ends] - spent[:-1], 1e-9))
            own = np.flatnonzero(bounds[ends, g] - bounds[:-1, g] >= least * norm * (1 - 1e-5) - 1e-6)
            np.add.at(needed, own, 1)
            np.add.at(needed, ends[own], -1)
            reached.append((own, ends[own], norm[own]))
        at = np.flatnonzero(np.cumsum(needed[:-1]) > 0)
        if not len(at):
            return
        # Cells of a window follow one another, and so they do among the cells that are needed.
        place = np.zeros(n_cells, np.int64)
        place[at] = np.arange(len(at))
        sums = np.zeros((len(at) + 1, len(self.items)))
        for c in range(0, len(at), 128):
            sums[c + 1 : c + 129] = self.adds[col[at[c : c + 128]]].sum(axis=1)
        np.cumsum(sums, axis=0, out=sums)
        for (size, members), (own, ends, norm) in zip(self.groups, reached, strict=True):
            if not len(own):
                continue
            first = place[own]
            cosines = (sums[first + (ends - own)] - sums[first])[:, members] / norm[:, None]
            close, which = np.nonzero(cosines >= least)
            for m in np.unique(which):
                mine = close[which == m]
                yield members[m], size, own[mine], cosines[mine, m]


def _searcher(blocks: list[_Block], idf: np.ndarray, limits: Limits):
    names = [part.split()[0] for part in _FOUND.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(part.split()[0], types[part.split()[1]]) for part in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        energy = np.append(idf.astype(np.float64) ** 2, 0.0)
        step = limits.step

        def search(texts: list[list[bytes]]) -> Iterator[tuple[int, int, tuple]]:
            """(number of the text, item_id, finding); texts are padded to whole cells of `step` words and gone through together."""
            cells = np.array([-(-len(t) // step) for t in texts])
            first = np.concatenate([[0], np.cumsum(cells)])
            features = np.full(int(first[-1]) * step, FEATURES, np.int32)
            for t, c in zip(texts, first, strict=False):
                features[c * step : c * step + len(t)] = _features(t, known)
            features = features.reshape(-1, step)
            spent = np.concatenate([[0.0], np.cumsum(energy[features].sum(axis=1))])
            owner = np.repeat(np.arange(len(texts)), cells)
            for block in blocks:
                best: dict[tuple[int, int], tuple] = {}
                for item, size, windows, cosines in block.candidates(features, spent, first[1:][owner], limits.cosine):
                    # Windows that overlap form a chain. None has more of the item than the whole chain, which is tried before its windows.
                    breaks = np.flatnonzero((np.diff(windows) > size) | (np.diff(owner[windows]) > 0)) + 1
                    for near, close in zip(np.split(windows, breaks), np.split(cosines, breaks), strict=True):
                        k = int(owner[near[0]])
                        places = near - int(first[k])
                        chain = texts[k][max(0, (int(places[0]) - 1) * step) : (int(places[-1]) + size + 1) * step]
                        own = block.items[item][1]
                        if len(near) > 1 and common_subsequence(own, chain) < limits.paraphrase * len(own):
                            continue
                        for cosine, place in zip(close.tolist(), places.tolist(), strict=True):
                            lo, hi = max(0, (place - 1) * step), (place + size + 1) * step
                            row = confirm(block.items[item], cosine, texts[k][lo:hi], lo)
                            old = best.get((k, item))
                            if row and (not old or (row[1], row[3], row[0]) > (old[1], old[3], old[0])):
                                best[k, item] = row
                for (k, item), row in best.items():
                    yield k, block.items[item][0], row

        def confirm(item: tuple[int, list[bytes], list[bytes]], cosine: float, region: list[bytes], place: int) -> tuple | None:
            _, mine, answer = item
            lcs = common_subsequence(mine, region)
            if lcs < limits.paraphrase * len(mine):
                return None
            said = common_subsequence(answer, region)
            if lcs >= limits.leak * len(mine):
                kind = "leak"
            elif said >= limits.answer * len(answer):
                kind = "paraphrase"
            else:
                return None
            return min(cosine, 1.0), lcs, len(mine), said, len(answer), place, kind

        for batch in batches:
            rows: list[tuple] = []
            ids, texts, held = [], [], 0
            for doc_id, text in zip([*batch.column(0).to_pylist(), None], [*batch.column(1), None], strict=True):
                found = words(text.as_py()) if text is not None else []
                if found:
                    ids.append(doc_id)
                    texts.append(found)
                    held += len(found)
                if texts and (held > 15_000 or text is None):
                    rows += [(ids[k], item_id, *row) for k, item_id, row in search(texts)]
                    ids, texts, held = [], [], 0
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _blocks(items: DataFrame, size: int) -> DataFrame:
    """items with shard and block; no (shard, block) has more than size rows. Rows are numbered within a shard, since hashed blocks would be uneven."""
    shards = -(-max(1, items.count()) // (size * SHARD_BLOCKS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("item_id", "text"))
    return dealt.withColumn("block", F.floor((place - 1) / size))


def leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document and benchmark item that it holds: cosine, words in common order, place and kind.

    kind is leak or paraphrase; first_word is where the compared region begins. Null or empty texts hold nothing, and
    items without a word are in nothing. Repeated rows each report; a null doc_id or item_id stays null. Items share a
    latent space in blocks of at most BLOCK_ITEMS, and no more than the rank; PASS_BLOCKS blocks share a pass over the
    documents. What an item finds does not depend on other items. Other columns are not looked at.
    """
    idf = inverse_frequencies(docs)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    numbered = stored(_blocks(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL"), min(BLOCK_ITEMS, limits.rank)), "items")
    blocks: list[_Block] = []
    found = None
    named = [(r["shard"], r["block"]) for r in numbered.select("shard", "block").distinct().orderBy("shard", "block").collect()]
    for shard, block in named:
        chosen = numbered.where((F.col("shard") == shard) & (F.col("block") == block))
        items = [(r["item_id"], own, answer_of(r["text"])) for r in chosen.orderBy("item_id", "text").collect() if (own := words(r["text"]))]
        if items:
            known = _Features()
            vocabulary = np.unique(np.concatenate([_features(own, known) for _, own, _ in items]))
            space = latent_space(chosen, idf, vocabulary, min(limits.rank, len(items), len(vocabulary)))
            blocks.append(_Block(items, idf, vocabulary, space, limits.step))
        if blocks and (len(blocks) == PASS_BLOCKS or (shard, block) == named[-1]):
            part = texts.mapInArrow(_searcher(blocks, idf, limits), _FOUND)
            found = part if found is None else found.union(part)
            blocks = []
    return found if found is not None else docs.sparkSession.createDataFrame([], _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs without a leak or paraphrase. Rows with the doc_id of one that leaks go with it; null doc_ids count as one."""
    gone = leaks(docs, benchmark, limits).select(F.col("doc_id").alias("_id")).distinct()
    gone = stored(gone, "leaking")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
