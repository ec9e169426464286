"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are tokenised, closed by an end id, cut into pieces of at most `most` ids and counted by length. From that
histogram (at most `most` numbers, the only thing the driver sees) lengths are placed longest first: each goes into the
packs that are shortest so far, all packs of one pattern at once, or opens new packs. The resulting patterns are joined
back to pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._shared import stored

MOST = 1024
END_ID = 0
#: Pieces of one length are ranked in groups of about this many, so that a length that most pieces have is no hot group.
RANKED_TOGETHER = 20_000
#: Distinct words whose ids a Python worker remembers before it starts afresh.
REMEMBERED = 1_000_000

#: Fixed value: how the byte-level tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token never spans a place between a character that is no space and a single space before another such character.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and their ids, if the file is a plain byte-level BPE whose ids follow its merges; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in merges]
    return found if made == sorted(made) else None


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes; ids of words are remembered within bounds.

    Words not met before go through the rank tables of the tokenizer file where it is a plain byte-level BPE, which
    gives the same ids three times as fast, and else through the tokenizer itself. So does every text that holds a token
    added to the vocabulary (such as one for the end of a text), which the tokenizer finds before it splits words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()
        spec = json.loads(Path(path).read_text("utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        ranks = _ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.known.fast = self.fast

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {k: array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for k, t in enumerate(texts) if any(a in t for a in self.added)}
        found = self._of_words([t for k, t in enumerate(texts) if k not in whole] if whole else texts)
        if whole:
            rest = iter(found)
            found = [whole[k] if k in whole else next(rest) for k in range(len(texts))]
        return found

    def _of_words(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        cut = [_parts(text) for text in texts]
        if not self.fast:
            new = list(set().union(*cut) - known.keys())
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                for word, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                    known[word] = array("I", found.ids).tobytes()
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]


class _Known(dict):
    """Ids of words; those not met before go through the rank tables."""

    fast = None

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = array("I", self.fast(word)).tobytes()
        return ids


def _parts(text: str) -> list[str]:
    """A text cut where no token goes across."""
    if not text:
        return []
    words = text.split()
    if "\0" in text or sum(map(len, words)) + len(words) - 1 != len(text):
        return _BETWEEN.split(text)
    # Every space stands alone between two words, and a token that begins with one begins there.
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(path: str, most: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs), 200):
                rows: list[tuple] = []
                for doc_id, ids in zip(docs[at : at + 200], encoder([t or "" for t in texts[at : at + 200].to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, most):
                        piece = ids[4 * start : 4 * (start + most)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + ([pa.array(columns[5], pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return cut


def pieces(docs: DataFrame, path: str, most: int = MOST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; a null text is empty, and an empty document is its end id alone."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_cutter(path, most, end_id, with_ids), _PIECES + ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], most: int = MOST) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with the number of packs that have them; lengths come longest first."""
    packs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    totals: list[int] = []

    def add(total: int, pattern: tuple[tuple[int, int], ...], count: int) -> None:
        if total not in packs:
            packs[total] = []
            heapq.heappush(totals, total)
        packs[total].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while totals and not packs[totals[0]]:
                packs.pop(heapq.heappop(totals))
            if totals and totals[0] + length <= most:
                total = totals[0]
                pattern, count = packs[total].pop()
                taken = min(left, count)
                if taken < count:
                    packs[total].append((pattern, count - taken))
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                add(total + length, grown, taken)
                left -= taken
            else:
                each = most // length
                if full := left // each:
                    add(each * length, ((length, each),), full)
                if rest := left % each:
                    add(rest * length, ((length, rest),), 1)
                left = 0
    return [x for total in sorted(packs, reverse=True) for x in packs[total]]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), ordered by length and rank: where the pieces of each length go."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, each in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, count, sequence, offset))
            next_rank[length] = rank + count * each
            offset += length * each
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(table: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1].reshape(-1, 5)
            within = rank - at[:, 1]
            own = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            arrays = [c for _, c in own] + [pa.array(at[:, 3] + within % np.maximum(at[:, 2], 1)), pa.array(at[:, 4] + within // np.maximum(at[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in own] + ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, most: int = MOST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) with sequence_id and offset.

    Every id of every document, its end id included, lies in exactly one piece; pieces fill a sequence from offset 0
    without gaps. Repeated rows are packed once each; a null doc_id stays null. Other columns are not looked at.
    """
    cut = stored(pieces(docs, path, most, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `most` rows
    table = slots(shortest_pack_first(counts, most))
    salts = max(8, -(-max(counts.values(), default=1) // RANKED_TOGETHER) * 4)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    within = Window.partitionBy("length", "salt").orderBy(*order)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("within", F.row_number().over(within)).join(firsts, ["length", "salt"])
    columns = [n.split()[0] for n in _PIECES.split(", ")] + ["ids"] * with_ids
    ranked = ranked.select(*columns, (F.col("first") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(table), _PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long")
