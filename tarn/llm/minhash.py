"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct 3-word shingles. Rows with equal sets form a class, whose smallest doc_id stands
for it. Of each representative HASHES minima are taken; bands of them give candidates, and the low BITS of each are
packed into a signature. Only pairs that share a band are looked at, and only so far as they may join something:

1. Within a band bucket each member is a candidate with the first one. Similarities are estimated from bit counts of the
   signatures (corrected for chance collisions); pairs that may reach the limit are confirmed on their full sets, for
   each document its most similar first one, then those whose ends are not connected yet.
2. Buckets that still hold several components are gone through: members of the largest component are dealt out in blocks
   and met by all others, so what is connected already is not compared with itself. This is done with signatures first;
   members without a pair that may reach the limit are left out, and the others come again with their full sets. Only
   links that join something leave a task.

A group of thousands of copies so gives thousands of pairs, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._shared import LOWER, UPPER, components, discard, stored

#: 42 bands of 6: a pair at similarity 0.85 shares no band with a chance of 2e-9.
BANDS, ROWS, BITS = 42, 6, 4
HASHES = BANDS * ROWS
#: An estimate from 252 minima lies within 0.12 (five standard deviations) of a true similarity of 0.85.
MARGIN = 0.12
#: Shingles in a block: a task holds two blocks, about 1 MB of sets.
BLOCK_SHINGLES = 64_000
#: Members of a bucket in a block where only signatures are compared.
BLOCK_MEMBERS = 8_000
#: Distinct words whose hash a Python worker remembers before it starts afresh.
REMEMBERED = 400_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FACTORS = np.random.default_rng(20_240_229).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 3-word shingles; of fewer words the whole sequence is one."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < 3:
        h = np.concatenate([np.full(3 - len(h), 7, np.uint64), h])
    return np.unique(_mix(_mix(_mix(h[:-2]) + h[1:-1]) + h[2:]))


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[None, at : at + 1024] * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The low bits of every minimum, two to a byte, filled up to whole 64-bit words."""
    low = ((least >> np.uint64(24)) & np.uint64(15)).astype(np.uint8)
    packed = low[0::2] | (low[1::2] << 4)
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys + column)
    return keys.view(np.int64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a packed signature (uint64 words) to each of many."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & _NIBBLES).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        rows = []
        for text in batch.column(2):
            own = shingles(text.as_py(), words)
            a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
            least = minima(own) if len(own) else None
            rows.append((len(own), a, b, band_keys(least) if len(own) else [], signature(least) if len(own) else b""))
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_SIGNED)[2:], strict=True))], schema=_SIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("rid"), F.col("text").cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n_shingles, set_a, set_b, bands, sig) of each row; rid is a hash of the text."""
    return _texts(docs).mapInArrow(_sign, "doc_id long, rid long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        own = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), own], names=["doc_id", "rid", "own"])


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, a_rid, b, b_rid, a_sig, b_sig) -> the pairs that may reach the limit, with their estimate."""
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
                e = estimates(one, two)
                batch = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(e)], names=["a", "a_rid", "b", "b_rid", "e"]).filter(pa.array(e >= least))
                yield batch

    return run


def _linked(one: np.ndarray, two: np.ndarray, limit_percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= limit_percent * (len(one) + len(two) - both)


def _confirmed(limit_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, a_own, b_own) -> (a, b) of the pairs at or above the limit."""
        for batch in batches:
            sets = zip(*[[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)], strict=True)
            good = pa.array([_linked(x, y, limit_percent) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(good)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that follow one another with equal first columns."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _near(group: pa.Table, limit_percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a group, for each member the later ones of other components that may reach the limit, the most similar first, and the estimates.

    Sorted by the size of the set, so that those of fitting sizes follow one another.
    """
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint64).reshape(group.num_rows, -1)
    component, large, sizes = (group.column(n).to_numpy() for n in ("component", "large", "n_shingles"))
    across = group.column("two")[0].as_py() < 0
    order = np.argsort(sizes, kind="stable")
    last = np.searchsorted(sizes[order], 100 * sizes[order] // limit_percent, side="right")
    for k, i in enumerate(order.tolist()):
        rest = order[k + 1 : last[k]]
        fits = component[rest] != component[i]
        if across:
            fits &= large[rest] != large[i]
        rest = rest[fits]
        if len(rest):
            e = estimates(sigs[i], sigs[rest])
            close = np.flatnonzero(e >= limit_percent / 100 - MARGIN)
            if len(close):
                close = close[np.argsort(-e[close], kind="stable")]
                yield i, rest[close], e[close]


def _flagging(limit_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, one, two, doc_id, rid, ...), sorted by the first three -> (key, doc_id, rid) of the members with a pair that may reach the limit."""
        for group in _groups(batches, 3):
            flagged = np.zeros(group.num_rows, bool)
            for i, rest, _ in _near(group, limit_percent):
                flagged[i] = True
                flagged[rest] = True
            for batch in group.select(["key", "doc_id", "rid"]).filter(pa.array(flagged)).to_batches():
                yield batch

    return run


def _joining(limit_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, one, two, doc_id, ..., own), sorted by the first three -> links (a, b) that join components of a group."""
        for group in _groups(batches, 3):
            ids, component = group.column("doc_id").to_pylist(), group.column("component").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
            parent = {c: c for c in component}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            found = []
            for i, rest, _ in _near(group, limit_percent):
                for j in rest.tolist():
                    a, b = root(component[i]), root(component[j])
                    if a != b and _linked(sets[i], sets[j], limit_percent):
                        parent[a] = b
                        found.append((ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _dealt(left: DataFrame, weight: Column, block: int) -> DataFrame:
    """(key, doc_id, rid, n_shingles, sig, component) with the groups (one, two) in which members of a bucket meet.

    Blocks have about `block` of the weight. The largest component of a bucket is in one group for each block of the
    others, and those are in one for each of its blocks and for each pair of their own.
    """
    parts = left.groupBy("key", "component").agg(F.sum(weight).alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    parts = parts.select("key", F.col("top.component").alias("top"), blocks(F.col("top.n")).alias("n_large"), blocks(F.col("n") - F.col("top.n")).alias("n_small"))
    at = left.join(parts, "key").withColumn("large", F.col("component") == F.col("top"))
    at = at.withColumn("block", F.pmod(F.xxhash64("doc_id", "rid"), F.when(F.col("large"), F.col("n_large")).otherwise(F.col("n_small"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda one, two: F.struct(one.alias("one"), two.alias("two"))
    of_large = F.transform(numbers("n_small"), lambda j: group(F.col("block"), -1 - j))
    of_small = F.concat(F.transform(numbers("n_large"), lambda i: group(i, -1 - F.col("block"))), F.transform(numbers("n_small"), lambda j: group(F.least("block", j), F.greatest("block", j))))
    return at.select("key", "doc_id", "rid", "n_shingles", "sig", "component", "large", F.explode(F.when(F.col("large"), of_large).otherwise(of_small)).alias("g")).select("key", "g.one", "g.two", "doc_id", "rid", "n_shingles", "sig", "component", "large")


def _merged(flagged: DataFrame) -> DataFrame:
    """(key, doc_id, rid) with buckets of the same few documents made one, so that a member is not sent once for each bucket.

    The name of a bucket becomes the first document that any of its members has met in some bucket; members of a bucket
    keep together under its new name.
    """
    node = ["doc_id", "rid"]
    first = flagged.groupBy("key").agg(F.min(F.struct(*node)).alias("first"))
    met = flagged.join(first, "key").groupBy(*node).agg(F.min("first").alias("met"))
    named = flagged.join(met, node).groupBy("key").agg(F.min("met").alias("name"))
    return flagged.join(named, "key").select(F.xxhash64("name").alias("key"), *node).distinct()


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "doc_id", "rid")


def near_duplicates(docs: DataFrame, limit_percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    component_id: the smallest doc_id that is reachable over links of similarity limit_percent / 100 or more. Null and
    empty texts have no shingles and are linked with nothing; so are rows without a doc_id, whose component is null and
    which are kept. Rows that share a doc_id are one document: n_shingles is of the row's own text, a link of one of the
    texts is a link of the document, and all its rows are kept or none. Other columns are not looked at.
    """
    whole, node = ["n_shingles", "set_a", "set_b"], ["doc_id", "rid"]
    signed = stored(signatures(docs), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(real.groupBy(*whole).agg(F.min(F.struct(*node)).alias("rep")).select(*whole, F.col("rep.doc_id").alias("rep"), F.col("rep.rid").alias("rep_rid")), "classes")
    known = stored(signed.drop("bands", "sig").join(classes, whole, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "known")
    heads = classes.select(F.col("rep").alias("doc_id"), F.col("rep_rid").alias("rid"))
    reps = stored(real.join(heads, node).dropDuplicates(node).select(*node, "n_shingles", "bands", "sig"), "representatives")
    discard(signed)
    # Members of band buckets, and the first of each bucket.
    banded = reps.select(*node, F.explode("bands").alias("key"))
    met = banded.groupBy("key").agg(F.min(F.struct(*node)).alias("lo"), F.max(F.struct(*node)).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "lo", "n")
    members = stored(banded.join(stored(met, "buckets"), "key"), "members")
    stars = members.where(F.struct(*node) != F.col("lo")).select(F.col("doc_id").alias("a"), F.col("rid").alias("a_rid"), F.col("lo.doc_id").alias("b"), F.col("lo.rid").alias("b_rid")).distinct()
    sigs = lambda end: reps.select(F.col("doc_id").alias(end), F.col("rid").alias(f"{end}_rid"), F.col("sig").alias(f"{end}_sig"))
    ends = ["a", "a_rid", "b", "b_rid"]
    signed_pairs = stars.join(sigs("a"), ["a", "a_rid"]).join(sigs("b"), ["b", "b_rid"]).select(*ends, "a_sig", "b_sig")
    near = stored(signed_pairs.mapInArrow(_estimated(limit_percent / 100 - MARGIN), "a long, a_rid long, b long, b_rid long, e double"), "near")
    texts = _texts(docs)

    def sets_of(nodes: DataFrame) -> DataFrame:
        # The nodes grow with the corpus, so they are never broadcast, and texts are dealt alike at every size.
        return stored(texts.join(nodes.distinct().hint("merge"), node).dropDuplicates(node).mapInArrow(_sets, "doc_id long, rid long, own binary"), "sets")

    # Repeated rows of one text are one node, so dropDuplicates on nodes leaves one text for each.
    of = lambda end: near.select(F.col(end).alias("doc_id"), F.col(f"{end}_rid").alias("rid"))
    sets = sets_of(of("a").union(of("b")))
    own = lambda end: sets.select(F.col("doc_id").alias(end), F.col("rid").alias(f"{end}_rid"), F.col("own").alias(f"{end}_own"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.select(*ends).join(own("a"), ["a", "a_rid"]).join(own("b"), ["b", "b_rid"]).select("a", "b", "a_own", "b_own")
        return stored(both.mapInArrow(_confirmed(limit_percent), "a long, b long"), "links")

    def roots(links: DataFrame) -> DataFrame:
        return stored(components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root")), "roots")

    # Documents of several texts join the classes of these.
    joined = known.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    links = stored(known.join(joined, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")
    best = near.groupBy("a", "a_rid").agg(F.max_by(F.struct("b", "b_rid"), F.struct(F.col("e"), -F.col("b"), "b_rid")).alias("x")).select("a", "a_rid", "x.b", "x.b_rid")
    links = links.union(confirmed(best))
    found = roots(links)
    rooted = lambda df, column, name: df.join(found.withColumnRenamed("_root", name), F.col(column) == F.col("_node"), "left").drop("_node").withColumn(name, F.coalesce(name, F.col(column)))
    apart = stored(rooted(rooted(near, "a", "ra"), "b", "rb").where("ra <> rb"), "apart")
    if not apart.isEmpty():
        links = links.union(confirmed(apart))
        found = roots(links)
    # Buckets of three or more that still hold several components.
    tagged = rooted(members.where("n > 2").select("key", *node), "doc_id", "component")
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    left = stored(tagged.join(mixed, "key").join(reps.select(*node, "n_shingles", "sig"), node), "mixed")
    discard(members, near, sets, apart)
    if not left.isEmpty():
        flagged = _gathered(_dealt(left, F.lit(1), BLOCK_MEMBERS)).mapInArrow(_flagging(limit_percent), "key long, doc_id long, rid long")
        flagged = stored(flagged.distinct(), "flagged")
        sets = sets_of(flagged.select(*node))
        of_nodes = left.dropDuplicates(node).select(*node, "n_shingles", "sig", "component")
        full = _dealt(_merged(flagged).join(of_nodes, node), F.col("n_shingles"), BLOCK_SHINGLES).join(sets, node).select("key", "one", "two", *node, "n_shingles", "sig", "component", "large", "own")
        links = links.union(stored(_gathered(full).mapInArrow(_joining(limit_percent), "a long, b long"), "links"))
        found = roots(links)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "rep", "doc_id"))
    named = known.join(found, F.col("rep") == F.col("_node"), "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
