"""SimHash near-dedup, checked by the Jaccard similarity of word shingles: 0.8 or more of sets of five words.

1. Candidates by SimHash. A text's fingerprint sums up its set of shingle
   hashes, bit by bit; fingerprints within simhash.RADIUS bits are found by
   simhash.links(), block tables compared bit-sliced, and are candidates.
   Near 0.8 most pairs lie further apart than any radius that can be searched.
   For these, a text's set of shingle hashes gets BANDS MinHash keys of ROWS
   values each; texts that share a key are candidates. A pair at similarity 0.8
   shares none with a chance of (1 - 0.8^5)^25, 5 in 100,000; closer pairs less.
   Equal sets collapse first.
2. Components of the candidates, so that each set is read and sent once, not
   once for each key. A component above CHUNK sets is dealt out as pairs of
   chunks to separate tasks.
3. Links. Within a component (or a pair of its chunks) the similarity of sets is
   exact, and a search in breadth takes each set out of the comparison as soon
   as it's reached. The components of these links are the groups.

Defined results: as in simhash.py; texts without words are equal, texts under
SHINGLE words have one shingle, the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Bloom, Words, mix, rolling, saved, slices, small_batches
from .components import components
from .simhash import first_of_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Sets of a component that one task compares with as many others.
CHUNK = 2000
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    words = Words(texts, lower=True)
    values = mix(words.hashes())[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    runs = rolling(values, k)
    out = []
    for lo, hi in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        out.append(np.unique(runs[lo : hi - k + 1]) if hi - lo >= k else rolling(values[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> np.uint64:
    return mix(np.array([len(shingles)], np.uint64) + mix(shingles).sum(dtype=np.uint64))[0]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        part = _FACTORS[:, None] * shingles[None, at : at + 512] + _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys + row)
    return keys


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """The SimHash of a set: a bit is 1 if it's set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        total += np.unpackbits(shingles[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles)).view(">u8").astype(np.uint64)[0]


def fingerprint_links(distinct: DataFrame, scope: str = "session") -> DataFrame:
    """(a, b): links between sets (set_id, fp) that connect what fingerprints within the radius connect."""
    first = saved(distinct.groupBy("fp").agg(F.min("set_id").alias("first"), F.count("*").alias("n")), scope)
    # written above, so that the join shuffles both sides and a crowded fingerprint can be split
    equal = distinct.join(first.filter("n > 1"), "fp").filter("set_id <> first").select(F.col("set_id").alias("a"), F.col("first").alias("b"))
    found = simhash.links(first.select("fp"), scope=scope)
    named = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"set_{end}"))
    near = found.join(named("a"), "a").join(named("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return equal.union(near)


def spanning_links(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (indices) that connect what all pairs of at least this similarity connect."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingles = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    left, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        frontier, left[root] = [root] if left[root] else [], False
        while frontier and left.any():
            now = frontier.pop()
            lo, hi = np.searchsorted(shingles, sets[now], "left"), np.searchsorted(shingles, sets[now], "right")
            spread = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum()) if len(lo) else lo
            both = np.bincount(owner[spread], minlength=len(sets))
            near = np.flatnonzero(left & (both > 0) & (both >= least * (sizes + sizes[now] - both) - 1e-9))
            links += [(now, i) for i in near.tolist()]
            left[near] = False
            frontier += near.tolist()
    return links


def links(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between sets (set_id, shingles, root, n), n being how many sets the component root has."""
    n = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), n).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(o, own) * n + F.greatest(o, own))
    dealt = members.select("set_id", "shingles", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(cells)).alias("cell"), "root")
    dealt = dealt.select("set_id", "shingles", F.xxhash64("root", "cell").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def found() -> pa.RecordBatch:
            pairs = [(ids[i], ids[j]) for i, j in spanning_links(sets)]
            return pa.record_batch([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            shingles = batch.column(1)
            for at, (i, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if k != key:
                    if len(ids) > 1:
                        yield found()
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(shingles[at].values.to_numpy().view(np.uint64).copy())
        if len(ids) > 1:
            yield found()

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups(documents: DataFrame, scope: str = "session", chunk: int = CHUNK, bloom_bits: int = Bloom.MOST) -> DataFrame:
    """(doc_id, row_hash, root): rows of one group have one root. row_hash: xxhash64 of the text."""
    small_batches(documents.sparkSession)
    source = documents.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").alias("whole_text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(part.column(2))
                ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                keys = [band_keys(s).view(np.int64) if len(s) else [] for s in sets]
                prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(ids), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_hash", "set_id", "fp", "keys"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(part.column(2))
                ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(ids), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "shingles"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = saved(source.mapInArrow(keyed, f"doc_id {id_type}, row_hash long, set_id long, fp long, keys array<long>"), scope)
    place = F.xxhash64("doc_id", "row_hash")
    distinct = rows.groupBy("set_id").agg(F.min_by("keys", place).alias("keys"), F.min("fp").alias("fp"), F.min(place).alias("place"))
    distinct = saved(distinct, scope)
    entries = distinct.select("set_id", F.explode("keys").alias("key"))
    # tables that a crowded key joins are written, so that both sides are shuffled and it can be split
    crowded = saved(entries.groupBy("key").agg(F.min("set_id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b"), scope)
    close = fingerprint_links(distinct.select("set_id", "fp"), scope)
    candidates = saved(components(close.union(entries.join(crowded, "key").select(F.col("set_id").alias("a"), "b")), scope), scope)
    sizes = saved(candidates.groupBy("root").agg(F.count("*").alias("n")), scope)
    members = candidates.join(sizes, "root").join(distinct.select(F.col("set_id").alias("node"), "place"), "node")
    members = saved(members.select(F.col("node").alias("set_id"), "root", "n", "place"), scope)
    # the texts are read again, one of each set
    bloom = Bloom(members, "place", bloom_bits)
    read = bloom.rows(source, place, True)
    read = read.withColumn("place", place).join(members.select("place"), "place", "left_semi").dropDuplicates(["place"])
    read = read.select("doc_id", "row_hash", "whole_text").mapInArrow(spelt, "set_id long, shingles array<long>")
    roots = components(links(read.join(members.drop("place"), "set_id"), chunk), scope).withColumnRenamed("node", "set_id")
    return rows.select("doc_id", "row_hash", "set_id").join(roots, "set_id", "left").select("doc_id", "row_hash", F.coalesce("root", "set_id").alias("root"))


def keep_first(documents: DataFrame, scope: str = "session", chunk: int = CHUNK, bloom_bits: int = Bloom.MOST) -> DataFrame:
    """The rows of documents without near duplicates: of each group the one with the least doc_id (null last, then by a hash of the text)."""
    return first_of_groups(documents, groups(documents, scope, chunk, bloom_bits), scope, bloom_bits)
