"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint sums up the hashes of its word shingles, bit by bit.
Documents are linked when their fingerprints differ in few bits, and the
components of these links are the groups.

Finding the links. Equal fingerprints collapse first, so exact copies cost one
entry. The 64 bits are cut into BLOCKS blocks; two fingerprints within RADIUS
bits agree in at least BLOCKS - RADIUS of them, so they share a bucket in at
least one of the tables that are keyed by so many blocks. This misses no pair.
Within a bucket, fingerprints are stored as bit planes (plane j holds bit j of
64 fingerprints in a word). XOR with another plane, or with one bit spread over
a word, gives a difference bit for 64 pairs at once; carry-save adders sum the
planes into counters that are themselves bit-sliced, and a block of pairs is
abandoned once every pair in it exceeds the radius.

A bucket need not give all its pairs, only links that connect what its pairs
connect. In a large bucket a search in breadth takes each fingerprint out of
the comparison as soon as it's reached, which yields a spanning forest. A
bucket above CHUNK entries is dealt out as pairs of chunks to separate tasks.

Defined results: a null text counts as empty; no words give fingerprint zero,
linked like any other; rows that share an id are rows of their own; a null id
is never a component's id unless no other is there; an empty table gives an
empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, map_batches, plain_names, saved, small_batches
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS = 6
#: Entries of a bucket that one task compares with as many others.
CHUNK = 8192
#: Up to this size a bucket's neighbours are compared by shifting planes, all buckets of a batch at once.
SMALL = 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The SimHash of one text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *keep): fp holds the 64 bits as a signed long."""
    small_batches(documents.sparkSession)
    carried = documents.select("doc_id", *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields] + ["fp long"])
    names = [*carried.columns, "fp"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t) for t in batch.column(len(names) - 1).to_pylist()), np.uint64, batch.num_rows)
        return pa.record_batch([*batch.columns[: len(names) - 1], _signed(found)], names)

    return map_batches(documents.select("doc_id", *keep, F.col("text").alias("whole_text")), run, schema)


# ---- bit-sliced comparison


def planes(values: np.ndarray) -> np.ndarray:
    """uint64[64, ceil(n / 64)]: word w of plane j holds bit j of values[64 w:64 w + 64]."""
    width = -(-len(values) // 64) * 64
    padded = np.zeros(width, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # [n, 64]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """bool[..., n] of words in the layout of planes()."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1)[..., :n].astype(bool)


def packed(flags: np.ndarray) -> np.ndarray:
    """The inverse of lanes(), padded with false."""
    width = -(-flags.shape[-1] // 64) * 64
    padded = np.zeros((*flags.shape[:-1], width), np.uint8)
    padded[..., : flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1).view(np.uint64)


def within(differences: Iterator[np.ndarray], alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words whose bits say which of the alive lanes differ in at most radius planes.

    differences yields one array of difference bits for each plane. Counters of
    weight 1, 2 and 4 are bit-sliced; each step adds two planes with carry-save
    adders; a count of 8 or more stays in over.
    """
    if not 0 <= radius < 8:
        raise ValueError("the counters hold radii below 8")
    one, two, four, over = (np.zeros_like(alive) for _ in range(4))
    far = np.zeros_like(alive)
    step = 0
    for first in differences:
        second = next(differences, None)
        if second is None:
            second = np.zeros_like(alive)
        half = first ^ second
        carry = (first & second) | (one & half)
        one = one ^ half
        carry_two = two & carry
        two = two ^ carry
        over |= four & carry_two
        four = four ^ carry_two
        step += 1
        if step % 4 == 0:
            far = over | _above(one, two, four, radius)
            if not (alive & ~far).any():
                return np.zeros_like(alive)
    return alive & ~(over | _above(one, two, four, radius))


def _above(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count exceeds radius."""
    greater, equal = np.zeros_like(one), np.full_like(one, ONES)
    for bit, counter in ((4, four), (2, two), (1, one)):
        if radius & bit:
            equal &= counter
        else:
            greater |= equal & counter
            equal &= ~counter
    return greater


def spanning_links(values: np.ndarray, radius: int = RADIUS, rows: int = 64) -> list[tuple[int, int]]:
    """Links (indices) that connect what all pairs within radius connect: a search in breadth over one bucket."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(values))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:rows], frontier[rows:]
            stored = planes(values[left])
            spread = np.where((values[now][:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1), ONES, np.uint64(0))
            alive = np.broadcast_to(packed(np.ones(len(left), bool)), (len(now), stored.shape[1])).copy()
            hit = lanes(within((stored[j][None, :] ^ spread[:, j][:, None] for j in range(64)), alive, radius), len(left))
            reached = hit.any(axis=0)
            if reached.any():
                parents = now[hit[:, reached].argmax(axis=0)]
                links += zip(parents.tolist(), left[reached].tolist())
                frontier, left = np.concatenate([frontier, left[reached]]), left[~reached]
    return links


def bucket_links(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between the values of each bucket values[starts[i]:starts[i + 1]]."""
    sizes = np.diff(starts)
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    room = np.repeat(starts[1:], sizes) - np.arange(len(values))  # entries from here to the bucket's end
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        at = np.flatnonzero(small & (room > shift))
        if len(at):
            here, there = planes(values[at]), planes(values[at + shift])
            hit = lanes(within((here[j] ^ there[j] for j in range(64)), packed(np.ones(len(at), bool)), radius), len(at))
            a.append(values[at[hit]])
            b.append(values[at[hit] + shift])
    for i in np.flatnonzero(sizes > SMALL):
        bucket = values[starts[i] : starts[i + 1]]
        if links := spanning_links(bucket, radius):
            pairs = np.array(links)
            a.append(bucket[pairs[:, 0]])
            b.append(bucket[pairs[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2


# ---- the join


def tables(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks: each leaves the bits of blocks - radius blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed_mask(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def further(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits that a mask leaves out, in radius + 1 parts: two fingerprints within radius agree in one of these at least."""
    rest = [i for i in range(64) if not mask >> i & 1]
    edges = [round(i * len(rest) / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << i for i in rest[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK, scope: str = "session") -> DataFrame:
    """(a, b): links between distinct fingerprints that connect what all pairs within radius connect. prints: distinct fp."""
    masks = tables(blocks, radius)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed_mask(m))).alias("part")) for i, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("fp", "k.t", F.xxhash64("k.t", "k.part").alias("key"))

    def counted(entries: DataFrame) -> DataFrame:
        # written, so that the join shuffles both sides and a crowded bucket can be split
        return entries.join(saved(entries.groupBy("key").count().filter(F.col("count") > 1), scope), "key")

    entries = counted(keyed)
    # a bucket above chunk is keyed once more, by a part of the bits that its table leaves out
    parts = F.element_at(F.array(*[F.array(*[F.lit(_signed_mask(x)) for x in further(m, radius)]) for m in masks]), F.col("t") + 1)
    finer = entries.filter(F.col("count") > chunk).select("fp", "key", F.posexplode(parts).alias("s", "mask"))
    finer = counted(finer.select("fp", F.xxhash64("key", "s", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")))
    entries = entries.filter(F.col("count") <= chunk).select("fp", "key", "count").union(finer.select("fp", "key", "count"))
    # one that is still above it is dealt out as pairs (x, y), x <= y, of its chunks
    n = F.ceil(F.col("count") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), n).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(o, own) * n + F.greatest(o, own))
    dealt = entries.select("fp", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(cells)).alias("cell"), "key")
    dealt = dealt.select("fp", F.xxhash64("key", "cell").alias("key"))
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            a, b = bucket_links(prints.view(np.uint64), starts, radius)
            pairs = np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))], 1), axis=0)
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_key, batch.column(1).to_numpy()])
            prints = np.concatenate([rest_fp, batch.column(0).to_numpy()])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on in the next batch
            rest_key, rest_fp = keys[whole:], prints[whole:]
            if whole:
                yield found(keys[:whole], prints[:whole])
        if len(rest_key) > 1:
            yield found(rest_key, rest_fp)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def groups(prints: DataFrame, scope: str = "session") -> DataFrame:
    """The rows of prints (doc_id, fp, ...) with root, the least fingerprint of their component, and component_id, its least doc_id."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(first.select("fp"), scope=scope), scope)
    linked = saved(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), scope)
    least = saved(linked.groupBy("root").agg(F.min("first_doc").alias("component_id")), scope)
    named = linked.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def near_duplicates(documents: DataFrame, scope: str = "session") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of its group."""
    prints = saved(fingerprints(documents), scope)
    return groups(prints, scope).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, scope: str = "session", bloom_bits: int = Bloom.MOST) -> DataFrame:
    """The rows of documents without near duplicates: of each group the one with the least doc_id (null last, then by a hash of the text)."""
    prints = saved(fingerprints(documents.select("doc_id", "text", F.xxhash64("text").alias("row_hash")), ("row_hash",)), scope)
    return first_of_groups(documents, groups(prints, scope), scope, bloom_bits)


def first_of_groups(documents: DataFrame, grouped: DataFrame, scope: str = "session", bloom_bits: int = Bloom.MOST) -> DataFrame:
    """The first row of each group, from (doc_id, row_hash, root) of all rows; row_hash is xxhash64 of the text.

    Rows that go, and rows found more than once, are few; a Bloom filter finds
    most others, which stay without a join. The rest join exactly.
    """
    grouped = saved(grouped.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")), scope)
    # by root: groups that share an id may have the same component_id
    # written, so that the join that follows shuffles both sides and a root with very many rows can be split
    first = saved(grouped.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1"), scope)
    crowded = grouped.join(first, "root").select("doc_id", "row_hash", (F.col("rank") == F.col("first")).alias("stays"))
    crowded = saved(crowded.distinct(), scope)
    bloom = Bloom(crowded.select(F.xxhash64("doc_id", "row_hash").alias("place")), "place", bloom_bits)

    columns = documents.columns
    documents = plain_names(documents)
    doc_id, text = (documents.columns[columns.index(c)] for c in ("doc_id", "text"))
    place = F.xxhash64(doc_id, F.xxhash64(text))
    plain = bloom.rows(documents, place, False)
    looked_up = bloom.rows(documents, place, True)
    c = crowded.select(F.col("doc_id").alias("crowded_id"), F.col("row_hash").alias("crowded_row"), "stays")
    same = F.col(doc_id).eqNullSafe(F.col("crowded_id")) & (F.xxhash64(text) == F.col("crowded_row"))
    kept = looked_up.join(c, same, "left").filter(F.coalesce("stays", F.lit(True)))
    once = kept.filter("stays").dropDuplicates(["crowded_id", "crowded_row"])
    return plain.union(kept.filter("stays IS NULL").select(*documents.columns)).union(once.select(*documents.columns)).toDF(*columns)
