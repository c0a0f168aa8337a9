"""Substring dedup by De Bruijn compaction.

The edges of the graph are token k-mers of WINDOW words; consecutive windows of
a document are consecutive edges, so a document is a path. A window is a
repeat when its words also start a window in a document with a smaller id, and
every word that a repeat covers is removed.

1. Partition. Every window is owned by its minimiser, the k-mer of ANCHOR words
   with the least hash in it (the leftmost of equals): a function of its words
   alone, so equal windows have equal owners. The windows of a document with
   one owner are consecutive and form a path, which is one row: the owner, a
   hash of all the path's words, the place. That is about one row for 18 words.
   An owner all of whose rows are of one document has no repeats and goes.
2. Compaction through joins. Equal paths are one, with the least place that
   has it as its source. An owner with one path doesn't branch: each of its
   windows has that source.
3. Branches. Where paths differ but share an owner, the windows of each
   distinct path are read at its source coordinates, and each window gets the
   least place among the paths that hold it. Windows of a path whose sources
   follow each other become one run again. The documents with such sources are
   read again, and their texts go through a join for it.
4. Spans. Occurrences join their paths; runs whose source is smaller than the
   document are repeats. Consecutive runs of a document with consecutive
   sources, that don't branch between them, compact into one span, however long:
   where it is, and the source's coordinates.
5. Verification. The words at each span's source coordinates are read and
   hashed by SHA-256, and words of a document go only where those at the span
   have the same digest.

Steps 1 to 4 take two 64-bit hashes together for equality, those of an owner and of the
whole path (or window), so two different stretches would meet with a chance of
about 2^-100 a pair; the words of such would stay.

Tables that are joined on a key with very many rows are written first, so that
the join shuffles both sides and a hot key can be split.

Defined results: a null text has no words; documents under WINDOW words lose
none; very long texts are worked through as they are; rows that share an id
never repeat each other, as neither id is smaller; rows without an id lose
nothing and are nobody's source; an empty table gives an empty table. Other
columns are ignored by deduplicate() unless asked for, and kept by
without_repeats(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, PrefixHash, Words, mix, plain_names, release, saved, slices, small_batches

WINDOW, ANCHOR = 50, 16
#: Bits of a filter at the most, as a power of two.
BLOOM_BITS = Bloom.MOST


class Paths:
    """The paths of a batch of texts; see the module's docstring, step 1."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR):
        words = Words(texts)
        values = mix(words.hashes())[words.codes] if len(words.codes) else np.empty(0, np.uint64)
        n = len(values)
        self.prefix, self.window = PrefixHash(values), window
        docs = words.doc_of_word()
        if n < window:
            at = owner = np.empty(0, np.int64)
        else:
            grams = n - anchor + 1
            starts = np.arange(grams)
            hashes = self.prefix.of(starts, starts + anchor)
            # the place of the least hash among span k-mers, by doubling
            span, width, least = window - anchor + 1, 1, starts
            while width * 2 <= span:
                a, b = least[:-width], least[width:]
                least = np.where(hashes[a] <= hashes[b], a, b)
                width *= 2
            if width < span:
                a, b = least[: n - window + 1], least[span - width : span - width + n - window + 1]
                least = np.where(hashes[a] <= hashes[b], a, b)
            at = np.flatnonzero(docs[: n - window + 1] == docs[window - 1 :])
            owner = least[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(owner) != 0) | (np.diff(at) != 1)
        first = np.flatnonzero(fresh)
        self.count = np.diff(np.append(first, len(at)))
        self.at = at[first]  # in the batch's words
        self.doc = docs[self.at] if len(at) else np.empty(0, np.int64)
        self.start = self.at - words.starts[self.doc]
        shift = owner[first] - self.at
        self.owner = hashes[owner[first]] if len(at) else np.empty(0, np.uint64)
        self.body = mix(self.prefix.of(self.at, self.at + self.count + window - 1) ^ (shift.astype(np.uint64) << np.uint64(32)) ^ self.count.astype(np.uint64))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of the chosen paths, and the offsets of each path's."""
        offsets = np.concatenate([[0], np.cumsum(self.count[chosen])])
        at = np.repeat(self.at[chosen] - offsets[:-1], self.count[chosen]) + np.arange(offsets[-1])
        return self.prefix.of(at, at + self.window), offsets


def _known(documents: DataFrame) -> DataFrame:
    """(doc_id, whole_text, row) of rows with an id; row is a hash of the text, for ids that are not unique."""
    return documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("whole_text"), F.xxhash64("text").alias("row"))


def _paths(documents: DataFrame) -> DataFrame:
    """All paths."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                p = Paths(part.column(1))
                signed = lambda x: pa.array(x.view(np.int64))
                if len(p.doc):
                    yield pa.record_batch([signed(p.owner), signed(p.body), pa.array(part.column(0).to_numpy()[p.doc]), pa.array(part.column(2).to_numpy()[p.doc]), pa.array(p.start.astype(np.int32)), pa.array(p.count.astype(np.int32))], ["owner", "body", "doc_id", "row", "start", "count"])

    return _known(documents).mapInArrow(run, "owner long, body long, doc_id long, row long, start int, count int")


def _read_at(documents: DataFrame, wanted: DataFrame, read, schema: str, scope: str, bloom_bits: int) -> DataFrame:
    """read() of the documents in wanted (doc_id, row, asked): a function of batches (doc_id, whole_text, row, asked).

    A filter keeps most other texts from being shuffled; the join is exact.
    """
    wanted = saved(wanted, scope)
    place = F.xxhash64("doc_id", "row")
    found = Bloom(wanted.select(place.alias("place")), "place", bloom_bits).rows(_known(documents), place, True)
    return found.join(wanted, ["doc_id", "row"]).select("doc_id", "whole_text", "row", "asked").mapInArrow(read, schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the paths that start where asked."""
    for batch in batches:
        for part in slices(batch, 1):
            p = Paths(part.column(1))
            asked = part.column(3)
            of = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
            chosen = np.flatnonzero(np.isin((p.doc << 32) | p.start, (of << 32) | asked.flatten().to_numpy().astype(np.int64)))
            if len(chosen):
                values, offsets = p.windows(chosen)
                signed = lambda x: pa.array(x[chosen].view(np.int64))
                edges = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.record_batch([signed(p.owner), signed(p.body), pa.array(part.column(0).to_numpy()[p.doc[chosen]]), pa.array(part.column(2).to_numpy()[p.doc[chosen]]), pa.array(p.start[chosen].astype(np.int32)), edges], ["owner", "body", "doc_id", "row", "start", "windows"])


def _digest(words: list[bytes], start: int, n: int, window: int = WINDOW) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + n + window - 1])).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words of the spans asked for."""
    for batch in batches:
        for part in slices(batch, 1):
            out = []
            for doc, text, row, asked in zip(*(c.to_pylist() for c in part.columns)):
                words = (text or "").encode("utf-8").split()
                out += [(doc, row, a["start"], a["n"], _digest(words, a["start"], a["n"])) for a in asked]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["from_doc", "from_row", "from_start", "n", "digest"])


def repeats(documents: DataFrame, scope: str = "session", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(doc_id, row, start, n, from_doc, from_row, from_start, digest): n consecutive windows from word start on are repeats.

    Their words are those at the source coordinates from_doc, from_row and from_start,
    and digest is the SHA-256 of what stands there. Tables that only a step reads are deleted after it.
    """
    step = {name: f"{scope}-substrings-{name}" for name in ("sketch", "owned", "merged", "branches", "edges", "lows", "digests")}
    done = lambda name: release(documents.sparkSession, step[name])
    sketch = saved(_paths(documents), step["sketch"])
    owners = sketch.groupBy("owner").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    owners = saved(owners.select("owner"), step["sketch"])
    # most owners are of one document: a filter keeps their rows from being shuffled once more
    some = Bloom(owners, "owner", bloom_bits).rows(sketch, F.col("owner"), True)
    owned = saved(some.join(owners, "owner"), step["owned"])
    done("sketch")
    branches = saved(owned.groupBy("owner").agg((F.min("body") < F.max("body")).alias("branches")), step["merged"])
    paths = saved(owned.groupBy("owner", "body").agg(F.min(F.struct("doc_id", "start", "row")).alias("source")), step["merged"])
    paths = saved(paths.join(branches, "owner"), step["branches"])
    done("merged")

    branching = paths.filter("branches").groupBy("source.doc_id", "source.row").agg(F.collect_set("source.start").alias("asked"))
    read = _read_at(documents, branching, _windows, "owner long, body long, doc_id long, row long, start int, windows array<long>", step["edges"], bloom_bits)
    edges = saved(read.dropDuplicates(["owner", "body"]).select("owner", "body", "doc_id", "row", "start", F.posexplode("windows").alias("i", "edge")), step["edges"])
    place = F.struct("doc_id", (F.col("start") + F.col("i")).alias("start"), "row")
    least = saved(edges.groupBy("owner", "edge").agg(F.min(place).alias("lo"), F.count("*").alias("n")).filter("n > 1").select("owner", "edge", "lo"), step["edges"])
    # a window found on one path only has that path's own source
    lows = saved(edges.join(least, ["owner", "edge"], "left").select("owner", "body", "i", F.coalesce("lo", place).alias("lo")), step["lows"])
    done("edges")
    lows = lows.groupBy("owner", "body").agg(F.sort_array(F.collect_list(F.struct("i", "lo"))).alias("lows"))
    low = lambda i: F.get("lows", i)["lo"]
    breaks = lambda i: (i == 0) | (low(i)["doc_id"] != low(i - 1)["doc_id"]) | (low(i)["row"] != low(i - 1)["row"]) | (low(i)["start"] != low(i - 1)["start"] + 1)
    heads = lows.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("lows") - 1), breaks))
    upto = lambda k: F.coalesce(F.get("heads", k + 1), F.size("lows"))
    runs = F.transform("heads", lambda i, k: F.struct(i.alias("i"), (upto(k) - i).alias("n"), low(i).alias("lo")))
    straight = paths.filter("NOT branches").select("owner", "body", F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("n"), "source")).cast("array<struct<i: int, n: int, lo: struct<doc_id: bigint, start: int, row: bigint>>>").alias("runs"))
    sources = saved(straight.union(heads.select("owner", "body", runs.alias("runs"))), step["owned"])
    done("branches")
    done("lows")

    found = owned.join(sources, ["owner", "body"]).select("doc_id", "row", "start", "count", F.explode("runs").alias("run")).filter("run.lo.doc_id < doc_id")
    found = found.select("doc_id", "row", (F.col("start") + F.col("run.i")).alias("start"), F.coalesce("run.n", "count").alias("n"), F.col("run.lo.doc_id").alias("from_doc"), F.col("run.lo.row").alias("from_row"), F.col("run.lo.start").alias("from_start")).distinct()
    # consecutive runs on one diagonal compact
    diagonal = Window.partitionBy("doc_id", "row", "from_doc", "from_row", "diagonal").orderBy("start")
    before = F.lag(F.col("start") + F.col("n")).over(diagonal)
    marked = found.withColumn("diagonal", F.col("from_start") - F.col("start")).withColumn("opens", F.coalesce((before < F.col("start")).cast("int"), F.lit(1)))
    numbered = marked.withColumn("span", F.sum("opens").over(diagonal))
    spans = numbered.groupBy("doc_id", "row", "from_doc", "from_row", "diagonal", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("from_start").alias("from_start"))
    spans = saved(spans.select("doc_id", "row", "start", (F.col("end") - F.col("start")).alias("n"), "from_doc", "from_row", "from_start"), scope)
    done("owned")

    asked = spans.groupBy(F.col("from_doc").alias("doc_id"), F.col("from_row").alias("row")).agg(F.collect_set(F.struct(F.col("from_start").alias("start"), "n")).alias("asked"))
    digests = saved(_read_at(documents, asked, _digests, "from_doc long, from_row long, from_start int, n int, digest binary", step["digests"], bloom_bits).distinct(), scope)
    done("digests")
    return spans.join(digests, ["from_doc", "from_row", "from_start", "n"])


def covered(n_words: int, spans, window: int = WINDOW) -> np.ndarray:
    """bool[n_words]: the words that windows of the spans (start, number of windows) cover."""
    steps = np.zeros(n_words + 1, np.int64)
    for start, n in spans:
        steps[min(n_words, start)] += 1
        steps[min(n_words, start + n + window - 1)] -= 1
    return np.cumsum(steps[:n_words]) > 0


def _cut(text: str | None, spans) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8").split()
    if not spans or not words:
        return len(words), 0, b" ".join(words).decode("utf-8")
    same = [(s["start"], s["n"]) for s in spans if _digest(words, s["start"], s["n"]) == s["digest"]]
    gone = covered(len(words), same)
    return len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone.tolist()) if not x).decode("utf-8")


def _each_cut(documents: DataFrame, made, schema, scope: str, bloom_bits: int) -> DataFrame:
    """made(batch, cuts) of all rows: cuts holds _cut() of each text. documents keeps its rows, in columns c0, c1, ... of the batch."""
    columns = documents.columns
    text_at, n = columns.index("text"), len(columns)
    found = repeats(documents, f"{scope}-repeats", bloom_bits)
    spans = saved(found.groupBy(F.col("doc_id").alias("span_doc"), F.col("row").alias("span_row")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")), scope)
    release(documents.sparkSession, f"{scope}-repeats")
    # documents without repeats need no join; the filter finds most of them before their texts are shuffled
    bloom = Bloom(spans.select(F.xxhash64("span_doc", "span_row").alias("place")), "place", bloom_bits)
    plain = plain_names(documents)
    doc_id, row = F.col(f"c{columns.index('doc_id')}").cast("long"), F.xxhash64(f"c{text_at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                listed = part.column(n).to_pylist() if part.num_columns > n else [None] * part.num_rows
                yield made(part, [_cut(t, s) for t, s in zip(part.column(text_at).to_pylist(), listed)])

    place = F.xxhash64(doc_id, row)
    rest = bloom.rows(plain, place, False).mapInArrow(run, schema)
    joined = bloom.rows(plain, place, True).join(spans, (doc_id == F.col("span_doc")) & (row == F.col("span_row")), "left").select(*plain.columns, "spans")
    return rest.union(joined.mapInArrow(run, schema))


def deduplicate(documents: DataFrame, keep: tuple[str, ...] = (), with_text: bool = True, scope: str = "session", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text, with the columns in keep.

    kept_text is the text as it was where nothing went, and else the words left, joined by spaces.
    """
    carried = documents.select("doc_id", *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields]
    names = [*carried.columns, "n_words", "n_removed", "kept_sha256", *(["kept_text"] * with_text)]
    schema = ", ".join([*fields, "n_words long", "n_removed long", "kept_sha256 string", *(["kept_text string"] * with_text)])
    slot = len(fields)

    def made(part: pa.RecordBatch, cuts: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = [pa.array([c[i] for c in cuts], pa.int64()) for i in (0, 1)]
        columns.append(pa.array([hashlib.sha256(c[2].encode("utf-8")).hexdigest() for c in cuts], pa.string()))
        if with_text:
            columns.append(pa.array([c[2] if c[1] else t for c, t in zip(cuts, part.column(slot).to_pylist())], pa.string()))
        return pa.record_batch([*part.columns[:slot], *columns], names)

    return _each_cut(documents.select("doc_id", *keep, "text"), made, schema, scope, bloom_bits)


def without_repeats(documents: DataFrame, scope: str = "session", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """documents with the words left as text, where any went, and n_chars, if it's there, their number of characters."""
    columns = documents.columns
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None

    def made(part: pa.RecordBatch, cuts: list[tuple[int, int, str]]) -> pa.RecordBatch:
        out = part.columns[: len(columns)]
        out[text_at] = pa.array([c[2] if c[1] else t for c, t in zip(cuts, out[text_at].to_pylist())], out[text_at].type)
        if chars_at is not None:
            out[chars_at] = pa.array([len(c[2]) if c[1] else n for c, n in zip(cuts, out[chars_at].to_pylist())], pa.int64()).cast(out[chars_at].type)
        return pa.record_batch(out, part.schema.names[: len(columns)])

    return _each_cut(documents, made, plain_names(documents).schema, scope, bloom_bits).toDF(*columns)
