"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a smoothed word unigram.

A text is coded as a row of symbols: its words, lower-cased A-Z, each followed
by a space, then one end. The model is a trie of byte contexts of up to ORDER
bytes, which run on across spaces into the words before. Before the first
symbol stand ends. A symbol is predicted in the longest context that training
texts have; if it has not followed there, an escape is coded and the next
shorter context predicts it, with the symbols of the longer one excluded, down
to an even choice among the bytes never seen. Escapes are estimated by method
D: of d distinct symbols in n occurrences each has half an occurrence less than
it was counted, and the escape has d halves. So the probabilities after any
context sum to one.

Training is pretrained: (context, symbol) is counted over all training texts,
and what is counted grows with them; nothing is left out. The code length of a
symbol depends on the ORDER bytes before it and on itself, six bytes that make
one long integer, so the corpus comes down to its distinct six-byte runs. Those
whose contexts end in the same three bytes meet in one group and hold all
contexts of three to five bytes that end so; contexts of up to two bytes are
sent to all. A group has at most 225^3 runs (two bytes before the three and the
symbol are free), and so has the table that is sent (three bytes), whatever the
input.

Code lengths of runs and counts of words are too many to send around. The most
frequent, at most HEAD_RUNS and HEAD_WORDS, go to the executors; every other
run or word of a document is looked up exactly with a join. Which way is taken
changes no score.

Defined results: a null text counts as empty: one token, the end. Rows that
share an id are scored one by one. A null id has no fold, so it trains. Without
training texts every symbol is as likely as any other. Very long texts are
coded in pieces of PIECE symbols, with the contexts before. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc32_mod, partitions_for, saved, slices, small_batches, sums

ORDER = 5
#: Contexts of so many bytes and less are sent to all.
LOW = 2
HEAD_WORDS, HEAD_RUNS = 200_000, 1 << 20
#: Symbols that are coded at a time; distinct runs that a task holds; runs that are priced at a time.
PIECE, HELD, GROUP = 1 << 20, 2_000_000, 200_000
SPACE, END = 0x20, 0xFF
#: Symbols: the bytes but for A-Z, ASCII white space and the end's own, and the space and the end.
ALPHABET = 225

_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[0x41:0x5B] += 0x20
_SYMBOL[0x09:0x0E] = SPACE


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after another, and where each text's start."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ended = pc.binary_join_element_wise(texts, pa.scalar(bytes([SPACE, END]), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if not len(ended):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    flat = _SYMBOL[np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    space = flat == SPACE
    keep = ~space
    keep[1:] |= (flat[:-1] != SPACE) & (flat[:-1] != END)  # a space stays behind a word
    return flat[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, offsets[:-1], dtype=np.int64))])


def runs(text: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Of the symbols text[lo:hi], each with the ORDER before it: the symbol in the lowest byte, the nearest in the next."""
    begin = max(0, lo - ORDER)
    part = text[begin:hi].astype(np.uint64)
    out = part.copy()
    for j in range(1, min(ORDER, len(part) - 1) + 1):
        out[j:] |= part[:-j] << np.uint64(8 * j)
    first = starts[:-1]
    ends = (1 << 8 * (ORDER + 1)) - 1
    for j in range(ORDER):  # nothing from the text before
        at = first[(first + j < starts[1:]) & (first + j >= lo) & (first + j < hi)] + j - begin
        own = (1 << 8 * (j + 1)) - 1
        out[at] = (out[at] & np.uint64(own)) | np.uint64(ends - own)
    return out[lo - begin :]


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    return np.unique(keys, return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tallies in one. Counts ride in the low 16 bits, so that one plain sort will do; larger counts are several rows."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    most = (1 << 16) - 1
    large = np.flatnonzero(counts > most)
    if len(large):
        more = counts[large] // most
        keys = np.concatenate([keys, np.repeat(keys[large], more)])
        counts = np.concatenate([np.where(counts > most, counts % most, counts), np.full(int(more.sum()), most)])
    packed = np.sort((keys << np.uint64(16)) | counts.astype(np.uint64))
    keys = packed >> np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat((packed & np.uint64(most)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)


# ---- the model


class Level:
    """All n-grams of one order (keys: context, then symbol) with their counts, and what their contexts hold."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, lower: Level | None):
        self.order, self.keys, self.counts = order, keys, counts.astype(float)
        self.contexts, slot = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = len(self.contexts)
        self.total, self.distinct = np.bincount(slot, self.counts, n), np.bincount(slot, minlength=n).astype(float)
        #: What the next shorter context has of the symbols that are excluded there.
        self.excluded = np.bincount(slot, lower.counts[np.searchsorted(lower.keys, keys & np.uint64((1 << 8 * order) - 1))], n) if lower else np.zeros(n)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of the next lower order."""
        keys, at = np.unique(self.keys & np.uint64((1 << 8 * self.order) - 1), return_inverse=True)
        return keys, np.bincount(at, self.counts, len(keys))


def levels(keys: np.ndarray, counts: np.ndarray, top: int, below: list[Level] | None = None) -> list[Level]:
    """The levels up to top from the n-grams of that order; below has the lowest ones if these are known."""
    bottom = len(below or ())
    tables = [(keys, counts.astype(float))]
    for order in range(top, bottom, -1):
        found, at = np.unique(tables[-1][0] & np.uint64((1 << 8 * order) - 1), return_inverse=True)
        tables.append((found, np.bincount(at, tables[-1][1], len(found))))
    out = list(below or ())
    for order, table in zip(range(bottom, top + 1), reversed(tables)):
        out.append(Level(order, *table, out[-1] if out else None))
    return out


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def code(keys: np.ndarray, model: list[Level]) -> np.ndarray:
    """log10 of the probability of each run's last symbol after the others."""
    out = np.zeros(len(keys))
    todo, came = np.arange(len(keys)), np.full(len(keys), -1)  # came: the longer context that was escaped from
    for level in reversed(model):
        key = keys[todo] & np.uint64((1 << 8 * (level.order + 1)) - 1)
        node, there = _find(level.contexts, key >> np.uint64(8))
        at, seen = _find(level.keys, key)
        now, node, hit, at = todo[there], node[there], seen[there], at[there]
        total, distinct = level.total[node], level.distinct[node]
        escaped = came[now] >= 0
        if escaped.any():
            longer = came[now][escaped]
            total[escaped] -= above.excluded[longer]
            distinct[escaped] -= above.distinct[longer]
        out[now[hit]] += np.log10((level.counts[at[hit]] - 0.5) / total[hit])
        gone = ~hit & (distinct > 0)  # with nothing else to come here, the way down is certain
        out[now[gone]] += np.log10(0.5 * distinct[gone] / total[gone])
        came[now[~hit]] = node[~hit]
        todo, above = np.delete(todo, np.flatnonzero(there)[hit]), level
    unseen = ALPHABET - len(model[0].keys)
    out[todo] -= np.log10(unseen if unseen > 0 else ALPHABET)
    return out


class Head:
    """Values of frequent keys, as a hash table that NumPy can ask: the first step holds most, the next what has clashed there."""

    STEP = 0x9E3779B97F4A7C15
    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.steps: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []

    def _build(self) -> None:
        keys, values, factor = self.keys, self.values, self.STEP
        while len(keys) or not self.steps:
            bits = max(4, int(2 * len(keys)).bit_length())
            slots = ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
            held, value = np.full(1 << bits, self.NONE), np.zeros(1 << bits)
            held[slots[::-1]], value[slots[::-1]] = keys[::-1], values[::-1]  # the more frequent one stays
            self.steps.append((np.uint64(factor), np.uint64(64 - bits), held, value))
            left = held[slots] != keys
            keys, values, factor = keys[left], values[left], (factor * self.STEP + 2) % (1 << 64) | 1

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, 0 for those it hasn't, and the places of these."""
        if not self.steps:
            self._build()
        out, todo = np.zeros(len(keys)), None
        for factor, shift, held, value in self.steps:
            now = keys if todo is None else keys[todo]
            slots = ((now * factor) >> shift).view(np.int64)
            hit = held[slots] == now
            if todo is None:
                np.multiply(value[slots], hit, out=out)
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = value[slots[hit]]
                todo = todo[~hit]
        return out, todo


# ---- on Spark


def _gathered(documents: DataFrame) -> DataFrame:
    """(word, key, c): all words (key null) and runs (word null) of all texts; c counts training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = merged(held)
            held.clear()
            for at in range(0, len(keys), 50_000):
                n = len(keys[at : at + 50_000])
                yield pa.record_batch([pa.nulls(n, pa.string()), pa.array(keys[at : at + n].view(np.int64)), pa.array(counts[at : at + n])], ["word", "key", "c"])

        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                trains = ~np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
                words = Words(part.column(0), lower=True)
                counts = np.bincount(words.codes, np.repeat(trains, words.counts), len(words.distinct)).astype(np.int64)
                yield pa.record_batch([words.distinct.cast(pa.string()), pa.nulls(len(counts), pa.int64()), pa.array(counts)], ["word", "key", "c"])
                text, starts = symbols(part.column(0))
                for lo in range(0, len(text), PIECE):
                    hi = min(len(text), lo + PIECE)
                    keys = runs(text, starts, lo, hi)
                    inside = np.clip(starts, lo, hi)
                    learnt = np.repeat(trains, np.diff(inside))
                    held.append(tally(keys[learnt]))
                    others = np.unique(keys[~learnt])
                    held.append((others, np.zeros(len(others), np.int64)))
                if len(held) > 1 and sum(len(h[0]) for h in held) > HELD:
                    held[:] = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
        if held:
            yield from out()

    counted = documents.select("text", "held_out").mapInArrow(run, "word string, key long, c long")
    return counted.groupBy("word", "key").agg(F.sum("c").alias("c"))


def _low(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order LOW: at most ALPHABET^(LOW + 1) rows."""
    key = F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))
    table = counted.filter("c > 0").groupBy(key.alias("key")).agg(F.sum("c").alias("c")).sort("key").toArrow()
    return table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("c").to_numpy()


def _priced(counted: DataFrame, low: tuple[np.ndarray, np.ndarray], group: int) -> DataFrame:
    """(key, c, score) of all runs (key, c): score is code()."""
    spark = counted.sparkSession
    model = spark.sparkContext.broadcast(low)
    tail = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))
    parts = max(partitions_for(spark), 1 + counted.count() // (2 * group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = levels(*model.value, LOW)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        goal, size, mask = group, 0, np.uint64((1 << 8 * (LOW + 1)) - 1)

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            known = counts > 0
            score = code(keys, levels(keys[known], counts[known], ORDER, below))
            for at in range(0, len(keys), 50_000):
                yield pa.record_batch([pa.array(keys[at : at + 50_000].view(np.int64)), pa.array(counts[at : at + 50_000]), pa.array(score[at : at + 50_000])], ["key", "c", "score"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= goal:
                keys, counts = joined()
                tails = (keys >> np.uint64(8)) & mask
                cut = int(np.searchsorted(tails, tails[-1]))  # the last tail may go on in the next batch
                if cut:
                    yield from out(keys[:cut], counts[:cut])
                held[:], size = [(keys[cut:], counts[cut:])], len(keys) - cut
                goal = max(group, 2 * size)
        if size:
            yield from out(*joined())

    return counted.select("key", "c").repartition(parts, tail).sortWithinPartitions(tail).mapInArrow(run, "key long, c long, score double")


def _largest(counted: DataFrame, most: int) -> DataFrame:
    """Rows with c of at least a power of two, the least one that leaves at most so many rows."""
    by_size = {r["size"]: r["n"] for r in counted.filter("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("size")).agg(F.count("*").alias("n")).collect()}  # 64 rows at the most
    kept, power = 0, max(by_size, default=0) + 1
    while power > 0 and kept + by_size.get(power - 1, 0) <= most:
        power -= 1
        kept += by_size.get(power, 0)
    return counted.filter(F.col("c") >= (1 << power))


#: Ids of words have the highest bit, those of runs haven't.
_WORD_ID = -(1 << 63)


def _word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) | 1 << 63  # as Spark's xxhash64 of a string


def score(documents: DataFrame, folds: int = 5, held_out_fold: int = 1, head_words: int = HEAD_WORDS, head_runs: int = HEAD_RUNS, group: int = GROUP, scope: str = "session") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    fold = crc32_mod("doc_id", folds)
    source = documents.select("doc_id", "text", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"))
    everything = saved(_gathered(source), scope)
    vocabulary = everything.filter("word IS NOT NULL AND c > 0").select("word", "c")
    ends = source.filter("not held_out").count()
    facts = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).head()
    train_tokens, distinct = (facts["n"] or 0) + ends, facts["v"] + (ends > 0)
    log_all = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    end_known, end_base = int(ends > 0), float(np.log10(ends + 0.5))

    counted = everything.filter("key IS NOT NULL").select("key", "c")
    priced = saved(_priced(counted, _low(counted), group), scope)

    column = lambda t, c: t.column(c).to_numpy()
    table = _largest(priced, head_runs).toArrow()
    frequent = Head(column(table, "key").astype(np.int64).view(np.uint64), column(table, "score").astype(float), column(table, "c"))
    least_run = int(column(table, "c").min()) if table.num_rows else None
    table = _largest(vocabulary, head_words).toArrow()
    common_words = table.column("word").combine_chunks().cast(pa.large_string()) if table.num_rows else pa.array([], pa.large_string())
    common_counts = column(table, "c")
    least_word = int(common_counts.min()) if table.num_rows else None
    model = spark.sparkContext.broadcast((common_words, np.log10(common_counts + 0.5), frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_words, common_logs, frequent = model.value
        for batch in batches:
            for part in slices(batch, 3, 2 << 20):
                words = Words(part.column(3), lower=True)
                n = len(words.distinct)
                at = np.asarray(pc.fill_null(pc.index_in(words.distinct, value_set=common_words), -1)).astype(np.int64)
                rare = np.flatnonzero(at < 0)
                rare_words = words.distinct.take(pa.array(rare)).cast(pa.large_binary()).to_pylist()
                base, known = np.zeros(n), np.zeros(n, np.int64)
                common = at >= 0
                base[common], known[common] = common_logs[at[common]], 1
                ids = np.zeros(n, np.uint64)
                ids[rare] = np.fromiter(map(_word_id, rare_words), np.uint64, len(rare))
                # of the rare words, each document's distinct ones and how often
                docs, codes = words.doc_of_word(), words.codes
                mask = ~common[codes] if len(codes) else np.zeros(0, bool)
                pairs, times = np.unique(docs[mask] * max(n, 1) + codes[mask], return_counts=True)
                of, rare_ids = [pairs // max(n, 1)], [ids[pairs % max(n, 1)]]
                rare_times = [times]
                # and of the rare runs
                text, starts = symbols(part.column(3))
                value = np.zeros(part.num_rows)
                for lo in range(0, len(text), PIECE):
                    hi = min(len(text), lo + PIECE)
                    keys = runs(text, starts, lo, hi)
                    found, missing = frequent.get(keys)
                    inside = np.clip(starts, lo, hi) - lo
                    value += sums(found, inside)
                    doc = np.searchsorted(inside, missing, "right") - 1
                    pairs, times = np.unique((doc.astype(np.uint64) << np.uint64(48)) | keys[missing], return_counts=True)
                    of.append((pairs >> np.uint64(48)).astype(np.int64))
                    rare_ids.append(pairs & np.uint64((1 << 48) - 1))
                    rare_times.append(times)
                of, rare_ids, rare_times = np.concatenate(of), np.concatenate(rare_ids), np.concatenate(rare_times)
                order = np.argsort(of, kind="stable")
                offsets = np.searchsorted(of[order], np.arange(part.num_rows + 1)).astype(np.int32)
                tails = pa.StructArray.from_arrays([pa.array(rare_ids[order].view(np.int64)), pa.array(rare_times[order])], ["id", "times"])
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), part.column(1), part.column(2), pa.array(words.counts + 1), pa.array(sums(known[codes], words.starts) + end_known), pa.array(sums(base[codes], words.starts) + end_base), pa.array(value), pa.ListArray.from_arrays(pa.array(offsets), tails)],
                    ["doc_id", "row", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )

    schema = "doc_id long, row long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<id: long, times: long>>"
    scored = saved(source.select("doc_id", F.monotonically_increasing_id().alias("row"), "held_out", F.col("text").alias("whole_text")).mapInArrow(run, schema), scope)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.id").alias("id"), F.col("r.times").alias("times"))
    # what is looked up is below the least count of what was sent, so frequent words and runs need not take part
    below = lambda least: F.lit(True) if least is None else F.col("c") < least
    all_words = everything.filter("word IS NOT NULL").filter(below(least_word))
    words = all_words.select(F.xxhash64("word").bitwiseOR(F.lit(_WORD_ID)).alias("id"), (F.col("c") > 0).cast("long").alias("known"), F.log10(F.col("c") + 0.5).alias("base"), F.lit(0.0).alias("score"))
    other = priced.filter(below(least_run)).select(F.col("key").alias("id"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
    looked_up = rare.join(words.union(other), "id")
    per_row = looked_up.groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"rare_{c}") for c in ("known", "base", "score")])
    joined = scored.drop("rare").join(per_row, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
