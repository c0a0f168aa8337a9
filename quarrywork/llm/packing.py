"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds.

A document is the ids of its text and a final end id. One longer than a
sequence is cut into full pieces and a last, shorter one. Full pieces fill a
sequence each. The others are dealt at random over partitions of a bounded
size, and every partition packs its own best-fit decreasing: pieces in falling
length, each into the fullest sequence that has room.

A partition's number of sequences is certified by lower bounds from dual
feasible functions (the sum of the lengths; Martello and Toth's f_t, which
rounds pieces above size - t up and drops those below t; and the family that
counts how many multiples of 1/k a length exceeds). Where the number
equals the bound, the packing is optimal for the pieces at hand. A partition
with a gap gives up its least filled sequences, as many as could close it. One
without a gap gives up its least filled sequence only, as the room left there
is what rounding up its bound has cost. The partitions exchange the documents
given up, several partitions' lots meet in one, and best-fit decreasing runs
again. A new lot is bounded like the first partitions, so rounds only ever see
bounded groups. Rounds go on until the pieces exchanged fit one partition, none
are given up, or a round needs as many sequences as it was given (its pieces
then stay as they were).

The certificate goes with the result: every piece has its lot (the partition
where it was packed last), and the number of sequences and the bound of that
lot; certificate() gives a row per lot. total_bound() bounds all pieces together.

Tokenizing: ASCII white space always ends a token here (the tokenizer's
pre-tokenizer never joins across it), so each distinct run of other characters
is encoded once and its ids are reused.

Defined results: a null or empty text is the end id alone; rows that share an
id are packed one by one and their pieces carry the same doc_id; an empty table
gives an empty table. Other columns are ignored. A text is tokenized as a whole,
so a very long one takes memory of a few times its size.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, saved, slices, small_batches

SIZE, END = 2048, 0
#: Pieces of a partition, about.
PARTITION = 60_000
#: Distinct runs of characters whose ids a task remembers.
REMEMBERED = 200_000

#: Latin letters (without the one whose lower case is two characters), and marks that never join letters before them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_MARKS = ".,;:!?#*$%&|<>()"
_LATIN = re.compile(f"[{_LETTERS}]+")


class Ids:
    """Ids of texts by a tokenizer's file, through a memory of distinct runs without white space.

    This is for tokenizers that drop white space and split the rest by a
    pattern that never joins letters with the marks behind them (apostrophes
    aside), so a space is put between a letter and a mark. A run of Latin letters
    is one piece of the pattern, whose last id alone carries the word end; so
    many such runs are encoded as one text and told apart by these ids. Any
    other run is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cluster's cores have tasks of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 2, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.memory: dict[str, bytes] = {}  # of one task: workers outlive their tasks

    def _alone(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            for word, code in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self.memory[word] = np.array(code.ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, lo = ids.tobytes(), 0
                for word, hi in zip(part, (cuts * 4).tolist()):
                    self.memory[word] = raw[lo:hi]
                    lo = hi
            else:
                self._alone(part)

    def learn(self, words: list[str]) -> None:
        """Puts words into the memory."""
        together, alone = [], []
        latin = _LATIN.fullmatch
        for word in words:
            (together if latin(word) else alone).append(word)
        self._together(together)
        self._alone(alone)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts one after another, and where each text's begin."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), ""), pa.array([], pa.large_string())])
        # the tokenizer lower-cases, but for its special tokens; only where none is near may A-Z be lower-cased first
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        if not special:
            texts = pc.replace_substring_regex(texts, pattern=f"([{_LETTERS}])([{_MARKS}])", replacement=r"\1 \2")
        words = Words(texts, lower=not special)
        distinct = words.distinct.to_pylist()
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        self.learn([w for w in distinct if w not in self.memory])
        coded = [self.memory[w] for w in distinct]
        sizes = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        each = sizes[words.codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        at = np.repeat(begin[words.codes] - ends[:-1].astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], ends[words.starts]


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): row tells rows that share an id apart."""
    small_batches(documents.sparkSession)
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, 6 << 20):
                flat, starts = ids.of(part.column(1))
                out: list[tuple] = []
                last = np.array([end], "<u4")
                for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    whole = np.concatenate([flat[lo:hi].astype("<u4", copy=False), last])
                    for k, at in enumerate(range(0, len(whole), size)):
                        piece = whole[at : at + size]
                        out.append((i, k, at, len(piece), zlib.crc32(piece.tobytes())))
                of, k, at, length, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.record_batch([part.column(0).cast(pa.int64()).take(pa.array(of)), part.column(2).take(pa.array(of)), pa.array(k.astype(np.int32)), pa.array(at), pa.array(length), pa.array(crc)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", F.col("text").alias("whole_text"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, size: int = SIZE, times: np.ndarray | None = None) -> int:
    """The best of the dual-feasible-function bounds on the number of sequences; times: how many pieces there are of each length given."""
    counts = np.zeros(size + 1, np.int64)
    np.add.at(counts, lengths, 1 if times is None else times)
    value = np.arange(size + 1)
    best = -(-int((counts * value).sum()) // size)
    above = np.cumsum(counts[::-1])[::-1]  # pieces of at least that length
    mass = np.concatenate([[0], np.cumsum(counts * value)])
    t = np.arange(1, size // 2 + 1)
    # f_t: a length above size - t counts as a full one, from t to size - t as itself, below t as none
    full = np.where(size - t + 1 <= size, above[np.minimum(size - t + 1, size)], 0)
    middle = mass[size - t + 1] - mass[t]
    best = max(best, int((full + -(-middle // size)).max()))
    for k in range(1, 21):  # u_k: x of size counts (ceil((k + 1) x) - 1) / k, and x itself where (k + 1) x is whole
        scaled = (k + 1) * value
        exact = scaled % size == 0
        total = int((counts * np.where(exact, value * k, (-(-scaled // size) - 1) * size)).sum())  # in units of 1 / (k size)
        best = max(best, -(-total // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and place there, and the sequences' room left."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some sequence has room r
    used = 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = size, used
            used += 1
        sequence[i], offset[i] = at, size - room
        room -= length
        if room:
            open_by_room[room].append(at)
            rooms |= 1 << room
    left = np.full(used, size, np.int64)
    np.subtract.at(left, sequence, lengths)
    return sequence, offset, left


def pack_group(lengths: np.ndarray, size: int, give: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """A partition's packing, which pieces it gives up for exchange, and its certificate: sequences and their bound, of all pieces and of those kept."""
    sequence, offset, left = best_fit(lengths, size)
    bound = lower_bound(lengths, size)
    gap = len(left) - bound
    out = np.zeros(len(lengths), bool)
    kept_used, kept_bound = len(left), bound
    if give:
        # what the gap has lost is in the emptiest sequences: enough of them that their room would make up gap + 1 sequences
        ranked = np.argsort(-left, kind="stable")
        share = np.cumsum(left[ranked])
        need = min(len(ranked), int(np.searchsorted(share, (gap + 1) * size)) + 1 if gap > 0 else 1)
        out = np.isin(sequence, ranked[:need])
        kept_used, kept_bound = len(left) - need, lower_bound(lengths[~out], size)
    return sequence, offset, out, {"used": len(left), "bound": bound, "kept_used": kept_used, "kept_bound": kept_bound}


_PACKED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part long, local long, offset long, given boolean, used long, bound long, kept_used long, kept_bound long"


def _pack(dealt: DataFrame, size: int, give: bool) -> DataFrame:
    def run(group):
        group = group.sort_values(["length", "doc_id", "row", "piece"], kind="stable")
        sequence, offset, given, certificate = pack_group(group["length"].to_numpy(), size, give)
        return group.assign(local=sequence, offset=offset, given=given, **certificate)

    return dealt.groupBy("part").applyInPandas(run, _PACKED)


def pack(cut: DataFrame, size: int = SIZE, partition: int = PARTITION, scope: str = "session") -> DataFrame:
    """pieces() with sequence_id, offset, lot, lot_used and lot_bound; each sequence is gapless from offset 0. cut must be a written table."""
    columns = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    one = F.lit(1).cast("long")
    # sequences and lots of full pieces are numbered below 0, others by round, partition and place there
    full = (-1 - F.monotonically_increasing_id()).alias("sequence_id")
    done = [cut.filter(F.col("length") == size).select(*columns, full, F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("lot"), one.alias("lot_used"), one.alias("lot_bound"))]

    def placed(packed: DataFrame, turn: int, used: str, bound: str) -> DataFrame:
        first = F.lit(turn << 52)
        sequence, lot = first + F.shiftleft(F.col("part"), 20) + F.col("local"), first + F.col("part")
        return packed.select(*columns, sequence.alias("sequence_id"), "offset", lot.alias("lot"), F.col(used).alias("lot_used"), F.col(bound).alias("lot_bound"))

    rest = cut.filter(F.col("length") < size)
    n, turn, before, given_up = rest.count(), 0, None, 0
    while n:
        lots = max(1, -(-n // partition))
        deal = F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(lots))
        packed = saved(_pack(rest.select(*columns, deal.alias("part")), size, lots > 1), scope)
        used = packed.groupBy("part").agg(F.max("used").alias("used"), F.max(F.col("used") - F.col("kept_used")).alias("given_up")).agg(F.sum("used").alias("used"), F.sum("given_up").alias("given_up")).head()
        if before is not None and used["used"] >= given_up:
            done[-1] = placed(before, turn - 1, "used", "bound")  # nothing gained: as it was
            break
        done.append(placed(packed.filter("not given"), turn, "kept_used", "kept_bound"))
        before, given_up, rest, turn = packed, used["given_up"], packed.filter("given"), turn + 1
        n = rest.count() if lots > 1 else 0
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole.drop("row")


def certificate(packed: DataFrame) -> DataFrame:
    """(lot, pieces, sequences, bound): a lot whose sequences equal its bound is packed as well as can be."""
    full = F.col("lot") == -1
    return packed.groupBy("lot").agg(F.count("*").alias("pieces"), F.when(full, F.count("*")).otherwise(F.max("lot_used")).alias("sequences"), F.when(full, F.count("*")).otherwise(F.max("lot_bound")).alias("bound"))


def total_bound(packed: DataFrame, size: int = SIZE) -> int:
    """The bound for all pieces together, from how many there are of each length."""
    rows = packed.groupBy("length").count().collect()  # one row for each length, size at the most
    return lower_bound(np.array([r["length"] for r in rows], np.int64), size, np.array([r["count"] for r in rows], np.int64)) if rows else 0


def pack_documents(documents: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, scope: str = "session") -> DataFrame:
    return pack(saved(pieces(documents, tokenizer, size, end), scope), size, scope=scope)
