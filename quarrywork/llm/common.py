"""What the operators of this subpackage share: word splitting in Arrow, and tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

try:
    _LIBC = ctypes.CDLL(None)
except OSError:
    _LIBC = None

_SAVED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one will do for local[...] only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrywork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Whether Spark deletes a query's shuffle files when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, scope: str = "session") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    The shuffle files of writing it go at once; nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarrywork-{uuid.uuid4().hex}"
    usual = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if usual is None else spark.conf.set(CLEANUP, usual)
    if not _SAVED:
        atexit.register(lambda: [release(spark, s) for s in list(_SAVED)])
    _SAVED.setdefault(scope, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str = "session") -> None:
    """Deletes the tables that saved() wrote under this scope. Frames that still read them fail afterwards."""
    for path in _SAVED.pop(scope, []):
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as gone:  # the session may have ended before the interpreter
            print(f"quarrywork: {path} stays: {type(gone).__name__}")


def moved(old: str, new: str) -> None:
    """What was saved under one scope belongs to another from now on."""
    _SAVED.setdefault(new, []).extend(_SAVED.pop(old, []))


#: Rows of an Arrow batch, and of a batch of the Parquet reader, where whole texts go to Python: a few MB of ordinary documents.
TEXT_ROWS, READER_ROWS = 1000, 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches, so that neither side of the pipe, nor the reader before it, holds many texts at once."""
    for name, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", TEXT_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READER_ROWS)):
        now = int(spark.conf.get(name, usual))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def plain_names(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1, ..., so that none clashes with a name used inside an operator; toDF() gives the names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


class Words:
    """The words of a batch of texts: codes into a list of distinct words, and where each text's words start."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a fresh copy: ascii_lower misreads arrays whose data don't begin at offset 0
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        real = pc.greater(pc.binary_length(flat), 0)
        if pc.sum(real).as_py() != len(flat):
            keep = np.asarray(real)
            before = np.concatenate([[0], np.cumsum(keep)])
            flat, starts = flat.filter(real), before[starts]
        coded = flat.dictionary_encode()
        #: int64[texts + 1]; the words of text i are codes[starts[i]:starts[i + 1]]
        self.starts = starts.astype(np.int64)
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        self.counts = np.diff(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w, seed) for w in self.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values; entry i is of values[i:i + k]. Callers mask runs that cross a text's end."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        out = out * factor + values[j : j + n]
        if j % 4 == 3:
            out = mix(out)
    return mix(out)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]], empty stretches included."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def hash_share(share: float) -> int:
    """The 64-bit hash up to which such a share of all hashes lies."""
    return min(int(share * 2**64), 2**64 - 1) - 2**63


def slices(batch: pa.RecordBatch, text_at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text, so that work arrays stay small; a longer text is a piece of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)).astype(np.int64)
    piece = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker waits for its next task with what it needs, not with its peak."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


class PrefixHash:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2^64."""

    BASE = 0x9E3779B97F4A7C55
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._back = self._powers(self.INVERSE, n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._powers(self.BASE, n), out=self._sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))


class Bloom:
    """A Bloom filter over 64-bit hashes, filled by Spark, of BITS bits for each hash.

    Only set words come to the driver: MOST bits at the most, 16 MB, whatever the
    size of the data. For more hashes than that serves there is no filter, and
    every row passes. Those who use it join exactly afterwards, so it only saves work.
    """

    BITS, MOST = 12, 27

    def __init__(self, hashes: DataFrame, col: str, most: int = MOST):
        n = hashes.count()
        self.bits = max(12, (self.BITS * n).bit_length())
        self.words: np.ndarray | None = None
        if self.bits > most:
            return
        mask = F.lit((1 << self.bits) - 1)
        spots = hashes.select(F.explode(F.array(F.col(col).bitwiseAND(mask), F.shiftrightunsigned(F.col(col), 32).bitwiseAND(mask))).alias("spot"))
        words = spots.select(F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        found = words.toArrow()
        held = np.zeros(1 << (self.bits - 6), np.int64)
        held[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.words = held.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        if self.words is not None:
            hashes = hashes.view(np.uint64)
            for shift in (0, 32):
                spot = (hashes >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
                out &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return out

    def rows(self, df: DataFrame, place, inside: bool) -> DataFrame:
        """The rows of df whose hash (a column expression) the filter has, or those it hasn't."""
        if self.words is None:
            return df if inside else df.limit(0)
        schema, columns = df.schema, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = batch.filter(pa.array(self.has(batch.column(len(columns)).to_numpy()) == inside))
                yield pa.record_batch(kept.columns[: len(columns)], columns)

        return df.select("*", place.alias("place in filter")).mapInArrow(run, schema)
