"""Byte-level text helpers and skew-safe joins shared by the operators of this package.

Texts are handled as UTF-8 bytes in numpy arrays, a few megabytes at a time, so that a Python worker's memory
depends on the slice size (or the longest single text) and not on the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logyield.session import new_table_path, remove_table

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder with zstd and read back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    with smaller_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def freed(*tables: DataFrame) -> None:
    """Removes tables of :func:`kept_table` that nothing reads any more; what was made from them is stored by then."""
    for table in tables:
        remove_table(table.sparkSession, table.kept_path)


def give_back() -> None:
    """Returns memory that this worker has freed to the system: idle workers share an executor's limit with busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def tidy(run):
    """A ``mapInArrow`` function that gives its memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def tidy_group(run, least_bytes: int = 1 << 20):
    """An ``applyInArrow`` function that gives its memory back after each large group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= least_bytes:
            give_back()
        return out

    return wrapped


@contextmanager
def smaller_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python workers ``BATCH_ROWS`` at a time: whole texts are wide, and both sides hold a batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------------------------------
# Joins with a hot key
# ---------------------------------------------------------------------------------------------------------------


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def aggregate_salted(df: DataFrame, keys: list[str], spread: list[str], first: dict, then: dict) -> DataFrame:
    """Aggregate per key when one key may own a third of the rows, keeping the salts that occur.

    Returns one row per (key, ``_salt``) that occurs in ``df``, each with the key's aggregate: ready to be joined back
    to ``df`` on (key, ``_salt``), where the hottest key is spread over ``SALTS`` join keys. ``first`` aggregates rows
    to (key, salt), ``then`` combines those; both map a name to a column expression.
    """
    salted = df.withColumn("_salt", salt_of(*spread))
    parts = salted.groupBy(*keys, "_salt").agg(*(e.alias(n) for n, e in first.items()))
    whole = parts.groupBy(*keys).agg(F.collect_set("_salt").alias("_salts"), *(e.alias(n) for n, e in then.items()))
    return whole.withColumn("_salt", F.explode("_salts")).drop("_salts")


# ---------------------------------------------------------------------------------------------------------------
# Arrow batches as byte buffers
# ---------------------------------------------------------------------------------------------------------------


class Texts(Sequence):
    """The UTF-8 bytes of an Arrow column, made Python objects only when asked for; null counts as empty."""

    def __init__(self, array: pa.Array):
        if pa.types.is_null(array.type):
            array = array.cast(pa.binary())
        elif pa.types.is_string(array.type):
            array = array.view(pa.binary())
        elif pa.types.is_large_string(array.type):
            array = array.view(pa.large_binary())
        self.array = array
        self.lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, at):
        if isinstance(at, slice):
            low, high, _ = at.indices(len(self))
            return [b"" if x is None else x for x in self.array.slice(low, high - low).to_pylist()]
        return self.array[at].as_py() or b""


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Texts:
    """The texts of a string or binary column."""
    return Texts(batch.column(batch.schema.get_field_index(column)))


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    start, size = 0, 0
    for i, length in enumerate(texts.lengths.tolist()):
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): texts one after the other, each followed by a line feed; ``starts`` has one entry more."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts


# ---------------------------------------------------------------------------------------------------------------
# Words and hashes
# ---------------------------------------------------------------------------------------------------------------

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER, LOWER)
#: Bytes of words that blanks separate: all but 0x20 and 0x09-0x0D.
NOT_BLANK = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Bytes of words made of letters, digits and everything beyond ASCII (after lower-casing).
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])

MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15
FACTOR_INVERSE = pow(FACTOR, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & MASK], np.uint64))[0])


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))


def powers(size: int, factor: int = FACTOR) -> np.ndarray:
    """factor**0 ... factor**(size-1) modulo 2**64; quick to make, so none is kept between slices."""
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        np.multiply(out[:step], np.uint64(pow(factor, done, 1 << 64)), out=out[done : done + step])
        done += step
    return out


def word_spans(buffer: np.ndarray, wordly: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; ``joined`` texts never share a run."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = wordly[buffer]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): a polynomial over random byte values, then mixed."""
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * powers(n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n + 1, FACTOR_INVERSE)[starts])


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``words[i : i + size]`` for every i where that many follow."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= np.uint64(FACTOR)
        out += words[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------------------------------------------------------
# Sums of vectors of a fixed length
# ---------------------------------------------------------------------------------------------------------------


def summed_vectors(parts: DataFrame, groups: int = 32) -> DataFrame:
    """Element-wise sums of the ``values`` (float64 bytes of one length per block) of each ``block``.

    Two levels, so that no task sees more vectors than a ``groups``-th of the input's tasks.
    """

    def add(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("values").to_pylist():
            part = np.frombuffer(raw, np.float64)
            total = part.copy() if total is None else total + part
        return pa.table(
            {"block": table.column("block").slice(0, 1).cast(pa.int32()), "values": pa.array([total.tobytes()], pa.binary())}
        )

    def by_lot(table: pa.Table) -> pa.Table:
        return add(table)

    lots = parts.withColumn("lot", F.pmod(F.xxhash64("values"), F.lit(groups)))
    some = lots.groupBy("block", "lot").applyInArrow(by_lot, "block int, values binary")
    return some.groupBy("block").applyInArrow(add, "block int, values binary")


# ---------------------------------------------------------------------------------------------------------------
# Bit tables: which rows may have one of many keys, without shuffling the others
# ---------------------------------------------------------------------------------------------------------------

TABLE_BITS = 22


def bit_words(keys: DataFrame, column: str) -> DataFrame:
    """(_w, _b): the bits of the (long) hashes in ``column`` as 64-bit words, 2 ** (TABLE_BITS - 6) rows at most.

    A clear bit proves that no key has the hash. The more keys, the more other rows share their bits: with very many
    keys every row may have one, which costs a larger shuffle and changes no result.
    """
    slot = F.shiftrightunsigned(column, 64 - TABLE_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias("_w"), bit.alias("_b"))
    return words.groupBy("_w").agg(F.bit_or("_b").alias("_b"))


class BitTable:
    """The same bits as an array, for use inside Python workers."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> BitTable:
        found = bit_words(keys, column).toArrow()
        words = np.zeros(1 << (TABLE_BITS - 6), np.int64)
        words[found.column("_w").to_numpy()] = found.column("_b").to_numpy()
        return cls(words.view(np.uint64))

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.view(np.uint64) >> np.uint64(64 - TABLE_BITS)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def suspects(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` that surely have none of the hashes ``keys`` has in ``column``, rows that may have one).

    The table of bits is joined by broadcast: its size does not depend on the data.
    """
    slot = F.shiftrightunsigned(column, 64 - TABLE_BITS)
    joined = df.withColumn("_w", F.shiftright(slot, 6)).join(F.broadcast(bit_words(keys, column)), "_w", "left")
    shifted = F.call_function("shiftrightunsigned", F.col("_b"), F.pmod(slot, F.lit(64)).cast("int"))
    may = F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.where(~may).select(*df.columns), joined.where(may).select(*df.columns)


def without(df: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose hash in ``column`` is not in ``dropped`` (distinct hashes); only suspects are shuffled."""
    kept, suspected = suspects(df, dropped, column)
    return kept.unionByName(suspected.join(dropped.select(column), column, "left_anti").select(*df.columns))
