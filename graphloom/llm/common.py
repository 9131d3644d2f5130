"""Shared pieces: Arrow text slices, vectorised word hashing, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..functions.lineage import shared_folder, shuffles_freed

U64 = np.uint64
#: Odd multipliers of the splitmix64 finaliser.
MIX_A, MIX_B, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
BASE = U64(0x5851F42D4C957F2D)
#: Bytes of text that are worked on at once; numpy's temporary arrays take some tens of times as much.
SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


# --- tables in the shared folder -------------------------------------------------------------------------------------

#: Bytes of an Arrow batch at which no more rows are added: texts are long, and a batch is held on both sides of the pipe to Python.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to BATCH_BYTES where it is larger.

    The setting is read when a plan runs, which may be after this library has returned it, so it cannot be put back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.match(r"(-?\d+)\s*([kmgt]?)", spark.conf.get(key).lower()).groups()
    now = int(digits) << 10 * " kmgt".index(unit or " ")
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system when it ends: Python workers stay for later tasks, several to an executor."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)
    return wrapped


class Stash:
    """Tables written to the shared folder: they cut lineage, outlive executors, and go when drop() is called."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written and read again; with by, packed closely and in a folder for each value of that column."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        with shuffles_freed(self.spark):
            if by is None:
                df.write.parquet(path)
            else:
                df.write.option("compression", "zstd").partitionBy(by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def free_shuffles(self) -> None:
        """Has the driver collect its garbage, so that the shuffle files of plans that have run go now."""
        self.spark._jvm.System.gc()

    def forget(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                self._remove(path)

    def leave(self, *tables: DataFrame) -> None:
        """Removes all tables but these, which later plans read."""
        stay = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for t in tables for f in t.inputFiles()}
        for k in range(1, self.n + 1):
            if f"t{k}" not in stay:
                self._remove(f"{self.root}/t{k}")


# --- joins whose keys may be hot ---

#: Rows up to which with_small broadcasts a table, after counting it; parts that a key is split into beyond that.
MOST_SENT, SALTS = 500_000, 16


def with_small(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with a table that has one row for each value of the keys, of which one may hold very many of the rows.

    A table of at most MOST_SENT rows, by count, is broadcast; the rows of one key meet a longer one in SALTS tasks.
    """
    if table.count() <= MOST_SENT:
        return rows.join(F.broadcast(table), keys)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*[f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


# --- bitmaps ---------------------------------------------------------------------------------------------------------

#: Bits of a bitmap that thins out a scan before a join: one megabyte to every task, whatever the number of rows. With more
#: rows than bits it lets everything through, and the join after it decides.
BITMAP_BITS = 1 << 23


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Packed bits of the low bits of a long column's values; BITMAP_BITS / 8 bytes however many rows there are."""
    place = F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = rows.select((place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    out = np.zeros(BITMAP_BITS // 32, dtype=np.uint32)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def within(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among those of the bitmap."""
    at = (values.view(np.uint64) & U64(BITMAP_BITS - 1)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


# --- Arrow text ------------------------------------------------------------------------------------------------------

def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j with their bytes and offsets from 0; a slice passes most_bytes only with a single row."""
    raw, off = column_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), i + most_rows, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def code_points(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return lead[off[1:]] - lead[off[:-1]]


# --- hashing ---------------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept in the process up to 2 ** 20 entries."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        want = max(n, 1 << 12)
        have = np.full(want, U64(base), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if want <= 1 << 20:
            _POWERS[name] = have
    return have[:n]


_INVERSE = pow(int(BASE), -1, 1 << 64)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of the polynomial's terms before each byte, and over all."""
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + U64(1)) * powers("up", int(BASE), len(buf)), out=sums[1:])
    return sums


def span_values(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of each byte span."""
    return (sums[ends] - sums[starts]) * powers("down", _INVERSE, len(sums))[starts]


def window_values(sums: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The polynomial of the windows of k bytes at some places."""
    return (sums[at + k] - sums[at]) * powers("down", _INVERSE, len(sums))[at]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum of the polynomial."""
    return mix(span_values(prefix_sums(buf), starts, ends) + (ends - starts).astype(np.uint64) * GOLDEN)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+; a row's end ends a word."""
    word = ~_SPACE[buf]
    start, end = word.copy(), word.copy()
    if len(buf):
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        full = off[:-1] < off[1:]
        first, last = off[:-1][full], off[1:][full] - 1
        start[first] |= word[first]
        end[last] |= word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(off, starts, side="right") - 1


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[buf]


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the word k-shingles; a row of 1 to k-1 words gives one shingle, its whole sequence."""
    starts, ends, row = word_spans(buf, off)
    word = span_hashes(buf, starts, ends)
    n_words = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    if len(word) >= k:
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        h = np.zeros(len(row) - k + 1, dtype=np.uint64)
        for d in range(k):
            h = mix(h + word[d : len(word) - k + 1 + d] * GOLDEN + U64(d + 1))
        h, rows = h[whole], row[: len(row) - k + 1][whole]
    else:
        h, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        more = np.zeros(len(short), dtype=np.uint64)
        for x, r in enumerate(short):
            s = U64(0)
            for w in word[first[r] : first[r] + n_words[r]]:
                s = mix(np.array([s + w * GOLDEN + U64(77)], dtype=np.uint64))[0]
            more[x] = s
        h, rows = np.concatenate((h, more)), np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
    return h, rows


ROW_BITS = U64(10)


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes (of 54 bits) of each row, sorted in it; rows are below 1024."""
    key = np.sort((rows.astype(np.uint64) << (U64(64) - ROW_BITS)) | (h >> ROW_BITS))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 54) - 1), (key >> (U64(64) - ROW_BITS)).astype(np.int64)
