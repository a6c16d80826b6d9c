"""Shared pieces: shared-folder tables, word tokenization over Arrow buffers, hashing.

Everything that touches text works on the Arrow string buffer of a batch with
numpy, so no Python object is made per word.  A batch is cut into chunks of
about ``CHUNK`` bytes; a document is never cut, so memory is bounded by the
chunk size or by the longest single document, whichever is larger.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20

#: Bytes that are no word byte for the pattern [^\x20\x09-\x0D]+
_SPACES = np.array([0x20, *range(0x09, 0x0E)])
NON_SPACE = np.ones(256, bool)
NON_SPACE[_SPACES] = False

#: Bytes of words for the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
WORD_SQL = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ tables
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_RECORDS: list[list[str]] = []


@contextmanager
def recording():
    """A list of the paths of the tables that `cut` writes meanwhile."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.pop()


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    The files survive the loss of any executor.  They go with the folder, or
    earlier with `drop` or `sweep`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithic-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _RECORDS:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lithic_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema made by `cut`, as one scan."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t._lithic_path for t in tables])


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `cut` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_lithic_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(docs: DataFrame, paths: list[str]) -> None:
    """Delete those of the folders that docs does not read, and empty the list."""
    read = docs.inputFiles() if paths else []
    for path in paths:
        if not any(path.rsplit("/", 1)[-1] in f for f in read):
            delete(docs.sparkSession, path)
    paths.clear()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ arrow
def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK):
    """(first row, end row, bytes, offsets from 0) of pieces of about `size` bytes of a text column."""
    offs, raw = string_buffers(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        b = min(b, n, a + 4096)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def release() -> None:
    """Give free memory of this process back to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function for mapInArrow whose worker keeps nothing of a task when it ends: workers live on, and what each job needed at most would add up."""

    @wraps(run)
    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every bit of the result hangs on every bit of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Spans are hashed by polynomials modulo this prime, in pairs of bases: two different spans of n values agree under one base with a
#: chance of n / 2**31 at most, whatever their structure (powers of two as modulus have pairs that agree under every odd base).
PRIME = U64((1 << 31) - 1)
_FOLD = U64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place, for any 64-bit x."""
    for _ in range(2):
        high = x >> _FOLD
        x &= PRIME
        x += high
    high = x >> _FOLD
    x &= PRIME
    x += high
    x[x == PRIME] = 0
    return x


class Powers:
    """Powers of a base modulo PRIME and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.n = base % int(PRIME), 0

    def _grown(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        k = 1
        while k < n:
            out[k : 2 * k] = _reduced(out[: min(k, n - k)] * U64(pow(base, k, int(PRIME))))
            k *= 2
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK + 1)
            self.up, self.down = self._grown(self.base, self.n), self._grown(pow(self.base, -1, int(PRIME)), self.n)
        return self.up, self.down


_BASES = tuple(Powers(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9))
#: A fixed random value for each byte, for each base.
_BYTE = tuple(mix(np.arange(1, 257, dtype=U64) * U64(k)) & PRIME for k in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5, 0x8EBC6AF09C88C6E3, 0xE7037ED1A0B428DB))
#: Values that are worked on at once, so that temporary arrays stay in the cache.
_PIECE = 1 << 14


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums of value * base**i for two bases; `span_hash` takes the hash of any span from them.

    values: bytes, or 64-bit names of which both halves count.  which: 0 or 1, two independent hashes.
    """
    n = len(values)
    out = np.zeros((2, n + 1), U64)
    powers = [_BASES[2 * which + k].upto(n + 1)[0] for k in range(2)]
    for a in range(0, n, _PIECE):
        x = values[a : a + _PIECE]
        for k in range(2):
            term = _BYTE[2 * which + k][x] if x.dtype == np.uint8 else x >> U64(33) if k else x & PRIME
            term *= powers[k][a : a + len(x)]
            high = term >> _FOLD
            term &= PRIME
            term += high  # below 2**33, so that sums of 2**31 values do not overflow
            term[0] += out[k, a]
            np.cumsum(term, out=out[k, a + 1 : a + 1 + len(x)])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """62-bit hash of values[start:end] for arrays of spans; equal spans have equal hashes wherever they stand."""
    out = np.empty(len(start), U64)
    downs = [_BASES[2 * which + k].upto(prefix.shape[1])[1] for k in range(2)]
    for a in range(0, len(start), _PIECE):
        x, y = start[a : a + _PIECE], end[a : a + _PIECE]
        total = (y - x).astype(U64) * U64(0x632BE59BD9B4E019)
        for k in range(2):
            h = _reduced(prefix[k][y] - prefix[k][x])
            h *= downs[k][x]
            total += _reduced(h) << U64(32 * k)
        out[a : a + len(x)] = mix(total)
    return out


_ODD = 0x9E3779B97F4A7C15
_ODD_POWERS: list[np.ndarray] = []
_ODD_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


def _odd_powers(n: int) -> list[np.ndarray]:
    if not _ODD_POWERS or len(_ODD_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        _ODD_POWERS[:] = [np.full(n, b, U64) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
        for x in _ODD_POWERS:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
    return _ODD_POWERS


def rough_prefix(data: np.ndarray) -> np.ndarray:
    """Running sums for `rough_span`, modulo 2**64: several times cheaper than `prefix_hash`."""
    up, out = _odd_powers(len(data) + 1)[0], np.zeros(len(data) + 1, U64)
    for a in range(0, len(data), _PIECE):
        x = data[a : a + _PIECE]
        term = _ODD_BYTE[x]
        term *= up[a : a + len(x)]
        term[:1] += out[a : a + 1]
        np.cumsum(term, out=out[a + 1 : a + 1 + len(x)])
    return out


def rough_span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of spans for finding candidates: equal spans have equal names, but different ones of a certain structure can share one."""
    down = _odd_powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


# ------------------------------------------------------------------ words
class Words:
    """Words of a chunk: byte spans, the row each stands in, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, member: np.ndarray):
        n = len(data)
        m = member[data]
        begin, end = m.copy(), m.copy()
        begin[1:] &= ~m[:-1]
        end[:-1] &= ~m[1:]
        at = offs[:-1][offs[:-1] < n]
        begin[at] |= m[at]
        last = offs[1:][offs[1:] > 0] - 1
        end[last] |= m[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def hashes(self, data: np.ndarray, which: int = 0) -> np.ndarray:
        return span_hash(prefix_hash(data, which), self.start, self.end, which)


def stable_hash(text: str) -> int:
    """A 63-bit hash of a string that is alike in all processes."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1


def uniform(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
