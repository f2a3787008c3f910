"""Shared pieces of the corpus operators: UTF-8 buffers, word boundaries, vectorised hashes, checkpoints.

Everything here works on one Arrow batch inside a Spark task; nothing gathers data on the driver.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER_LUT = np.frombuffer(LOWER, np.uint8)

# One byte class per word definition: True where the byte belongs to a word.
SPACE_WORDS = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
ALNUM_WORDS = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster shares; only a local session may do without `spark.checkpoint.dir`: it gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="verdance-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df into the cluster's shared folder, so that a lost executor costs no more than this step."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def sampled(hash_column: str, share: Column) -> Column:
    """Whether a row is in a sample of this share by a 64-bit hash, down to shares of 2^-52."""
    return F.pmod(F.col(hash_column), F.lit(1 << 52)) < share * float(1 << 52)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row; they bound a task's working memory."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words as byte positions, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = inside[data]
    first = offs[:-1][offs[:-1] < offs[1:]]  # a row's first byte can't continue the row before
    begins, ends = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
    begins[first] = m[1:-1][first]
    before = first[first > 0] - 1
    ends[before] = m[1:-1][before]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n + n // 4 + 1, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [s, e): polynomial prefix sums, shifted to the range's start, then mixed."""
    up, down = _power_tables(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=h[1:])
    return mix((h[e] - h[s]) * down[s] + (e - s).astype(U64))


def shingle_hashes(w: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words of each row (of all its words where it has fewer, but not none), and row bounds."""
    n = np.diff(first)
    out, bounds = np.zeros(0, U64), np.concatenate([[0], np.cumsum(np.where(n >= size, n - size + 1, n > 0))])
    if bounds[-1]:
        step = [U64(pow(0xD6E8FEB86659FD93, k + 1, 2**64)) for k in range(size)]
        row = np.repeat(np.arange(len(n)), np.diff(bounds))
        at = first[row] + np.arange(bounds[-1]) - bounds[row]
        left = np.minimum(first[row + 1] - at, size)
        padded = np.concatenate([w, np.zeros(size, U64)])
        out = left.astype(U64)
        for k in range(size):
            out += np.where(left > k, padded[at + k], U64(0)) * step[k] if (n < size).any() else padded[at + k] * step[k]
        out = mix(out)
    return out, bounds


def as_signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)
