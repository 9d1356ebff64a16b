"""Shared pieces of the corpus operators: table access, durable tables in the shared folder, word arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut by rows and by bytes, so that one batch of long texts stays small in a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "flowloom-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


_SCOPES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch():
    """Tables that are stored within are deleted on leaving, unless they were stored to keep."""
    held: list[DataFrame] = []
    token = _SCOPES.set((*_SCOPES.get(), held))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        discard(*held)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors, forgets the partitioning.

    keep: the table outlives the innermost scratch() (what a function returns reads it later), not those around.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_path = path
    if scopes := _SCOPES.get()[: -1 if keep else None]:
        scopes[-1].append(again)
    return again


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_stored_path", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo 4, is 2: rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def as_binary(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


# Rolling 64-bit hashes over bytes and words ----------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


class Roller:
    """Polynomial hashes modulo 2^64 with an odd base, so that any span's hash comes from prefix sums.

    Different spans can have one hash (long Thue-Morse words do, for every base): good for choosing and dealing out, not for equality.
    """

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.bytes = mix64((np.arange(256, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
        self.base = (int(self.bytes[7]) & ~7 | 5) % 2**64
        self.inverse = pow(self.base, -1, 2**64)
        self.seed = np.uint64(seed)
        self.up, self.down = self._powers(1 << 14)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (self.base, self.inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        return out[0], out[1]

    def _room(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = self._powers(1 << int(n).bit_length())

    def words(self, raw: np.ndarray, starts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """One hash per word of raw (bytes joined by single spaces at gaps)."""
        self._room(len(raw))
        v = self.bytes[raw]
        v[gaps] = 0
        v *= self.up[: len(raw)]
        return mix64(np.add.reduceat(v, starts) * self.down[starts] + self.seed)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._room(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[first]) * self.down[first] + self.seed)


def word_bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and gaps of words that single spaces join; norm isn't empty."""
    raw = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate((np.zeros(1, np.int64), gaps + 1))
    ends = np.concatenate((gaps, np.array([len(raw)], np.int64)))
    return raw, starts, ends, gaps


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of so many values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
