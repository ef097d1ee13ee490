"""Shared helpers: reading tables, cutting lineage, vectorised word hashing, and the split of rows by doc_id."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Whole texts make rows long: few of them and few bytes at once keep Arrow buffers and Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


_ours: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share. Only a local session may leave that unset:
    on a cluster each executor would write to its own disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "local" not in _ours:
            _ours["local"] = [tempfile.mkdtemp(prefix="folio-")]
        base = "file://" + _ours["local"][0]
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  a leftover scratch folder is harmless
        pass


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the result survives lost executors and has no lineage."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop_dir, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that is no longer used back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def released(batches: Iterator) -> Iterator:
    """batches; what each of them needed goes back to the system, so that workers stay small between long texts."""
    for batch in batches:
        yield batch
        release()


def sub_batches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (one row at least)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    a, base = 0, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, base + most, "right")))
        yield a, b
        a, base = b, int(ends[b - 1])


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INV = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        ups, downs = np.full(size, _ODD, np.uint64), np.full(size, _INV, np.uint64)
        ups[0] = downs[0] = 1
        _powers[:] = [np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lut(spaces: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, bool)
    if spaces is None:  # letters: ASCII letters and every byte of a longer sequence
        word[:128] = False
        word[65:91] = word[97:123] = True
    else:
        word[list(spaces)] = False
    return lower, word


LOWER, IS_WORD = _lut(SPACE)
_, IS_LETTER = _lut(None)


class Words:
    """Words of some texts, by default lower-cased in A-Z: 64-bit hashes, and where each text's words begin.

    starts and ends are byte positions in `joined`; bounds[i]:bounds[i + 1] are the words of text i."""

    def __init__(self, texts: list[bytes] | tuple[np.ndarray, np.ndarray], is_word: np.ndarray = IS_WORD, letters: np.ndarray = LOWER) -> None:
        """texts: a list, or their bytes with a line feed behind each and their sizes without it."""
        if isinstance(texts, tuple):
            raw, sizes = texts
        else:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.joined = b = letters[raw]
        word = np.zeros(len(b) + 1, np.int8)
        word[1:] = is_word[b]
        edge = np.flatnonzero(np.diff(word))
        self.starts, self.ends = edge[::2], edge[1::2]
        ups, _ = _tables(len(b) + 1)
        self._sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * ups[: len(b)], out=self._sums[1:])
        self.hashes = self._hash(self.starts, self.ends)
        self.offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=self.offsets[1:])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))

    def prefixes(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes of words, unlike those of whole words."""
        at = self.starts[words]
        return mix(self._hash(at, at + n) + np.uint64(n))

    def word(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i]].tobytes()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of each run of k words; h: the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_ODD) + h[i : i + n]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer than k words, all of them as one; without words, none."""
    if 0 < len(h) < k:
        k = len(h)
    return np.unique(shingle_hashes(h, k)) if len(h) else np.empty(0, np.uint64)
