"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file; the package that holds it is installed wherever Python is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def wrapped(docs: DataFrame) -> DataFrame:
    """Each row as one struct `_row`, so that columns of any names can pass through an operator's joins."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row")[c].alias(c) for c in columns])


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch of whole texts, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release_memory() -> None:
    """Give back what a finished task has freed: Arrow's pool and the heap keep it otherwise, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model of this subpackage learns from: crc32 of the id's digits, modulo 5, is 0.

    A null id counts as held out, as it can't be dealt to a fold.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class WordHash(dict):
    """64-bit hashes of byte strings, remembered for the frequent ones; at most `most` entries are held."""

    def __init__(self, most: int = 100_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the shingle hash, one for each position of a word in its shingle.
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words; of the whole sequence if it is shorter; none of an empty one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1] * _MULTIPLIERS[0]
    for j in range(1, width):
        out += hashes[j : n - width + 1 + j] * _MULTIPLIERS[j]
    out += np.uint64(width)
    return mix64(out)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of strings; b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_fold(doc_id: int) -> int:
    """The fold of `held_out` in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
