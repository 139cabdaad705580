"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.session import tune

#: Rows and bytes that one Arrow batch holds at most, so that a Python worker keeps few long texts at a time.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the corpus operators count on."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the quarter that nothing is learnt from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def lower_words(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, A-Z lower-cased, split at ASCII white space, a block at a time.

    Only one block is held as separate words, however long the text is.
    """
    start = 0
    while start < len(data):
        end = start + block
        if end < len(data):
            # Cut behind the first white space after the block, so that no word is cut.
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
        words = data[start:end].lower().split()
        if words:
            yield words
        start = end


def matches(pattern, text: str) -> Iterator[list[str]]:
    """All matches of a compiled pattern, a block at a time for very long texts."""
    if len(text) <= 1 << 22:
        yield pattern.findall(text)
    else:
        found = pattern.finditer(text)
        while block := [m.group() for m in islice(found, 1 << 16)]:
            yield block


class WordIds(dict):
    """Numbers for words, given on first sight; `fresh` lists the words since the last `take`.

    The holder clears it at `limit` words, so it stays bounded over any number of texts.
    """

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit
        self.fresh: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh

    def full(self) -> bool:
        return len(self) > self.limit

    def of_all(self, blocks: Iterator[list]) -> np.ndarray:
        return np.concatenate([self.of(block) for block in blocks] or [np.zeros(0, np.int64)])


def subword_buckets(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word, and the word itself, as flat buckets and the word each belongs to.

    A word is framed by `<` and `>`; n-grams run over its UTF-8 bytes.
    """
    framed = [b"<" + w + b">" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(framed)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # bytes from here to the word's end
    found, owners = [], []
    prime = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # The word as a whole: sum of its bytes, each weighted by a power that depends on its place.
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        weight = _mix((place + 1).astype(np.uint64) * prime)
        whole = np.add.reduceat(_mix(data + np.uint64(1)) * weight, starts) if len(starts) else data
        found.append(_mix(whole) % np.uint64(buckets))
        owners.append(np.arange(len(framed)))
        for n in sizes:
            if len(data) < n:
                continue
            code = np.full(len(data) - n + 1, n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            ok = left[: len(code)] >= n
            found.append(_mix(code[ok]) % np.uint64(buckets))
            owners.append(owner[: len(code)][ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of a public mixing function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
