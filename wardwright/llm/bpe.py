"""Byte-level BPE: encoding by rounds over padded matrices, decoding by table."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import WordIds, matches, prepare, table

_NONE = np.int64(1 << 40)  # rank of a pair that does not merge
#: Bucket widths; a piece goes to the narrowest bucket that holds it, longer ones to their next power of two.
_WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Hashed lookup from a pair of tokens to the rank of their merger, by open addressing in numpy arrays."""

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> PairTable:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        bits = max(4, (2 * len(merged)).bit_length())
        made = cls(np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64), 1)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64) if merged else np.zeros(0, np.int64)
        values, slots = np.array(merged, np.int64), made._slot(keys)
        while len(keys):
            # Of the keys that want a free slot, one each gets it; the rest try the next.
            free = made.keys[slots] == -1
            made.keys[slots[free]] = keys[free]
            placed = made.keys[slots] == keys
            made.ranks[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], slots[~placed] + 1 & (1 << bits) - 1
            made.probes += 1
        return made

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, probes: int):
        self.keys, self.ranks, self.probes, self.bits = keys, ranks, probes, len(keys).bit_length() - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE where one side is padding (-1) or nothing merges."""
        keys = left << 32 | right
        out = np.full(keys.shape, _NONE, np.int64)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        wanted, slots = keys.ravel()[rest], self._slot(keys.ravel()[rest])
        flat = out.ravel()
        for _ in range(self.probes):
            there = self.keys[slots]
            hit = there == wanted
            flat[rest[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there != -1)
            rest, wanted, slots = rest[on], wanted[on], slots[on] + 1 & (1 << self.bits) - 1
            if not len(rest):
                break
        return flat.reshape(keys.shape)


class Codec:
    """Encodes pieces by the ranks of a vocabulary and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pairs: PairTable):
        self.ranks, self.pairs = ranks, pairs
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is a token is that token; the others go by length into matrices."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[n] = np.array([rank], np.int64)
            else:
                width = next((w for w in _WIDTHS if w >= len(piece)), 1 << (len(piece) - 1).bit_length())
                buckets.setdefault(width, []).append(n)
        for width, numbers in buckets.items():
            rows = max(1, (1 << 18) // width)
            for at in range(0, len(numbers), rows):
                part = numbers[at : at + rows]
                for n, ids in zip(part, self._merge([pieces[n] for n in part], width)):
                    out[n] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.of_byte[data], -1)
        if (ids[np.arange(width) < lengths[:, None]] < 0).any():
            raise ValueError("a byte of the text is not in the vocabulary")
        done: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        rank = self.pairs.of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)  # leftmost of the lowest
            least = rank[np.arange(len(rows)), at]
            over = least == _NONE
            if over.any():
                for n in np.flatnonzero(over):
                    done[rows[n]] = ids[n][ids[n] >= 0]
                live = ~over
                rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
                if not len(rows):
                    break
            if width > _WIDTHS[-1]:
                ids, rank = self._merge_long(ids, rank, at, least)
            else:
                ids, rank = self._merge_one(ids, rank, at, least)
        return done

    def _merge_one(self, ids, rank, at, least):
        """Merge the pair at `at` in each row and close the gap."""
        n, width = ids.shape
        row = np.arange(n)
        ids[row, at] = least
        column = np.arange(width - 1)
        ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), np.arange(width - 1) + (column > at[:, None]), axis=1)
        used = max(1, int((ids >= 0).sum(axis=1).max(initial=1)))
        ids = ids[:, :used]  # compaction: columns that no row uses any more go
        if used == 1:
            return ids, np.full((n, 1), _NONE, np.int64)
        rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), np.arange(used - 1) + (np.arange(used - 1) > at[:, None]), axis=1)
        # Only the pairs on both sides of the merged token are new.
        for place in (at - 1, at):
            ok = np.flatnonzero((place >= 0) & (place < used - 1))
            rank[ok, place[ok]] = self.pairs.of(ids[ok, place[ok]], ids[ok, place[ok] + 1])
        return ids, rank

    def _merge_long(self, ids, rank, at, least):
        """The same for long pieces, one by one: all places of the lowest pair at once, from the left and without
        overlap. That equals one merge a round unless a pair ranks lower that arises at the end or on the way (a
        merged token and the left half of the next place); then only the leftmost merges."""
        out_ids, out_rank = [], []
        for n in range(len(ids)):
            row, ranks = ids[n][ids[n] >= 0], None
            pair = rank[n][: len(row) - 1]
            for every in (True, False):
                places = np.flatnonzero(pair == least[n]) if every else at[n : n + 1]
                if every and len(places) > 1:
                    gap = np.diff(places) > 1
                    run = np.concatenate([[0], np.cumsum(gap)])
                    first = places[np.concatenate([[True], gap])]
                    places = places[(places - first[run]) % 2 == 0]
                new = row.copy()
                new[places] = least[n]
                keep = np.ones(len(row), bool)
                keep[places + 1] = False
                new = new[keep]
                ranks = self.pairs.of(new[:-1], new[1:])
                if len(places) == 1:
                    break
                half = row[places[1:][np.diff(places) == 2]]
                on_the_way = self.pairs.of(np.full(len(half), least[n]), half)
                if min(ranks.min(initial=_NONE), on_the_way.min(initial=_NONE)) >= least[n]:
                    break
            out_ids.append(new), out_rank.append(ranks)
        used = max(map(len, out_ids))
        ids = np.full((len(out_ids), used), -1, np.int64)
        rank = np.full((len(out_ids), max(1, used - 1)), _NONE, np.int64)
        for n, (new, ranks) in enumerate(zip(out_ids, out_rank)):
            ids[n, : len(new)], rank[n, : len(ranks)] = new, ranks
        return ids, rank


def decode_ids(tokens: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces, up to a bound."""

    def __init__(self, codec: Codec, pattern: str):
        self.codec, self.pattern = codec, regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.pool = WordIds(), np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; pieces not seen before are encoded together."""
        numbers = [self.numbers.of_all(matches(self.pattern, t)) for t in texts]
        if fresh := self.numbers.take():
            ids = self.codec.encode([p.encode("utf-8") for p in fresh])
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.pool = np.concatenate([self.pool, *ids]).astype(np.int32)
        out = []
        for n in numbers:
            length = self.length[n]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.pool[np.repeat(self.start[n] - (ends - length), length) + np.arange(total)])
        if self.numbers.full():
            self.clear()
        return out


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each text (array of int) by the vocabulary file at `path`, each match of `pattern` by
    itself and without special tokens. A null text counts as empty and has an empty array. Repeated rows and
    extra columns pass; an input column named like the result is replaced. Whole texts are encoded."""
    spark = prepare(docs.sparkSession)
    # Vocabulary and pair table go to each executor once: a file of some hundred kB and the 10 to 20 MB made of it,
    # whatever the data.
    ranks = read_ranks(path)
    pairs = PairTable.build(ranks)
    sent = spark.sparkContext.broadcast((ranks, pairs.keys, pairs.ranks, pairs.probes))

    @F.pandas_udf("array<int>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, *arrays = sent.value
        encoder = Encoder(Codec(vocabulary, PairTable(*arrays)), pattern)
        for batch in texts:
            yield pd.Series(encoder.encode(t or "" for t in batch), dtype=object)

    return docs.withColumn(ids, encoded(text))


def decode(docs: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add the bytes that each array of ids stands for. A null array gives no bytes; an unknown id is an error."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(path).items()})

    @F.pandas_udf("binary")
    def decoded(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = sent.value
        for batch in arrays:
            yield pd.Series([b"" if a is None else decode_ids(tokens, a.tolist()) for a in batch], dtype=object)

    return docs.withColumn(data, decoded(ids))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of ids and the hashes of the ids and of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text"), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
