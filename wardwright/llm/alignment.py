"""Alignment of two tokenizers' tokens: windows between whitespace anchors, aligned once per pair of id tuples."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table
from wardwright.session import settle

_BLOCK = 4 << 20  # characters of text, about, whose documents share one row of id pairs
_LONG = 1 << 18  # longer texts are tokenised in parts, cut where both tokenizers must cut
_MEMO = 400_000  # windows that a task remembers
_PLAIN = 64  # links of a group up to which they are listed one by one
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the
    others, in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file; it is given the text with a space before it.

    Files whose merges stand in the order of their ids, cut by the usual expression, give the same ids by ranks, which is much
    faster. That is done for texts of characters below U+0250, whose classes no version of Unicode has changed.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library would spin on others
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        entries = sorted((number, token) for token, number in self.model.get_vocab().items())
        self.bytes = [b""] * (entries[-1][0] + 1)
        for number, token in entries:
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut, model = told.get("pre_tokenizer") or {}, told["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        by_rank = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not told.get("normalizer")
                   and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))
                   and all(model["vocab"].get("".join(m)) == 256 + k for k, m in enumerate(merges)))
        ranks = {bytes(letters[c] for c in token): number for token, number in model["vocab"].items() if number < 256 + len(merges)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if by_rank else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [bool(self.ranks) and not _NEWER.search(t) for t in texts]
        others = iter(self.model.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.ranks.encode_ordinary(" " + t) if p else next(others).ids for t, p in zip(texts, plain)]

    def decode(self, ids: list[int]) -> bytes:
        return self.ranks.decode_bytes(ids) if self.ranks else b"".join(map(self.bytes.__getitem__, ids))


#: The expression that byte-level files cut texts by (a fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEWER = re.compile("[^\x00-\u024f]")


class Pieces:
    """A sentence-piece file; its pieces write the space as U+2581, and it puts one before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        #: No piece goes on behind a space, so no merge crosses the end of a word.
        self.cuts_at_spaces = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def parts_of(text: str, size: int = _LONG) -> list[str]:
    """A long text cut between a letter and a space before a letter; the space is left out, as both tokenizers see one
    before every part. Without such places it stays whole."""
    parts, start = [], 0
    while len(text) - start > size and (m := _CUT.search(text, start + size)):
        parts.append(text[start : m.start()])
        start = m.start() + 1
    return [*parts, text[start:]]


class Windows:
    """Aligns windows of token ids and remembers them by their ids: groups as text, numbers of groups and links, and
    which pairs of ids are linked how often, end to end in two arrays."""

    def __init__(self, first, second):
        self.tokenizers = (first, second)
        self.lengths = [[len(b) for b in t.bytes] for t in self.tokenizers]
        self.arrays = [np.array(n, np.int64) for n in self.lengths]
        self.marked = [np.array([b[:1] == b" " for b in t.bytes], bool) for t in self.tokenizers]
        self.names = [[str(k) for k in range(len(t.bytes))] for t in self.tokenizers]
        self.other = len(second.bytes)  # a pair of ids is one number: first * other + second
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        # Per window: groups, links, and where its pairs end.
        self.groups, self.links, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.fresh: list[tuple[bytes, bytes]] = []  # ids, packed

    def settle(self) -> None:
        """Align the windows met since the last time, all at once: tokens are in one group up to the next byte where
        tokens of both end. Laid end to end the windows stay apart, as both tokenizers end at the end of each."""
        if not self.fresh:
            return
        ids = [np.frombuffer(b"".join([w[side] for w in self.fresh]), np.uint32).astype(np.int64) for side in (0, 1)]
        ends = [np.cumsum(n[k]) for n, k in zip(self.arrays, ids)]
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, e) for e in ends]
        size = [np.bincount(g, minlength=len(shared)) for g in group]
        start = [np.cumsum(n) - n for n in size]
        window = np.searchsorted(np.cumsum([len(w[0]) // 4 for w in self.fresh]), start[0], "right")  # of each group
        # Every first token with each second token of its group, in order; large groups are listed by different ids.
        links = size[0] * size[1]
        small = links[group[0]] <= _PLAIN
        reach = np.where(small, size[1][group[0]], 0)
        begin = np.cumsum(reach) - reach
        second = np.arange(reach.sum()) + np.repeat(start[1][group[0]] - begin, reach)
        pairs = np.repeat(ids[0], reach) * self.other + ids[1][second]
        owner, times = np.repeat(window[group[0]], reach), np.ones(len(pairs), np.int64)
        for g in np.flatnonzero(links > _PLAIN).tolist():
            (left, n), (right, m) = (np.unique(k[at[g] : at[g] + many[g]], return_counts=True) for k, at, many in zip(ids, start, size))
            pairs = np.concatenate([pairs, (left[:, None] * self.other + right).ravel()])
            times = np.concatenate([times, (n[:, None] * m).ravel()])
            owner = np.concatenate([owner, np.full(len(left) * len(right), window[g])])
        order = np.argsort(owner, kind="stable")
        filled, n = int(self.ends[-1]), len(self.fresh)
        while filled + len(pairs) > len(self.pairs):
            self.pairs, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pairs, self.times))
        self.pairs[filled : filled + len(pairs)], self.times[filled : filled + len(pairs)] = pairs[order], times[order]
        self.ends = np.concatenate([self.ends, filled + np.cumsum(np.bincount(owner, minlength=n))])
        self.groups = np.concatenate([self.groups, np.bincount(window, minlength=n)])
        self.links = np.concatenate([self.links, np.bincount(window, links, n).astype(np.int64)])
        first, second = (list(map(names.__getitem__, k.tolist())) for names, k in zip(self.names, ids))
        text = [f"{first[s]}|{second[t]}" if a == 1 == b else ",".join(first[s : s + a]) + "|" + ",".join(second[t : t + b])
                for s, t, a, b in zip(*(x.tolist() for x in (*start, *size)))]
        stops = np.cumsum(np.bincount(window, minlength=n)).tolist()
        self.text += [";".join(text[s:e]) for s, e in zip([0, *stops], stops)]
        self.fresh = []

    def of(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """The windows of a text, by number; new ones are aligned by `settle`. They end where tokens of both end and tokens
        of both begin with a space."""
        starts = []
        for ids, lengths, marked in zip((first, second), self.arrays, self.marked):
            place = np.flatnonzero(marked[ids[1:]]) + 1
            starts.append((place, np.cumsum(lengths[ids])[place - 1]))
        (a, a_end), (b, b_end) = starts
        if len(a) and len(b):
            met = np.minimum(np.searchsorted(b_end, a_end), len(b) - 1)
            shared = b_end[met] == a_end
            a, b = (4 * a[shared]).tolist(), (4 * b[met[shared]]).tolist()
        else:
            a, b = [], []
        left, right, known, found = first.tobytes(), second.tobytes(), self.known, []
        get, append, s, t = known.get, found.append, 0, 0
        for e, u in zip([*a, len(left)], [*b, len(right)]):
            # The two tuples of ids, packed, with a number between them that is no id.
            x, y = left[s:e], right[t:u]
            key = x + b"\xff\xff\xff\xff" + y
            number = get(key)
            if number is None:
                known[key] = number = len(known)
                self.fresh.append((x, y))
            append(number)
            s, t = e, u
        return found

    def counted(self, found: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of a text, sorted, and how often each is linked."""
        number, n = np.unique(np.array(found), return_counts=True)
        start, end = self.ends[number], self.ends[number + 1]
        size = end - start
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        pairs, place = np.unique(self.pairs[at], return_inverse=True)
        return pairs, np.bincount(place, self.times[at] * np.repeat(n, size), len(pairs)).astype(np.int64)


def _small(values: np.ndarray) -> tuple[str, bytes]:
    """An array of whole numbers in the narrowest type that holds it."""
    kind = np.min_scalar_type(int(values.max(initial=0))).str
    return kind, values.astype(kind).tobytes()


class Block:
    """The documents of one block: their figures, and their linked pairs as places in the block's list of pairs."""

    def __init__(self, windows: Windows, digest: bool):
        self.windows, self.digest, self.size = windows, digest, 0
        self.rows: list[tuple] = []
        self.entries: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, keys: list, texts: list[str | None]) -> None:
        """Tokenise a batch whole and align it."""
        w = self.windows
        parts = [parts_of(t) if t and w.tokenizers[1].cuts_at_spaces else [t or ""] for t in texts]
        flat = [p for ps in parts for p in ps]
        encoded = [t.encode(flat) for t in w.tokenizers]
        at, rows = 0, []
        for key, text, ps in zip(keys, texts, parts):
            both = [e[at] if len(ps) == 1 else [i for ids in e[at : at + len(ps)] for i in ids] for e in encoded]
            at += len(ps)
            data = b" " + (text or "").encode()
            if text and all(t.decode(ids) == data for t, ids in zip(w.tokenizers, both)):
                rows.append((key, len(both[0]), len(both[1]), w.of(*(np.array(ids, np.uint32) for ids in both))))
            else:
                rows.append((key, 0, 0, []))
            self.size += len(text or "")
        w.settle()
        for key, n_a, n_b, found in rows:
            if not found:
                self._row(key, 0, 0, 0, 0, "", 0)
                continue
            pairs, times = w.counted(found)
            self.entries.append(pairs)
            self.times.append(times)
            groups = ";".join(map(w.text.__getitem__, found))
            self._row(key, n_a, n_b, int(w.groups[found].sum()), int(w.links[found].sum()),
                      sha256(groups.encode()).hexdigest() if self.digest else groups, len(pairs))
        if len(w.known) > _MEMO:
            w.clear()

    def _row(self, *values) -> None:
        self.rows.append(values)

    def packed(self, number: int) -> dict:
        entries = np.concatenate([*self.entries, np.zeros(0, np.int64)])
        pairs, place, n = np.unique(entries, return_inverse=True, return_counts=True)
        at, times = _small(place), _small(np.concatenate([*self.times, np.zeros(0, np.int64)]))
        names = ("keys", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs")
        return {"block": number, "pairs": pairs, "documents": n, "at_type": at[0], "at": at[1], "times_type": times[0], "times": times[1],
                **dict(zip(names, map(list, zip(*self.rows))))}


def _blocks(first_path: str, second_path: str, digest: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 50)  # many lists and strings are made here, and no cycles
        windows = Windows(ByteLevel(first_path), Pieces(second_path))
        number = TaskContext.get().partitionId() << 32

        def packed(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block.packed(number)], schema=schema)

        block = Block(windows, digest)
        for batch in batches:
            for at in range(0, len(batch), 100):
                block.add(batch.column(0).slice(at, 100).to_pylist(), batch.column(1).slice(at, 100).to_pylist())
                if block.size >= _BLOCK:
                    yield packed(block)
                    number, block = number + 1, Block(windows, digest)
        if block.rows:
            yield packed(block)

    return run


def _judged(schema: pa.Schema):
    """From blocks with the counts of their pairs to a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                counts = row["counts"].values.flatten() if row["counts"].is_valid else []
                n, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if len(counts):
                    place = counts[0].to_numpy()
                    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                    n[place], best[place] = counts[1].to_numpy(), counts[2].to_numpy(zero_copy_only=False)
                at = np.frombuffer(row["at"].as_py(), row["at_type"].as_py()).astype(np.int64)
                times = np.frombuffer(row["times"].as_py(), row["times_type"].as_py()).astype(np.int64)
                ends = np.cumsum(row["n_pairs"].values.to_numpy())
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * n[at])]
                n_best, total = (s[ends] - s[np.concatenate([[0], ends[:-1]])] for s in sums)
                columns = [row[c].values for c in ("keys", "n_a", "n_b", "n_groups", "n_links")]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(total), row["groups"].values], schema=schema)
                for start in range(0, len(out), 2000):
                    yield out.slice(start, 2000)

    return run


def align(docs: DataFrame, first_path: str, second_path: str, doc_key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    The first tokenizer is a byte-level BPE file, given the text with a space before it, the second a sentence-piece file, which
    adds one. Tokens are in one group up to the next byte where tokens of both end; within a group all are linked. `groups`
    lists them as `a1,a2|b1;a3|b2,b3` (with `digest` its SHA-256 in hex). A pair's count is the number of documents that link it;
    `n_best` counts the links whose count is the highest of their first id, `count_sum` adds up the counts of all links.

    Texts are tokenised whole, those beyond 262,144 characters in parts cut where no token can cross. They are cut into windows at
    anchors, verified bytes where tokens of both end and tokens of both begin with a space, and each pair of id tuples is aligned
    once. Documents travel in blocks of some 8 MB of text, which ask for the counts of their distinct pairs only, so
    neither the pairs of documents nor the table of counts is sent anywhere whole.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have zeros and an empty
    `groups`. Every row is a document, also where keys repeat or are null. Other columns are left out. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    key_type = docs.schema[doc_key].dataType.simpleString()
    figures = ("n_a", "n_b", "n_groups", "n_links")
    ddl = (f"block long, pairs array<long>, documents array<long>, at_type string, at binary, times_type string, times binary, keys array<{key_type}>, "
           + ", ".join(f"{c} array<long>" for c in figures) + ", groups array<string>, n_pairs array<long>")
    empty = spark.createDataFrame([], ddl)
    blocks = settle(docs.select(doc_key, text).mapInArrow(_blocks(first_path, second_path, digest, empty.toArrow().schema), ddl), "aligned-blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("block", "place", "x.*")
    counts = settle(asked.groupBy("pairs").agg(F.sum("documents").alias("n")), "pair-counts")
    other = len(Pieces(second_path).bytes)
    first = F.floor(F.col("pairs") / other)
    highest = counts.groupBy(first.alias("first")).agg(F.max("n").alias("highest"))
    rated = settle(counts.withColumn("first", first).join(highest, "first").select("pairs", "n", (F.col("n") == F.col("highest")).alias("best")), "rated-pairs")
    replies = asked.join(rated, "pairs").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("counts"))
    out = f"{doc_key} {key_type}, " + ", ".join(f"{c} long" for c in (*figures, "n_best", "count_sum")) + ", groups string"
    return (blocks.drop("pairs", "documents").join(replies, "block", "left")
            .mapInArrow(_judged(spark.createDataFrame([], out).toArrow().schema), out))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                    digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")
