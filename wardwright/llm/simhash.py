"""SimHash near-duplicates: fingerprints, and BK-trees over shards of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import lower_words, prepare, table
from wardwright.llm.graph import components
from wardwright.session import settle

SEED = 42


class BKTree:
    """Fingerprints as nodes; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, mark: int) -> None:
        self.prints.append(mark)
        self.children.append({})
        new, node = len(self.prints) - 1, 0
        while new:
            distance = (mark ^ self.prints[node]).bit_count()
            child = self.children[node].setdefault(distance, new)
            if child == new:
                return
            node = child

    def near(self, mark: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius. By the triangle inequality only edges whose key differs from
        the distance to their parent by no more than the radius lead to any."""
        stack = [0] if self.prints else []
        while stack:
            node = stack.pop()
            distance = (mark ^ self.prints[node]).bit_count()
            if distance <= radius:
                yield node
            children = self.children[node]
            if children:
                stack += [children[edge] for edge in range(distance - radius, distance + radius + 1) if edge in children]


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The SimHash of a text over word shingles, repeats counted; 0 for a text without words."""
    ones, count, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in lower_words((text or "").encode("utf-8")):
        words = carry + words
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        if ends:
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            count += len(ends)
        carry = words[len(words) - shingle + 1 :] if shingle > 1 else []
        if not ends:
            carry = words
    if not count:
        if not carry:
            return 0
        return digest(b" ".join(carry), seed)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """Add `fingerprint`, a long whose bits are the SimHash."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def printed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).astype(np.int64))

    return docs.withColumn("fingerprint", printed(text))


def split_masks(free: int, parts: int) -> list[int]:
    """The set bits of `free` dealt to `parts` masks of neighbouring bits."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once per mask: (mask, bits under it, fingerprint, node)."""
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("mark").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks])
    return rows.select(F.explode(keys).alias("key"), "mark", "node").select("key.mask", "key.bits", "mark", "node")


def _tree_links(radius: int):
    """Links of each shard, from rows that come sorted by shard."""

    def shard_links(marks: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
        tree, top, links = BKTree(), [], []

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for k, mark in enumerate(marks.view(np.uint64).tolist()):
            top.append(k)
            # A link inside what is linked already adds nothing to the components.
            for other in tree.near(mark, radius):
                if (a := root(other)) != (b := root(k)):
                    top[max(a, b)] = min(a, b)
                    links.append((int(nodes[k]), int(nodes[other])))
            tree.add(mark)
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            held = [x for x in (rest, batch) if x is not None]
            if not held:
                return
            rows = pd.concat(held) if len(held) > 1 else held[0]
            if rows.empty:
                continue
            mask, bits = rows["mask"].to_numpy(), rows["bits"].to_numpy()
            marks, nodes = rows["mark"].to_numpy(), rows["node"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]))
            ends = np.append(starts[1:], len(rows))
            whole = len(starts) if batch is None else len(starts) - 1  # the last shard may go on in the next batch
            links = [x for a, b in zip(starts[:whole], ends[:whole]) if b - a > 1 for x in shard_links(marks[a:b], nodes[a:b])]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
            rest = None if batch is None else rows.iloc[starts[whole] :]

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def near_links(marks: DataFrame, radius: int, shard_limit: int = 20_000) -> DataFrame:
    """Links (a, b) between the nodes of `marks` (mark, node; marks distinct) that connect all marks at most
    `radius` bits apart.

    The 64 bits are cut into radius + 1 blocks: marks within the radius agree in one block at least, so a shard
    holds the marks that agree in one, and each shard has its tree. A shard over `shard_limit` is not searched
    but cut again by blocks of the bits left over, until the bits themselves bound it (2 ** 20 marks for radius 2).
    """
    masks = split_masks((1 << 64) - 1, radius + 1)
    keyed, found = _keyed(marks, masks), None
    while True:
        bounded = all((((1 << 64) - 1) & ~m).bit_count() <= 20 for m in masks)
        hot = None
        if not bounded:
            hot = settle(keyed.groupBy("mask", "bits").count().where(F.col("count") > shard_limit).select("mask", "bits"), "hot-shards")
            hot = None if hot.isEmpty() else hot
        cold = keyed if hot is None else keyed.join(hot, ["mask", "bits"], "left_anti")
        links = settle(cold.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "mark")
                       .mapInPandas(_tree_links(radius), "a long, b long"), "near-links")
        found = links if found is None else found.union(links)
        if hot is None:
            return found
        rows = keyed.join(hot, ["mask", "bits"], "left_semi")
        parts = []
        for mask in masks:
            children = [mask | m for m in split_masks(((1 << 64) - 1) & ~mask, radius + 1)]
            parts.append(_keyed(rows.where(F.col("mask") == _signed(mask)), children))
        keyed = parts[0]
        for part in parts[1:]:
            keyed = keyed.union(part)
        keyed = settle(keyed, "hot-marks")
        masks = [mask | m for mask in masks for m in split_masks(((1 << 64) - 1) & ~mask, radius + 1)]


def near_duplicates(docs: DataFrame, shingle: int, radius: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the SimHash and the smallest id reachable over links of
    at most `radius` differing bits, itself included.

    Copies share a fingerprint and are folded to one before any search; no pair of copies is ever made. Null and
    blank texts have fingerprint 0 and are linked like any other. Rows with a null id link nothing themselves; they
    get the component of their fingerprint if a row with an id has the same, else null. Repeated rows stay as many
    as they are. An empty table gives an empty result; other columns are not carried.
    """
    printed = settle(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle)
                     .select("doc_id", "fingerprint"), "fingerprints")
    marks = settle(printed.where("doc_id IS NOT NULL").groupBy(F.col("fingerprint").alias("mark"))
                   .agg(F.min("doc_id").alias("node")), "distinct-prints")
    roots = components(near_links(marks, radius))
    classes = settle(marks.join(roots, "node", "left").select(
        F.col("mark").alias("fingerprint"), F.coalesce("root", "node").alias("component_id")), "print-classes")
    return printed.join(classes, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
