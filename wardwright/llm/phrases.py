"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count the proposals and their negative border."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardwright.llm.common import WordIds, _mix, prepare, table
from wardwright.session import settle

LONGEST = 4  # words of a phrase
SUPPORT = 30  # occurrences that make a phrase a candidate
SAMPLE = 8  # one document in so many is in the sample
CAUTION = 0.6  # the sample's support is this part of the share it should have, so that few phrases are missed
COVER = (80, 100)  # a longer phrase with at least this share of the occurrences covers the phrases inside it
TOP = 2000
_STREAM = 1 << 12  # words of a stored stream, about; Parquet pages hold a hundred rows at least
_TOGETHER = 1 << 19  # words that are counted together in a task
_SLICES = 256  # of the hash space, at least
_SLICE = 1 << 22  # words of the corpus for each slice; few, large slices, as every task makes a row for each
_ROWS = 16  # packed rows of an Arrow batch
_HELD = 1 << 18  # counts that are held before they are added up, at least
_BITS = (20, 29)  # bounds of a filter's size, as powers of two: 128 kB to 64 MB

_ENDS = b".,;:!?\n\v\f\r"
#: A-Z to lower case, every piece end to a full stop, tab to space.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"." * len(_ENDS) + b" ")


def folded_words(text: str, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, with b"." for the end of a piece; a block at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(data):
        end = start + block
        while end < len(data) and data[end] not in b" .":  # cut between words only
            end += 1
        # Only the space is left of what split() would split at.
        yield data[start:end].replace(b".", b" . ").split()
        start = end


# --- texts as numbers -----------------------------------------------------------

STREAMS = "lang string, sampled boolean, n long, codes binary, words array<string>, word_codes array<long>"


class Encoder:
    """Writes texts as 64-bit word codes, 0 between pieces, and remembers which words are new to it."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words = WordIds()
        self.words[b"."]  # number 0, code 0
        self.codes = np.zeros(0, np.uint64)

    def encode(self, text: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        from xxhash import xxh64_intdigest

        ids = self.words.of_all(folded_words(text))
        fresh = self.words.take()
        codes = np.fromiter((0 if w == b"." else xxh64_intdigest(w) or 1 for w in fresh), np.uint64, len(fresh))
        self.codes = np.concatenate([self.codes, codes]) if len(fresh) else self.codes
        out = self.codes[ids]
        if self.words.full():
            self.clear()
        return out, fresh, codes


def _encoded(schema: pa.Schema):
    """Texts -> rows of some _STREAM words of one language, and with each the words that the task has not reported yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, sizes, words, codes = Encoder(), {}, {}, [], []

        def row(key: tuple) -> pa.RecordBatch:
            stream = np.concatenate(held.pop(key))
            out = {"lang": key[0], "sampled": key[1], "n": int(np.count_nonzero(stream)), "codes": stream.tobytes(),
                   "words": [w for w in words if w != b"."], "word_codes": [c for c in codes if c]}
            del sizes[key], words[:], codes[:]
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in batches:
            for k in range(len(batch)):
                lang, sampled, text = (c[k].as_py() for c in batch.columns)
                stream, fresh, new = encoder.encode(text)
                words += fresh
                codes += new.astype(np.int64).tolist()
                held.setdefault((lang, sampled), []).extend((stream, np.zeros(1, np.uint64)))
                sizes[lang, sampled] = sizes.get((lang, sampled), 0) + len(stream)
                if sizes[lang, sampled] >= _STREAM:
                    yield row((lang, sampled))
        for key in list(held):
            yield row(key)

    return run


# --- counting -------------------------------------------------------------------

class Filter:
    """A set of phrase hashes as bits. It may hold phrases that were never put in, which costs counting, no result."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.shift = np.uint64(64 - (len(data).bit_length() + 2))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrase_hashes(codes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the phrases of so many words that start at `at`; the last two bits tell how many."""
    total = np.full(len(at), words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[at + k]
        return _mix(total) & ~np.uint64(3) | np.uint64(words - 1)


def _levels(stream: np.ndarray, lang: str):
    """Word codes of a language's stream, so that no phrase is the same in two languages, and where its words stand."""
    from xxhash import xxh64_intdigest

    return _mix(stream ^ np.uint64(xxh64_intdigest(lang.encode()))), stream != 0


def _next(usable: np.ndarray) -> np.ndarray:
    """Where a phrase of one word more starts: both that begin here without its last word and without its first are usable."""
    return np.flatnonzero(usable[:-1] & usable[1:])


def border_hashes(stream: np.ndarray, lang: str, known: Filter | None, sizes: range) -> Iterator[np.ndarray]:
    """Hashes of the phrases to count: known ones and their negative border, which are those that leave a known phrase both
    without their last and without their first word. Beyond two words without `known`, none; below `sizes`, only looked at."""
    codes, inside = _levels(stream, lang)
    usable = np.concatenate([inside, [False]])
    for words in range(1, sizes.stop):
        at = np.flatnonzero(usable[:-1]) if words == 1 else _next(usable)
        hashes = phrase_hashes(codes, at, words)
        if words in sizes:
            yield hashes
        usable = np.zeros(len(usable), bool)
        # A longest phrase that is counted here may itself be new, so what is longer builds on all that are counted.
        usable[at if known is None or words in sizes and sizes.start > 1 else at[known.has(hashes)]] = True


def exact_phrases(stream: np.ndarray, lang: str, proposed: Filter, found: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hashes, places) of the phrases to count by their words: those found frequent, and those that the failures of the border
    make possible. The pass before counted a phrase if both parts, without its last and without its first word, were counted
    and proposed. A phrase that it counted is taken if it was found; one that it did not count may be frequent if both
    parts are taken. Filters are asked only about what was counted, so a bit that other phrases have set adds to the counting, no more."""
    codes, inside = _levels(stream, lang)
    usable = np.concatenate([inside, [False]])
    grown = usable  # where the pass before went on to a word more
    for words in range(1, LONGEST + 1):
        at = np.flatnonzero(usable[:-1]) if words == 1 else _next(usable)
        hashes = phrase_hashes(codes, at, words)
        counted = grown[at] & grown[at + 1] if words > 1 else np.ones(len(at), bool)
        taken = ~counted | found.has(hashes)
        yield words, hashes[taken], at[taken]
        usable, grown = np.zeros(len(usable), bool), np.zeros(len(usable), bool)
        usable[at[taken]] = True
        grown[at[counted & proposed.has(hashes)]] = True


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Stored streams of a language, put together up to _TOGETHER words."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for k in range(len(batch)):
            lang, stream = batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_py(), np.uint64)
            parts = held.setdefault(lang, [])
            parts.append(stream)
            if sum(map(len, parts)) >= _TOGETHER:
                yield lang, np.concatenate(held.pop(lang))
    for lang, parts in held.items():
        yield lang, np.concatenate(parts)


# Counts travel packed: a row holds the counts of one slice of the hash space, so that few bytes go through the shuffle, and
# each slice is added up by itself. There are as many slices as keep one small, however large the corpus.

PACKED = "slice long, lang string, hashes binary, columns binary, kind string, n binary"


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, their first bytes together, then their second ones and so on; the high ones are
    mostly zero and compress to nothing."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(values: np.ndarray) -> tuple[str, np.ndarray]:
    kind = np.min_scalar_type(int(values.max(initial=0))).str
    return kind, values.astype(kind)


def _cuts(hashes: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """Sorted hashes by slice: (slice, start, end) of those that hold any."""
    bounds = np.array([(k << 64) // slices for k in range(slices)], np.uint64)
    at = np.searchsorted(hashes, bounds).tolist() + [len(hashes)]
    return [(k, at[k], at[k + 1]) for k in range(slices) if at[k] < at[k + 1]]


def _packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as the JVM holds a batch outside its heap."""
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary())
    for at in range(0, len(rows), _ROWS):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows[at : at + _ROWS]), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "lang", "hashes", "columns", "kind", "n"])


def _border_counts(known, sizes: range, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed = known and Filter(known.value)
        for lang, stream in _streams(batches):
            hashes, n = np.unique(np.concatenate(list(border_hashes(stream, lang, proposed, sizes))), return_counts=True)
            kind, n = _narrow(n)
            rows = [(k, "", _planes(hashes[a:b]), b"", kind, n[a:b].tobytes()) for k, a, b in _cuts(hashes, slices)]
            yield from _packed(rows)

    return run


def _exact_counts(proposed, found, slices: int):
    """The same for phrases by their words: per row the word codes that occur, and each phrase as places among them, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filter(proposed.value), Filter(found.value)
        for lang, stream in _streams(batches):
            parts = []
            for words, hashes, at in exact_phrases(stream, lang, *filters):
                order, first = _equal(hashes, [stream[at + k] for k in range(words)])
                own = at[order[first]]
                codes = np.zeros((LONGEST, len(own)), np.uint64)
                codes[:words] = stream[own[None, :] + np.arange(words)[:, None]]
                parts.append((hashes[order[first]], codes, np.diff(first, append=len(at))))
            hashes, codes, n = (np.concatenate(x, axis=-1) for x in zip(*parts))
            order = np.argsort(hashes)
            kind, n = _narrow(n[order])
            rows = []
            for k, a, b in _cuts(hashes[order], slices):
                own, places = np.unique(codes[:, order[a:b]], return_inverse=True)
                if own[0]:  # all of four words
                    own, places = np.concatenate([np.zeros(1, np.uint64), own]), places + 1
                rows.append((k, lang, _planes(own[1:]), places.astype(np.uint32).tobytes(), kind, n[a:b].tobytes()))
            yield from _packed(rows)

    return run


def _equal(hashes: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it each different row begins. Rows are sorted by their hashes; by their
    columns too only if different rows have the same hash."""
    order = np.argsort(hashes)
    for again in (False, True):
        same = np.diff(hashes[order], prepend=~hashes[order[:1]]) == 0
        new = np.logical_or.reduce([~same, *(np.diff(c[order], prepend=~c[order[:1]]) != 0 for c in columns)])
        if again or not (same & new).any():
            return order, np.flatnonzero(new)
        order = np.lexsort([*columns, hashes])


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of `keys` added up."""
    columns = list(keys.T)
    hashes = columns[0]
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            hashes = _mix(hashes) * np.uint64(0x9E3779B97F4A7C15) + c
    order, first = _equal(hashes, columns if len(columns) > 1 else [])
    return keys[order[first]], np.add.reduceat(n[order], first)


def _sums(exact: bool, support: int):
    """Packed rows sorted by slice and language -> the sums that reach the support. What is held is added up whenever it has
    doubled, so a slice takes as much memory as it has different phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, room = None, [], 0, _HELD

        def total() -> tuple[np.ndarray, np.ndarray]:
            return _added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def result() -> pa.RecordBatch:
            keys, n = total()
            keys, n = keys[n >= support].view(np.int64), n[n >= support]
            if not exact:
                return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(n)], names=["hash", "n"])
            lang = pa.array([key[1]], pa.string()).take(pa.array(np.zeros(len(n), np.int64)))
            codes = [pa.array(keys[:, k], mask=keys[:, k] == 0) for k in range(LONGEST)]
            return pa.RecordBatch.from_arrays([lang, *codes, pa.array(n)], names=["lang", "c1", "c2", "c3", "c4", "n"])

        for batch in batches:
            for k in range(len(batch)):
                slice_, lang, hashes, columns, kind, n = (c[k].as_py() for c in batch.columns)
                if held and (slice_, lang) != key:
                    yield result()
                    held, size, room = [], 0, _HELD
                key, values = (slice_, lang), _of_planes(hashes)
                if exact:
                    places = np.frombuffer(columns, np.uint32).reshape(LONGEST, -1).T
                    values = np.concatenate([np.zeros(1, np.uint64), values])[places]
                held.append((values.reshape(len(values), -1), np.frombuffer(n, kind).astype(np.int64)))
                size += len(values)
                if size > room:
                    held = [total()]
                    size = len(held[0][1])
                    room = max(_HELD, 2 * size)
        if held:
            yield result()

    return run


def _filter(rows: DataFrame):
    """Broadcast bits of the hashes of `rows`: 16 per phrase, within fixed bounds."""
    spark = rows.sparkSession
    bits = min(max((16 * rows.count()).bit_length(), _BITS[0]), _BITS[1])
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1
    blocks = rows.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    data = np.zeros((1 << bits) // 8, np.uint8)
    for block, part in blocks.collect():  # 4 kB each, 64 MB in all at most
        data[(block - 1) * 4096 : block * 4096] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(data.tobytes())


def _summed(counted: DataFrame, exact: bool, support: int) -> DataFrame:
    out = "lang string, c1 long, c2 long, c3 long, c4 long, n long" if exact else "hash long, n long"
    return settle(counted.repartition("slice").sortWithinPartitions("slice", "lang").mapInArrow(_sums(exact, support), out), "phrase-counts")


def _counted(streams: DataFrame, known, sizes: range, support: int, slices: int) -> DataFrame:
    """(hash, n) of what is counted and reaches the support. Tasks add up what they read, so no hash is hot."""
    return _summed(streams.select("lang", "codes").mapInArrow(_border_counts(known, sizes, slices), PACKED), False, support)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, sample: int = SAMPLE) -> DataFrame:
    """(lang, words, phrase, n): phrases of 1 to 4 words with `support` occurrences or more, and a row of `words` 0 per
    language with the number of all its words.

    Toivonen's algorithm. One document in `sample`, chosen by a hash of the row, is mined with a lowered support; what is
    frequent there is proposed. A full pass counts the proposed phrases and their negative border. Those of the border that turn out
    frequent are failures; a further pass counts all that they make possible, phrases that build on other possible
    ones included, which closes the border in one go. That pass counts by the words themselves, everything found before as well: hashes
    and filters, whose size is bounded, may let too much be counted but decide nothing.

    The sample grows with the corpus and settles only what is counted in which pass, never what is found. Texts are
    encoded once, 8 bytes a word, and read by the passes from the shared folder.
    """
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    chosen = F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]), F.lit(sample)) == 0
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), chosen.alias("sampled"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    streams = settle(rows.mapInArrow(_encoded(spark.createDataFrame([], STREAMS).toArrow().schema), STREAMS), "word-streams")
    few, lowered = streams.where("sampled"), max(2, int(np.ceil(support / sample * CAUTION)))
    slices = max(_SLICES, (streams.agg(F.sum("n")).first()[0] or 0) // _SLICE)
    short = _counted(few, None, range(1, 3), lowered, slices)
    long = _counted(few, _filter(short), range(3, LONGEST + 1), lowered, slices)
    proposed = _filter(short.unionByName(long))
    found = _filter(_counted(streams, proposed, range(1, LONGEST + 1), support, slices))
    codes = [f"c{k + 1}" for k in range(LONGEST)]
    exact = _summed(streams.select("lang", "codes").mapInArrow(_exact_counts(proposed, found, slices), PACKED), True, support)

    # Words for codes. Should two words share a code, their phrases cannot be told apart: better to stop than to add them up.
    asked = exact.select("lang", *codes, "n", F.posexplode(F.array_compact(F.array(*codes))).alias("place", "code"))
    reported = streams.select(F.explode(F.arrays_zip("words", "word_codes")).alias("x")).select(F.col("x.word_codes").alias("code"), F.col("x.words").alias("word"))
    wanted = settle(asked.select("code").distinct(), "frequent-codes")
    named = settle(reported.join(wanted, "code", "left_semi").groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("_last")), "frequent-words")
    if not named.where("word <> _last").isEmpty():
        raise ValueError("two words have the same 64-bit code")
    phrases = asked.join(named, "code").groupBy("lang", *codes, "n").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("_w"))
    phrases = phrases.select("lang", F.size("_w").alias("words"), F.array_join(F.col("_w.word"), " ").alias("phrase"), "n")
    totals = streams.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").select("lang", F.lit(0).alias("words"), F.lit("").alias("phrase"), "n")
    return settle(phrases.unionByName(totals), "frequent-phrases")


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """Each language's first `top` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs in a piece of text between `.,;:!?` and line ends, as words between spaces and tabs, A-Z lower-cased. It is cut
    in two where a / (l + r) is least (a: occurrences, l and r: those of the parts), the score being that quotient times two
    million, rounded down. Phrases inside a longer one with at least 80 % of their occurrences are dropped.
    Null texts are empty, a null language is `und`; repeated rows count as often as they occur; an empty table gives no rows. A text
    of any length is worked on in blocks. Other columns, whatever their names, have no part in the counts.
    """
    found = frequent_phrases(docs, text, lang, support, sample)
    phrases = found.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest"))
    left = phrases.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    scored = (cuts.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"])
              .withColumn("score", F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut")))
    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_size")
    inner = (candidates.where("words > 2").select("lang", "a", "words", "_w", sizes)
             .withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)))
             .groupBy("lang", part(F.col("_start"), F.col("_size")).alias("phrase")).agg(F.max("a").alias("_longer")))
    covered = F.col("_longer").isNotNull() & (_wide("_longer") * COVER[1] >= _wide("a") * COVER[0])
    kept = scored.join(inner, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = found.where("words = 0").select("lang", "n")
    return (kept.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
counts AS (
  SELECT lang, m, phrase, count(*) AS n FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM lists, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND n >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.n + y.n) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM candidates, (VALUES (2), (3)) AS sizes(z) WHERE z < m) GROUP BY ALL),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest x LEFT JOIN inner_phrases i USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
