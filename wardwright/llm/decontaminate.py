"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import WordIds, _mix, matches, prepare, table
from wardwright.session import settle

WINDOW = 8  # tokens of a template window
SHORT = 5  # window for items with fewer tokens than WINDOW; a shorter item is one window, found by equal tokens only
ENOUGH = 6  # matching windows that suffice (13 tokens in a row), or half of the item's windows if that is less
_FILTER_BITS = 22

#: Unit words that count as units behind a number (fixed values).
UNITS = frozenset("""mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg lb lbs oz ton tons pound pounds gram grams ml l liter
liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years k mph kmh
percent dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz w kw v a n j kj pa c f degree degrees meter meters metre metres""".split())
_SPACED = re.compile(r"\S+")
#: Scripts written without spaces (Thai to Khmer, kana, Han): each character is a word.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_NUMBER = re.compile(r"[^\w$€£+-]*([$€£]?)([+-]?\d+(?:[.,:/]\d+)*)(%|°?[A-Za-z]{0,4})[^\w%]*")
_ENDS = re.compile(r"[.!?:;…][\"')\]»”]*$")
LITERAL, NUMBER, UNIT, CAPITAL, NOTHING = range(5)
_PLACEHOLDER = {NUMBER: 0x4E554D, UNIT: 0x554E49, CAPITAL: 0x4E414D}


def canonical(word: str) -> tuple[list[tuple[int, str]], bool]:
    """What a spaced word stands for, as (kind, value) tokens, and whether a sentence ends with it."""
    ends = bool(_ENDS.search(word))
    if any(map(str.isdigit, word)) and (m := _NUMBER.fullmatch(word)):
        unit = m[1] or m[3].lower()
        return [(NUMBER, m[2])] + ([(UNIT, unit)] if unit else []), ends
    bare = "".join(filter(str.isalnum, word))
    if not bare:
        return [], ends
    low = bare.lower()
    if low in UNITS:
        return [(UNIT, low)], ends
    return [(CAPITAL if bare[0].isupper() and len(bare) > 1 and bare[1:].islower() else LITERAL, low)], ends


def spaced_words(text: str) -> Iterator[list[str]]:
    """The words of a text, blocks of them for long texts."""
    return matches(_SPACED if text.isascii() or not _ANY_UNSPACED.search(text) else _MIXED, text)


class Bitmap:
    """A set of hashes as bits of fixed size; it may hold what was never put in."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]


def _beside(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring token codes."""
    return _mix(left * np.uint64(0xC2B2AE3D27D4EB4F) + right)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if n > len(_POWERS[0]):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _hashes(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window: the sum of its codes, the k-th times the k-th power of the base."""
    power, inverse = _powers(len(code) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:-1], dtype=np.uint64)])
    return (total[size:] - total[:-size]) * inverse[: len(code) - size + 1] + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64))


def _readings(starts: np.ndarray, hashed: np.ndarray, slots: np.ndarray, size: int, capital: np.ndarray, turn: np.ndarray):
    """Windows with each choice of capitalised words read as names, up to half slots: start, hash, chosen places as bits.
    `turn` is what a name adds to the code of a word. In parts of bounded size."""
    inside = np.concatenate([[0], np.cumsum(capital)])
    choices = np.array([[sum(comb(n, k) for k in range(room + 1)) for room in range(size // 2 + 1)] for n in range(size + 1)])
    rows = np.cumsum(choices[inside[starts + size] - inside[starts], size // 2 - slots])
    power = _powers(size)[0]
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + (1 << 19), "right")))
        i, h, left, bits = starts[at:end], hashed[at:end], size // 2 - slots[at:end], np.zeros(end - at, np.int16)
        for k in range(size):
            more = np.flatnonzero(capital[i + k] & (left > 0))
            if len(more):
                i, h = np.concatenate([i, i[more]]), np.concatenate([h, h[more] + turn[i[more] + k] * power[k]])
                left, bits = np.concatenate([left, left[more] - 1]), np.concatenate([bits, bits[more] | (1 << k)])
        yield i, h, bits
        at = end


class Templates:
    """Turns texts into template windows; remembers what words stand for, up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words = WordIds(300_000)
        self.names: list[str] = []
        # Per word: number of tokens, whether a sentence ends with it, kind and code of its first token, code of its second.
        self.count, self.ends = np.zeros(0, np.int8), np.zeros(0, bool)
        self.kind, self.code, self.unit = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def learn(self) -> None:
        fresh = self.words.take()
        if not fresh:
            return
        from xxhash import xxh64_intdigest

        n = len(fresh)
        count, ends, kind, code, unit = bytearray(b"\1" * n), bytearray(n), bytearray(n), [0] * n, np.zeros(n, np.uint64)
        for k, word in enumerate(fresh):
            bare = word.rstrip(".,!?;:")
            if bare.isalpha() and bare not in UNITS:  # most words, without further ado
                low = bare if bare.islower() else bare.lower() if len(bare) > 1 and bare[1:].islower() and bare[0].isupper() else ""
                if low and low not in UNITS:
                    ends[k] = bare != word and word[-1] != ","
                    kind[k], code[k] = LITERAL if low is bare else CAPITAL, xxh64_intdigest(low)
                    continue
            tokens, ends[k] = canonical(word)
            count[k] = len(tokens)
            if tokens:
                kind[k], code[k] = tokens[0][0], xxh64_intdigest(tokens[0][1])
            if len(tokens) > 1:
                unit[k] = xxh64_intdigest(tokens[1][1])
        self.names += fresh
        self.count, self.ends = np.concatenate([self.count, np.frombuffer(count, np.int8)]), np.concatenate([self.ends, np.frombuffer(ends, bool)])
        self.kind, self.code = np.concatenate([self.kind, np.frombuffer(kind, np.int8)]), np.concatenate([self.code, np.array(code, np.uint64)])
        self.unit = np.concatenate([self.unit, unit])

    def _tokens(self, numbers: np.ndarray, first: np.ndarray):
        """Codes of the values, codes with numbers and units as placeholders, whether each token is such a slot, whether it
        is capitalised, whether that is inside a sentence, and the word and place it came from. `first`: words that begin a
        text. A second token of a word is the unit of its number."""
        count = self.count[numbers]
        word = np.repeat(np.arange(len(numbers)), count)
        second = np.concatenate([[False], word[1:] == word[:-1]]) if len(word) else np.zeros(0, bool)
        kind, plain = self.kind[numbers[word]], np.where(second, self.unit[numbers[word]], self.code[numbers[word]])
        number = (kind == NUMBER) & ~second
        start = first | np.concatenate([[True], self.ends[numbers[:-1]]])
        behind_number = np.concatenate([[False], number[:-1]]) if len(word) else second
        unit = second | (kind == UNIT) & behind_number & ~first[word]
        capital = kind == CAPITAL
        code = plain.copy()
        for slot, at in ((NUMBER, number), (UNIT, unit)):
            code[at] = _PLACEHOLDER[slot]
        return plain, code, number | unit, capital, capital & ~start[word], word, second

    def vocabulary(self, text: str | None) -> list[int]:
        """Hashes of the tokens of a text and of its neighbouring tokens, in all readings of capitalised words."""
        numbers = self.words.of_all(spaced_words(text)) if isinstance(text, str) else np.zeros(0, np.int64)
        self.learn()
        numbers = numbers[self.count[numbers] > 0]
        _, code, _, capital, _, _, _ = self._tokens(numbers, np.arange(len(numbers)) == 0)
        name = np.where(capital, np.uint64(_PLACEHOLDER[CAPITAL]), code)
        found = [_mix(code), *(_beside(a[:-1], b[1:]) for a in (code, name) for b in (code, name))]
        return np.unique(np.concatenate(found)).view(np.int64).tolist()

    def windows(self, texts: list[str | None], sizes: tuple[int, ...], wanted: tuple[Bitmap, Bitmap] | None = None, block: int = 1 << 18):
        """Per text the number of tokens and its windows: each one by its values, without slots, and those of SHORT
        tokens or more with at least half literal tokens by their template too; with `wanted`, bitmaps of the windows and the
        vocabulary of all items, only those that may be windows of an item. There a capitalised word that no item has
        is a name only, and windows with two neighbours that no item has as neighbours are not read at all.
        A capitalised word is read as a name and as a literal, wherever it stands; `usual` is the reading as a name inside
        a sentence and a literal at its start, and `light` says that this one has a template. Words are worked on a block
        at a time."""
        numbers = [self.words.of_all(spaced_words(t)) if isinstance(t, str) else np.zeros(0, np.int64) for t in texts]
        self.learn()
        numbers = [n[self.count[n] > 0] for n in numbers]
        stream = np.concatenate([*numbers, np.zeros(0, np.int64)])
        lengths = np.array([len(n) for n in numbers], np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(stream), bool)
        first[begins[lengths > 0]] = True
        token_at = np.concatenate([[0], np.cumsum(self.count[stream], dtype=np.int64)])  # tokens before each word
        found: list[list[dict]] = [[] for _ in texts]
        for at in range(0, len(stream), block):
            low, high = max(0, at - 1), min(len(stream), at + block + max(sizes))
            plain, code, slot, capital, inner, word, second = self._tokens(stream[low:high], first[low:high])
            word += low
            turn = np.uint64(_PLACEHOLDER[CAPITAL]) - plain
            either, named, strange, apart = capital, *(np.zeros(len(code), bool) for _ in range(3))
            if wanted is not None and len(code):
                of_items = wanted[1][_mix(code)]
                either, named, strange = capital & of_items, capital & ~of_items, ~of_items & ~capital & ~slot
                code = np.where(named, np.uint64(_PLACEHOLDER[CAPITAL]), code)
                apart[1:] = ~(wanted[1][_beside(code[:-1], code[1:])] | either[:-1] | either[1:])  # from the token before
            named_before, strange_before, apart_before = (np.concatenate([[0], np.cumsum(x)]) for x in (named, strange, apart))
            slots_before, inner_before, capitals_before = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, inner, capital))
            for size in sizes:
                n = len(code) - size + 1
                if n <= 0:
                    continue
                own = (word[:n] >= at) & (word[:n] < at + block) & (owner[word[:n]] == owner[word[size - 1 :]])
                n_slots, n_inner, n_capitals = (x[size:] - x[:-size] for x in (slots_before, inner_before, capitals_before))
                light = (2 * (n_slots + n_inner) <= size) & (size >= SHORT)
                exact, template = _hashes(plain, size), _hashes(code, size)
                fixed = n_slots + named_before[size:] - named_before[:-size]
                fits = own & (2 * fixed <= size) & (n_slots + n_capitals > 0) & (strange_before[size:] == strange_before[:-size])
                fits &= apart_before[size:] == apart_before[1 : n + 1]
                tried = np.flatnonzero(fits) if size >= SHORT else np.zeros(0, np.int64)
                every = np.flatnonzero(own)
                parts = [(every, exact[every], np.full(len(every), -1))]
                parts = chain(parts, _readings(tried, template[tried], fixed[tried], size, either, turn))
                for starts, hashed, names in parts:
                    if wanted is not None:
                        kept = wanted[0][hashed]
                        starts, hashed, names = starts[kept], hashed[kept], names[kept]
                    for i, h, bits in zip(starts.tolist(), hashed.astype(np.int64).tolist(), names.tolist()):
                        if bits >= 0:
                            bits |= sum(1 << k for k in range(size) if named[i + k])
                        if not bits and not n_slots[i]:
                            continue  # Without slots the template is the values.
                        chosen = 0 if bits < 0 else bits
                        inside = [j for j in range(i, i + size) if bits >= 0 and (slot[j] or chosen >> j - i & 1)]
                        usual = bool(light[i] and (bits >= 0 or not n_slots[i]) and all(inner[j] == (chosen >> j - i & 1) for j in range(i, i + size)))
                        text = int(owner[word[i]])
                        found[text].append({
                            "hash": h, "pos": int(token_at[word[i]] + second[i] - token_at[begins[text]]), "light": bool(light[i]), "usual": usual,
                            "slots": [canonical(self.names[stream[word[j]]])[0][int(second[j])][1] for j in inside]})
        tokens = token_at[begins + lengths] - token_at[begins]
        if self.words.full():
            self.clear()
        return list(zip(tokens.tolist(), found))


WINDOWS_TYPE = "tokens int, windows array<struct<hash:long,pos:int,light:boolean,usual:boolean,slots:array<string>>>"


def _size(tokens: int) -> int:
    return WINDOW if tokens >= WINDOW else min(tokens, SHORT)


def _by_length(made: Templates, texts: list[str | None]) -> list[tuple[int, list[dict]]]:
    """The windows of items: those of WINDOW tokens, or those of SHORT for an item too short for one, or the whole item."""
    rows = made.windows(texts, (WINDOW,))
    for size in {_size(n) for n, _ in rows if 0 < n < WINDOW}:
        places = [k for k, (n, _) in enumerate(rows) if _size(n) == size]
        for k, row in zip(places, made.windows([texts[k] for k in places], (size,))):
            rows[k] = row
    return rows


def _windows():
    """The windows of items."""

    @F.pandas_udf(WINDOWS_TYPE)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = Templates()
        for batch in texts:
            rows = []
            for at in range(0, len(batch), 100):
                rows += _by_length(made, batch[at : at + 100].tolist())
            yield pd.DataFrame(rows, columns=["tokens", "windows"])

    return found


def _hits(sizes: tuple[int, ...], wanted, schema: pa.Schema):
    """(doc, hash, doc_pos, doc_usual, doc_slots) of the windows of documents that pass the bitmaps. A map over batches, as a
    function of the text would be worked out twice, once to leave out the documents without windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = Templates(), tuple(map(Bitmap, wanted.value))
        for batch in batches:
            for at in range(0, len(batch), 100):
                keys, texts = (batch.column(k).slice(at, 100).to_pylist() for k in (0, 1))
                rows = [(key, w["hash"], w["pos"], w["usual"], w["slots"]) for key, (_, found) in zip(keys, made.windows(texts, sizes, bits)) for w in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _vocabulary():
    """The vocabulary of items."""

    @F.pandas_udf("array<long>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Templates()
        for batch in texts:
            yield pd.Series([made.vocabulary(t) for t in batch])

    return found


def _bits(hashes: DataFrame) -> bytes:
    """The bitmap of a column of hashes; at most a row per bit comes to the driver."""
    slots = hashes.select(F.shiftrightunsigned("hash", 64 - _FILTER_BITS).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, matched_windows, item_windows, same_slots) for each document and benchmark item it leaks.

    Windows of the item's template are joined with windows of the document's by hash. Matches are followed along the line of
    equal distance between the two places; on each line the slot values must map one to one from the item to the
    document, which a question with other numbers and names does and a chance meeting of placeholders does not; on a
    line where they do not, only windows whose values are all equal count.
    A capitalised word may be a name or a literal, wherever in a sentence it stands; if names at the start of sentences do
    not map one to one, these words are literals there.
    Windows of more slots than literals have no template and items of fewer than five tokens are one window; these count only
    with all values equal. Every window is also joined by its values, so a verbatim copy is found wherever it stands.
    A document leaks an item if what counts covers six different windows of it or half, of all its windows or of those with
    a template. `same_slots` says that no slot differs.

    Only windows that pass a bitmap of the benchmark's windows are ever rows, and only those whose words and neighbours pass one
    of its vocabulary are read in more than one way; each has a fixed size of 512 kB, so a large benchmark lets more pass but
    changes no result. Texts without a letter or digit, null texts and null
    keys have no windows to find. Repeated rows of a key count once. Empty tables give an empty result.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key).alias("item"), F.col(item_text).alias("_text"))
    plain = items.select("item", _windows()("_text").alias("w")).select("item", "w.tokens", F.col("w.windows").alias("found"))
    size = F.when(F.col("tokens") >= WINDOW, WINDOW).otherwise(F.least(F.col("tokens"), F.lit(SHORT)))
    windows = settle(plain.where("tokens > 0").select("item", size.alias("size"), "found", (F.col("tokens") - size + 1).alias("item_windows"))
                     .select("item", "size", "item_windows", F.size(F.array_distinct(F.transform(F.filter("found", lambda x: x["light"]), lambda x: x["pos"]))).alias("item_light"), F.explode("found").alias("x"))
                     .select("item", "size", "item_windows", "item_light", F.col("x.hash").alias("hash"), F.col("x.pos").alias("item_pos"), F.col("x.light").alias("light"), F.col("x.usual").alias("item_usual"), F.col("x.slots").alias("item_slots")), "item-windows")
    sizes = tuple(sorted(r[0] for r in windows.select("size").distinct().collect())) or (WINDOW,)
    vocabulary = items.select(F.explode(_vocabulary()("_text")).alias("hash"))
    sent = spark.sparkContext.broadcast((_bits(windows), _bits(vocabulary)))
    hit_type = f"doc {docs.schema[doc_key].dataType.simpleString()}, hash long, doc_pos int, doc_usual boolean, doc_slots array<string>"
    hits = docs.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text)).mapInArrow(
        _hits(sizes, sent, spark.createDataFrame([], hit_type).toArrow().schema), hit_type)
    met = hits.join(windows, "hash").withColumn("line", F.col("doc_pos") - F.col("item_pos"))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    place = F.struct("item_pos", "light")
    usual = F.col("item_usual") & F.col("doc_usual")
    lines = met.groupBy("doc", "item", "item_windows", "item_light", "line").agg(
        F.collect_set(place).alias("places"), F.collect_set(F.when(usual, place)).alias("usual_places"),
        F.collect_set(F.when(F.col("item_slots") == F.col("doc_slots"), place)).alias("exact_places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.array_distinct(F.flatten(F.collect_set(F.when(usual, pairs)))).alias("usual_pairs"))

    def one_to_one(column: str):
        return ((F.size(column) == F.size(F.array_distinct(F.transform(column, lambda p: p["i"]))))
                & (F.size(column) == F.size(F.array_distinct(F.transform(column, lambda p: p["d"])))))

    # Names at the start of sentences, if they map one to one as well; else literals there.
    counted = (F.when(one_to_one("pairs"), F.col("places")).when(one_to_one("usual_pairs"), F.array_union("usual_places", "exact_places"))
               .otherwise(F.col("exact_places")))
    judged = F.when(one_to_one("pairs"), F.col("pairs")).otherwise(F.col("usual_pairs"))
    # A window of the item counts once, on however many lines the document repeats it.
    covered = (lines.select("doc", "item", "item_windows", "item_light", F.forall(judged, lambda p: p["i"] == p["d"]).alias("same"),
                            F.explode(counted).alias("place"))
               .groupBy("doc", "item", "item_windows", "item_light").agg(F.collect_set("place").alias("places"), F.bool_and("same").alias("same_slots"))
               .withColumn("matched_windows", F.size("places").cast("long")).withColumn("matched_light", F.size(F.filter("places", lambda p: p["light"]))))
    enough = lambda n: F.least(F.lit(ENOUGH), F.ceil(F.col(n) / 2))
    leaked = (F.col("matched_windows") >= enough("item_windows")) | (F.col("item_light") > 0) & (F.col("matched_light") >= enough("item_light"))
    return covered.where(leaked).select(
        "doc", "item", "matched_windows", F.col("item_windows").cast("long").alias("item_windows"), "same_slots")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns kept. A row without an id is known by its text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.col("text"), 256)))
    keyed = docs.withColumn("_key", key)
    leaking = settle(leaks(keyed, benchmark, doc_key="_key").select(F.col("doc").alias("_key")).distinct(), "leaking-documents")
    return keyed.join(leaking, "_key", "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matched_windows", "item_windows", "same_slots")
