"""Phrase mining against plain counting and its SQL."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import rows_of

from wardwright.llm import phrases, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
FIELDS = "doc_id long, lang string, text string, n long, rank int, phrase string"


def plain_counts(rows):
    """(lang, words) -> occurrences, and words per language."""
    counts, totals = Counter(), Counter()
    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    return counts, totals


def plain_collocations(rows, support, top):
    counts, totals = plain_counts(rows)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    kept = []
    for (lang, words), a in candidates.items():
        score, k = min((2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words)))
        covered = any(other == lang and len(longer) > len(words) and 100 * b >= 80 * a
                      and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
                      for (other, longer), b in candidates.items())
        if not covered:
            kept.append((lang, -score, -a, " ".join(words).encode(), a, counts[lang, words[:k]], counts[lang, words[k:]]))
    out, rank = [], Counter()
    for lang, score, _, phrase, a, l, r in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), a, l, r, totals[lang], -score))
    return sorted(out)


def made(seed, n=300):
    """Texts of few words, with common passages, rare languages and odd white space."""
    rng = random.Random(seed)
    passage = "the cat sat on the mat"
    for k in range(n):
        words = [rng.choice(["a", "b", "The", "of", "é", "x\u00a0y", "É", passage, passage.upper()]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", ",", "\x0b", "\x1c"]) for w in words)
        yield k, rng.choice(["en", "en", "fr", None, "und", "rare" if k % 50 == 0 else "en"]), rng.choice([text, text, None]) if k % 9 == 0 else text


@pytest.mark.parametrize("support, sample", [(5, 8), (2, 4), (3, 1), (30, 50)])
def test_equals_plain_counting(spark, support, sample):
    rows = list(made(support))
    docs = spark.createDataFrame([(k, lang, text, 7, 7, "clash") for k, lang, text in rows], FIELDS)
    want = plain_collocations([r[1:] for r in rows], support, 40)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert rows_of(phrases.collocations(docs, support=support, top=40, sample=sample), *columns) == want and want


def test_phrases_that_the_sample_misses_are_found(spark):
    """Nothing is in the sample (no hash is 0 modulo a huge number), so all frequent phrases are failures of the border."""
    rows = list(made(99))
    docs = spark.createDataFrame([(k, lang, text, 7, 7, "clash") for k, lang, text in rows], FIELDS)
    counts, totals = plain_counts([r[1:] for r in rows])
    want = sorted((lang, len(w), " ".join(w), n) for (lang, w), n in counts.items() if n >= 4) + [(lang, 0, "", n) for lang, n in totals.items() if n]
    for sample in (1, 1 << 40):
        assert rows_of(phrases.frequent_phrases(docs, support=4, sample=sample), "lang", "words", "phrase", "n") == sorted(want)


def test_one_hot_phrase_long_texts_and_nothing(spark):
    docs = spark.createDataFrame([(k, "en", "same old words again", 1, 1, "") for k in range(4000)] + [(None, "en", "z " * 400_000, 1, 1, ""), (1, None, None, 1, 1, ""), (1, "", " \t\n", 1, 1, "")], FIELDS)
    found = {r.phrase: (r.a, r.l, r.r, r.n) for r in phrases.collocations(docs).collect()}
    n = 16_000 + 400_000
    assert found == {"same old words again": (4000, 4000, 4000, n), "z z z z": (399_997, 400_000, 399_998, n)}
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_blocks_keep_words_and_pieces():
    text = "Aa bb. cc\tdd;ee " * 50 + "é" * 3000 + " end"
    for block in (1, 7, 100, 1 << 20):
        assert [w for part in phrases.folded_words(text, block) for w in part] == [w for part in phrases.folded_words(text) for w in part]


def test_border_of_known_phrases():
    """What is counted: known phrases, and those that are not known but whose two parts are."""
    stream = np.array([11, 12, 13, 14, 0, 12, 13, 11, 12], np.uint64)
    codes, _ = phrases._levels(stream, "en")

    class Known:
        def __init__(self, *known):
            self.hashes = [int(phrases.phrase_hashes(phrases._levels(np.array(p, np.uint64), "en")[0], np.array([0]), len(p))[0]) for p in known]

        def has(self, hashes):
            return np.isin(hashes, np.array(self.hashes, np.uint64))

    known = Known((11,), (12,), (13,), (11, 12), (12, 13))
    found = [len(h) for h in phrases.border_hashes(stream, "en", known, range(1, 5))]
    # All words; pairs of known words, 14 is none; 11 12 13, whose two pairs are known, is the border; of four words none.
    assert found == [8, 5, 1, 0]


def test_a_bit_that_others_set_hides_no_phrase():
    """The word was not proposed, so nothing longer was counted, whatever the filters say of the pair: all may be frequent."""
    stream = np.array([11] * 6 + [0], np.uint64)
    codes, _ = phrases._levels(stream, "en")
    hashes = [phrases.phrase_hashes(codes, np.array([0]), k)[0] for k in (1, 2)]

    class Bits:
        def __init__(self, *of):
            self.of = np.array(of, np.uint64)

        def has(self, asked):
            return np.isin(asked, self.of)

    for proposed, found, want in (((hashes[1],), hashes, [6, 5, 4, 3]), (hashes, hashes, [6, 5, 0, 0]), ((), (), [0, 0, 0, 0])):
        taken = phrases.exact_phrases(stream, "en", Bits(*proposed), Bits(*found))
        assert [len(at) for _, _, at in taken] == want


def test_full_filters_hide_no_phrase(spark, monkeypatch):
    """Words that only one document has, often in a row, and filters so small that most bits are set."""
    monkeypatch.setattr(phrases, "_BITS", (15, 15))
    rows = [(k, "en", f"w{k} " * 24 + f"of w{k}", 1, 1, "") for k in range(4000)]
    counts, _ = plain_counts([r[1:3] for r in rows])
    want = sorted((" ".join(w), n) for (_, w), n in counts.items() if n >= 20)
    found = phrases.frequent_phrases(spark.createDataFrame(rows, FIELDS), support=20).where("words > 0")
    assert rows_of(found, "phrase", "n") == want


def test_phrases_of_one_hash_stay_apart():
    hashes, column = np.array([7, 7, 5, 7, 7], np.uint64), np.array([1, 2, 3, 1, 2], np.uint64)
    order, first = phrases._equal(hashes, [column])
    assert column[order[first]].tolist() == [3, 1, 2] and np.diff(first, append=5).tolist() == [1, 2, 2]


def test_packed_rows_grow_with_the_streams_only():
    """A task makes a row per slice and stream, and the corpus takes few slices."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([rng.integers(1, 50, 20_000).astype(np.uint64).tobytes()])], names=["lang", "codes"])
    rows = [r for out in phrases._border_counts(None, range(1, 3), 16)(iter([batch])) for r in out.to_pylist()]
    assert sorted(r["slice"] for r in rows) == list(range(16))
    hashes, n = zip(*((phrases._of_planes(r["hashes"]), np.frombuffer(r["n"], r["kind"])) for r in rows))
    assert sum(map(len, hashes)) == sum(map(len, n)) and sum(int(x.sum()) for x in n) == 20_000 + 19_999


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({phrases.SQL})").fetchall())
    assert rows_of(queries.QUERIES["op11_toivonen_phrases"](spark, SF), *columns) == want
