"""Token alignment against a plain walk over bytes."""

import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import rows_of
from tokenizers import Tokenizer

from wardwright.llm import alignment, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def plain(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters, n = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            letters[chr(b)] = b
        else:
            letters[chr(256 + n)] = b
            n += 1

    def tokens(text):
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        pieces = [second.id_to_piece(i) for i in b]
        return ((a, [bytes(letters[c] for c in first.id_to_token(i)) for i in a]),
                (b, [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, pieces)]))

    rows, links = [], []
    for text in texts:
        (a, a_bytes), (b, b_bytes) = tokens(text) if text else (([], []), ([], []))
        whole = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        groups, mine, i, j, x, y = [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            left, right = [], []
            while not left or not right or x != y:
                if x <= y and i < len(a) and (not left or x < y or not right and x == y and len(left) == 0):
                    left.append(a[i])
                    x += len(a_bytes[i])
                    i += 1
                else:
                    right.append(b[j])
                    y += len(b_bytes[j])
                    j += 1
            groups.append((left, right))
            mine += [(u, v) for u in left for v in right]
        text_of = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        rows.append((len(a), len(b), len(groups), len(mine), text_of))
        links.append(mine)
    held = Counter(p for mine in links for p in set(mine))
    highest = Counter()
    for (u, _), count in held.items():
        highest[u] = max(highest[u], count)
    return [(*r[:4], sum(held[p] == highest[p[0]] for p in mine), sum(held[p] for p in mine), r[4]) for r, mine in zip(rows, links)]


ODD = [None, "", " ", "  two  spaces ", "a", "<|endoftext|> and <s> </s> <unk> are text", "naïve café — ﬁne", "日本語のテキスト 漢字", "emoji 😀👩‍👩‍👧 and \ufeff bom", "tab\tand\nlines\n\n end ",
       "x" * 5000, "ab " * 3000, "\u2581 is a space to one of them", "e\u0301 composed é", "1234567890 3.14159", "don't we'll they're", "\x00\x01", "a\u00a0b\u3000c"]


def rows_for(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, 7, "clash", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string, block double")
    return rows_of(alignment.align(docs, FIRST, SECOND, **options), *COLUMNS, "groups")


def test_equals_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_BLOCK", 4000)  # several blocks
    monkeypatch.setattr(alignment, "_MEMO", 50)
    rng = random.Random(1)
    words = "the of and internationalization Straße naïve 42 foo_bar don't ünïcödé -- ...".split()
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["a copy of a text"] * 40
    want = plain(texts)
    assert rows_for(spark, texts) == [(k, *w) for k, w in enumerate(want)]
    assert sum(w[0] > 0 for w in want) > 150 and any(w[0] == 0 for w in want[2:])
    assert [r[-1] for r in rows_for(spark, texts, digest=True)] == [sha256(w[-1].encode()).hexdigest() if w[0] else "" for w in want]


def test_repeated_null_keys_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two three"), (None, None)], "doc_id long, text string")
    got = rows_of(alignment.align(docs, FIRST, SECOND), "doc_id", "n_links", "count_sum")
    want = plain(["one two", "one two", "one two three", None])
    assert got == sorted([(1, w[3], w[5]) for w in want[:2]] + [(None, w[3], w[5]) for w in want[2:]], key=lambda r: (r[0] is not None, r[0], r[1]))
    assert alignment.align(docs.limit(0), FIRST, SECOND).count() == 0


def test_long_texts_in_parts_give_the_tokens_of_the_whole():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "Beta", "γ", "don't", "12", "  x", "été", "日本", "a-b"]) for _ in range(4000))
    first, second = alignment.ByteLevel(FIRST), alignment.Pieces(SECOND)
    assert second.cuts_at_spaces
    parts = alignment.parts_of(text, 1000)
    assert len(parts) > 10 and " ".join(parts) == text and alignment.parts_of("日本" * 900, 100) == ["日本" * 900]
    for t in (first, second):
        whole, = t.encode([text])
        assert [i for ids in t.encode(parts) for i in ids] == whole


def test_large_groups_are_counted_by_different_ids(monkeypatch):
    """Groups of many tokens, such as runs of bytes that only one tokenizer knows: the same counts as listed one by one."""
    texts = ["\u2603\u2603\u2603 \U0001F9FF\U0001F9FF x", "zażółć gęślą jaźń " * 5, "ꙮꙮꙮꙮꙮꙮ ꙮꙮ"]
    results = []
    for limit in (1, 64):
        monkeypatch.setattr(alignment, "_PLAIN", limit)
        block = alignment.Block(alignment.Windows(alignment.ByteLevel(FIRST), alignment.Pieces(SECOND)), False)
        block.add([1, 2, 3], texts)
        results.append((block.rows, [e.tolist() for e in block.entries], [t.tolist() for t in block.times]))
    assert results[0] == results[1] and max(map(max, results[0][2])) > 1


def test_windows_are_learnt_once_and_end_where_both_do():
    w = alignment.Windows(alignment.ByteLevel(FIRST), alignment.Pieces(SECOND))
    ids = [np.array(t.encode(["the cat and the cat and the cat"])[0], np.uint32) for t in w.tokenizers]
    found = w.of(*ids)
    assert not len(w.groups)
    w.settle()
    assert len(w.groups) == len(w.text) == 3 and len(found) == 8 and len(set(found)) == len(w.known) == 3
    for key in w.known:
        a, b = (np.frombuffer(part, np.uint32) for part in key.split(b"\xff\xff\xff\xff"))
        assert b"".join(w.tokenizers[0].bytes[i] for i in a) == b"".join(w.tokenizers[1].bytes[i] for i in b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *w[:-1], sha256(w[-1].encode()).hexdigest() if w[0] else "") for d, w in zip(docs, plain([d.text for d in docs])))
    assert rows_of(queries.QUERIES["op13_tokenizer_alignment"](spark, SF), *COLUMNS, "groups_sha256") == want


def test_ranks_give_the_ids_of_the_merges():
    """The fast way for common texts and the library's own, on given and on random texts."""
    first = alignment.ByteLevel(FIRST)
    assert first.ranks is not None
    rng = random.Random(3)
    letters = "abcdeinorst   ABCXYZ'éßüøñ0123456789.,;:!?()[]{}<>|\\\\/\"#$%&*+-=_~^`\t\n\r\x0b\x0c\x85\xa0\xad\x00\x7f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice(["ing", "tion", "the", " ", "  ", "ment", "er", "un", "s", "\n", "'ll", "'S", "ð", "ſ"]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert not any(alignment._NEWER.search(t) for t in texts)
    want = [e.ids for e in first.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert first.encode(texts) == want
    mixed = ["plain", "日本", "é", "😀", "ɐ"]
    assert first.encode(mixed) == [e.ids for e in first.model.encode_batch_fast([" " + t for t in mixed], add_special_tokens=False)]
