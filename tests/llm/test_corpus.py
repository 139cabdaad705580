"""The corpus operators against brute force, public libraries and edge cases."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import os
import random
import re
import urllib.parse
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from wardwright.llm import (bpe, decontaminate, embeddings, graph, langid, queries, secret_scan, sharding, simhash, toxicity,
                            url_filter, warc)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text here again"), (4, "same text here again"), (None, "same text here again"),
       (5, "word " * 40_000), (6, "x" * 50_000), (7, "日本語 😀 zażółć %41 \\u0041 &#65;")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blank, repeated and long texts, with columns named like results."""
    rows = [(i, t, "en", "s", "clash", 9, 9.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans string, shard int, score double")


def root_of(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(50)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = root_of({n for link in links for n in link}, links)
    assert found == {n: r for n, r in want.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: decontamination ------------------------------------------------------

ITEM = "A train leaves Berlin at 30 km per hour and Anna waits for it in Munich with 12 bags until the night falls on the town"


def test_leaks_by_template(spark):
    other = ITEM.replace("30", "45").replace("Berlin", "Lisbon").replace("12", "7").replace("Anna", "Carla").replace("Munich", "Porto")
    mixed = ITEM + " and then " + ITEM.replace("Anna", "Berta")
    clash = "then Anna gave 5 pears to Bert and 5 pears to Carl and 5 pears to Dora and 5 pears to Emil and 5 pears to Finn"
    docs = spark.createDataFrame([
        (1, "Before it. " + ITEM + ". After it."), (2, "Before it. " + other), (3, "nothing of the kind is said in this text at all, whatever one reads into it"),
        (4, None), (5, ""), (6, mixed), (None, ITEM), (7, "".join(c if c != "5" else str(n) for n, c in enumerate(clash))), (1, "Before it. " + ITEM + ". After it.")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, ITEM), (11, clash), (12, None), (13, "too short"), (14, "only six words are in here")], "item_id long, text string")
    found = {(r.doc, r["item"]): r for r in decontaminate.leaks(docs, benchmark).collect()}
    # Document 7 gives one value of the item two values: its slots do not map one to one.
    assert set(found) == {(1, 10), (2, 10), (6, 10)}
    assert found[1, 10].same_slots and not found[2, 10].same_slots and found[1, 10].matched_windows == found[1, 10].item_windows
    kept = decontaminate.remove_leaks(docs.withColumn("extra", F.lit(1)), benchmark)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == ["doc_id", "text", "extra"]
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_template_windows_do_not_depend_on_blocks():
    rng = random.Random(1)
    words = ["the", "Anna", "30", "km", "5kg", "end.", "|", "of", "$7", "then"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 5, 300, 90)] + [None]
    whole = decontaminate.Templates().windows(texts, (5, 8))
    order = lambda rows: [(n, sorted((w["hash"], w["pos"], w["slots"]) for w in found)) for n, found in rows]
    assert order(whole) == order(decontaminate.Templates().windows(texts, (5, 8), block=17))
    assert decontaminate.canonical("30km,") == ([(1, "30"), (2, "km")], False)


def test_a_repeated_window_counts_once(spark):
    words = "the quick river ran over seven old grey stones while both herons slept under their willow near some bridge at dusk".split()
    docs = spark.createDataFrame([(1, " | ".join([" ".join(words[:8])] * 6)), (2, " ".join(words[:13]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [(r.doc, r.matched_windows) for r in decontaminate.leaks(docs, benchmark).collect()] == [(2, 6)]


def test_slot_heavy_and_short_items_are_found_as_copies(spark):
    items = ["Compute 12 + 45 * 3 - 8 / 2 + 7", "Name three rivers", "東京から大阪まで三時間かかります", "zebra Anna Bert Carl Dora Emil Finn Gustav Hans 4 7 9", "+ - *"]
    docs = ["It says: Compute 12 + 45 * 3 - 8 / 2 + 7 as a task", "please name three rivers of it", "昨日、東京から大阪まで三時間かかりますと言った", "see zebra Anna Bert Carl Dora Emil Finn Gustav Hans 4 7 9 there",
            "It says: Compute 13 + 46 * 4 - 9 / 5 + 6 as a task", "please name four rivers", "see zebra Olaf Paul Rolf Sven Theo Uwe Veit Wolf 5 8 3 there", "+ - *"]
    spoken = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc, r["item"]): (r.matched_windows, r.item_windows, r.same_slots) for r in decontaminate.leaks(spoken, benchmark).collect()}
    assert found == {(0, 0): (3, 3, True), (1, 1): (1, 1, True), (2, 2): (9, 9, True), (3, 3): (5, 5, True)}


def test_names_that_begin_a_sentence(spark):
    items = ["Tom has 5 apples. Sue has 3 pears. How many fruits are there", "What is the capital of France", "What is 5 plus 7"]
    docs = ["Ann has 7 apples. Ben has 4 pears. How many fruits are there", "Q What is the capital of France", "Q What is 3 plus 9",
            "then Tom has 6 apples. Sue has 2 pears. How many fruits are there", "Tom has 5 rivers. Sue sees 3 pears. How few fruits are there"]
    spoken = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc, r["item"]): r.same_slots for r in decontaminate.leaks(spoken, benchmark).collect()}
    assert found == {(0, 0): False, (1, 1): True, (2, 2): False, (3, 0): False}


def test_template_windows_equal_all_readings_tried():
    rng = random.Random(8)
    words = ["the", "Anna", "Bert", "Carl", "30", "km", "end.", "of"]
    for size in (5, 8):
        text = " ".join(rng.choice(words) for _ in range(60))
        (tokens, found), = decontaminate.Templates().windows([text], (size,))
        kinds = [(k, v) for w in text.split() for k, v in decontaminate.canonical(w)[0]]
        want = 0
        for at in range(tokens - size + 1):
            fixed = sum(k == 1 or k == 2 and at + j and kinds[at + j - 1][0] == 1 for j, (k, _) in enumerate(kinds[at:at + size]))
            capitals = sum(k == 3 for k, _ in kinds[at:at + size])
            want += (fixed > 0) + sum(math.comb(capitals, n) for n in range(size // 2 - fixed + 1) if fixed <= size // 2)
        assert len(found) == want == len({(w["hash"], w["pos"]) for w in found})


def test_vocabulary_of_the_items_loses_no_reading():
    """Windows that an item has: with the bitmaps of the items the same as when every reading of every window is made."""
    rng = random.Random(5)
    words = ["the", "The", "anna", "Anna", "Bert", "BERT", "30", "km", "Km", "end.", "of", "Of", "5kg", "Zoo", "x1"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [said(rng.randint(3, 14)) for _ in range(40)]
    texts = [said(120) + " " + rng.choice(items).title() + " Qwe Rty " + rng.choice(items) for _ in range(60)] + [None, "", "Anna"]
    made = decontaminate.Templates()
    rows = decontaminate._by_length(made, items)
    sizes = tuple(sorted({decontaminate._size(n) for n, _ in rows if n}))
    hashes = {w["hash"] for _, found in rows for w in found}

    def bitmap(values):
        bits = np.zeros(1 << decontaminate._FILTER_BITS, bool)
        bits[(np.array(sorted(values), np.int64).view(np.uint64) >> np.uint64(64 - decontaminate._FILTER_BITS)).astype(np.int64)] = True
        return decontaminate.Bitmap(np.packbits(bits).tobytes())

    wanted = (bitmap(hashes), bitmap({h for i in items for h in made.vocabulary(i)}))
    shown = lambda found: sorted((w["hash"], w["pos"], w["light"], w["usual"], w["slots"]) for w in found if w["hash"] in hashes)
    everything = decontaminate.Templates().windows(texts, sizes)
    pruned = decontaminate.Templates().windows(texts, sizes, wanted)
    assert [(n, shown(found)) for n, found in pruned] == [(n, shown(found)) for n, found in everything]
    assert sum(len(shown(found)) for _, found in pruned) > 500


def test_leaks_equal_brute_force(spark):
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    assert found == {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}


# --- 2: URLs -----------------------------------------------------------------

def test_url_query_equals_sql(spark):
    got = sorted(map(tuple, queries.QUERIES["op2_url_filter"](spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(queries.SQL["op2_url_filter"]).fetchall())


def test_urls_equal_all_rules_tried(spark):
    hosts = ["com", "example.com", "WWW.example.com", "a.net", "netx", "ads.net", "", "u@example.com:80"]
    paths = ["", "/", "/en/", "/EN/", "/es/x", "/fr", "/ads/1", "/ads/help", "/xads/", "/banner", "/banner/x", "/bannerX", "/en/casino?q", "#f", "/porn\n"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/en/"] * 2
    rows = spark.createDataFrame([(u, "x") for u in urls], "url string, rule string")
    rules = [*url_filter.SITE_RULES, *url_filter.PATTERN_RULES]
    got = url_filter.judge_urls(rows).collect()
    assert len(got) == len(urls)
    everything = url_filter.RuleIndex(rules, {})
    everything.by_token, everything.always = {}, list(range(len(rules)))
    for r in got:
        assert (r.rule, r.pattern, r.verdict) == everything.judge(r.host, r.path, "allow")[:3], r.url
    assert {(r.host, r.path, r.verdict) for r in got if not r.url} == {("", "", "allow")}
    assert url_filter.judge_urls(rows.limit(0)).count() == 0
    assert max(r.rules_tried for r in got) < len(rules)


# --- 3: secrets --------------------------------------------------------------

def test_layers_are_unwrapped_and_mapped():
    secret = "password=hunter2secret"
    quoted = urllib.parse.quote("token: abc123xyz")
    packed = base64.b64encode(gzip.compress(f"x {secret} y".encode())).decode()
    nested = base64.b64encode(base64.b64encode(f"api_key = {'k' * 12}".encode())).decode()
    unicode = "".join(f"\\u{ord(c):04x}" for c in "secret=topsecret9")
    for text in (f"a {quoted} b", f"a {packed} b", f"a {nested} b", f"a {unicode} b"):
        base, spans, layers, _ = secret_scan.scan(text)
        assert layers and len(spans) > len([s for s in spans if s in base]), text
        kind, start, end = next(s for s in spans if s not in base)
        assert kind == "assign" and 2 <= start < end <= len(text) - 2
    # Half escaped: the span covers the escapes it stands for.
    _, spans, _, _ = secret_scan.scan("my pass%77ord=abcdefgh end")
    assert ("assign", 3, 22) in spans
    once = secret_scan.scan(base64.b64encode(gzip.compress(b"password=abcdefg" * 4000)).decode(), max_decoded=1000)
    assert len(once[3]) == 1 and not [x for x in once[1] if x[0] == "assign"]


def test_compressed_layers_to_the_last():
    secret = b"x password=hunter2secret y"
    nested = [gzip.compress(gzip.compress(secret)), gzip.compress(zlib.compress(secret)), bz2.compress(lzma.compress(gzip.compress(secret))),
              gzip.compress(base64.b64encode(gzip.compress(gzip.compress(secret))))]
    members = [pack(b"nothing ") + pack(secret) for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress)]
    odd = [gzip.compress(b"x pass") + gzip.compress(b"word=hunter2secret"), gzip.compress(b"nothing") + b"\0" * 8 + gzip.compress(secret),
           gzip.compress(b"nothing") + gzip.compress(gzip.compress(secret)), gzip.compress(b"nothing") + secret, b"BZh, " + secret,
           gzip.compress(b"a" * 5000) * 300 + gzip.compress(secret)]
    for data in nested + members + odd:
        packed = base64.b64encode(data).decode()
        _, spans, _, oversized = secret_scan.scan(f"see {packed} end")
        assert ("assign", 4, 4 + len(packed.rstrip("="))) in [(k, s, min(e, 4 + len(packed.rstrip("=")))) for k, s, e in spans] and not oversized, data[:8]
        assert secret_scan.scan(f"see {data.hex()} end")[1]
    bomb = base64.b64encode(gzip.compress(gzip.compress(b"\0" * 5000) + b"\0" * 5000)).decode()
    assert len(secret_scan.scan(bomb, max_decoded=1000)[3]) == 1


SECRET = "password=hunter2secret"


def deflated(data):
    tool = zlib.compressobj(wbits=-15)
    return tool.compress(data) + tool.flush()


@pytest.mark.parametrize("packed", [
    "https://h.org/a/" + base64.b64encode(b"x " + SECRET.encode()).decode(),  # behind a path
    "k_" + base64.b64encode(b"x " + SECRET.encode()).decode(), "ab-" + base64.b64encode(gzip.compress(SECRET.encode())).decode(),
    "%FF" + "".join(f"%{b:02X}" for b in SECRET.encode()),  # a byte that is no text
    "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET),  # half of a pair
    base64.b64encode(SECRET.encode("utf-16-le")).decode(), base64.b64encode(SECRET.encode("utf-16")).decode(), base64.b64encode(SECRET.encode("utf-16-be")).decode(),
    base64.b64encode(b"user\0" + SECRET.encode() + b"\0\xff\xfe").decode(),  # fields between zeros
    base64.b64encode(deflated(b"some words, then " + SECRET.encode() + b", then more words " * 3)).decode(),  # no header
    base64.encodebytes(b"-" * 50 + SECRET.encode() + b"-" * 50).decode().strip(),  # over a line end
    base64.encodebytes(gzip.compress(os.urandom(200) + SECRET.encode())).decode().strip(), "f" + SECRET.encode().hex(),
])
def test_layers_that_are_not_clean(packed):
    text = f"see {packed} end"
    _, spans, _, oversized = secret_scan.scan(text)
    hits = [(start, end) for kind, start, end in spans if kind == "assign"]
    assert hits and not oversized
    # The span covers what the secret was unwrapped from, and no more than the run.
    assert all(4 <= start < end <= 4 + len(packed) for start, end in hits)
    assert "hunter" not in (masked := secret_scan._masked(text, spans, "[secret]")) and masked.startswith("see ") and masked.endswith(" end")
    assert not [s for s in secret_scan.scan(masked)[1]]


def test_only_compressed_layers_are_held_back(spark):
    # Plain layers many times the limit: a secret half in URL, half in Unicode escapes behind a long tail, and base64 in base64.
    plain = "\\u0070ass%77ord=hunter2secret " + "tail " * 5000 + base64.b64encode(base64.b64encode(b"y" * 3000 + SECRET.encode())).decode()
    _, spans, layers, oversized = secret_scan.scan(plain, max_decoded=100)
    assert {s[1] == 0 for s in spans if s[0] == "assign"} == {True, False} and layers >= 4 and not oversized
    # Too large to unwrap: counted, and masked whole.
    bomb = base64.b64encode(gzip.compress(b"z" * 2000 + SECRET.encode())).decode()
    _, spans, _, oversized = secret_scan.scan(f"a {bomb} b", max_decoded=100)
    assert not spans and oversized and set(oversized) == {(2, 2 + len(bomb))}
    # The same run seen in several layers is unpacked and charged once.
    again = f"%41 \\u0042 {base64.b64encode(gzip.compress(b'z' * 900 + SECRET.encode())).decode()}"
    assert not secret_scan.scan(again, max_decoded=1000)[3]


def test_oversized_runs_do_not_survive_redaction(spark, monkeypatch):
    bomb = base64.b64encode(gzip.compress(b"z" * 5000 + SECRET.encode())).decode()
    rows = spark.createDataFrame([(1, f"a {bomb} b"), (2, "clean")], "doc_id long, text string")
    monkeypatch.setattr(secret_scan.scan, "__defaults__", (1000,))
    assert {r.doc_id: r.text for r in secret_scan.redact(rows).collect()} == {1: "a [secret] b", 2: "clean"}
    assert {r.doc_id: r.oversized > 0 for r in secret_scan.scan_secrets(rows).collect()} == {1: True, 2: False}


def test_base_columns_equal_plain_expressions_over_the_table(spark):
    """The contract's columns, computed here by `re` over all given texts."""
    def base(text):
        found = []
        for order, (kind, pattern, group, least) in enumerate((
                ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
                ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
            found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        return sorted(found)

    got = {r.doc_id: r for r in queries.QUERIES["op3_secret_scan"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want, r = base(text), got[doc_id]
        spans = [f"{kind}:{start}:{end}" for start, _, end, kind in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_base_spans_follow_the_contract(spark, odd):
    texts = ["token=api:secret1", "token=token:abcdefg", "PASSWORD : 'abcdef' AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "deadbeef" * 3, "deadbeef" * 2 + "dead", None]
    kinds = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    for text in texts:
        want = [(k, m.start(), m.end()) for k, (p, g, n) in kinds.items() for m in re.finditer(p, text or "") if len(m[g]) >= n]
        assert secret_scan.scan(text)[0] == want
    found = secret_scan.scan_secrets(odd)
    assert found.count() == len(ODD) and found.columns.count("spans") == 1
    masked = secret_scan.redact(spark.createDataFrame([(1, "a token=abcdefgh b", 18), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, masked.collect())) == [(1, "a [secret] b", 12), (2, None, None), (3, "clean", 5)]


# --- 4 and 9: classifiers ----------------------------------------------------

def test_languages_held_out(spark, odd):
    got = queries.QUERIES["op4_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95 and got.where("score < 0 OR score > 1").count() == 0
    learnt = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), sample_rows=300)
    out = langid.identify(odd, learnt).collect()
    assert [r.lang_pred for r in out if not (r.text or "").strip()] == ["und"] * 3 and len(out) == len(ODD)
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.train(odd.limit(0)) is None


def test_toxicity_learns(spark, odd):
    rng = random.Random(5)
    plain = ["garden", "river", "stone", "window", "paper", "music", "yellow", "winter", "travel", "market", "silver", "planet"]
    texts = [" ".join(rng.choice(plain) for _ in range(40)) for _ in range(600)]
    labels = [n % 2 for n in range(600)]
    texts = [t + rng.choice([" idiotic ", " pathetic ", " scumbag "]) + rng.choice(plain) if y else t for t, y in zip(texts, labels)]
    model = toxicity.fit(texts[:400], labels[:400], ["en"] * 400, 0.1, steps=150)
    score = model.score(*toxicity.Reader(model).read(texts[400:]))
    assert ((score >= 0.3) == np.array(labels[400:])).mean() > 0.97 and score.min() >= 0 and score.max() <= 1
    # Blocks of words give what the whole text gives.
    long = " ".join(texts)
    whole = toxicity.Reader(model).read([long, ""])
    toxicity._BLOCK, before = 100, toxicity._BLOCK
    try:
        parts = toxicity.Reader(model).read([long, ""])
    finally:
        toxicity._BLOCK = before
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    scored = toxicity.score_toxicity(odd, model)
    assert scored.count() == len(ODD) and scored.where("score IS NULL").count() == 0
    assert toxicity.score_toxicity(odd.limit(0), None).count() == 0 and toxicity.fit(["a"], [1], [None], 0.1) is None


def test_toxicity_learns_from_every_labelled_document(spark):
    """The first model sees ten documents of each label; words that only others hold must move all the same, and the model must not depend
    on how rows are dealt out. Held-out documents teach nothing."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = [(k, ["en", "fr", None][k % 3], " ".join(word() for _ in range(5)), k % 4 == 0) for k in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, "en", "no id", ), (7, "en", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    start = np.random.default_rng(11).normal(0, 0.3, (toxicity.BUCKETS, 16)).astype(np.float32)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        models = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            models.append(toxicity.train(docs.repartition(int(n)), labels, rows_per_label=10))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    moved = (models[0].embedding != start).any(axis=1)
    of = lambda held: np.unique(toxicity.subword_buckets(
        [w.encode() for k, _, text, _ in rows if (zlib.crc32(str(k).encode()) % 4 == 2) == held for w in text.split()], toxicity.SIZES, toxicity.BUCKETS)[0])
    taught = of(False)
    assert moved[taught].sum() > 0.4 * len(taught) > 20 * 5 * 22 and not moved[np.setdiff1d(of(True), taught)].any()
    assert np.allclose(models[0].embedding, models[1].embedding, atol=1e-5) and np.allclose(models[0].cuts, models[1].cuts, atol=1e-2)
    assert models[0].languages == ["en", "fr"]


def test_toxicity_groups_keep_ids_apart():
    """Labels go to the documents of their id only; long texts end a part early."""
    import pyarrow as pa

    rows = [(0, "a", 1, None, None), (0, "a", None, "en", "x" * 5), (0, "a", None, None, "y"), (0, "b", None, "en", "no label"),
            (0, "c", 0, None, None), (1, "d", 0, None, None), (1, "d", None, "fr", "z")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 2])], names=list("gilxt")) for k in range(0, len(rows), 2)]
    toxicity._TEXT, before = 4, toxicity._TEXT
    try:
        parts = [(texts, y.tolist(), langs) for texts, y, langs in toxicity._together(iter(batches))]
    finally:
        toxicity._TEXT = before
    assert parts == [(["x" * 5], [1.0], ["en"]), (["y"], [1.0], [None]), (["z"], [0.0], ["fr"])]


# --- 5: WARC -----------------------------------------------------------------

def test_warc_query_equals_sql(spark):
    got = sorted(queries.QUERIES["op5_warc"](spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert [tuple(r) for r in got] == sorted(con.execute(queries.SQL["op5_warc"]).fetchall())


def test_archives_round_trip(spark):
    big = "<p>é\r\n\r\n</p>" * 200
    rows = [(1, "http://a.example.com/x", big), (2, "http://a.example.com/x", big), (3, "http://b.example.com/\r\nX: y", "small"),
            (4, None, None), (None, "http://c.org", big), (5, "http://d.org/%41", "small"), (5, "http://d.org/%41", "small")]
    rows += [(k, "http://hot.example.com/", f"page {k}") for k in range(100, 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archive = warc.write_archives(pages)
    got = warc.read_captures(archive, pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[1].payload) == ("revisit", 2, None) and by[2].payload.decode() == big
    assert by[None].refers_to == 2 and by[1].payload_bytes == len(big.encode()) and by[3].url == "http://b.example.com/\r\nX: y"
    assert (by[4].url, by[4].payload) == (None, b"") and {by[k].payload.decode() for k in (100, 899)} == {"page 100", "page 899"}
    missing = spark.createDataFrame([(999_999, "http://none.org"), (100, "http://a.example.com/x")], "page_id long, url string")
    assert warc.read_captures(archive, missing).count() == 0
    assert warc.read_captures(warc.write_archives(pages.limit(0)), pages).count() == 0
    assert warc.sort_key("http://A.b.com:80/x?y#z") == "com,b,a:80)/x?y"


def test_records_hold_the_address_as_it_is():
    for url in ("http://d.org/%41?a=b%0A", " http://x/ y ", "http://d.org/\r\nWARC-Type: x", "", "http://é.org/ü", "no scheme: at all"):
        member = warc._record(5, url, b"<p>", hashlib.sha1(b"<p>").hexdigest(), None)
        got = warc.parse_record(member)
        assert (got["page_id"], got["url"], got["payload"], got["record_type"]) == (5, url, b"<p>", "response")
        head = gzip.decompress(member).split(b"\r\n\r\n")[0].decode()
        assert head.count("WARC-Type:") == 1 + url.count("WARC-Type:") * 2
        if "\n" not in url:
            assert f"\r\nWARC-Target-URI: {url}\r\n" in head
    info = gzip.decompress(warc._warcinfo())
    assert info.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and int(re.search(rb"Content-Length: (\d+)", info)[1]) == len(info.split(b"\r\n\r\n", 1)[1]) - 4


def test_archive_files_begin_with_a_warcinfo_record(spark):
    archive = warc.write_archives(spark.createDataFrame([(k, f"http://a.b/{k}", "x" * k) for k in range(9)], "page_id long, url string, html string"))
    for file in {r.file for r in archive.captures.collect()}:
        data = open(os.path.join(archive.folder.removeprefix("file:"), file), "rb").read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and gzip.decompress(data).count(b"WARC/1.1\r\n") == 1 + archive.captures.where(F.col("file") == file).count()


# --- 6: sharding -------------------------------------------------------------

def test_shards_are_even_and_gapless(spark, odd):
    got = queries.QUERIES["op6_histogram_shards"](spark, SF).toPandas()
    by = got.groupby("shard")
    assert sorted(by.groups) == list(range(24)) and all(sorted(g.slot) == list(range(len(g))) for _, g in by)
    size = by["size"].sum()
    # No boundary is further from its place than half a document or the tolerance.
    assert size.max() - size.min() <= 2 * max(got["size"].max(), 0.01 * size.mean())
    con = duckdb.connect()
    want = con.execute(f"SELECT doc_id, strlen(coalesce(text, '')) + 8 FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(zip(got.doc_id, got["size"])) == sorted(want)
    fine = sharding.shard_by_bytes(spark.read.parquet(f"{SF}/documents.parquet"), 4, bucket_bytes=50_000).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in fine.groupby("shard"))
    few = sharding.shard_by_bytes(odd, 3).collect()
    assert len(few) == len(ODD) and {r.size for r in few if not r.text} == {8}
    assert sharding.shard_by_bytes(odd.limit(0), 3).count() == 0


def test_splitters_are_within_the_tolerance(spark):
    rng = np.random.default_rng(7)
    high, size = rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(8, 5000, 3000)
    high[:900] = high[0]  # a group of equal texts, cut between its ids
    rows = [(int(h), k, int(n)) for k, (h, n) in enumerate(zip(high, size))]
    bounds, below = sharding.find_splitters(spark.createDataFrame(rows, "high long, low long, size long"), 40, 0.05)
    key = lambda h, low: (h + (1 << 63)) << 64 | (low + (1 << 63))
    total, widest = int(size.sum()), int(size.max())
    for k, (bound, n) in enumerate(zip(bounds, below), 1):
        under = [r for r in rows if key(r[0], r[1]) < bound]
        assert len(under) == n and abs(sum(r[2] for r in under) - total * k / 40) <= max(0.05 * total / 40, widest)
    assert bounds == sorted(bounds)


# --- 7: SimHash --------------------------------------------------------------

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    got = queries.QUERIES["op7_simhash"](spark, SF).collect()
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    some = sorted(texts)[:: max(1, len(texts) // 100)]
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all(prints[d] == f"{brute_print(texts[d]):016x}" for d in some)
    ids, marks = sorted(prints), np.array([int(prints[d], 16) for d in sorted(prints)], np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(marks[i] ^ marks) <= 2)]
    assert {r.doc_id: r.component_id for r in got} == root_of(ids, links)
    out = simhash.near_duplicates(odd, 3, 2).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in out if r.doc_id is None] == [4]
    assert simhash.near_duplicates(odd.limit(0), 3, 2).count() == 0


def test_hot_shards_are_cut_again(spark):
    rng = random.Random(2)
    marks = {rng.getrandbits(12) << 20 | 0xABC for _ in range(400)} | {rng.getrandbits(64) >> 1 for _ in range(200)}
    rows = [(m, n) for n, m in enumerate(sorted(marks))]
    links = simhash.near_links(spark.createDataFrame(rows, "mark long, node long"), 2, shard_limit=30).collect()
    near = [(a, b) for m, a in rows for k, b in rows if a < b and (m ^ k).bit_count() <= 2]
    nodes = [n for _, n in rows]
    assert root_of(nodes, [tuple(x) for x in links]) == root_of(nodes, near)


# --- 8: embeddings -----------------------------------------------------------

def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    points = [base[k % 120] + rng.normal(size=16) * 0.03 * (k % 3) for k in range(700)] + [base[0]] * 40
    rows = [(n, [float(x) for x in p.astype(np.float32)], n % 2) for n, p in enumerate(points)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None] * 8, 1), (5003, [float("nan")] * 16, 1), (5004, rows[0][1], None), (5005, [], 0), (5006, [2.0, 1.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98, part_rows=50, leaf_rows=60).collect()}
    v = np.array([r[1] for r in rows[:740]])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.arange(740)[:, None] % 2 == np.arange(740) % 2)
    np.fill_diagonal(near, False)
    found = sum(got[n].n_links for n in range(740))
    assert 0.99 * near.sum() <= found <= near.sum()
    want = root_of(range(740), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    assert np.mean([got[n].component_id == want[n] for n in range(740)]) > 0.99
    assert all(got[n].n_links == 0 and got[n].kept for n in range(5000, 5007)) and len(got) == len(rows)


# --- 10: byte-level BPE ------------------------------------------------------

def test_bpe_equals_tiktoken(spark, odd):
    ranks = bpe.read_ranks(VOCABULARY)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["", "a" * 1500, "ab" * 700 + "é" * 300, "".join(rng.choice("abcdefghij") for _ in range(4000)), " \n\n\t x  ", "日本語 😀👍🏽 zażółć" * 20, "<|endoftext|>"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(400)) for _ in range(20)]
    encoder = bpe.Encoder(bpe.Codec(ranks, bpe.PairTable.build(ranks)), public_tokenizers.PATTERN)
    assert [e.tolist() for e in encoder.encode(texts)] == [want.encode_ordinary(t) for t in texts]
    coded = bpe.decode(bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect()
    assert len(coded) == len(ODD)
    for r in coded:
        assert r.ids == want.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op10_byte_bpe"](spark, SF).collect()}
    assert got == {d: len(want.encode_ordinary(t)) for d, t in docs}


# --- the pipeline ------------------------------------------------------------

def test_pipeline_stages_keep_the_rules(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.limit(5)), SF)
    classes = simhash.near_duplicates(docs, 3, 2)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted({r.component_id for r in classes.collect()})
    done = corpus_pipeline.run(spark, SF)
    assert done.where("NOT round_trip").count() == 0 and 0 < done.count() <= one.count()
    blank = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, blank, SF).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    """Ids that repeat with other texts, null ids and texts, repeated rows: a text goes only if a near copy of it stays."""
    import corpus_pipeline

    base = " ".join(f"word{k}" for k in range(400))
    bits = lambda a, b: bin(simhash.fingerprint(a, 3) ^ simhash.fingerprint(b, 3)).count("1")
    near = next(f"{base} tail{k}" for k in range(500) if bits(base, f"{base} tail{k}") <= 2)
    other, third = " ".join(f"other{k}" for k in range(300)), " ".join(f"third{k}" for k in range(300))
    rows = [(1, base, "b"), (1, other, "a"), (2, near, "a"), (2, third, "a"), (3, base, "a"), (None, base, "a"), (None, other + " x y z", "a"), (4, None, "a"), (5, "", "a"),
            (6, "alone", "z"), (6, "alone", "y"), (6, "alone", "y"), (None, "nameless", "b"), (None, "nameless", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, {"k": 1}) for i, t, s in rows], "doc_id long, text string, lang string, source string, _row int, extra map<string,int>")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)[:8]) for r in kept.collect())
    assert got == sorted([("1", "word0 wo"), ("1", "other0 o"), ("2", "third0 t"), ("4", "None"), ("6", "alone"), ("None", "nameless")])
    assert sorted(map(str, kept.collect())) == sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs.orderBy(F.desc("source")), SF).collect()))
