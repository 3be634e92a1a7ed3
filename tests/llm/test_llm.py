"""The text operators on small tables against brute force, with nulls, empty and long texts, repeated rows and odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, common, components, cotraining, decontaminate, html_text, jaccard_join, language_id, license_scan, pii, quality_rules, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=55))
    out = []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randrange(20, 160))
        if i % 3 == 0 and out:
            w = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w) + (f"\n{passage}" if i % 5 == 0 else ""))
    return [*out, out[3], out[3].upper(), "", "   ", "one two", "One  two\n", "a", None, " ".join(rng.choices(WORDS, k=30_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus())]
    rows += [rows[5], (None, "no id at all here", None, None, None), (None, None, None, None, None)]
    # columns whose names clash with those that the operators use inside
    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "h": F.lit("x"), "kept": F.lit(0), "places": F.lit(2), "set": F.lit(3)}).repartition(3)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("region", [256, 3])
def test_jaccard_components(docs, region):
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect()
    got = jaccard_join.jaccard_components(docs, region).collect()
    assert len(got) == docs.count()
    want = brute_components([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_blocks_of_large_regions():
    rng = random.Random(3)
    import numpy as np

    base = [rng.getrandbits(60) for _ in range(60)]
    sets = {k: np.unique(np.array([x if rng.random() > 0.08 else rng.getrandbits(60) for x in base], dtype=np.uint64)) for k in range(1, 40)}
    links, _ = jaccard_join.join_region(1, sets)
    union = jaccard_join._Union()
    for a, b in links:
        union.join(a, b)
    brute = jaccard_join._Union()
    for a in sets:
        for b in sets:
            if a < b and jaccard_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                brute.join(a, b)
    assert {k: union.root(k) for k in sets} == {k: brute.root(k) for k in sets}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "u long, v long")
    got = components.components(edges)
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_language_id(spark):
    rng = random.Random(2)
    syll = {"xx": ["ba", "do", "ki"], "yy": ["zu", "wé", "ñy"]}
    rows = [(i, " ".join("".join(rng.choices(syll[g], k=3)) for _ in range(30)), g, "s", 1) for i in range(120) for g in [("xx", "yy")[i % 2]]]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, "12 34 !!", None, None, None), (None, "bado kiba", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(df, ~F.col("held_out"))
    got = {r.doc_id: r for r in language_id.predict(df, model, "held_out").collect()}
    assert all(got[i].lang_pred == g for i, _, g, _, _ in rows if g)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502)) and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    none = language_id.fit(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    slots, homes, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r["size"]].add(r.shard)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    order = Counter()
    for r in sharding.sized(docs).collect():
        order[r.k1, r.k2] += r["size"]
    seq = [order[k] for k in sorted(order)]

    def enough(c):
        used = at = 0
        for x in seq:
            if x > c:
                return False
            used, at = (used + 1, x) if not used or at + x > c else (used, at + x)
        return used <= 4

    assert max(sizes.values()) == next(c for c in range(max(seq), sum(seq) + 1) if enough(c))
    assert sharding.shard(docs.where("false"), 4).count() == 0


def test_refined_cuts_equal_whole_search(spark):
    rng = random.Random(5)
    groups = [(rng.randrange(1 << 60), rng.randrange(1 << 60), rng.randrange(1, 500)) for _ in range(3000)] + [(7 << 48, 5, 4000)]
    df = spark.createDataFrame(groups, "k1 long, k2 long, bytes long").cache()
    got, _ = sharding.plan_cuts(df, 9, 3, 3)
    ends, total = [], 0
    for _, _, b in sorted(groups):
        total += b
        ends.append((total, False))
    assert got == sharding.smallest(ends, 9, False)


def test_cotraining(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(WORDS, k=50)), "en", f"s{i % 3}", 200) for i in range(60)]
    bad = [(100 + i, " ".join("### $$$" for _ in range(30)), "en", f"s{3 + i % 3}", 20) for i in range(40)]
    df = spark.createDataFrame([*good, *bad, (None, None, None, None, None), (999, "", None, None, None)], DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.score(df, cotraining.fit(df, labels)).collect()}
    assert all(got[r[0]].kept for r in good) and not any(got[r[0]].kept for r in bad)
    flat = cotraining.score(df, cotraining.fit(df, labels.where("quality = 1"))).collect()
    assert {r.quality for r in flat} == {1.0}


def test_licenses(spark):
    texts = ["Copyright (c) 2020 Someone\n\n" + license_scan._MIT.upper().replace("license", "licence"), "Text.\nReleased under the MIT licence!\nMore.", "no licence at all", None, "", "Licensed under the Apache License, version 2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit("x"))
    got = {r.doc_id: (r.licence, r.line_licences) for r in license_scan.scan(df).collect()}
    assert got[0][0] == "MIT" and got[1] == (None, ["MIT"]) and got[2] == (None, []) and got[3] == (None, []) and got[4] == (None, []) and got[5] == ("Apache-2.0", ["Apache-2.0"])


def test_pii(spark):
    text = "a.b@c.d-e.com x@y z 1.2.3.4.5 999.1.1.1; 4111 1111 1111 1111, 1234567890123 +1 (555) 555-7713. https://e.org/x?y=1. token = \"abcdef0123456789abcd\" IBAN: DE44500105175407324931 é@f.g"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_url, r.n_account, r.n_secret) == (1, 1, 1, 1, 1, 1, 1)
    kinds = {s.split(":")[0]: text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",")}
    assert kinds["email"] == "a.b@c.d-e.com" and kinds["card"] == "4111 1111 1111 1111" and kinds["secret"] == "abcdef0123456789abcd" and kinds["url"] == "https://e.org/x?y=1"
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df.withColumn("n_chars", F.lit(5))).collect()}
    assert "4111" not in clean[1] and "[email]" in clean[1] and clean[2] is None


def test_base_spans_equal_the_patterns():
    rng, auto = random.Random(6), pii.build()
    for _ in range(3000):
        t = "".join(rng.choices("a1 9.@+-(%é0", k=rng.randrange(40)))
        got = pii.spans_of(auto, t)
        digits = lambda s: re.sub(r"[^0-9]", "", s)
        assert got["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert got["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert got["card"] == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        assert got["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_decontamination(spark):
    rng = random.Random(8)
    items = [" ".join(rng.choices(WORDS, k=k)) for k in (30, 42, 3)]
    near = items[1].split()
    near[5] = "other"
    far = items[0].split()
    far[7] = far[22] = "other"
    body = lambda x: " ".join(rng.choices(WORDS[200:], k=80)) + " " + x + " " + " ".join(rng.choices(WORDS[200:], k=80))
    texts = [body(items[0].upper() + "!!"), body(" ".join(near)), body(" ".join(far)), body(""), items[1], None, "", items[2]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())
    near_sim = 33 / 43  # five of 38 shingles differ
    assert near_sim < 0.8 and got == {(0, 0): 2, (4, 1): 1, (7, 2): 1}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>One\n two<br>three<p>Four <a href='x>y'>link</a>.<aside>Side</aside><script>var a='</p>';</script></article><section id=comments><p>Nice!</p></section><footer>&copy; x</footer>"
    soup = "<body><ul><li><a>Home</a><li><a>About</a></ul><div><p>" + "Long text here. " * 10 + "</p><p>" + "More of it. " * 10 + "</p></div><div class=sidebar>" + "Side. " * 40 + "</div><p>Terms</p>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", soup), (5, "u", "plain words")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == "Head & line\nOne two three\nFour link." and got[2] == got[3] == "" and got[5] == "plain words"
    assert got[4].startswith("Long text here.") and "More of it." in got[4] and "Side" not in got[4] and "Home" not in got[4]


def test_quality_rules(docs):
    rows = {}
    led = quality_rules.apply_policy(quality_rules.ledger(docs))
    for r in led.collect():
        rows.setdefault(r.doc_id, r)
    for r in docs.where("doc_id IS NOT NULL").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        k, covered = Counter(g), set()
        for i, x in enumerate(g):
            if k[x] > 1:
                covered.update(range(i, i + 5))
        got = rows[r.doc_id]
        assert (got.n_words, got.n_repeat_words, got.word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert got.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (got.base_failed and got.kept)
    assert docs.where(quality_rules.verdict(F.col("text"))).count() == led.where("kept").count()
    ab = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(led).collect()}
    assert ab["few_words"][0] == led.where("n_words < 10").count()


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    import regex
    import tiktoken

    data = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["", None, "a" * 3000, " " * 700, "<|endoftext|>", "é" * 400, "x\n\n y's 123"] + ["".join(rng.choices("thein é\n'sQ1日", k=rng.randrange(300))) for _ in range(60)]
    rows = bpe.token_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), data, public_tokenizers.PATTERN)
    for r in rows.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode_rows(rows, data).collect()} == {i: t or "" for i, t in enumerate(texts)}
    vocab = bpe.Vocabulary(data)
    for p in regex.findall(public_tokenizers.PATTERN, " ".join(t or "" for t in texts)):
        assert vocab.merge_long(p.encode()) == (vocab.encode_pieces([p])[p] if p.encode() not in ranks else vocab.merge_long(p.encode()))


def test_bpe_pieces_are_forgotten_and_met_again(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    vocab = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    monkeypatch.setattr(bpe, "REMEMBER", 40)
    known, rng = bpe.Pieces(vocab), random.Random(4)
    for _ in range(60):
        pieces = ["".join(rng.choices("abcdé ", k=rng.randrange(1, 9))) for _ in range(rng.randrange(70))]
        ids, at = bpe._gathered(known.ids, known.at, places) if len(places := known.places(pieces)) else (known.ids[:0], [0])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [vocab.encode_pieces([p])[p] for p in pieces]
        assert [known.written[k] for k in places.tolist()] == [" ".join(map(str, vocab.encode_pieces([p])[p])) for p in pieces]
        raw, begin = vocab.decode(ids)
        assert raw.tobytes() == "".join(pieces).encode() and len(begin) == len(ids) + 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(WORDS)}" for _ in range(60))
    first, item = text(), " ".join(rng.choices(WORDS, k=30))
    rows = [(1, first, "en", "s", 1), (2, first + " more", "en", "s", 1), (3, "too short", "en", "s", 1), (4, text() + " " + item, "en", "s", 1), (5, text() + " me@x.org", None, None, None), (5, text(), "en", "s", 1), (6, None, "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert nxt.columns == docs.columns
        docs = nxt
    assert sorted(r.doc_id for r in docs.collect()) == [1, 5] and all("me@x.org" not in r.text for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 5]


def test_html_sums_choose_the_text():
    para = lambda w: f"<p>{(w + ' text of the page. ') * 12}</p>"
    teasers = "".join(f"<article><h3><a href=x>Teaser {i}</a></h3><p>Teaser words {i}</p></article>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href=x>Link {i}</a>" for i in range(8)) + "</ul>"
    body = f"<div><h1>Head</h1>{para('One')}{para('Two')}</div>"
    for page in (f"{body}{teasers}", f"{teasers}{body}", f"<main>{body}{teasers}</main>"):
        got = html_text.main_text(page)
        assert got.startswith("Head\nOne") and "Two" in got and "Teaser" not in got
    assert "Comment" not in html_text.main_text(f"{body}<div class=comments><article>{para('Comment')}{para('Comment')}{para('Comment')}</article></div>")
    got = html_text.main_text(f"{links}<h1>Head</h1>{links}{para('One')}{links}{para('Two')}{links}<p>Terms</p>")  # no article
    assert got.startswith("Head\nOne") and got.index("One") < got.index("Link 7") < got.index("Two") and got.count("Link 0") == 1 and "Terms" not in got
    assert html_text.main_text(f"<div class=ad>Advert<article>{para('One')}</article>").startswith("One")
    assert html_text.main_text(f"<div><div class=ad>Advert<article>{para('One')}</article></div>").startswith("One")
    two = html_text.main_text(f"<article>{para('One')}{links}{para('Two')}</article><article>{para('Three')}{para('Four')}</article>")
    assert all(w in two for w in ("One", "Link 3", "Two", "Three", "Four"))


def test_full_licence_texts_and_lines_without_the_word(spark):
    named = dict(license_scan.TEXTS)
    flat = " ".join(license_scan._ISC.split())
    texts = [named["Apache-2.0"], named["GPL-3.0"].upper(), named["MPL-2.0"], "Copyright (c) 2020, X\nAll rights reserved.\n\n" + named["BSD-3-Clause"], named["Unlicense"], "MIT License\n\nCopyright (c) 2021 X\n\n" + named["MIT"], named["CC0-1.0"], "Title\n" + flat + "\nbody", "x\n# SPDX-License-Identifier: LGPL-2.1-or-later\ny", flat]
    got = {r.doc_id: (r.licence, r.line_licences) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(7)] == ["Apache-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause", "Unlicense", "MIT", "CC0-1.0"]
    assert got[7] == (None, ["ISC"]) and got[8] == (None, ["LGPL-2.1"]) and got[9] == ("ISC", ["ISC"])


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(WORDS)}" for _ in range(60))
    a, b, c, d, e, f, item = text(), text(), text(), text(), text(), text(), " ".join(rng.choices(WORDS, k=30))
    near = lambda x: x + " more"
    rows = [(1, a), (7, near(a)), (7, b), (2, c), (2, d), (8, near(c)), (9, near(c) + " yet"), (12, near(d)), (None, e), (None, e), (None, near(e)), (None, f), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    got = Counter((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, docs, str(tmp_path)).collect())
    left = [x for x in got if x[0] is None and x[1] in (e, near(e))]
    assert len(left) == 1 and got == Counter([(1, a), (7, b), (2, c), (12, near(d)), left[0], (None, f), (None, None)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (3, f"{c} {item}"), (3, d), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect())
    assert got == Counter([(None, b), (3, d), (4, None)])


def test_cues_beside_a_dotted_capital():
    assert [chr(c) for c in range(0x110000) if len(chr(c).lower()) != 1] == ["İ"]
    auto, text = pii.build(), "HTTPS://e.org/x IBAN: DE44500105175407324931 TOKEN=abcdef0123456789 Password: 0123456789abcdef WWW.e.org"
    plain = pii.spans_of(auto, text)
    assert [len(plain[k]) for k in ("url", "account", "secret")] == [2, 1, 2]
    assert pii.spans_of(auto, "İ " + text) == {k: [(a + 2, b + 2) for a, b in v] for k, v in plain.items()}


def test_cotraining_looks_at_all_documents(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(WORDS, k=20)), "en", f"s{i % 3}", 100) for i in range(2600)]
    df = spark.createDataFrame([*rows, *[rows[7]] * 3], DOCS)
    w = {v: [0.0] * n + [3.0] for v, n in (("t", cotraining.DIMS + cotraining._EXTRA), ("m", cotraining.META))}
    import numpy as np

    rest = cotraining._unlabelled(df, spark.createDataFrame([(i,) for i in range(100, 200)], "_id long"))
    got = cotraining.gathered(rest, {v: np.array(x) for v, x in w.items()})
    assert got["all"] == 2500 and all(sum(g[2] for g in got[v]) == 2500 and {g[0] for g in got[v]} == {1} for v in "tm")
    picked = cotraining.most_confident(got["t"], cotraining.GIVE * got["all"])
    assert abs(sum(n for _, n, _ in picked) - 125) < 1e-6


def test_cotraining_sample_is_of_distinct_labels(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "LABELLED", 40)
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "### $$$", "en", "s", 9) for i in range(60)], DOCS)
    labels = [(i, i % 2) for i in range(60)]
    first = spark.createDataFrame(labels, "doc_id long, y int").orderBy(F.xxhash64("doc_id")).first()
    labels = spark.createDataFrame(labels + [tuple(first)] * 100, "doc_id long, quality int")
    assert "w" in cotraining.fit(docs, labels)
