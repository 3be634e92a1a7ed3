"""Text operators against brute force: decontamination over all windows, languages and quality worked out without the engine."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import DOCS, WORDS
from waymark.llm import bpe, cotraining, decontaminate, html_text, language_id, pii, textarrays as ta


def words_of(text):
    return re.sub(r"[!-/:-@\[-`{-~]", "", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()


def shingles(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute_windows(text, item):
    """Best similarity of a window and the first place that has it."""
    w, own = words_of(text), words_of(item)
    if not w or not own:
        return None
    n, best = min(len(own), len(w)), None
    want = shingles(own)
    for k in range(len(w) - n + 1):
        have = shingles(w[k : k + n])
        both = sum((have & want).values())
        sim = both / (sum(have.values()) + sum(want.values()) - both)
        if sim >= 0.8 and (best is None or sim > best[0]):
            best = (sim, k)
    return best


def test_all_windows_with_similarity(spark):
    rng = random.Random(31)
    pick = lambda k: rng.choices(WORDS, k=k)
    items = [" ".join(pick(k)) for k in (1, 2, 3, 4, 5, 6, 9, 15, 30, 60, 120, 200)] + [" ".join(pick(4) * 8), " ".join(pick(15))]
    texts = []
    for item in items:
        for edits in range(7):
            w = item.split()
            if edits == 5:  # rotated
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            elif edits == 6:  # a piece in the middle is longer
                w = w[: len(w) // 2] + pick(len(w) // 12) + w[len(w) // 2 :]
            else:
                for _ in range(edits * len(w) // 60 + (edits > 2 and len(w) > 30)):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], pick(1), pick(2)])
            texts.append(" ".join([*pick(rng.randrange(40)), *w, *pick(rng.randrange(40))]))
    texts += [items[8] + " " + items[8] + " x " + items[9], "", " ", items[2].upper() + "!", " ".join(pick(3)), items[10] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*[(i, t) for i, t in enumerate(items)], (None, items[7])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, i): (round(b[0], 9), b[1]) for d, t in enumerate(texts) for i, item in [*enumerate(items), (None, items[7])] if (b := brute_windows(t, item))}
    assert got == want and len(want) > 60 and any(b[0] < 1 for b in want.values())


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    rng = random.Random(32)
    items = [" ".join(rng.choices(WORDS, k=20)) for _ in range(15)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(15)}


def test_radius_of_similar_windows():
    """How far from its item SimHash puts a window of the least similarity: never beyond the radius in 4000 of them."""
    rng, far = np.random.default_rng(33), []
    for _ in range(4000):
        n = int(rng.integers(9, 150))
        own = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = own.copy()
        other[: n // 9] = rng.integers(0, 2**63, n // 9, dtype=np.uint64)
        a, b = (decontaminate._fingerprints(decontaminate._signs(x).sum(axis=0)[None, :]) for x in (own, other))
        far.append(int(decontaminate._ONES[a ^ b].sum()))
    assert max(far) <= decontaminate.RADIUS and 7 < np.mean(far) < 12


def test_nearest_centroid_by_hand(spark):
    rng = random.Random(34)
    syll = {"xx": ["ba", "do", "ki"], "yy": ["zu", "wé", "ñy"], "zz": ["tra", "sho", "pli"]}
    rows = [(i, " ".join("".join(rng.choices(syll[g], k=3)) for _ in range(12)), g, "s", 1) for i in range(90) for g in [("xx", "yy", "zz")[i % 3]]]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df, F.col("doc_id") < 60)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}

    def vector(text):
        text = re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalpha() else " ", text)
        raw = re.sub(rb" +", b" ", text.encode())
        counts = np.zeros(language_id.DIMS)
        for k in (2, 3):
            for i in range(len(raw) - k + 1):
                code = sum(raw[i + j] << (8 * j) for j in range(k))
                counts[((code + k) * 2654435761 % 2**32) >> (32 - 12)] += 1
        v = np.log1p(counts) * model["idf"]
        return v / np.linalg.norm(v)

    for i, t, g, _, _ in rows:
        cos = model["centroids"] @ vector(t)
        assert got[i].lang_pred == model["owner"][int(np.argmax(cos))] == g and abs(got[i].score - cos.max()) < 1e-4


def test_cotraining_without_the_engine(spark):
    rng = random.Random(35)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rng.choices(WORDS[:200] if good else WORDS[150:], k=rng.randrange(20, 60))) + ("" if good else " ##" * rng.randrange(9))
        rows.append((i, text, "en", f"s{rng.randrange(3) + (0 if good else 2)}", len(text)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)], "doc_id long, quality int")
    model = cotraining.fit(docs, labels)
    got = {r.doc_id: r.quality for r in cotraining.score(docs, model).collect()}
    # the same by plain arrays: both views of all rows, labelled ones in the order of their key
    held = {r["_doc"]: r for r in docs.select(*cotraining._inputs(docs, F.col("doc_id").alias("_doc")), F.xxhash64("doc_id").alias("_key")).collect()}

    def arrays(ids):
        raw = [held[i]["_text"].encode() for i in ids]
        t = cotraining.text_view(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        return {"t": t, "m": cotraining.meta_view(np.array([[held[i][c] for c in ("_s", "_l", "_n")] for i in ids]))}

    known = sorted(range(0, 240, 2), key=lambda i: held[i]["_key"])
    rest = arrays(range(1, 240, 2))
    lengths = np.array([len(held[i]["_text"].encode()) for i in range(1, 240, 2)])

    def gather(models):
        out = {"all": 120.0, "t": [], "m": []}
        for v, other in (("t", "m"), ("m", "t")):
            groups = {}
            for k, z in enumerate(cotraining.logits(rest[other], models[other])):
                if abs(z) > 1:
                    groups.setdefault((int(z > 0), min(int((abs(z) - 1) * 4), cotraining.STEPS - 1), int(lengths[k] % cotraining.KINDS)), []).append(k)
            out[v] = [(g[0], g[1], float(len(own)), rest[v][own].astype(np.float64).mean(axis=0).astype(np.float32)) for g, own in sorted(groups.items())]
        return out

    want = cotraining.trained(np.array([int(i % 3 > 0) for i in known]), arrays(known), gather)
    both = arrays(range(240))
    z = np.stack([want["scale"][v][0] * cotraining.logits(x, want["w"][v]) + want["scale"][v][1] for v, x in both.items()], axis=1)
    plain = 1 / (1 + np.exp(-np.clip(cotraining.logits(z.astype(np.float32), want["mix"]), -30, 30)))
    assert max(abs(got[i] - plain[i]) for i in range(240)) < 1e-3
    unseen = [i for i in range(240) if i % 2]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in unseen]) > 0.9


def test_classes_within_the_article_are_text():
    para = "<p>" + "Words of the article. " * 12 + "</p>"
    page = f"<body><div class='site-header'>Site</div><article><h1 class='article-header'>Head</h1><p class='notice'>Notice of the author, part of what is told here.</p>{para}<div class='share'>Share this</div><p id=comments-on-law>On law.</p>{para}</article><div class=comments>Reader</div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Head\nNotice of the author") and "On law." in got
    assert not any(w in got for w in ("Site", "Share this", "Reader"))


def brute_lines(page):
    """The text of plain pages by the rule, written out: paragraphs in a body, link lists weigh nothing."""
    lines = re.findall(r"<(p|li)>(.*?)</\1>", page)
    texts = [" ".join(re.sub(r"<[^>]*>", "", t).split()) for _, t in lines]
    weights = [len(x) if "<a" not in t else 0 for (_, t), x in zip(lines, texts)]
    sums = [sum(weights[i : i + html_text.WINDOW]) for i in range(len(lines))]
    bound, spans, i = min(html_text.SURGE, max(sums) // 2), [], 0
    while i < len(lines):
        if sums[i] > bound and weights[i]:
            j = i
            while j < len(lines) and sums[j]:
                j += 1
            spans.append((max(sums[i:j]), i, j))
            i = j
        else:
            i += 1
    good = [s for s in spans if s[0] >= html_text.PART * max(x[0] for x in spans)]
    first = good[0][1]
    while first and weights[first - 1]:
        first -= 1
    return "\n".join(texts[first : good[-1][2]])


@pytest.mark.parametrize("seed", range(6))
def test_spans_of_plain_pages(seed):
    rng = random.Random(seed)
    page = ""
    for _ in range(30):
        if rng.random() < 0.5:
            page += "".join(f"<li><a href=x>{rng.choice(WORDS)}</a></li>" for _ in range(rng.randrange(1, 6)))
        else:
            page += "".join("<p>" + " ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) + "</p>" for _ in range(rng.randrange(1, 4)))
    assert html_text.main_text(page) == brute_lines(page)


def test_cue_spans_equal_their_patterns():
    rng, auto = random.Random(36), pii.build()
    parts = ["Token", "=", ":", " ", "'", "abcDEF012345", "İ", "API_KEY", "https://", "WWW.", "x.org/a?b", ").", "IBAN", "DE44500105175407324931", "account no", "ſ", "K", " ", "password", "99-1234567"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(12)))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        got = pii.spans_of(auto, t)
        assert got["url"] == [(m.start(), m.start() + len(m[0].rstrip(".,;:!?)]}"))) for m in pii._URL.finditer(low)]
        assert got["account"] == [m.span(1) for m in pii._ACCOUNT.finditer(low)]
        assert got["secret"] == [m.span(1) for m in pii._SECRET.finditer(low)]


def test_vocabulary_without_a_byte():
    import base64

    data = b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255))
    with pytest.raises(ValueError, match="255"):
        bpe.Vocabulary(data)


def test_runs_hash_like_short_texts():
    words, at = ta.word_hashes(np.frombuffer(b"one two three four", np.uint8), np.array([0, 18]))
    for n in range(1, 5):
        for k in range(5 - n):
            alone, _ = ta.shingle_hashes(words[k : k + n], np.array([0, n]))
            assert alone[0] == ta.run_hashes(words, n)[k]


def test_many_known_digests_are_joined(spark, monkeypatch):
    from waymark.llm import license_scan

    texts = ["Released under the MIT License.", "Title\nLicensed under CC BY-NC 4.0\nLicensed under CC BY-NC 4.0!\nReleased under the MIT licence\nbody", "none", None, "", "Title\nLicensed under CC BY-NC 4.0"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    plain = lambda df: sorted((repr(r.doc_id), r.digest, r.licence, tuple(r.line_licences)) for r in df.collect())
    few = plain(license_scan.scan(docs))
    none = license_scan.scan(docs, license_scan.known_digests(spark).where("false"))
    assert all(r.licence is None and r.line_licences == [] for r in none.collect())
    monkeypatch.setattr(license_scan, "LISTED", 3)
    assert plain(license_scan.scan(docs)) == few and ("1", ("CC-BY-NC-4.0", "MIT")) in {(r[0], r[3]) for r in few}
