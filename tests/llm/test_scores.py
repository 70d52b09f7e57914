"""Quality, language, top-k, urls, licenses and media on small tables."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import langid, licenses, media, quality, topk, urlfilter

ODD = [(9001, ""), (9002, None), (9003, "12 34 !?"), (None, "no id at all"), (9004, "x " * 50_000), (9004, "x " * 50_000)]


def clean(rng):
    return " ".join(rng.choice(["the", "tion", "ander", "of", "erst", "and"]) + rng.choice(["", ".", ","]) for _ in range(60))


def junk(rng):
    return " ".join(rng.choice(["the", "tion", "ander"]) + rng.choice(["%%%", "$$$", "!!", "&&&"]) for _ in range(60))


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, junk(rng) if i % 3 == 0 else clean(rng)) for i in range(300)]
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string").withColumn("score", F.lit("was"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(5, None), (6, 7)], "doc_id long, quality int")
    voters = quality.fit(docs, labels)
    out = quality.score(docs, voters).collect()
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all((r.predicted == 1) == (r.doc_id % 3 != 0) for r in out if r.doc_id is not None and r.doc_id < 300)
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), voters).count() == 0


def test_language(spark):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "with", "other"], "de": ["schön", "über", "nicht", "auch"], "fr": ["être", "leçon", "voilà", "où"]}
    rows = [(i, " ".join(rng.choice(words[v]) for _ in range(1 + i % 40)), v) for i, v in enumerate(list(words) * 60)]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in ODD)], "doc_id long, text string, lang string")
    models = langid.fit(docs)
    out = langid.identify(docs.withColumn("lang_pred", F.lit("was")), models).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert sum(by[i].lang_pred == v for i, _, v in rows) >= 0.99 * len(rows)
    assert {by[i].lang_pred for i in (9001, 9002, 9003)} == {"und"}
    signs = np.append(np.flatnonzero(langid._letters()), 0).astype(np.uint64)
    assert len(signs) == langid.alphabet()
    for before in (0, ord("t") << 21 | ord("h"), ord("日") << 21 | ord("e"), ord("h")):
        probabilities = models.probability(signs | np.uint64(before << 21))
        assert np.allclose(probabilities.sum(0), 1, atol=1e-6) and (probabilities > 0).all()
    nothing = langid.fit(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), models).count() == 0


def slow_cost(texts, text):
    """Mean cost of a text under an interpolated Kneser-Ney trigram model of texts, sign by sign, over plain dictionaries."""
    from collections import Counter
    from math import log

    def signs(t):
        out = ["", ""]
        for c in [*t.lower(), ""]:
            c = c if c.isalpha() and __import__("unicodedata").category(c)[0] == "L" else ""
            if c or out[-1]:
                out.append(c)
        return out

    three = Counter(tuple(s[i : i + 3]) for s in map(signs, texts) for i in range(len(s) - 2))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1] for g in two)
    d, total, cost, s = 0.75, sum(one.values()), 0.0, signs(text)
    for i in range(len(s) - 2):
        a, b, c = s[i : i + 3]
        p = max(one[c] - d, 0) / total + d * len(one) / total / langid.alphabet()
        follow = [n for g, n in two.items() if g[0] == b]
        p = max(two[b, c] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p if follow else p
        follow = [n for g, n in three.items() if g[:2] == (a, b)]
        p = max(three[a, b, c] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p if follow else p
        cost -= log(p)
    return cost / (len(s) - 2)


def test_language_models_are_kneser_ney(monkeypatch):
    from collections import Counter

    texts = {"en": ["The thing, with other things", "there is"], "ja": ["日本語の文、と文", "本の話"], "de": ["Über schöne Dinge"]}
    counts = [dict(Counter(int(c) for t in texts[v] for part in langid.trigrams(t) for c in part)) for v in sorted(texts)]
    models = langid.Models(sorted(texts), counts)
    for text in ("the thing", "日本", "Ω unseen ü", "x", "schöne 日 things"):
        mean, _, n = models.surprise(text)
        assert mean == pytest.approx([slow_cost(texts[v], text) for v in sorted(texts)], rel=1e-4) and n > 1
    whole = np.concatenate(list(langid.trigrams("ab  c d" * 50 + " end")))
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert np.array_equal(np.concatenate(list(langid.trigrams("ab  c d" * 50 + " end"))), whole)


def test_any_alphabet(spark):
    """Two languages of 2,000 signs each, none in common, and an alphabet that neither has."""
    rng = random.Random(6)
    text = lambda first, n: "".join(chr(first + rng.randrange(2000)) for _ in range(n))
    rows = [(i, text(0x4E00 + 3000 * (i % 2), 30 + i % 90), "ab"[i % 2]) for i in range(400)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    others = [(i, text(0x4E00 + 3000 * (i % 2), 30), "ab"[i % 2]) for i in range(200)]
    assert all(models.judge(t)[0] == v for _, t, v in others)
    assert all(models.judge(text(0xAC00, 60))[2] for _ in range(50))


def test_quality_votes(spark):
    """Against plain cosines and votes over the same vectors, and the same scores in blocks of any size."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "buy", "cheap", "pills", "now"]
    rows = [(i, " ".join(rng.choice(words[:5] if i % 2 else words[3:]) for _ in range(30))) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    voters = quality.fit(docs, labels)
    bags = [quality.features(t) for _, t in rows]
    own = voters.latent(quality._weighed(bags, voters.idf))
    wanted = []
    for v in own:
        cosine = [sum(int(a) * int(b) for a, b in zip(v, w, strict=True)) / quality._UNIT**2 for w in voters.vectors]
        best = sorted(range(len(cosine)), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        edge = cosine[best[-1]]
        weights = [max(0, min(1, cosine[j])) ** quality.POWER for j in best]
        wanted.append((sum(w * voters.labels[j] for w, j in zip(weights, best, strict=True)) / sum(weights), sum(c == edge for c in cosine) > 1))
    got = voters.scores(bags)
    assert all(g == pytest.approx(w, abs=1e-9) for g, (w, tied) in zip(got, wanted, strict=True) if not tied)
    assert [float(voters.scores([b])[0]) for b in bags[:40]] == got[:40].tolist()
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == bool(i % 2) for i in held) >= 0.9 * len(held)
    # words alone tell plain lower-case texts apart
    assert set(quality.features("the quick brown fox")[0]) != set(quality.features("buy cheap pills now")[0])


def test_phases_skip_no_result():
    """Collected and resolved entries against all products, with norms that vary by row and by slice."""
    rng = np.random.default_rng(4)
    q = rng.integers(-50, 50, (7, 12)) * rng.integers(1, 9, (7, 1))
    c = rng.integers(-50, 50, (3000, 12)) * rng.integers(0, 9, (3000, 1))
    c[::3, 6:] = 0
    scores = q @ c.T
    low = np.sort(scores, axis=1)[:, -5]
    for slices in (1, 2, 5):
        cuts = topk._cuts(12, slices)
        entries = list(topk._collect(q, c, low, cuts))
        assert sum(len(i) for _, i, _, _ in entries) < scores.size
        got = [(i, j, s) for x in topk._resolve(q, c, low, cuts, entries) for i, j, s in zip(*x, strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= low[:, None]), strict=True)}


def brute_top(rows, every, k):
    usable = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min(np.float32(v).tolist() for i, v in rows if i == q and v is not None and all(x is not None and np.isfinite(x) for x in v))
        own = [int(np.floor(256 * np.float64(np.float32(x)))) for x in own]
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(own))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("n", [0, 3, 400])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, None), (2010, [None] * 8), (2020, [float("nan")] * 8), (50, [None] * 8), (60, [float("-inf")] * 8), (None, rows[1][1]), (30, [0.5, 0.25])]
        rows[9] = (9, [float(np.float32(x)) for x in rows[3][1]])
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), every=10, k=5, block_bytes=16 * 72, head=20).collect()
    wanted = brute_top([r for r in rows if r != (30, [0.5, 0.25])], 10, 5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id != 30} == {w for w in wanted if w[0] != 30}


URLS = [
    ("http://A.Example.ORG/es/x", "example.org/es/", "block"), ("http://b.example.org/en/123?q", "example.org/en/1", "block"), ("https://example.org/en/2", "org/", "allow"), ("https://notexample.org/es/", "org/", "allow"),
    ("https://x.com/de/1", "com/de/", "block"), ("https://x.com/fr/", "com/fr/", "allow"), ("https://x.com/de", None, "allow"), ("https://telecom/de/", None, "allow"), ("https://m.ads-x.net/", None, "block"),
    ("https://readsx.net/", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("http://org", None, "allow"), ("://", None, "allow"), ("http://x.org?a/es/", None, "allow"), ("http://x.org/ÄÖ\n", "org/", "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "was") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(URLS)}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_a_list_of_many_rules(spark):
    """Thousands of rules from a table, against every rule tried on every url; long and repeated urls."""
    rng = random.Random(12)
    rows = [(rng.choice(["allow", "block"]), f"{'sub.' * (i % 3)}site{i}.example.net", rng.choice(["/", "/a/", f"/p{i % 7}"])) for i in range(3000)]
    rules = urlfilter.rules_of(spark.createDataFrame(rows, "verdict string, host string, path string"))
    urls = [f"https://{'x.' * (i % 2)}{'sub.' * (i % 4)}site{rng.randrange(3300)}.example.net{rng.choice(['/', '/a/b', '/p3/q', ''])}" for i in range(400)] + ["http://site1.example.net/" + "a/" * 50_000] * 3
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, url in enumerate(urls):
        host, path = urlfilter.split_url(url)
        fit = [r for r in rules if (h := r.name.partition("/"))[0] and (host == h[0] or host.endswith("." + h[0])) and path.startswith("/" + h[2])]
        best = min(fit, key=lambda r: (-len(r.name), rules.index(r)), default=None)
        assert got[i] == ((best.name, best.verdict) if best else (None, "allow"))


def test_index_runs_few_rules():
    rules = tuple(urlfilter.Rule.host("block", f"site{i}.example.org/") for i in range(100))
    index = urlfilter.Index(rules, {"example": 500, "org": 900})
    assert max(map(len, index.by_token.values())) == 1 and not index.always
    assert index.judge("http://a.site7.example.org/", "a.site7.example.org", "/") == ("site7.example.org/", "block")


def test_licenses(spark):
    rows = [
        ("/a/LICENSE", "Released under the MIT License."), ("/a/x.txt", "no words of it"), ("/a/b/y.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore words here and more and more"),
        ("/a/b/z.txt", "plain"), ("/a/b/c/COPYING.md", "This work is licensed under the GNU General Public License, version 3."), ("/a/b/c/d/w.txt", ""), ("/q.txt", None), (None, "Licensed under CC BY-NC 4.0."), (None, "x"),
        ("/e/short.txt", "Licensed under CC BY-NC 4.0."), ("/e/f/t.txt", "text"), ("/g/k.txt", "a driver license is a permission to drive"),
    ]
    files = spark.createDataFrame([(*r, "was") for r in rows], "path string, text string, license string")
    out = [(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.license_scan(files).collect()]
    assert sorted(out, key=str) == sorted([
        ("/a/LICENSE", "MIT", "MIT", None), ("/a/x.txt", None, "MIT", "/a/"), ("/a/b/y.txt", "Apache-2.0", "Apache-2.0", None), ("/a/b/z.txt", None, "MIT", "/a/"), ("/a/b/c/COPYING.md", "GPL-3.0-only", "GPL-3.0-only", None),
        ("/a/b/c/d/w.txt", None, "GPL-3.0-only", "/a/b/c/"), ("/q.txt", None, None, None), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (None, None, None, None), ("/e/short.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        ("/e/f/t.txt", None, "CC-BY-NC-4.0", "/e/"), ("/g/k.txt", None, None, None)], key=str)
    assert licenses.license_scan(files.limit(0)).count() == 0


def bmp(image):
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    body = b"".join(row[:, ::-1].tobytes().ljust(stride, b"\0") for row in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_media(spark):
    image = np.random.default_rng(3).integers(0, 256, (13, 7, 3), dtype=np.uint8)
    grey = image[:, :, :1]
    stored = [
        b"P6\n# note\n7 13\n255\n" + image.tobytes(), bmp(image), b"P3 7 13 255\n" + b" ".join(b"%d" % v for v in image.ravel()), media.encode_pgm(grey.tobytes(), 7), b"P2\n7 13\n255\n" + b"\n".join(b"%d" % v for v in grey.ravel()),
        b"P1\n3 2\n1 0 1\n0 1 0\n", b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]), None, b"", b"P6\n7", b"GIF89a",
    ]
    frame = spark.createDataFrame([(i, bytearray(s) if s is not None else None, "was") for i, s in enumerate(stored)], "i int, media binary, tile string")
    out = {r.i: r for r in media.media_features(frame, side=4).collect()}
    assert all(bytes(out[i].samples) == image.tobytes() for i in (0, 1, 2)) and all(bytes(out[i].samples) == grey.tobytes() for i in (3, 4))
    assert bytes(out[5].samples) == bytes(out[6].samples) == bytes([0, 255, 0, 255, 0, 255])
    assert all(out[i].width is None and out[i].dhash is None for i in (7, 8, 9, 10))
    tile = np.load(__import__("io").BytesIO(bytes(out[0].tile)))
    assert tile.shape == (4, 4, 3) and np.array_equal(tile, media.area_resize(image, 4, 4)) and out[0].dhash == out[1].dhash


def test_area_resize_is_exact(monkeypatch):
    monkeypatch.setattr(media, "_STRIP", 5 * 22)
    image = np.random.default_rng(4).integers(0, 256, (23, 11, 2), dtype=np.uint8)
    fine = np.repeat(np.repeat(image, 6, 0), 7, 1).astype(float)  # 138 x 77 holds 6 x 7 boxes evenly
    wanted = np.floor(fine.reshape(6, 23, 7, 11, 2).mean((1, 3)) + 0.5)
    assert np.array_equal(media.area_resize(image, 6, 7), wanted)


def test_text_media(spark):
    """Every digest against plain Python over the same bytes."""
    rows = [*ODD, (1, "é" * 288), (2, "x" * 577), (3, "same"), (4, "same")]
    docs = spark.createDataFrame([(*r, "was") for r in rows], "doc_id long, text string, feature string")
    out = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert media.text_media(docs.limit(0)).count() == 0 and media.text_media(docs).count() == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 24, 1)
        fine = np.repeat(np.repeat(grey[:, :, 0].astype(float), 8, 0), 9, 1)  # boxes of 8 rows and 9 columns, evenly
        small = np.floor(fine.reshape(8, len(grey), 9, 24).mean((1, 3)) + 0.5)
        bits = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(stored))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(stored).hexdigest())
        assert r.feature == bits


BROKEN = [
    b"P2\n1 1\n255\n99999999999999999999999", b"P3 1 1 255 " + b"9" * 400, b"P2 1 1 255 300", b"P5\n1 1\n100\n\xff", b"P1\n2 1\n1 9\n", b"P1\n2 2\n1 0 1\n", b"P5\n3 3\n255\nab", b"P4\n9 9\n1", b"P5\n-3 3\n255\nab", b"P5\n99999999 99999999\n255\n", b"P6", b"P5\n# open",
    b"BM", b"BM" + b"\0" * 60, b"BM" + b"\xff" * 80, b"P7\n1 1", b"\xff" * 100,
]


def test_broken_media_give_nulls(spark):
    rng = random.Random(3)
    good = [b"P2\n2 1\n255\n1 2", b"P5\n2 2\n255\nabcd", bmp(np.zeros((3, 3, 3), np.uint8))]
    noise = [bytes(b if rng.random() > 0.1 else rng.randrange(256) for b in rng.choice(good)) for _ in range(300)]
    frame = spark.createDataFrame([(i, bytearray(s), "was") for i, s in enumerate([*BROKEN, *good, *noise])], "i int, media binary, dhash string")
    out = {r.i: r for r in media.media_features(frame, side=4).collect()}
    assert len(out) == len(BROKEN) + len(good) + len(noise)
    assert all(out[i].width is None and out[i].dhash is None for i in range(len(BROKEN)))
    assert all(out[len(BROKEN) + i].width for i in range(len(good)))


def test_bit_fields():
    pixel = struct.pack("<4B", 1, 2, 3, 4)
    head = lambda masks: b"BM" + struct.pack("<IHHI", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0) + struct.pack("<3I", *masks)
    assert media.decode(head((0xFF0000, 0xFF00, 0xFF)) + pixel).ravel().tolist() == [3, 2, 1]
    assert media.decode(head((0xFF, 0xFF00, 0xFF000000)) + pixel).ravel().tolist() == [1, 2, 4]
    with pytest.raises(ValueError):
        media.decode(head((0xF8, 0xFF00, 0xFF000000)) + pixel)


def test_license_notices_of_any_case_and_wrapping():
    known = licenses.Templates()
    for text, name in [
        ("RELEASED UNDER THE MIT LICENSE", "MIT"), ("REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS, WITH OR WITHOUT MODIFICATION, ARE PERMITTED", "BSD-3-Clause"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at this place. */", "MPL-2.0"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following holds", "BSD-3-Clause"),
    ]:
        cosine, found, _ = known.scan(text)
        assert found == name and cosine > 0.85
    words = "Anyone may share\nthese zebra notes\nforever"
    own = licenses.Templates({"Own": ("Anyone may share these zebra notes forever",)})
    assert own.scan(f"other words first\n{words}\nand more")[:2] == (pytest.approx(1.0), "Own")
    assert known.scan("plain words\nover two lines") == (0.0, None, False)


@pytest.mark.parametrize(("text", "name"), [
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 3", "LGPL-3.0-only"), ("GNU Affero General Public License version 3", "AGPL-3.0-only"), ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-2.0-only"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"), ("Licensed under CC BY 3.0", None), ("Licensed under the Apache License, Version 1.1", None), ("Apache License, Version 1.1", None),
    *((t, n) for n, texts in licenses.TEMPLATES.items() for t in texts),
])
def test_near_relatives_are_told_apart(text, name):
    assert licenses.Templates().scan(text)[1] == name


def test_licenses_at_any_length():
    known = licenses.Templates()
    for pads in (0, 20, 100, 3000):
        assert known.scan("Released under the MIT License. " + "pad " * pads)[:2] == (pytest.approx(1.0), "MIT")
        assert known.scan("pad " * pads + "\n\n# Licensed under the Apache License,\n# Version 2.0\n")[1] == "Apache-2.0"
    whole = licenses.TEXTS["BSD-2-Clause"][0]
    words = whole.split()
    wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert known.scan("int main;\n\n" + wrapped + "\n\n" + "code " * 500)[1] == "BSD-2-Clause"


def test_license_cosines():
    """The best part's cosine against dense vectors over all words."""
    import math
    from collections import Counter

    known, bags = licenses.Templates(), [Counter(licenses._WORD.findall(t.lower())) for texts in licenses.TEMPLATES.values() for t in texts]
    df = Counter(w for b in bags for w in b)
    vector = lambda bag: {w: n * ((math.log((1 + len(bags)) / (1 + df[w])) + 1) if w in df else math.log(1 + len(bags)) + 1) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for text in ("released under this mit license by us", "licensed under the apache license version 2.0 of old"):
        words = licenses._WORD.findall(text)
        v = vector(Counter(words))
        best = max(sum(v.get(w, 0) * x for w, x in vector(b).items()) / norm(v) / norm(vector(b)) for b, m in zip(bags, known.marks, strict=True) if m == licenses.marks_of(words))
        assert known.match(words)[0] == pytest.approx(best)


def test_license_ties_and_repeats(spark):
    rows = [("/a/LICENSE", "Released under the MIT License"), ("/a/COPYING", "Licensed under CC BY 4.0"), ("/a/b.txt", "x"), ("/a/b.txt", "x"), ("/c/LICENSE", "Released under the MIT License"), ("/c/LICENSE", "Released under the MIT License"), ("/c/d", "long " * 30_000)]
    out = [(r.path, r.license, r.inherited_from) for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert sorted(out, key=str) == sorted([("/a/LICENSE", "MIT", None), ("/a/COPYING", "CC-BY-4.0", None), ("/a/b.txt", "CC-BY-4.0", "/a/"), ("/a/b.txt", "CC-BY-4.0", "/a/"), ("/c/LICENSE", "MIT", None), ("/c/LICENSE", "MIT", None), ("/c/d", "MIT", "/c/")], key=str)


GNU = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; {}version 2 of the License{}\n\nThis program is distributed in the hope that it will be useful."


@pytest.mark.parametrize(("text", "want"), [
    (GNU.format("either ", ", or\n(at your option) any later version."), "GPL-2.0-or-later"), (GNU.format("", "."), "GPL-2.0-only"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\nx = 1\n", "MIT OR Apache-2.0"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "MIT AND BSD-3-Clause"), ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: MIT OR Nobody-7", None),
])
def test_later_versions_and_expressions(text, want):
    found = licenses.Templates().scan(text)
    assert found[1] == want, found


def test_templates_of_everyday_words():
    own = licenses.Templates({"OWN": ("You may use this software for any purpose",), "MIT": licenses.TEMPLATES["MIT"]})
    assert own.scan("Hello.\nYou may use this software for any purpose.\nBye.")[:2] == (1.0, "OWN")
