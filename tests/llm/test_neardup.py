"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trailweave.llm import neardup


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, bits):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if (int(keys[i]) ^ int(keys[j])).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def near_keys(rng, n, spread):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(spread):
            k = base
            for _ in range(rng.randrange(6)):
                k ^= 1 << rng.randrange(64)
            out.append(k)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("text", ["", None, "Ab", "a B", "One two THREE", "ÄÖ ä x\ty", "w " * 500, " ".join(map(str, range(70_000)))])
def test_fingerprint(text):
    assert neardup.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_every_link(seed):
    keys = near_keys(random.Random(seed), 60, 6)
    a, b = neardup.trie_forest(keys, 3, 0)
    assert len(a) < len(keys) and all((int(keys[i]) ^ int(keys[j])).bit_count() <= 3 for i, j in zip(a, b, strict=True))
    least = list(range(len(keys)))
    for _ in keys:
        for i, j in zip(a, b, strict=True):
            least[i] = least[j] = min(least[i], least[j])
    assert least == slow_components(keys, 3)


@pytest.mark.parametrize("seed", range(2))
def test_components_over_blocks(spark, seed):
    keys = near_keys(random.Random(seed), 80, 5)
    rows = [(i, int(k)) for i, k in enumerate(keys.view(np.int64))] + [(1000 + i, int(k)) for i, k in enumerate(keys.view(np.int64)[:20])]
    prints = spark.createDataFrame(rows, "doc_id long, fp long").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(prints).collect()}
    roots = slow_components(keys, 3)
    least = {}
    for i, root in enumerate(roots):
        least.setdefault(root, i)
    assert len(got) == len(rows)
    assert all(got[i] == least[roots[i]] for i in range(len(keys))) and all(got[1000 + i] == least[roots[i]] for i in range(20))


def test_cases(spark):
    rows = [(3, "", "x"), (2, None, "x"), (None, "alone without id", "x"), (None, "alone without id", "x"), (7, "same text", "x"), (7, "same text", "x"), (6, "SAME text", "x"), (None, "same text", "x"), (9, "ß " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = neardup.near_duplicates(neardup.fingerprints(docs)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == sorted([("3", "2"), ("2", "2"), ("None", "None"), ("None", "None"), ("7", "6"), ("7", "6"), ("6", "6"), ("None", "6"), ("9", "9")])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "6", "9", "None"]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, groups = [], []
    for g in range(60):
        text = [word() for _ in range(rng.randrange(80, 500))]
        rows.append((10 * g, " ".join(text)))
        for c in range(1, rng.randrange(1, 6)):
            other = list(text)
            for _ in range(max(1, len(text) // 80)):
                other[rng.randrange(len(other))] = word()
            rows.append((10 * g + c, " ".join(other)))
        groups.append(10 * g)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = sum(1 for i in shingles if i % 10 and len(shingles[i] & shingles[i - i % 10]) >= 0.8 * len(shingles[i] | shingles[i - i % 10]))
    assert kept >= set(groups) and near > 60
    assert len(kept) - len(groups) <= sum(1 for i in shingles if i % 10) - near + 0.03 * near


def wide_prints(spark, rows):
    return spark.createDataFrame([(i, [int(w) for w in np.array(r, np.uint64).view(np.int64)]) for i, r in enumerate(rows)], "fp long, wide array<long>").repartition(3)


def flipped(rng, words, bits):
    words = list(words)
    for at in bits:
        words[at // 64] ^= 1 << at % 64
    return words


def differ(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))


def test_a_chance_candidate_does_not_hide_a_link(spark):
    rng = random.Random(7)
    one = [rng.getrandbits(64) for _ in range(16)]
    one[8] |= 0b111 << 61
    # the same first key, every other key three bits or more apart
    two = flipped(rng, one, [32 * key + at for key in range(1, 32) for at in rng.sample(range(29), 4)])
    # first among the rows of that key, near both there and nowhere else
    chance = [one[0] & 0xFFFFFFFF | rng.getrandbits(32) << 32, *(rng.getrandbits(64) for _ in range(7)), one[8] & ~(0b111 << 61), *(rng.getrandbits(64) for _ in range(7))]
    assert differ(one, two) <= neardup.WIDE_BUDGET < min(differ(one, chance), differ(two, chance))
    links = neardup.wide_links(wide_prints(spark, [one, two, chance])).collect()
    assert {(r.a, r.b) for r in links} == {(0, 1)}


def test_wide_links_connect_all_true_candidates(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(3):
        base = [rng.getrandbits(64) for _ in range(16)]
        rows += [flipped(rng, base, rng.sample(range(1024), rng.randrange(80, 130))) for _ in range(60)]
    halves = [[w >> s & 0xFFFFFFFF for w in r for s in (0, 32)] for r in rows]
    got = list(range(len(rows)))
    links = [(r.a, r.b) for r in neardup.wide_links(wide_prints(spark, rows)).collect()]
    for _ in rows:
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    true = 0
    for i in range(len(rows)):
        for j in range(i):
            checks = [t for t in range(32) if (halves[i][t] ^ halves[j][t]).bit_count() <= 2 and differ([rows[i][(t // 2 + 8) % 16]], [rows[j][(t // 2 + 8) % 16]]) <= 20]
            if checks and differ(rows[i], rows[j]) <= neardup.WIDE_BUDGET:
                true += 1
                assert got[i] == got[j]
    assert true > 50 and all(differ(rows[a], rows[b]) <= neardup.WIDE_BUDGET for a, b in links)


@pytest.mark.parametrize("words", [(8, 40), (40, 300)])
def test_nothing_goes_below_the_similarity_and_little_stays_above(spark, words):
    rng = random.Random(words[0])
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(150):
        text = [word() for _ in range(rng.randrange(*words))]
        texts.append(text)
        for _ in range(rng.randrange(4)):
            other = list(text)
            # from far above the similarity to far below it
            for _ in range(rng.randrange(1, max(2, len(text) // 12))):
                at = rng.choice([rng.randrange(len(other)), len(other) - 1])
                other[at : at + 1] = rng.choice([[word()], [], [other[at], word()]])
            texts.append(other)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    least = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    want = set(least)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    gone = len(texts) - len(want)
    assert gone > 30 and want <= kept
    assert len(kept - want) <= 0.05 * gone


def test_links_are_confirmed_at_the_similarity_itself(spark):
    sets = spark.createDataFrame([(1, list(range(9))), (2, [*range(8), 20]), (3, list(range(7))), (4, []), (5, [])], "fp long, shingles array<long>")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (4, 5)], "a long, b long")
    # 8 of 10; 7 of 9; 7 of 9; none of 9; two texts without words
    assert {(r.a, r.b) for r in neardup.similar_links(links, sets).collect()} == {(1, 2), (4, 5)}
