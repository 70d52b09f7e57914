"""The pipeline, stage by stage, against plain versions of each stage on the smallest test tables."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="needs the test tables")


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def test_stages(spark):
    import corpus_pipeline
    from trailweave.llm import langid, mixing, quality
    from trailweave.llm.queries import tokenizer_path
    from trailweave.llm.shared import written
    from trailweave.llm.tokens import encoder

    start = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "mixing", "packing"]
    rows = {"start": start.collect()}
    docs, before = start, {"start": start}
    for name in list(stages)[:-1]:
        before[name] = docs
        docs = written(stages[name](spark, docs, DIR), name)
        assert docs.columns == start.columns
        rows[name] = docs.collect()
    texts = {r.doc_id: r.text for r in rows["start"]}
    assert all(r.text == texts[r.doc_id] for part in rows.values() for r in part)

    voters = quality.fit(start, labels)
    good = voters.scores([quality.features(r.text) for r in rows["start"]]) >= 0.7
    assert {r.doc_id for r in rows["quality"]} == {r.doc_id for r, g in zip(rows["start"], good, strict=True) if g}

    models = langid.fit(before["language"])
    assert {r.doc_id for r in rows["language"]} == {r.doc_id for r in rows["quality"] if not models.judge(r.text)[2]}

    kept, sets = {r.doc_id for r in rows["near_duplicates"]}, {r.doc_id: shingles(r.text) for r in rows["language"]}
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    near = defaultdict(dict)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders[g]).items():
            if j != i:
                near[i][j] = both / len(s | sets[j])
    assert not [(i, j) for i in kept for j, v in near[i].items() if j in kept and v >= 0.85]
    assert all(max(near[i].values(), default=0) >= 0.65 for i in sets if i not in kept)

    plan = {r.doc_id: (r["size"], r.target, r.taken, r.copies) for r in mixing.mix(before["mixing"]).collect()}
    assert Counter(r.doc_id for r in rows["mixing"]) == Counter({i: c for i, (_, _, _, c) in plan.items() if c})
    assert all(abs(taken - c * size) <= size / 2 for size, _, taken, c in plan.values())

    encode, pieces = encoder(tokenizer_path()), stages["packing"](spark, docs, DIR)
    out = pieces.collect()
    wanted = Counter()
    for r in rows["mixing"]:
        wanted[r.doc_id] += len(encode(r.text or "")) // 4 + 1
    got, full = Counter(), Counter()
    for r in out:
        got[r.doc_id] += r.length
        full[r.sequence_id] += r.length
    assert got == wanted and max(full.values()) <= 1024


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    """Each stage keeps columns that are named like an operator's own, and takes nulls, repeats and long texts."""
    import corpus_pipeline

    start = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    long = spark.createDataFrame([(900_001, "Und das ist der lange Text. " * 20_000, "de", "s"), (900_002, None, None, None), (900_003, "", "en", "s"), (None, "Lo que no tiene nombre es lo que somos.", "es", None), (900_004, "twice the same words of the other", "en", "s"), (900_004, "twice the same words of the other", "en", "s")], start.schema)
    own = {"score": "'s' || doc_id", "predicted": "'p'", "LANG_pred": "'l'", "lang_rejected": "'r'", "size": "-7", "source_size": "'x'", "target": "'t' || doc_id", "taken": "false", "copies": "99", "fp": "'f'", "room": "'m'", "wide": "'w'"}
    docs = start.unionByName(long).selectExpr("*", *[f"{v} AS {k}" for k, v in own.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert out.filter("size = -7 AND copies = 99 AND NOT taken AND predicted = 'p' AND LANG_pred = 'l' AND fp = 'f' AND room = 'm' AND (doc_id IS NULL OR (target = 't' || doc_id AND score = 's' || doc_id))").count() == out.count() > 0
        assert stage(spark, docs.limit(0), DIR).count() == 0, name
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DIR).groupBy("doc_id").count().filter("count > 1")
    assert kept.count() == 0
    pack = dict(corpus_pipeline.STAGES)["packing"]
    assert pack(spark, docs.limit(0), DIR).count() == 0 and pack(spark, docs.filter("doc_id > 900000 OR doc_id IS NULL"), DIR).filter("doc_id = 900002").first().length == 1
