"""Packing: an exact round trip of every id, little padding, bounded windows."""

from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from trailweave.llm import packing, tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "one", "Two  spaces\n\nand lines\t.", "naïve café, l'été!", "<|endoftext|> inside", "日本語 text", "word " * 3000, "a-b_c 12.5% it's we'll", "tail  ", "\x1c odd\u0085 space"]


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), tokens.encoder(PATH)
    for text in filter(None, TEXTS):
        assert np.frombuffer(own(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[(i, t) for i, t in enumerate(TEXTS * 30)], [], [(None, "x")], [(3, "same text here")] * 200])
def test_round_trip(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(docs, PATH, room=64, windows=4).collect()
    own, sequences = tokens.encoder(PATH), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append(r)
    full = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        full += at
    wanted = [(i, own(t or "") + b"\0\0\0\0") for i, t in rows]
    assert full == sum(len(w) for _, w in wanted) // 4
    if len({i for i, _ in rows}) == len(rows):
        by_doc = defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
        for i, ids in wanted:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == ids
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:n]) for n in range(len(pieces))]
            assert all(r.doc_tokens == len(ids) // 4 for r in pieces)
    if len(rows) > 100:
        assert 1 - full / 64 / len(sequences) < 0.1


def test_other_columns_are_not_read(spark):
    rows = [(i, f"word {i} " * 9) for i in range(20)]
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    clashing = plain.selectExpr("doc_id", "text", "'x' AS start", "1 AS sequence_id", "array(1) AS ids", "'y' AS TEXT_", "doc_id AS offset")
    pieces = lambda df: sorted((r.doc_id, r.start, bytes(r.ids), r.sequence_id, r.offset) for r in packing.pack(df, PATH, room=64).collect())
    assert pieces(clashing) == pieces(plain)
