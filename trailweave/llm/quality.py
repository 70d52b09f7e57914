"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is two hashed bags: of its words, lower-cased, and of their shapes (runs of lower-case letters, of capitals and
of digits are one sign each, all other signs stand for themselves), so that both what is said and how it is written
count; ``SHARES`` says how much, and a third part holds the share of words that repeat an earlier one. Bags are
weighted by TF-IDF. Of about ``sample`` labelled documents (a documented bound; drawn by a hash of doc_id) the driver
takes the leading latent directions; their labelled vectors, of a size fixed by the bound, are broadcast. Every
document's exact cosine with every labelled vector is computed block by block, and its nearest ``neighbours`` vote with
weights that grow with similarity.

Weights, directions and vectors are rounded to whole numbers below 2^20, so that all sums are exact in doubles and a
text's score doesn't depend on the rows beside it.

Defined cases: a text without words (null or empty) gets the share of label 1; with no labels all get 0.5; labels
other than 0 and 1 are not learnt from; a doc_id with several labels counts with each, and one with several rows with
each different text; a null doc_id has no label; repeated rows are scored alike; which of equally
similar labelled texts vote is settled by the drawn texts alone; a long text is read whole; an empty table gives an empty result; a column of the input
that is named like a new one gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.langid import held_out
from trailweave.llm.shared import extended

SHAPES, WORDS, LATENT, NEIGHBOURS, POWER = 1024, 2048, 48, 16, 8
DIMENSIONS = SHAPES + WORDS + 1
#: How much the shapes, the words and the repeats weigh in a vector's square.
SHARES = (0.8, 0.15, 0.05)
ACCEPT = 0.7
_SIGNS = bytes((ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b) for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_EDGES = re.compile(rb"^[^a-z\x80-\xff]+|[^a-z\x80-\xff]+$")
_ROWS, _FINE, _UNIT = 128, 1 << 12, 1 << 20


def _shape(shape: bytes) -> int:
    return crc32(_RUNS.sub(rb"\1", shape)) % SHAPES


def _word(word: bytes) -> int:
    return SHAPES + crc32(_EDGES.sub(b"", word)) % WORDS


#: Columns of words up to _SHORT bytes are remembered; longer ones would fill a worker's memory.
_SHORT = 48
_short_shape, _short_word = lru_cache(1 << 15)(_shape), lru_cache(1 << 15)(_word)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the words of a text, of their shapes, and of repeats (the last column, per mille)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found: Counter = Counter()
    for shape, n in Counter(data.translate(_SIGNS).split()).items():
        found[(_short_shape if len(shape) <= _SHORT else _shape)(shape)] += n
    words = Counter(data.lower().split())
    for word, n in words.items():
        found[(_short_word if len(word) <= _SHORT else _word)(word)] += n
    if words:
        found[DIMENSIONS - 1] = 1000 - 1000 * len(words) // words.total()
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


def _weighed(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """A row for each bag: its parts as unit vectors by TF-IDF, in their shares, as whole numbers up to ``_FINE``."""
    dense = np.zeros((len(bags), DIMENSIONS), np.float32)
    for row, (columns, counts) in zip(dense, bags, strict=True):
        row[columns] = np.log1p(counts)
    dense *= idf
    out = np.empty(dense.shape, np.float32)
    for lo, hi, share in zip((0, SHAPES, DIMENSIONS - 1), (SHAPES, DIMENSIONS - 1, DIMENSIONS), SHARES, strict=True):
        part = dense[:, lo:hi].astype(np.float64)
        # np.sqrt and division are exact in each element; the sums of squares are of floats cut to 12 bits
        norm = np.sqrt((np.rint(part * 64) ** 2).sum(1, keepdims=True)) / 64
        out[:, lo:hi] = np.rint(part / (np.maximum(norm, 1e-12) if lo < DIMENSIONS - 1 else 7.0) * (_FINE * share**0.5))
    return out


@dataclass
class Voters:
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def latent(self, weighed: np.ndarray) -> np.ndarray:
        """Latent vectors of length ``_UNIT`` in whole numbers (zero for an empty bag)."""
        rows = weighed.astype(np.float64) @ self.directions
        return np.rint(rows / np.maximum(np.sqrt((np.rint(rows / _FINE) ** 2).sum(1, keepdims=True)) * _FINE, 1e-12) * _UNIT)

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(bags), self.share)
        own = self.latent(_weighed(bags, self.idf))
        cosine = own @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1) / _UNIT**2, 0, 1) ** POWER
        total = weight.sum(1)
        voted = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where((total > 1e-9) & (own != 0).any(1), np.clip(voted, 0, 1), self.share)


def _directions(rows: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, times ``_FINE`` in whole numbers, by subspace iteration from a seeded start."""
    some = np.random.default_rng(3).normal(size=(rows.shape[1], min(LATENT + 16, rows.shape[0]))).astype(np.float32)
    for _ in range(rounds):
        some, _ = np.linalg.qr(rows.T @ (rows @ some))
    _, _, turned = np.linalg.svd(rows @ some, full_matrices=False)
    return np.rint(some @ turned.T[:, :LATENT] * _FINE)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Voters:
    """Voters from labelled rows of ``docs`` that aren't held out."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20))
    drawn = spark.createDataFrame(drawn.collect(), drawn.schema) if n else drawn
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "quality", "text"]).select("quality", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["label", "columns", "counts"])

    got = [b for b in rows.mapInArrow(bags, "label int, columns array<int>, counts array<float>").toArrow().to_batches() if b.num_rows]
    found = [(label, columns.values.to_numpy(), counts.values.to_numpy()) for b in got for label, columns, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True)]
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    label = np.array([r[0] for r in found], np.float64)
    share = float(label.mean()) if len(label) else 0.5
    got_bags = [r[1:] for r in found]
    seen = np.zeros(DIMENSIONS)
    for columns, _ in got_bags:
        seen[columns] += 1
    idf = np.log((1 + len(found)) / (1 + seen)).astype(np.float32) + 1
    if not seen.any():
        return Voters(idf, np.zeros((DIMENSIONS, 1)), np.zeros((0, 1)), label, share)
    weighed = np.concatenate([_weighed(got_bags[lo : lo + _ROWS], idf) for lo in range(0, len(got_bags), _ROWS)])
    filled = np.flatnonzero(weighed.any(1))
    voters = Voters(idf, _directions(weighed), np.zeros((0, 1)), label[filled], share)
    voters.vectors = np.concatenate([voters.latent(weighed[filled[lo : lo + _ROWS]]) for lo in range(0, len(filled), _ROWS)])
    return voters


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """``docs`` with score and predicted."""
    new = {"score": "double", "predicted": "integer"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    at = [c.lower() for c in docs.columns].index("text")
    schema = extended(docs, new)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                scores = voters.scores([features(t.as_py()) for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, schema)
