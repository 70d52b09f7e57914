"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first four, five and six letters, hashed into ``TERMS`` columns; a
term is there or it isn't. The machine's logit is a bias, a weight for each term, and for each pair of terms the inner
product of their factors, so that two words may say more together than both do alone (or less). Pairs are never listed:
over all terms they are half of (sum of factors)^2 minus the sum of squares.

Long texts don't drown in pairs: terms are kept only if they tell something about the label by themselves (in ``LEAST``
drawn texts at least, with shares among the classes ``CLEAR`` standard errors apart), so clean words add nothing,
however many they are. What kept terms mean together is left to their factors.

The fit takes about ``sample`` labelled documents that aren't held out (a documented bound; half of them toxic where
there are as many, drawn by a hash of doc_id at a rate that follows from each class's count), sends their hashed terms
to the driver, and runs on it by adaptive steps over shuffled batches from a seeded start. The bias is corrected for the
share of each class that was drawn. A quarter of the drawn rows isn't fitted on: it sets the scale of the logits.

Defined cases: a text without a word (null or empty) gets the share of label 1; with no labels, or one class alone, all
get that class's share (0 with no labels); labels other than 0 and 1 are not learnt from; a null doc_id has no label; a
doc_id with several labels or texts counts with each; repeated rows are scored alike; a long text is read whole; an
empty table gives an empty result; a column of the input that is named like a new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import extended

TERMS, FACTORS, ACCEPT = 1 << 18, 8, 0.7
#: In how many drawn texts a term must be, and how many standard errors its shares must be apart.
LEAST, CLEAR = 4, 3.5
_WORD_BYTES, _ROWS = 64, 256
#: ASCII letters and what lies beyond ASCII make up words; capitals of ASCII are lowered, all else parts words.
_PARTS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _hashed(word: bytes) -> tuple[int, ...]:
    letters = word.decode("utf-8", "replace")
    starts = {letters[:n] for n in (4, 5, 6) if len(letters) >= n}
    return (crc32(word) % TERMS, *(crc32(b"^" + s.encode("utf-8", "replace")) % TERMS for s in sorted(starts)))


_short = lru_cache(1 << 16)(_hashed)


def terms(text: str | None) -> np.ndarray:
    """The sorted columns of a text's terms."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split())
    found = {c for w in words for c in (_short(w) if len(w) <= _WORD_BYTES else _hashed(w))}
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Machine:
    bias: float
    share: float
    columns: np.ndarray  # those of terms that tell something, sorted
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, bags: list[np.ndarray]) -> np.ndarray:
        """Of each bag; sums run in the order of columns, so a text's logit doesn't depend on the rows beside it."""
        out = np.full(len(bags), self.bias)
        for i, bag in enumerate(bags):
            at = np.searchsorted(self.columns, bag)
            at = at[np.append(self.columns, -1)[at] == bag]
            if len(at):
                v = self.factors[at]
                total = v.sum(0)
                out[i] += self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum())
        return out

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.logits(bags), -40, 40)))
        return np.where([len(b) > 0 for b in bags], p, self.share)


def telling(bags: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Columns of the terms whose shares among the classes differ clearly, sorted."""
    of = np.repeat(label, [len(b) for b in bags])
    columns = np.concatenate(bags) if bags else np.zeros(0, np.int32)
    seen, toxic = np.bincount(columns, minlength=TERMS), np.bincount(columns, of, TERMS)
    n1 = label.sum()
    n0 = len(label) - n1
    share = seen / len(label)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((seen >= LEAST) & (np.abs(toxic / n1 - (seen - toxic) / n0) > CLEAR * error)).astype(np.int32)


def _passes(bags: list[np.ndarray], label: np.ndarray, width: int, rng: np.random.Generator, passes: int, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of ``width`` columns by adaptive gradient steps with decay."""
    bias, weights, factors = 0.0, np.zeros(width), rng.normal(0, 0.05, (width, FACTORS))
    g_bias, g_weights, g_factors = 1e-8, np.full(width, 1e-8), np.full((width, FACTORS), 1e-8)
    for _ in range(passes):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            columns = np.concatenate([bags[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            sums = np.zeros((len(some), FACTORS))
            np.add.at(sums, of, factors[columns])
            squares = np.bincount(of, (factors**2).sum(1)[columns], len(some))
            logit = bias + np.bincount(of, weights[columns], len(some)) + 0.5 * ((sums * sums).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label[some]) / len(some)
            grad = np.bincount(columns, error[of], width)
            used = np.unique(columns)
            grad_v = np.stack([np.bincount(columns, error[of] * sums[of, f], width) for f in range(FACTORS)], 1)[used] - factors[used] * grad[used, None] + decay * factors[used]
            grad_w = grad[used] + decay * weights[used]
            g_bias += error.sum() ** 2
            bias -= rate * error.sum() / g_bias**0.5
            g_weights[used] += grad_w**2
            weights[used] -= rate * grad_w / np.sqrt(g_weights[used])
            g_factors[used] += grad_v**2
            factors[used] -= 0.5 * rate * grad_v / np.sqrt(g_factors[used])
    return bias, weights, factors


def train(bags: list[np.ndarray], label: np.ndarray, odds: float = 0.0, seed: int = 13, passes: int = 12) -> Machine:
    """A machine from bags of terms; ``odds`` is added to the bias for classes that were drawn at other rates."""
    rng, share = np.random.default_rng(seed), float(label.mean()) if len(label) else 0.0
    if len(np.unique(label)) < 2:
        return Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), share, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    aside = rng.permutation(len(bags)) % 4 == 0
    own = [b for b, a in zip(bags, aside, strict=True) if not a]
    columns = telling(own, label[~aside]) if len(np.unique(label[~aside])) == 2 else np.zeros(0, np.int32)
    told = [np.searchsorted(columns, b[np.isin(b, columns, assume_unique=True)]) for b in own]
    bias, weights, factors = _passes(told, label[~aside], len(columns), rng, passes)
    machine = Machine(bias, share, columns, weights, factors)
    held, y = machine.logits([b for b, a in zip(bags, aside, strict=True) if a]), label[aside]
    scale, shift = _scaled(held, y) if len(np.unique(y)) == 2 else (1.0, 0.0)
    return Machine(bias * scale + shift + odds, share, columns, weights * scale, factors * scale**0.5)


def _scaled(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (0.5 to 4) and shift of logits with the least loss on rows set aside, by a search that narrows."""
    best, span = (1.0, 0.0), (2.0, 3.0)
    loss = lambda s, b: float(np.logaddexp(0, -(2 * y - 1) * (s * logits + b)).mean()) + 1e-3 * (s - 1) ** 2 + 1e-3 * b * b
    for _ in range(6):
        around = [(best[0] * span[0] ** i, best[1] + span[1] * j) for i in (-1, -0.5, 0, 0.5, 1) for j in (-1, -0.5, 0, 0.5, 1)]
        best, span = min(((min(max(s, 0.5), 4.0), b) for s, b in around), key=lambda p: loss(*p)), (span[0] ** 0.5, span[1] / 2)
    return best


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Machine:
    """A machine from labelled rows of ``docs`` that aren't held out."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(counts.get(1, 0), sample // 2)
    rates = {1: toxic / max(counts.get(1, 0), 1), 0: min(1.0, (sample - toxic) / max(counts.get(0, 0), 1))}
    rate = F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    drawn = spark.createDataFrame(drawn.collect(), drawn.schema) if counts else drawn.limit(0)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                yield pa.record_batch([part.column(0).cast(pa.int32()), pa.array([terms(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], names=["label", "terms"])

    got = [b for b in rows.mapInArrow(bags, "label int, terms array<int>").toArrow().to_batches() if b.num_rows]
    found = {(label, own.values.to_numpy().tobytes()) for b in got for label, own in zip(b.column(0).to_pylist(), b.column(1), strict=True)}
    found = sorted(found)  # equal texts count once, in an order that doesn't depend on tasks
    odds = float(np.log(rates[0] / rates[1])) if counts.get(0) and counts.get(1) else 0.0
    machine = train([np.frombuffer(t, np.int32) for _, t in found], np.array([y for y, _ in found], np.float64), odds)
    machine.share = counts.get(1, 0) / max(1, sum(counts.values()))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with score and predicted."""
    new = {"score": "double", "predicted": "integer"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    at = [c.lower() for c in docs.columns].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                scores = shared.value.scores([terms(t.as_py()) for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, extended(docs, new))
