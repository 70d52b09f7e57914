"""Language identification by interpolated Kneser-Ney models over character trigrams.

A model for each language is fitted on about ``sample`` labelled documents of it (a documented bound; they are drawn
by a hash of doc_id and text, with a rate that follows from the language's count), counted on the executors. Letters
are lower-cased and stand for themselves, whatever their script; all other characters are one separator. N-grams of
code points are hashed (by a bijection, so none share a hash) into one sorted array for each order, with a column of
probabilities for each language; whole texts of every document are scored against all. What remains is spread evenly
over all letters of Unicode, so a letter that no language has costs the same in each.

The language of the lowest length-normalised cross-entropy is chosen. When a text is rejected is calibrated on a
quarter of the drawn documents, which the models are not fitted on: its entropy may exceed the language's mean by
``errors`` standard errors for its length, plus the slack that all but ``miss`` of these documents need, plus
``margin`` nats.

The languages are a setting of a corpus: their models must stay below ``most_bytes``, which is checked before they are
broadcast.

Defined cases: a null text and one without a letter are ``und`` with score 0 and rejected; a null doc_id is never
held out (its hash counts as that of an empty text); repeated rows are scored alike and drawn once; a language whose
drawn documents have no letter is not learnt; with no language to learn from all is ``und``; long texts are read in
chunks that carry two letters over the seam, so they score as if read at once; an empty table gives an empty result; a
column of the input that is named like a new one gives way to it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import extended

DISCOUNT = 0.75
#: Bits of a code point, and code points read at once.
_BITS, _CHUNK = np.uint64(21), 1 << 18
_POINT, _PAIR = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, itself where it is a letter, else 0."""
    return np.fromiter((c if category(chr(c))[0] == "L" else 0 for c in range(0x110000)), np.uint32, 0x110000)


@lru_cache(1)
def alphabet() -> int:
    """Number of signs: all letters of Unicode and the separator."""
    return int((_letters() != 0).sum()) + 1


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of the trigrams of a text, some at a time; separators don't repeat, and one stands at both ends."""
    before, text = np.zeros(2, np.uint64), text.lower()
    for lo in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[lo : lo + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = _letters()[points].astype(np.uint64)
        if lo + _CHUNK >= len(text):
            signs = np.append(signs, np.uint64(0))
        signs = signs[(signs != 0) | (np.concatenate([before[-1:], signs[:-1]]) != 0)]
        line = np.concatenate([before, signs])
        before = line[-2:]
        if len(signs):
            yield (line[:-2] << (_BITS + _BITS)) | (line[1:-1] << _BITS) | line[2:]


def mixed(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of one order (a bijective mix of 64 bits, so no two n-grams share one)."""
    h = codes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class HashArray:
    """Sorted hashes of n-grams, and for each a row of values by language."""

    def __init__(self, rows: dict[int, np.ndarray], languages: int, missing: float):
        codes = np.fromiter(rows, np.uint64, len(rows))
        keys = mixed(codes)
        at = np.argsort(keys)
        values = np.array(list(rows.values()), np.float64).reshape(len(rows), languages)
        self.keys, self.missing = keys[at], missing
        self.values = np.where(values[at] == 0, missing, values[at])

    def get(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full((len(codes), self.values.shape[1]), self.missing)
        want = mixed(codes)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        out = self.values[at]
        out[self.keys[at] != want] = self.missing
        return out


class Models:
    """Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, languages: list[str], counts: list[dict[int, int]]):
        n, signs = len(languages), alphabet()
        self.languages, self.limits, self.base = languages, np.zeros((n, 3)), np.full(n, 1 / signs)
        rows: list[dict[int, np.ndarray]] = [{} for _ in range(5)]

        def put(part: int, code: int, language: int, value: float) -> None:
            rows[part].setdefault(code, np.zeros(n))[language] = value

        for i, c3 in enumerate(counts):
            c2, c1, follow2, kinds2, follow3, kinds3 = (defaultdict(int) for _ in range(6))
            for code, k in c3.items():
                follow3[code >> 21] += k
                kinds3[code >> 21] += 1
                c2[code & int(_PAIR)] += 1  # continuations
            for code, k in c2.items():
                follow2[code >> 21] += k
                kinds2[code >> 21] += 1
                c1[code & int(_POINT)] += 1
            total = sum(c1.values())
            if total:
                self.base[i] = DISCOUNT * len(c1) / total / signs
            for code, k in c1.items():
                put(0, code, i, (k - DISCOUNT) / total)
            for code, k in c2.items():
                put(1, code, i, (k - DISCOUNT) / follow2[code >> 21])
            for code, k in follow2.items():
                put(2, code, i, DISCOUNT * kinds2[code] / k)
            for code, k in c3.items():
                put(3, code, i, (k - DISCOUNT) / follow3[code >> 21])
            for code, k in follow3.items():
                put(4, code, i, DISCOUNT * kinds3[code] / k)
        self.one, self.two, self.back_one, self.three, self.back_two = (HashArray(r, n, missing) for r, missing in zip(rows, (0.0, 0.0, 1.0, 0.0, 1.0), strict=True))
        self.held = None

    def bytes(self) -> int:
        return sum(a.keys.nbytes + a.values.nbytes for a in (self.one, self.two, self.back_one, self.three, self.back_two))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last sign of each trigram after the first two, in each language."""
        two = codes & _PAIR
        p = self.one.get(codes & _POINT) + self.base
        p = self.two.get(two) + self.back_one.get(two >> _BITS) * p
        return self.three.get(codes) + self.back_two.get(codes >> _BITS) * p

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        """Negative log probabilities; those of trigrams met lately come from a table with a place for each hash."""
        if self.held is None:
            places = 1 << max(10, 20 - len(self.languages).bit_length())
            self.held = np.full(places, ~np.uint64(0)), np.zeros((places, len(self.languages)), np.float32)
        keys, costs = self.held
        at = (mixed(codes) >> np.uint64(32)).astype(np.int64) & (len(keys) - 1)
        missed = keys[at] != codes
        if not missed.any():
            return costs[at]
        new, back = np.unique(codes[missed], return_inverse=True)
        fresh = -np.log(self.probability(new)).astype(np.float32)
        out = costs[at]
        out[missed] = fresh[back]
        place = (mixed(new) >> np.uint64(32)).astype(np.int64) & (len(keys) - 1)
        keys[place] = new  # of several the last stays, in both tables
        winner = keys[place] == new
        costs[place[winner]] = fresh[winner]
        return out

    def surprise(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Mean negative log probability and mean square in each language, and the number of trigrams."""
        total, square, n = np.zeros(len(self.languages)), np.zeros(len(self.languages)), 0
        for codes in trigrams(text):
            s = self._costs(codes)
            total, square, n = total + s.sum(0, dtype=np.float64), square + np.einsum("ij,ij->j", s, s, dtype=np.float64), n + len(codes)
        return total / max(n, 1), square / max(n, 1), n

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        if not text or not self.languages:
            return "und", 0.0, True
        mean, _, n = self.surprise(text)
        if n < 2:  # no letter
            return "und", 0.0, True
        best = int(mean.argmin())
        score = 1 / np.exp(-np.minimum((mean - mean[best]) * min(n, 200), 700)).sum()
        level, spread, slack = self.limits[best]
        rejected = bool(mean[best] > level + spread / math.sqrt(n) + slack)
        return self.languages[best], float(score) * (0.5 if rejected else 1.0), rejected

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}


def fit(docs: DataFrame, sample: int = 800, miss: float = 0.001, errors: float = 4.0, margin: float = 0.05, most_bytes: int = 256 << 20) -> Models:
    """Models from rows of ``docs`` with a language that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return Models([], [])
    rate = F.create_map(*[F.lit(x) for v in sizes for x in (v, min(1.0, sample / sizes[v]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 20))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < rate[F.col("lang")] * float(1 << 20)).dropDuplicates(["lang", "doc_id", "draw"])
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id", "draw"), F.lit(4)) == 0
    fitted, calibrating = drawn.filter(~aside).select("lang", "text"), drawn.filter(aside).select("lang", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in trigrams(text.as_py()):
                    code, n = np.unique(part, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for lang, code, n in fitted.mapInArrow(grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n")).collect():
        counts[lang][code] = n
    languages = sorted(counts)
    models = Models(languages, [counts[v] for v in languages])
    if models.bytes() > most_bytes:
        raise ValueError(f"models of {len(languages)} languages take {models.bytes()} bytes, more than may be broadcast")
    shared = spark.sparkContext.broadcast(models)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        number = {v: i for i, v in enumerate(models.languages)}
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mean, square, n = models.surprise(text.as_py())
                if lang in number and n > 1:
                    out.append((number[lang], float(mean[number[lang]]), float(square[number[lang]]), n))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["language", "mean", "square", "n"])

    # where a language has no document aside, those of the fit stand in
    own: dict[int, list] = defaultdict(list)
    for part in (calibrating, fitted):
        missing = [v for i, v in enumerate(languages) if i not in own]
        if missing:
            for i, mean, square, n in part.filter(F.col("lang").isin(missing)).mapInArrow(entropies, "language long, mean double, square double, n long").collect():
                own[i].append((mean, square, n))
    for i, seen in own.items():
        mean, square, n = np.array(sorted(seen)).T
        level = np.average(mean, weights=n)
        spread = errors * math.sqrt(max(0.0, np.average(square, weights=n) - level**2))
        models.limits[i] = level, spread, max(0.0, float(np.quantile(mean - level - spread / np.sqrt(n), 1 - miss))) + margin
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with lang_pred, score and lang_rejected."""
    new = {"lang_pred": "string", "score": "double", "lang_rejected": "boolean"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    at = [c.lower() for c in docs.columns].index("text")
    schema = extended(docs, new)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            rows = [models.judge(t.as_py()) for t in batch.column(at)]
            columns = zip(*rows, strict=True) if rows else ((),) * 3
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)
