"""URL filters: pattern rules behind an index of their rarest literal tokens.

Tokens are runs of a-z and 0-9 of the lower-cased url. A rule's literal tokens are those that it holds between two
delimiters, so that any url it fits has them too; how often each occurs is counted over all urls, and the rule is
filed under the rarest. A url's tokens fetch its candidate rules, and only these run their regular expressions
(rules without such a token are always candidates). Of the rules that fit, the longest wins, then the first named;
where no host rule fits, the verdict is that of the method's own patterns, else ``allow``.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no host rule; an empty table
gives an empty result; repeated rows are judged
alike; urls of any length are read whole; rules of equal length go by their order; a column of the input that is named like a new one gives way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import extended

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    """A regular expression for host + path, and literals (delimited in every text that it fits)."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    own: bool = False

    @classmethod
    def host(cls, verdict: str, name: str) -> Rule:
        """``host/path``: the host and its subdomains, paths that start so."""
        host, slash, path = name.partition("/")
        delimited = f"{host}/{path.rpartition('/')[0]}/"
        return cls(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(_TOKEN.findall(delimited.translate(_LOWER))))


HOST_RULES = (Rule.host("allow", "org/"), Rule.host("block", "example.org/es/"), Rule.host("block", "example.org/en/1"), Rule.host("allow", "com/fr/"), Rule.host("block", "com/de/"))
#: Parts of host names by what they stand for.
KINDS = {
    "advertising": ("ad", "ads", "adserver", "adservice", "banner", "banners", "doubleclick", "popunder"), "tracking": ("analytics", "beacon", "clicktrack", "pixel", "tracker", "tracking"),
    "gambling": ("bet", "betting", "bingo", "casino", "jackpot", "poker", "slots"), "adult": ("adult", "escort", "porn", "sex", "xxx"), "piracy": ("torrent", "warez"), "malware": ("malware", "phishing"),
}
#: The method's own patterns, for urls that no host rule fits: hosts with such a part.
OWN_RULES = tuple(Rule(f"own:{t}", "block", rf"(?:[^/]*[.-])?{t}(?:[.-][^/]*)?(?:/.*)?\Z", (t,), True) for kind in KINDS.values() for t in kind)


def rules_of(table: DataFrame, most: int = 1_000_000) -> tuple[Rule, ...]:
    """Host rules of a table (verdict, host, path), such as a published list of many thousands.

    A list is a setting, held by every task: more than ``most`` rows are an error.
    """
    rows = table.select("verdict", "host", F.coalesce("path", F.lit("/")).alias("path")).filter("host IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(sorted((Rule.host(r.verdict, f"{r.host}{r.path}") for r in rows), key=lambda r: (r.name, r.verdict)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def token_counts(pages: DataFrame, wanted: frozenset[str]) -> dict[str, int]:
    """In how many rows of ``pages`` each wanted token occurs; no more rows than tokens come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in wanted.intersection(_TOKEN.findall((url or "").translate(_LOWER))):
                    counts[t] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return dict(pages.select("url").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n")).collect())


class Index:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for rank, rule in enumerate(rules):
            entry = (-len(rule.name) if not rule.own else 1, rank, rule, re.compile(rule.pattern, re.S))
            (self.by_token[min(rule.literals, key=lambda t: (counts.get(t, 0), -len(t), t))] if rule.literals else self.always).append(entry)

    def judge(self, url: str | None, host: str, path: str) -> tuple[str | None, str]:
        candidates = list(self.always)
        for t in set(_TOKEN.findall((url or "").translate(_LOWER))) & self.by_token.keys():
            candidates += self.by_token[t]
        fitting = min((e for e in candidates if e[3].match(host + path)), default=None, key=lambda e: e[:2])
        return (None if fitting is None or fitting[2].own else fitting[2].name), (fitting[2].verdict if fitting else "allow")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + OWN_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    new = ("host", "path", "rule", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in new])
    index_counts = token_counts(pages, frozenset(t for r in rules for t in r.literals))
    at = [c.lower() for c in pages.columns].index("url")
    schema = extended(pages, dict.fromkeys(new, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, index_counts)
        for batch in batches:
            rows = []
            for url in batch.column(at).to_pylist():
                host, path = split_url(url)
                rows.append((host, path, *index.judge(url, host, path)))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), pa.string()) for c in columns)], names=[*batch.schema.names, *new])

    return pages.mapInArrow(run, schema)
