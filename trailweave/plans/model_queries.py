"""Registered queries of models' explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.models import forest, shap
from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.plans.proxies import FLOWS, TX, flows, transactions
from trailweave.plans.queries import SHAPES
from trailweave.session import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SHAPE_NAMES = ["n_in", "n_out", "in_sats", "out_sats", "most_equal"]
#: Trees over shapes of transactions, a parameter of the query: (feature, cut, share that goes left, left, right) or a leaf's path length.
TREES = [
    ("n_out", 2.5, 0.61, ("in_sats", 3e6, 0.43, 5.31, ("n_out", 1.5, 0.37, 7.11, 8.93)), ("out_sats", 9.5e6, 0.29, ("n_in", 0.5, 0.53, 3.07, 6.41), 4.27)),
    ("in_sats", 6.1e6, 0.71, ("n_in", 1.5, 0.59, ("in_sats", 1.2e6, 0.31, 6.73, 9.17), 8.05), ("n_in", 3.5, 0.83, ("n_out", 3.5, 0.67, 5.93, 7.57), 2.39)),
    ("out_sats", 1.4e7, 0.47, ("out_sats", 4.3e6, 0.23, ("n_in", 0.5, 0.41, 4.61, 7.79), ("most_equal", 1.5, 0.97, 8.37, 3.11)), ("n_in", 2.5, 0.89, ("in_sats", 2.7e6, 0.19, 5.03, ("n_out", 4.5, 0.79, 6.89, 3.83)), 4.49)),
]


def grown(spec: tuple, names: list[str], sample: int = 1 << 20) -> forest.Tree:
    """A tree as arrays from its nested form; shares become sizes of a sample."""
    nodes: list[list] = []

    def add(part, size: float) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, size, part])
        if isinstance(part, tuple):
            f, cut, share, left, right = part
            kids = add(left, size * share), add(right, size * (1 - share))
            nodes[at] = [names.index(f), cut, *kids, size, share * nodes[kids[0]][5] + (1 - share) * nodes[kids[1]][5]]
        return at

    add(spec, sample)
    return forest.Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def _exported(trees: list[tuple]) -> str:
    """Splits on the ways to all leaves as SQL rows: tree, leaf, value, f, low, high, share of the sample that stays."""
    rows, leaf = [], 0

    def walk(tree: int, part, way: list[tuple]) -> None:
        nonlocal leaf
        if isinstance(part, tuple):
            f, cut, share, left, right = part
            walk(tree, left, [*way, (f, "-inf", cut, share)])
            walk(tree, right, [*way, (f, cut, "inf", 1 - share)])
            return
        leaf += 1
        rows.extend(f"({tree}, {leaf}, {part}::DOUBLE, '{f}', '{low}'::DOUBLE, '{high}'::DOUBLE, {share!r}::DOUBLE)" for f, low, high, share in way)

    for i, t in enumerate(trees):
        walk(i, t, [])
    return ", ".join(rows)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {FLOWS}, {TX}, {SHAPES}, splits(tree, leaf, value, f, low, high, share) AS (VALUES {_exported(TREES)}),
x AS (UNPIVOT (SELECT h.txid, n_in::DOUBLE AS n_in, n_out::DOUBLE AS n_out, in_sats::DOUBLE AS in_sats, out_sats::DOUBLE AS out_sats, coalesce(e.most_equal, 0)::DOUBLE AS most_equal FROM shapes h LEFT JOIN equal_outs e USING (txid)) ON n_in, n_out, in_sats, out_sats, most_equal INTO NAME f VALUE v),
bits(f, b) AS (VALUES ('n_in', 1), ('n_out', 2), ('in_sats', 4), ('out_sats', 8), ('most_equal', 16)), sets AS (SELECT unnest(range(32)) AS s),
terms AS (SELECT txid, leaf, value, b, bool_and(v > low AND v <= high)::INTEGER::DOUBLE AS stays, product(share) AS share FROM splits JOIN x USING (f) JOIN bits USING (f) GROUP BY ALL),
means AS (SELECT txid, s, sum(part) AS mean FROM (SELECT txid, s, leaf, any_value(value) * product(CASE WHEN s & b > 0 THEN stays ELSE share END) AS part FROM terms, sets GROUP BY txid, s, leaf) GROUP BY txid, s)
SELECT o.txid, f AS feature, round(sum(factorial(bit_count(o.s)::INTEGER)::DOUBLE * factorial(4 - bit_count(o.s)::INTEGER)::DOUBLE / 120.0 * (w.mean - o.mean)) / {len(TREES)}, 6) AS shapley
FROM means o JOIN bits ON o.s & b = 0 JOIN means w ON w.txid = o.txid AND w.s = o.s | b GROUP BY o.txid, f""")
def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of given trees for every transaction; the SQL goes through all sets of features."""
    rows = cx.transaction_shapes(flows(spark, sf_dir)).select("txid", *SHAPE_NAMES)
    out = shap.explained(rows, [grown(t, SHAPE_NAMES) for t in TREES], SHAPE_NAMES)
    return out.select("txid", F.posexplode("shapley").alias("_i", "v")).select("txid", F.array(*[F.lit(n) for n in SHAPE_NAMES])[F.col("_i")].alias("feature"), F.round("v", 6).alias("shapley"))


@query()
def forest_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chain feature adds to an address's mean path in a forest fitted on all addresses."""
    names = list(ft.CHAIN)
    rows = written(ft.chain_features(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir))).select("address", *names), "to_explain")
    fitted = forest.fit(rows, names, trees=60)
    out = shap.explained(forest.score(rows, fitted, "score"), fitted.trees, names)
    return out.select("address", F.col("score"), F.lit(fitted.base()).alias("base_path_length"), *[F.col("shapley")[i].alias(n) for i, n in enumerate(names)])
