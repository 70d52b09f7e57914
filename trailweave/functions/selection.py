"""Exact medians of many columns and keys, with bounded memory for keys of any size.

A group of up to ``most`` values is a plain aggregate. The others are selected by histogram rounds on the bits of their
values: doubles as whole numbers of the same order, 13 bits a round from the top. A round counts, for each group, how
many of the values that share the bits found so far have each next digit, and the digit in which the wanted rank lies is
the next one found. So no task holds a group's values: rounds move counts, at most 2^13 for each group and task, and
after five rounds all bits are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from trailweave.session import written

#: Widths of the digits, from the top: 64 bits.
DIGITS = (13, 13, 13, 13, 12)
_TOP = -(1 << 63)


@F.pandas_udf(LongType())
def _ordered(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Doubles as whole numbers whose unsigned order is theirs."""
    for v in values:
        bits = v.to_numpy(np.float64).view(np.int64)
        yield pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(_TOP)))


@F.pandas_udf(DoubleType())
def _value(ordered: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for o in ordered:
        bits = o.to_numpy(np.int64)
        yield pd.Series(np.where(bits < 0, bits ^ np.int64(_TOP), ~bits).view(np.float64))


def medians(rows: DataFrame, names: list[str], key: str | None = None, most: int = 1 << 16) -> DataFrame:
    """``key`` (where one is given) and the exact median of each of ``names``: of an even number the mean of the two in the middle.

    Nulls don't count; a group of nulls alone has a null. NaN is larger than all other values.
    """
    at = F.col(key) if key else F.lit(0)
    # read for sizes, for small groups and for large ones, however costly the rows are to make
    rows = written(rows.select(*([key] if key else []), *names), "median_rows")
    long = rows.select(at.alias("g"), F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])))
    sizes = long.groupBy("g", "c").agg(F.count("v").alias("n"))
    big = written(sizes.filter(F.col("n") > most), "big_groups")
    if big.isEmpty():  # the usual case: one aggregate
        out = rows.groupBy(at.alias("g")).agg(*[F.median(F.col(n).cast("double")).alias(n) for n in names])
    else:
        small = long.join(big, ["g", "c"], "left_anti").groupBy("g", "c").agg(F.median("v").alias("m"))
        both = small.unionByName(_selected(long.filter("v IS NOT NULL").join(big, ["g", "c"], "left_semi"), big))
        out = both.groupBy("g").agg(*[F.max(F.when(F.col("c") == i, F.col("m"))).alias(n) for i, n in enumerate(names)])
    return out.withColumnRenamed("g", key) if key else out.drop("g")


def _selected(long: DataFrame, groups: DataFrame) -> DataFrame:
    """g, c, m: medians of groups (g, c, n) by rounds."""
    values = written(long.select("g", "c", _ordered("v").alias("u")), "ordered_bits")
    ranks = F.array(F.struct(F.lit(0).alias("s"), F.floor((F.col("n") + 1) / 2).alias("rank")), F.struct(F.lit(1).alias("s"), (F.floor(F.col("n") / 2) + 1).alias("rank")))
    state, left = groups.select("g", "c", F.inline(ranks), F.lit(0).cast("long").alias("found")), 64
    for turn, width in enumerate(DIGITS):
        left -= width
        digit = F.shiftrightunsigned("u", left).bitwiseAND(F.lit((1 << width) - 1))
        if turn:  # what shares no bits found is left behind, so the later rounds read little; before the first all do
            known = values.withColumn("found", F.shiftrightunsigned("u", left + width))
            values = written(known.join(state.select("g", "c", "found").distinct(), ["g", "c", "found"], "left_semi").select("g", "c", "u"), f"shared_{turn}")
        found = F.shiftrightunsigned("u", left + width) if turn else F.lit(0).cast("long")
        hits = values.select("g", "c", found.alias("found"), digit.alias("digit"))
        counts = state.join(hits.groupBy("g", "c", "found", "digit").agg(F.count(F.lit(1)).alias("k")), ["g", "c", "found"])
        line = Window.partitionBy("g", "c", "s").orderBy("digit")  # at most 2^width digits
        upto = counts.withColumn("upto", F.sum("k").over(line)).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("k") < F.col("rank")))
        state = written(upto.select("g", "c", "s", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), F.shiftleft("found", width).bitwiseOR(F.col("digit")).alias("found")), f"digits_{turn}")
    return state.select("g", "c", _value("found").alias("v")).groupBy("g", "c").agg(F.avg("v").alias("m"))
