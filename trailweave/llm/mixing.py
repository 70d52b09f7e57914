"""Mixing sources to target weights, by DataFrame functions alone.

Targets come from capped water-filling: each source's share of the whole is clamped at ``max_epochs`` times its
size, and the excess is dealt out again by weight among the others until none is above. A source's documents then
all take their whole repetitions; a seeded order of them decides which take one more, up to the very word: the
boundary document takes a fractional repetition. The boundary key of every source is found by rounds of exact
histograms: a round counts the words below each of 256 candidate keys inside the source's open interval and opens the
candidate's cell that holds the boundary. Sources, sums and open intervals are tables throughout, so there may be any
number of sources, and no source is ever sorted or held in one task; to the driver come four numbers a round.

Defined cases: a null text has size 0 and takes nothing; a null source is one source, the last; rows that share a
doc_id (all null ones do) share a place in the order, and on the boundary take an equal fraction each, rounded down
(so up to a word a row is left over); an empty table gives an empty result; a text of any length counts
whole; a column of the input that is named like a new one gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.shared import replace_columns, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of an order key, and of the digit that a round of histograms takes.
KEY_BITS, DIGIT = 60, 8


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sized: DataFrame) -> DataFrame:
    """source, size (sum) and place from 0, by code point, null last: ranges of sources, and counts of the ranges before."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"))
    ordered = written(sums.orderBy(F.col("source").asc_nulls_last()).withColumns({"at": F.monotonically_increasing_id()}), "sources")
    part = F.shiftrightunsigned("at", 33)
    ranges = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    return ordered.withColumn("part", part).join(before, "part").select("source", "size", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("place"))


def water_fill(sums: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``sums`` (source, size, place) with target: shares of the whole by weight, none above ``max_epochs`` times its size.

    A round clamps all sources above their cap at the level of the round before; the rest of the words and of the
    weights, two numbers, set the next level.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(sums.withColumns({"weight": weight, "cap": F.col("size") * max_epochs}), "weighed")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    whole, all_weights = table.agg(F.sum(wide("size")), F.sum(wide("weight"))).first()
    left, open_weights, clamped = int(whole or 0), int(all_weights or 0), -1
    while open_weights:
        # left * weight / open_weights > cap, in whole numbers
        above = F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(5,0)") > F.col("cap").cast("decimal(20,0)") * F.lit(open_weights).cast("decimal(18,0)")
        n, caps, gone = table.filter(above).agg(F.count(F.lit(1)), F.sum(wide("cap")), F.sum(wide("weight"))).first()
        if n == clamped:
            break
        clamped, left, open_weights = n, int(whole) - int(caps or 0), int(all_weights) - int(gone or 0)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(max(1, open_weights)))
    return table.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(share, F.lit(0.0))) if open_weights else F.col("cap").cast("double")).drop("weight", "cap")


def order_key(doc_id: Column, seed: int) -> Column:
    """60 seeded bits of a doc_id, which any SQL engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def boundaries(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, low, rest, cell: keys below ``low`` hold all but ``rest`` of the words wanted, the key itself ``cell``.

    ``keyed`` has place, key and weight, ``wanted`` place and more (above 0, below the place's weight).
    """
    opened = written(wanted.select("place", F.lit(0).cast("long").alias("prefix"), F.col("more").alias("rest")), "open_0")
    for turn in range(1, -(-KEY_BITS // DIGIT) + 1):
        left = max(0, KEY_BITS - turn * DIGIT)
        digits = KEY_BITS - (turn - 1) * DIGIT - left
        rows = keyed.select("place", F.shiftright("key", left).alias("cell_of"), "weight").withColumn("prefix", F.shiftright("cell_of", digits))
        cells = rows.join(opened, ["place", "prefix"]).groupBy("place", "rest", "cell_of").agg(F.sum("weight").alias("cell"))
        upto = F.sum("cell").over(Window.partitionBy("place").orderBy("cell_of"))  # 256 rows of a place at most
        below = cells.withColumn("below", upto - F.col("cell")).filter((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("cell") > F.col("rest")))
        opened = written(below.select("place", F.col("cell_of").alias("prefix"), (F.col("rest") - F.col("below")).alias("rest"), "cell"), f"open_{turn}")
    return opened.select("place", F.col("prefix").alias("low"), "rest", "cell")


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``sized`` (doc_id, source, size and others) with source_size, target, taken and copies (taken, in whole documents)."""
    narrow = written(sized.select("source", order_key(F.col("doc_id"), seed).alias("key"), "size"), "sizes")
    plan = water_fill(numbered_sources(narrow), weights, max_epochs)
    goal = F.least(F.floor(F.col("target") + 0.5), F.col("size") * max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(goal / F.col("size"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("whole", whole).withColumn("more", (goal - F.col("whole") * F.col("size")).cast("long")), "plan")
    own = plan.select(F.col("source").alias("_tw_source"), F.col("place").alias("_tw_place"), F.col("size").alias("_tw_size"), F.col("target").alias("_tw_target"), F.col("whole").alias("_tw_whole"), "more")
    same = F.col("source").eqNullSafe(F.col("_tw_source"))
    keyed = written(narrow.join(own.filter("more > 0"), same).select(F.col("_tw_place").alias("place"), "key", F.col("size").alias("weight")), "mix_keys")
    found = boundaries(keyed, own.filter("more > 0").select(F.col("_tw_place").alias("place"), "more"))
    steps = written(own.join(found.select(F.col("place").alias("_tw_place"), F.col("low").alias("_tw_low"), F.col("rest").alias("_tw_rest"), F.col("cell").alias("_tw_cell")), "_tw_place", "left").drop("more"), "steps")
    joined = sized.withColumn("_tw_key", order_key(F.col("doc_id"), seed)).join(steps, same)
    extra = F.when(F.col("_tw_key") < F.col("_tw_low"), F.col("size")).when(F.col("_tw_key") == F.col("_tw_low"), F.expr("CAST(size AS DECIMAL(19,0)) * CAST(_tw_rest AS DECIMAL(18,0)) div nullif(_tw_cell, 0)")).otherwise(F.lit(0))
    joined = joined.withColumn("_tw_extra", F.coalesce(extra, F.lit(0)).cast("long"))
    taken = F.col("_tw_whole") * F.col("size") + F.col("_tw_extra")
    copies = F.col("_tw_whole") + F.when((F.col("_tw_extra") * 2 > F.col("size")), 1).otherwise(0)
    out = replace_columns(joined, source_size=F.col("_tw_size"), target=F.col("_tw_target"), taken=taken.cast("long"), copies=copies.cast("long"))
    return out.drop("_tw_key", "_tw_extra", *steps.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, taken and copies."""
    return mix_sized(replace_columns(docs, size=word_count(F.col("text"))), weights, max_epochs, seed)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says (the boundary document by the nearer whole number)."""
    return mixed.withColumn("_tw_n", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) END"))).drop("_tw_n")
