"""Exact order statistics of groups of any size.

Values are counted in logarithmic buckets first, which combines before the
shuffle; only the buckets that hold a wanted rank are looked into. A bucket with
more distinct values than one task should sort is cut into equal ranges, again
and again, so neither a hot group nor a hot bucket is held by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.functions.buckets import Buckets
from urbanloom.plans.tables import written

ALPHA = 0.002
#: Distinct values of a slot that one task sorts, and the ranges that a larger slot is cut into.
SORT_ROWS, RANGES = 1_000_000, 65_536


def same(left: list[str], right: list[str]) -> list[Column]:
    """Equality of two lists of keys, in which NULL equals NULL."""
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]


def bucket_ranks(counts: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, n (rows of the group), and per name p: p_low and p_high, the two order statistics of linear
    interpolation, each a struct of bucket, place (how many rows of the bucket come before it) and rows (of the bucket), and p_part.

    `counts` has keys, bucket and n."""
    own = Window.partitionBy(*keys)
    held = counts.withColumns({"_upto": F.sum("n").over(own.orderBy("bucket")), "_all": F.sum("n").over(own)})  # a group has as many rows as buckets
    out, before = [F.first("_all").alias("n")], F.col("_upto") - F.col("n")
    for name, share in at.items():
        rank = F.lit(float(share)) * (F.col("_all") - 1)
        for side, r in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            hit = (before <= r) & (r < F.col("_upto"))
            out.append(F.max(F.when(hit, F.struct("bucket", (r - before).alias("place"), F.col("n").alias("rows")))).alias(f"{name}_{side}"))
        out.append(F.first(rank - F.floor(rank)).alias(f"{name}_part"))
    return held.groupBy(*keys).agg(*out)


def values_at(slots: DataFrame, asked: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """slot, place, value: of every asked place of a slot the value that so many of its rows come before.

    `slots` has slot (string), value (double) and n (rows of that value; one row a
    value); `asked` has slot and place. Slots of more than `sort_rows` values are
    cut into ranges first.
    """
    done, asked = None, asked.select("slot", "place", F.col("slot").alias("_slot"), F.col("place").alias("_place")).distinct()
    while True:
        size = slots.groupBy("slot").agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
        large = size.where((F.col("_n") > sort_rows) & (F.col("_low") < F.col("_high")))
        if done is None and large.limit(1).count() == 0:
            break
        large = written(large, "large-slots")
        small = slots.join(large.select("slot"), "slot", "left_anti")
        found = _sorted(small, asked)
        done = written(found if done is None else done.unionByName(found), "found")
        if large.limit(1).count() == 0:
            return done
        # halves first, so that the difference of two huge values can't overflow
        share = (F.col("value") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        cut = slots.join(large, "slot").withColumn("_range", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int"))
        counts = cut.groupBy("slot", "_range").agg(F.sum("n").alias("_rows"))
        upto = F.sum("_rows").over(Window.partitionBy("slot").orderBy("_range"))  # RANGES rows at most
        placed = asked.join(counts.withColumn("_upto", upto), "slot").where("_upto > place AND _upto - _rows <= place")
        inner = F.concat_ws("/", "slot", "_range")
        asked = written(placed.select(inner.alias("_next"), "slot", "_range", (F.col("place") - F.col("_upto") + F.col("_rows")).alias("place"), "_slot", "_place"), "asked")
        kept = cut.join(asked.select("slot", "_range", "_next").distinct(), ["slot", "_range"])
        slots = written(kept.select(F.col("_next").alias("slot"), "value", "n"), "slots")
        asked = asked.select(F.col("_next").alias("slot"), "place", "_slot", "_place")
    return _sorted(slots, asked)


def _sorted(slots: DataFrame, asked: DataFrame) -> DataFrame:
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value"))
    held = slots.withColumn("_upto", upto).join(asked, "slot").where("_upto > place AND _upto - n <= place")
    return held.select(F.col("_slot").alias("slot"), F.col("_place").alias("place"), "value")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], sort_rows: int = SORT_ROWS) -> DataFrame:
    """keys and one column per name in `at`: the percentile by linear interpolation, exactly.

    NULL and NaN values are left out; NULL keys are a group; infinite values
    count; a group without values has no row; an empty table gives none.
    """
    held = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn("bucket", Buckets(ALPHA).of(F.col("_v")))
    counts = held.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    slot = lambda bucket: F.concat_ws("|", F.to_json(F.struct(*keys)), bucket.cast("string"))
    ranked = written(bucket_ranks(counts, keys, at), "ranks")
    wanted = ranked.select(*keys, *(f"{n}_part" for n in at), F.inline(F.array(*(F.struct(F.lit(f"{n}_{x}").alias("what"), F.col(f"{n}_{x}.bucket").alias("bucket"), F.col(f"{n}_{x}.place").alias("place"), F.col(f"{n}_{x}.rows").alias("_rows")) for n in at for x in ("low", "high")))))
    wanted = wanted.withColumn("slot", slot(F.col("bucket")))
    chosen = wanted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("bucket").alias("_b"), "slot").distinct()
    theirs = [*keys, "bucket"]
    inside = held.join(chosen, same(theirs, [*(f"_k{i}" for i in range(len(keys))), "_b"])).groupBy("slot", F.col("_v").alias("value")).agg(F.count("*").alias("n"))
    # no bucket has more values than rows, and those are counted already
    asked = wanted.select("slot", "place")
    small = (ranked.agg(*(F.max(f"{n}_{x}.rows") for n in at for x in ("low", "high"))).first() if at else ()) or ()
    if all(r is None or r <= sort_rows for r in small):
        found = _sorted(inside, asked.select("slot", "place", F.col("slot").alias("_slot"), F.col("place").alias("_place")).distinct())
    else:
        found = values_at(written(inside, "slots"), asked, sort_rows)
    ends = wanted.join(found, ["slot", "place"]).groupBy(*keys).agg(*(F.max(F.when(F.col("what") == f"{n}_{x}", F.col("value"))).alias(f"_{n}_{x}") for n in at for x in ("low", "high")), *(F.first(f"{n}_part").alias(f"{n}_part") for n in at))
    return ends.select(*keys, *(between(F.col(f"_{n}_low"), F.col(f"_{n}_high"), F.col(f"{n}_part")).alias(n) for n in at))


def between(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation; equal ends (infinite ones too) give their value."""
    return F.when(low == high, low).otherwise(low + (high - low) * part)
