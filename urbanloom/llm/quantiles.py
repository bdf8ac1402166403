"""Percentiles of very large columns with bounded relative error, from mergeable sketches.

A sketch is a table: group keys, bucket, count. Buckets are logarithmic with a
fixed relative width and a sign, so their order is the order of values, and the
sketch of a union is the sum of the counts of equal buckets. A percentile's
bucket bounds it to a relative error of `alpha`; the exact value, where it is
wanted, is found inside that one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.buckets import Buckets
from urbanloom.operators.ranked import SORT_ROWS, between, bucket_ranks, values_at
from urbanloom.plans.tables import pinned, written

#: Relative error of the sketches behind p1: at most 0.2 %.
ALPHA = 0.002


def sketch(rows: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """keys, bucket, n, alpha: the sketch of `value` per group. Counts are combined before the shuffle.

    A sketch is an ordinary table: one written per day is merged with any other.

    Defined results: NULL and NaN values are left out; NULL keys are a group;
    infinite values have buckets of their own; an empty table gives an empty
    sketch; columns other than keys and value are left out.
    """
    held = rows.select(*keys, Buckets(alpha).of(F.col(value).cast("double")).alias("bucket")).where("bucket IS NOT NULL")
    return held.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.lit(float(alpha)).alias("alpha"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches combined to coarser or equal groups: counts of equal buckets add up. Those of another alpha stay apart, so ranks refuses the mixture."""
    return sketches.groupBy(*keys, "bucket", "alpha").agg(F.sum("n").alias("n")).select(*keys, "bucket", "n", "alpha")


def ranks(sketches: DataFrame, keys: list[str], at: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """operators.ranked.bucket_ranks of sketches; the job fails if one was made with another alpha."""
    of_scheme = F.when(F.col("alpha") == float(alpha), F.col("bucket")).otherwise(F.raise_error(F.lit(f"a sketch has another alpha than {alpha}")).cast("int"))
    return bucket_ranks(sketches.select(*keys, of_scheme.alias("bucket"), "n"), keys, at)


def percentiles(sketches: DataFrame, keys: list[str], at: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """keys, n, and per percentile name p: p (relative error at most alpha for values of one sign), p_min and p_max (bounds)."""
    b, held = Buckets(alpha), ranks(sketches, keys, at, alpha)
    out = [*keys, "n"]
    for name in at:
        low, high, part = F.col(f"{name}_low.bucket"), F.col(f"{name}_high.bucket"), F.col(f"{name}_part")
        mix = lambda x, y, part=part: x * (1 - part) + y * part
        out += [mix(b.estimate(low), b.estimate(high)).alias(name), mix(b.bounds(low)[0], b.bounds(high)[0]).alias(f"{name}_min"), mix(b.bounds(low)[1], b.bounds(high)[1]).alias(f"{name}_max")]
    return held.select(*out)


def wrong_statistics(rows: DataFrame, row_key: str, value: str, whole: str, part: str, classes: list[str], stats: DataFrame, stats_key: str, published: dict[str, tuple[str, float]], tolerance: float, relative: bool, alpha: float = ALPHA, sort_rows: int = SORT_ROWS) -> DataFrame:
    """The keys of published statistics that differ from the exact percentile by more than `tolerance`.

    `stats` has one row per group (whole, part, *classes); a NULL part means the
    whole, whose sketch is the sum of its parts'. `published` maps a column of
    `stats` to its share, as {"median": ("z_median", 0.5)}. The sketch decides
    every row whose bounds lie on one side of the tolerance; for the others the
    order statistics are looked up inside their buckets, exactly.

    Defined results: rows count once per row_key (repeats are identical); NULL
    and NaN values are dropped; a NULL class is a class; rows with a NULL part
    count in the whole only; a NULL published figure is no case, a NaN one is; a
    group without values has no case; clashing extra columns are left out.
    """
    b, at = Buckets(alpha), {name: share for name, (_, share) in published.items()}
    keys = [whole, part, *classes]
    held = rows.select(F.col(row_key).alias("_row"), *keys, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)")
    # the rows are read and freed of repeats once; parts and wholes both start from the written sketch
    fine = written(sketch(held.distinct(), keys, "_value", alpha), "sketch")
    coarse = merged(fine, [whole, *classes]).withColumn(part, F.lit(None).cast("string"))
    groups = ranks(fine.where(F.col(part).isNotNull()), keys, at, alpha).unionByName(ranks(coarse, keys, at, alpha))
    theirs = stats.select(F.col(stats_key).alias("_id"), *(F.col(k).alias(f"_s_{k}") for k in keys), *(F.col(c).cast("double").alias(f"_pub_{name}") for name, (c, _) in published.items()))
    same = [F.col(f"_s_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = theirs.join(groups, same)

    def differs(pub: Column, exact: Column) -> Column:
        return F.abs(pub - exact) > (F.abs(exact) * tolerance if relative else tolerance)

    # over a bucket range: surely differs if both ends do on the same side, surely doesn't if neither end does
    ends = {}
    for name in published:
        low, high, share = F.col(f"{name}_low.bucket"), F.col(f"{name}_high.bucket"), F.col(f"{name}_part")
        for side, k in (("least", 0), ("most", 1)):
            ends[f"_{name}_{side}"] = b.bounds(low)[k] * (1 - share) + b.bounds(high)[k] * share
    joined = pinned(joined, ends)
    verdicts = []
    for name in published:
        pub, least, most = F.col(f"_pub_{name}"), F.col(f"_{name}_least"), F.col(f"_{name}_most")
        outside = (pub < least) | (pub > most)
        crosses = F.lit(relative) & (least <= 0) & (most >= 0)
        verdicts.append(F.when(pub.isNull(), 0).when(F.isnan(pub), 2).when(outside & ~crosses & differs(pub, least) & differs(pub, most), 2).when(crosses | differs(pub, least) | differs(pub, most), 1).otherwise(0))
    judged = written(joined.withColumn("verdict", F.greatest(*verdicts, F.lit(0))).select("_id", "verdict", *keys, *(f"_pub_{n}" for n in published), *(f"{n}_{x}" for n in published for x in ("low", "high", "part"))), "judged")

    unsure = judged.where("verdict = 1")
    named = F.inline(F.array(*(F.struct(F.lit(f"{n}_{x}").alias("what"), F.col(f"{n}_{x}.bucket").alias("_bucket"), F.col(f"{n}_{x}.place").alias("place")) for n in published for x in ("low", "high"))))
    wanted = unsure.select("_id", *(F.col(k).alias(f"_s_{k}") for k in keys), named)
    slot = F.concat_ws("|", F.to_json(F.struct(*(f"_s_{k}" for k in keys))), F.col("_bucket").cast("string"))
    wanted = wanted.withColumn("slot", slot)
    # the rows of the asked buckets, in one pass for parts and wholes (whose part is NULL)
    chosen = wanted.select("slot", "_bucket", *(f"_s_{k}" for k in keys)).distinct()
    base = [F.col(f"_s_{k}").eqNullSafe(F.col(k)) for k in [whole, *classes]] + [F.col("_bucket") == F.col("bucket"), F.col(f"_s_{part}").isNull() | (F.col(f"_s_{part}") == F.col(part))]
    inside = held.withColumn("bucket", b.of(F.col("_value"))).join(chosen, base).select("slot", "_row", "_value").distinct()
    counted = written(inside.groupBy("slot", F.col("_value").alias("value")).agg(F.count("*").alias("n")), "slots")
    chosen = wanted.join(values_at(counted, wanted.select("slot", "place"), sort_rows), ["slot", "place"])
    exact = chosen.groupBy("_id").agg(*(F.max(F.when(F.col("what") == f"{n}_{x}", F.col("value"))).alias(f"_{n}_{x}") for n in published for x in ("low", "high")))
    checked = unsure.join(exact, "_id")
    fails = F.lit(False)
    for n in published:
        fails = fails | F.coalesce(differs(F.col(f"_pub_{n}"), between(F.col(f"_{n}_low"), F.col(f"_{n}_high"), F.col(f"{n}_part"))), F.lit(False))
    return judged.where("verdict = 2").select("_id").unionByName(checked.where(fails).select("_id"))
