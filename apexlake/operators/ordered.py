"""Running sums, ranks and nearest rows over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Names = Sequence[str]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without the setting, only a session on one machine may have its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return top.rstrip("/")


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: made once, with a size that joins can go by, and there if executors are lost."""
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, keys: Names, how: str = "left") -> DataFrame:
    """The rows with the table's other columns, joined on keys where nulls are equal; without keys the table is one row."""
    take = [c for c in table.columns if c not in keys]
    a, b = rows.alias("_left"), table.alias("_right")
    on = [F.col(f"_left.`{k}`").eqNullSafe(F.col(f"_right.`{k}`")) for k in keys]
    both = a.join(b, on, how) if on else a.crossJoin(F.broadcast(b))
    return both.select(*(F.col(f"_left.`{c}`") for c in rows.columns if c not in take), *(F.col(f"_right.`{c}`") for c in take))


def running_total(rows: DataFrame, group: Names, order: Names, weight: Column | int, out: str) -> DataFrame:
    """+ out: sum of the weight over the group's rows up to this one, in order; nulls come first.

    Rows are dealt out by ranges of (group, order), so a group lies in as many parts as it has rows for; the sums of
    parts, one row for each group and part, are added up and joined back. Rows equal in group and order lie
    in one part: aggregate them first where there may be many. Their own order is undefined.
    """
    columns = rows.columns
    dealt = rows.withColumn("_weight", weight if isinstance(weight, Column) else F.lit(weight)).repartitionByRange(*group, *order)
    dealt = kept(dealt.withColumn("_part", F.spark_partition_id()))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*group, "_part")]
    sums = dealt.groupBy(*group, "_part").agg(F.sum("_weight").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy(*group).orderBy("_part")) - F.col("_sum")).drop("_sum")
    within = F.sum("_weight").over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    numbered = dealt.withColumn("_within", within).alias("r").join(before.alias("b"), same("r", "b"))
    return numbered.select(*(F.col(f"r.{c}") for c in columns), (F.col("_before") + F.col("_within")).alias(out))


def quantiles(values: DataFrame, group: Names, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, count, {name: quantile}): exact quantiles by linear interpolation; null values don't count.

    Equal values of a group are one row with their number, which is added up from the smallest value on;
    the two values about a quantile's place are those whose running number first reaches it. No
    buffer of a group's values anywhere. NaN counts as larger than any number. Groups without values have no row.
    """
    rows = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_total(rows, group, ["_v"], F.col("_k"), "_upto")
    total = rows.groupBy(*group).agg(F.sum("_k").alias("_n"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]
    met = ranked.alias("r").join(total.alias("t"), same)
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    reaches = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    ends = {f"{n}{e}": reaches(place) for n, q in shares.items() for e, place in (("_low", F.floor(at(q))), ("_high", F.ceil(at(q))))}
    found = met.groupBy(*(F.col(f"r.{c}").alias(c) for c in group)).agg(F.max("_n").alias("_n"), *(c.alias(n) for n, c in ends.items()))
    between = lambda n, q: F.col(f"{n}_low") + (at(q) - F.floor(at(q))) * (F.col(f"{n}_high") - F.col(f"{n}_low"))
    exact = lambda n, q: F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(between(n, q))
    return found.select(*group, F.col("_n").alias("count"), *(exact(n, q).alias(n) for n, q in shares.items()))


def nearest(targets: DataFrame, target: str, points: DataFrame, place: str, order: str, carry: Names, keys: Names = (), parts: int | None = None) -> DataFrame:
    """targets + carry: columns of the point whose place is nearest to the target, at any distance; ties by order.

    An as-of join from both sides. Points and targets are cut into equal stretches of each group's range; within a stretch
    a window knows the last point before and the first behind each target. Past the stretch's ends they
    are the last and first of the nearest stretch that has points, of which there are ``parts`` a group at
    most (default: as many as shuffle partitions). Points at one place are one row, the first in order. Targets
    without points, or null, get nulls; repeated targets stay. Points without place are left out.
    """
    parts = parts or int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = targets.columns
    point = F.struct(F.col(place).cast("double").alias("at"), F.col(order).alias("o"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    group = [f"_g{i}" for i in range(len(keys))]
    own = [F.col(k).alias(g) for k, g in zip(keys, group)]
    points = points.where(F.col(place).isNotNull() & ~F.isnan(F.col(place).cast("double"))).select(*own, F.col(place).cast("double").alias("_at"), point.alias("_p"))
    points = points.groupBy(*group, "_at").agg(F.min_by("_p", "_p.o").alias("_p"))
    span = points.groupBy(*group).agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    asked = targets.select(*own, F.nullif(F.col(target).cast("double"), F.lit(float("nan"))).alias("_at"), F.struct(*(F.col(c).alias(f"t{i}") for i, c in enumerate(names))).alias("_t"))
    both = points.withColumn("_t", F.lit(None).cast(asked.schema["_t"].dataType)).unionByName(asked.withColumn("_p", F.lit(None).cast(points.schema["_p"].dataType)))
    both = both.alias("x").join(span.alias("s"), [F.col(f"x.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group], "left") if group else both.alias("x").crossJoin(F.broadcast(span))  # one row
    stretch = F.when(F.col("_b") > F.col("_a"), F.least(F.greatest(F.floor((F.col("_at") - F.col("_a")) / (F.col("_b") - F.col("_a")) * parts), F.lit(0)), F.lit(parts - 1))).otherwise(0)
    g = [F.col(f"x.{c}").alias(c) for c in group]
    both = both.select(*g, "_at", "_p", "_t", stretch.alias("_s"))
    ends = both.where("_p is not null").groupBy(*group, "_s").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    every = both.select(*group, "_s").distinct()
    near = [*group, "_s"]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in near]
    up, down = W.partitionBy(*group).orderBy("_s"), W.partitionBy(*group).orderBy(F.desc("_s"))
    ends = every.alias("e").join(ends.alias("f"), same("e", "f"), "left").select(*(F.col(f"e.{c}") for c in near), "_first", "_last")
    ends = ends.select(
        *near, F.last("_last", ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, -1)).alias("_later"),
    )
    ahead, back = (W.partitionBy(*near).orderBy(by, F.col("_t").isNotNull()).rowsBetween(W.unboundedPreceding, 0) for by in (F.asc("_at"), F.desc("_at")))
    found = both.select(
        *near, "_at", "_t", F.last("_p", ignorenulls=True).over(ahead).alias("_before"), F.last("_p", ignorenulls=True).over(back).alias("_behind"),
    ).where("_t is not null")
    found = found.alias("x").join(ends.alias("e"), same("x", "e"))
    low, high = F.coalesce("_before", "_earlier"), F.coalesce("_behind", "_later")
    gap = lambda p: F.struct(F.abs(p["at"] - F.col("_at")).alias("d"), p["o"].alias("o"))
    best = F.when(F.col("_at").isNull(), None).when(low.isNull(), high).when(high.isNull(), low).when(gap(low) <= gap(high), low).otherwise(high)
    return found.select("_t", best.alias("_p")).select(*(F.col(f"_t.t{i}").alias(c) for i, c in enumerate(names)), *(F.col(f"_p.c{i}").alias(c) for i, c in enumerate(carry)))
