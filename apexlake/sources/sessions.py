"""The store of sessions: result tables by session and date, read back over all of them, and small documents."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from apexlake.operators import ordered
from apexlake.operators.issues import METRICS

#: Tables of a session; the first is required of any session that is compared.
TABLES = ("top_issues", "events", "corner_cards", "stability_report", "apex_scan", "curvature_debug", "consistency_values", "benchmark_lap", "corner_cards_with_delta", "apex_params")
BESTS = "track string, lap int, laptime_s double, session string, date string"


class _Files:
    """Paths of whatever file system a root lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(path))) if self.exists(path) else []

    def move(self, path: str, to: str) -> None:
        """The folder to another place, instead of what lies there."""
        self.system.delete(self.path(to), True)
        self.system.mkdirs(self.path(to).getParent())
        if not self.system.rename(self.path(path), self.path(to)):
            raise OSError(f"could not move {path} to {to}")

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def _schema(spark: SparkSession, root: str, name: str) -> StructType | None:
    """All columns that any session's table has had, from the table's manifest."""
    if not _Files(spark, root).exists(f"{root}/{name}.schema"):
        return None
    return StructType.fromJson(read_document(spark, f"{root}/{name}.schema", {}))


def save(table: DataFrame, root: str, name: str, session: str, date: str | None = None) -> None:
    """save_all() of one session's table, which may have no rows; then the session is left without any."""
    save_all(table.withColumn("session", F.lit(session)), root, name, date, [session])


def save_all(table: DataFrame, root: str, name: str, date: str | None = None, named: Sequence[str] = ()) -> None:
    """Writes the tables of all sessions in it, by column session, in one job; what these held before is kept once, under ``<name>.bak``.

    A session is a partition of the table, and only partitions of these sessions, and of those named, are touched: written beside the table, then moved
    into their place. Columns new to the table go to its manifest; those it knows keep their type. The rows may
    have been read from the very partitions. Date: today if null. Rows of a null session are left out.
    """
    spark = table.sparkSession
    files, schema = _Files(spark, root), _schema(spark, root, name) or StructType()
    known = {f.name: f.dataType for f in schema}
    rows = table.where("session is not null").withColumns({"session": F.col("session").cast("string"), "date": F.lit(date) if date else F.current_date().cast("string")})
    rows = rows.select(*(F.col(f"`{c}`").cast(known.get(c, t)).alias(c) for c, t in ((f.name, f.dataType) for f in rows.schema)))
    part = F.concat(F.lit("s-"), "session")
    fresh = f"{root}/{name}.new-{uuid.uuid4().hex}"
    rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(fresh)
    added = [f for f in rows.schema if f.name not in known]
    if added:
        for f in added:
            schema = schema.add(f.name, f.dataType, True)
        save_document(spark, schema.jsonValue(), f"{root}/{name}.schema")
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    written = [n for n in files.names(fresh) if n.startswith("part=")]
    for own in sorted({*written, *(f"part={escaped(f's-{s}')}" for s in named)}):
        if files.exists(f"{root}/{name}/{own}"):
            files.move(f"{root}/{name}/{own}", f"{root}/{name}.bak/{own}")
        if own in written:
            files.move(f"{fresh}/{own}", f"{root}/{name}/{own}")
    files.delete(fresh)


def load(spark: SparkSession, root: str, name: str, sessions: Sequence[str] | None = None, backup: bool = False) -> DataFrame | None:
    """A table over all sessions, or the named ones only, with columns session and date; null if none was written.

    The schema is the manifest's, so no file is opened to find it, and named sessions are a filter on partitions.
    """
    schema = _schema(spark, root, name)
    path = f"{root}/{name}{'.bak' if backup else ''}"
    if schema is None or not _Files(spark, root).exists(path):
        return None
    rows = spark.read.schema(StructType([*schema]).add("part", "string")).parquet(path)
    return (rows if sessions is None else rows.where(F.col("part").isin([f"s-{s}" for s in sessions]))).drop("part")


def save_deltas(cards: DataFrame, with_deltas: DataFrame, root: str, session: str, date: str | None = None) -> bool:
    """Writes corner_cards_with_delta if the differences are new: if the cards lacked any. Says whether it did."""
    recomputed = not set(METRICS) <= set(cards.columns)
    if recomputed:
        save(with_deltas, root, "corner_cards_with_delta", session, date)
    return recomputed


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, session, date, n): what the store holds, a row for each table and session."""
    found = [(name, load(spark, root, name)) for name in TABLES]
    rows = spark.createDataFrame([], "name string, session string, date string, n long")
    for name, table in found:
        if table is not None:
            rows = rows.unionByName(table.groupBy(F.lit(name).alias("name"), "session", "date").agg(F.count(F.lit(1)).alias("n")))
    return rows


def preview(spark: SparkSession, root: str, name: str, session: str, n: int = 5) -> DataFrame | None:
    """A few rows of a session's table; null if there is no such table."""
    table = load(spark, root, name, [session])
    return None if table is None else table.limit(n)


def history(spark: SparkSession, root: str, session: str, lap: int) -> DataFrame | None:
    """The corner cards of a lap of an earlier session; null, with a warning, if there are none."""
    cards = load(spark, root, "corner_cards", [session])
    found = None if cards is None else cards.where(F.col("lap") == lap)
    if found is None or found.isEmpty():
        logging.getLogger(__name__).warning("no cards of lap %s of session %s", lap, session)
        return None
    return found


def registered(issues: DataFrame, benchmarks: DataFrame | None = None) -> DataFrame:
    """(session, date, lap, laptime_s): sessions that have top issues, with their benchmark lap if known."""
    rows = issues.groupBy("session").agg(F.max("date").alias("date"))
    if benchmarks is None:
        return rows.withColumns({"lap": F.lit(None).cast("int"), "laptime_s": F.lit(None).cast("double")})
    return rows.join(benchmarks.select("session", "lap", "laptime_s"), "session", "left")


def benchmark(current: DataFrame, best: DataFrame) -> DataFrame:
    """(session, lap, laptime_s, mode): the best lap of earlier sessions, unless the current is strictly faster.

    current: (session, lap, laptime_s, mode); best: (session, lap, laptime_s), one row each at most.
    """
    rows = current.join(best.select("session", F.col("lap").alias("_lap"), F.col("laptime_s").alias("_s")), "session", "left")
    old = F.col("_s").isNotNull() & ~(F.coalesce(F.col("laptime_s") < F.col("_s"), F.lit(False)))
    pick = lambda a, b: F.when(old, b).otherwise(F.col(a)).alias(a)
    return rows.select("session", pick("lap", F.col("_lap")), pick("laptime_s", F.col("_s")), pick("mode", F.lit("historical_pb")))


def update_bests(times: DataFrame, root: str) -> int:
    """Adds the laps of (track, lap, laptime_s, session, date) that are strictly faster than all before them to the kept bests; how many.

    Laps count in order of date, session and lap, after those kept already. Records are added, never changed, and each call's are
    a version of their own, so that a call made twice, or again after it was cut short, adds nothing twice.
    Calls for one root must follow each other. Null or non-positive times and null tracks are left out.
    """
    spark = times.sparkSession
    files, path = _Files(spark, root), f"{root}/bests"
    kept = bests(spark, root)
    laps = times.where("track is not null and laptime_s > 0").select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in BESTS.split(", "))))
    fastest = W.partitionBy("track").orderBy("date", "session", "lap", "laptime_s").rowsBetween(W.unboundedPreceding, -1)
    known = kept.groupBy("track").agg(F.min("laptime_s").alias("_known"))
    rows = ordered.looked_up(laps, known, ["track"]).withColumn("_before", F.least("_known", F.min("laptime_s").over(fastest)))
    new = ordered.kept(rows.where(F.col("_before").isNull() | (F.col("laptime_s") < F.col("_before"))).drop("_known", "_before"))
    n = new.count()
    if n:
        version = 1 + max((int(v.removeprefix("v=")) for v in files.names(path) if v.startswith("v=")), default=0)
        fresh = f"{root}/bests.new-{uuid.uuid4().hex}"
        new.write.parquet(fresh)
        files.move(fresh, f"{path}/v={version:08d}")
    return n


def bests(spark: SparkSession, root: str) -> DataFrame:
    """(track, lap, laptime_s, session, date, v): every best there was, v the call that added it; no rows if there are none yet."""
    if not any(n.startswith("v=") for n in _Files(spark, root).names(f"{root}/bests")):
        return spark.createDataFrame([], f"{BESTS}, v int")
    return spark.read.schema(f"{BESTS}, v int").parquet(f"{root}/bests")


def current_bests(spark: SparkSession, root: str) -> DataFrame:
    """(track, lap, laptime_s, session, date): the best of each track."""
    rows = bests(spark, root)
    return rows.groupBy("track").agg(F.min_by(F.struct("lap", "laptime_s", "session", "date"), "laptime_s").alias("b")).select("track", "b.*")


def best_history(spark: SparkSession, root: str) -> DataFrame:
    """(track, lap, laptime_s, session, date, old_lap, old_laptime_s, old_session, improvement): bests that replaced another, in order of time."""
    order = W.partitionBy("track").orderBy(F.desc("laptime_s"))
    rows = bests(spark, root).drop("v").withColumns({f"old_{c}": F.lag(c).over(order) for c in ("lap", "laptime_s", "session")})
    return rows.where("old_laptime_s is not null").withColumn("improvement", F.col("old_laptime_s") - F.col("laptime_s"))


def exists(spark: SparkSession, path: str) -> bool:
    return _Files(spark, path).exists(path)


def save_document(spark: SparkSession, document: Mapping[str, Any], path: str) -> None:
    """A small JSON document: settings, a benchmark lap, apex parameters."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, defaults: Mapping[str, Any]) -> dict[str, Any]:
    """A document over its defaults; these alone if it is absent or no JSON object."""
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect()))
    except (AnalysisException, ValueError):
        return dict(defaults)
    return {**defaults, **found} if isinstance(found, dict) else dict(defaults)
