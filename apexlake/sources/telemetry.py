"""Telemetry from delimited files with whatever headers: columns found by aliases, units, clean rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apexlake.functions.text import speed_unit, to_ms

#: Headers that are understood, in order of preference.
ALIASES = {
    "t_s": ("t_s", "time_s", "time", "timestamp", "elapsed_time", "elapsed_time (s)"),
    "lap": ("lap", "lap #", "lap_number"),
    "lat": ("lat", "latitude", "latitude (deg)", "latitude_deg"),
    "lon": ("lon", "longitude", "longitude (deg)", "longitude_deg"),
    "v": ("speed", "speed (m/s)", "speed_mps", "speed_m/s", "speed_kmh", "speed (km/h)", "speed_mph", "speed (mph)"),
    "longitudinal_acc_g": ("longitudinal_acc", "longitudinal_acc (g)", "longitudinal g", "longitudinal-acc (g)"),
}
REQUIRED = ("t_s", "lat", "lon", "v")
#: Columns that are passed on under their own names.
EXTRA = ("rpm", "throttle", "throttle_pos")


def plain(name: str) -> str:
    return " ".join(name.lower().split())


def bare(name: str) -> str:
    """Without what is in parentheses and without spaces."""
    return re.sub(r"\s+", "", re.sub(r"\([^)]*\)", "", plain(name)))


def resolve(columns: Sequence[str], aliases: Sequence[str], override: str | None = None) -> str | None:
    """The column that an override or else the first alias names; of columns that look alike the last."""
    if override is not None:
        same = [c for c in columns if plain(c) == plain(override)]
        if same:
            return same[0]
    known = {bare(c): c for c in columns}
    return next((known[bare(a)] for a in aliases if bare(a) in known), None)


def metric_speed(columns: Sequence[str]) -> str | None:
    """Of several speed columns the first that is in metres a second."""
    speeds = [c for c in columns if "speed" in c.lower() or "velocity" in c.lower()]
    if len(speeds) < 2:
        return None
    return next((c for c in speeds if "m/s" in c.lower() or ("mps" in c.lower() and "mph" not in c.lower())), None)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with a header as strings, + file, rid: UTF-8, with or without its mark, or else Latin-1.

    rid orders rows by file name, block of the file and place in it, so a session in several files is in order of their names.
    """
    read = lambda encoding: spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path)
    lines = spark.read.text(path)
    whole = lines.where(~F.is_valid_utf8("value")).isEmpty()
    rows = read("UTF-8" if whole else "ISO-8859-1")
    names = [c.lstrip("﻿").removeprefix("ï»¿") for c in rows.columns]
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("_metadata.file_name").alias("file"), place.alias("rid")).toDF(*names, "file", "rid")


def canonical(rows: DataFrame, overrides: Mapping[str, str] | None = None, unit: str = "auto", keys: Sequence[str] = (), order: str = "rid") -> DataFrame:
    """(keys, rid, t_s, lat, lon, v, lap, longitudinal_acc_g, rpm ..., altitude): telemetry in metres a second.

    Raises if time, position or speed has no column. What is no number is null. Laps are filled forward
    and 0 at the start; then rows without time, position or speed go. altitude is passed on unless it is
    0 everywhere.
    """
    overrides = overrides or {}
    own = [c for c in rows.columns if c != order and c not in keys]
    column = {name: resolve(own, aliases, overrides.get(name)) for name, aliases in ALIASES.items()}
    if unit == "auto" and "v" not in overrides:
        column["v"] = metric_speed(own) or column["v"]
    missing = [name for name in REQUIRED if column[name] is None]
    if missing:
        raise ValueError("; ".join(f"no column for {m} (one of {', '.join(ALIASES[m])})" for m in missing) + f"; there are {', '.join(own)}")
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))
    if unit == "auto":
        unit = speed_unit(column["v"], rows.agg(F.max(number(column["v"]))).first()[0])
    fields = [number(column[c]).alias(c) for c in ("t_s", "lat", "lon")] + [to_ms(number(column["v"]), unit).alias("v")]
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    lap = F.coalesce(F.last(number(column["lap"]), ignorenulls=True).over(w), F.lit(0.0)) if column["lap"] else F.lit(0.0)
    fields += [lap.cast("int").alias("lap"), (number(column["longitudinal_acc_g"]) if column["longitudinal_acc_g"] else F.lit(None).cast("double")).alias("longitudinal_acc_g")]
    fields += [F.col(f"`{c}`").alias(c) for c in EXTRA if c in own]
    height = resolve(own, ("altitude", "altitude (m)"))
    if height and not rows.where(F.coalesce(number(height) != 0, F.lit(True))).isEmpty():
        fields.append(number(height).alias("altitude"))
    return rows.select(*keys, order, *fields).dropna(subset=list(REQUIRED))
