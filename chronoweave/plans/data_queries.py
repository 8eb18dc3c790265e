"""Queries of the general data-preparation operators over the domain tables, with their SQL where SQL can say it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.cells import bytes_missing, day_state, plain, reading_missing
from chronoweave.operators.impute import fill_from_similar
from chronoweave.operators.percentiles import percentiles, value_counts
from chronoweave.operators.periods import merge_periods
from chronoweave.operators.regrid import regular_series, step_millis
from chronoweave.operators.spikes import flag_readings
from chronoweave.sources.tables import millis, table

MARKS = {"p50": Fraction(50, 100), "p90": Fraction(90, 100), "p95": Fraction(95, 100), "p99": Fraction(99, 100)}


def _clock() -> dict:
    """Time of day as two numeric features."""
    angle = F.pmod(millis("time"), F.lit(86_400_000)) * F.lit(6.283185307179586 / 86_400_000)
    return {"f_sin": F.sin(angle), "f_cos": F.cos(angle)}


def filled_traffic(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "traffic").select("reading_id", "name", "kind", "time", "value", "status").withColumn("day", F.floor(millis("time") / 86_400_000))
    gone = reading_missing(F.col("value"), F.col("status"))
    return fill_from_similar(df, "reading_id", ["name", "day"], {"value": gone}, _clock(), {"f_kind": F.col("kind"), "f_status": plain("status")})


def filled_flow(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "interface_kinds").select(plain("kind").alias("k_kind"), "speed")
    meta = table(spark, folder, "series_meta").select(F.col("name").alias("m_name"), plain("kind").alias("m_kind")).dropDuplicates(["m_name"])
    speeds = meta.join(kinds, F.col("m_kind") == F.col("k_kind"), "left").select("m_name", "speed")
    df = table(spark, folder, "flow").select("flow_id", "name", "time", "in", "out", "type")
    df = df.join(speeds, F.col("name") == F.col("m_name"), "left").drop("m_name").withColumn("day", F.floor(millis("time") / 86_400_000))
    gone = {f: bytes_missing(F.col(f), F.col("speed")) for f in ("in", "out")}
    numeric = _clock() | {f"f_{f}": F.when(~gone[f], F.log1p(F.col(f).cast("double"))) for f in gone}
    return fill_from_similar(df, "flow_id", ["name", "day"], gone, numeric, {"f_type": plain("type")})


def filled_availability(spark: SparkSession, folder: str) -> DataFrame:
    state = day_state(F.col("value"))
    df = table(spark, folder, "availability").select("avail_id", "name", "index", "uptime", "notes", "outages", state.alias("value"))
    up = F.try_to_number(F.regexp_extract("uptime", r"(\d{1,3}(\.\d{1,4})?)", 1), F.lit("999.9999")).cast("double")
    return fill_from_similar(df, "avail_id", ["name"], {"value": F.col("value").isNull()}, {"f_up": up, "f_out": F.log1p(F.col("outages").cast("double"))}, {"f_notes": plain("notes")})


def p1_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every missing cell with its fill (as text) and method."""
    parts = [
        (filled_traffic(spark, folder), "traffic", "reading_id", "value"),
        (filled_availability(spark, folder), "availability", "avail_id", "value"),
    ]
    frames = [d.where(F.col(f"{f}_fill").isNotNull()).select(F.lit(tab).alias("tab"), F.col(i).alias("row_id"), F.lit(f).alias("field"), F.col(f"{f}_fill").alias("method"), F.col(f"{f}_filled").cast("string").alias("filled")) for d, tab, i, f in parts]
    flow = filled_flow(spark, folder)
    both = flow.select("flow_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_fill").alias("method"), F.col(f"{f}_filled").cast("string").alias("filled")) for f in ("in", "out")])).alias("x")).where("x.method is not null")
    frames.append(both.select(F.lit("flow").alias("tab"), F.col("flow_id").alias("row_id"), "x.*"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_cells(spark, folder).where("filled is not null").select("tab", "row_id", "field")


def p1_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Missing cells by table, field and fill method."""
    return p1_cells(spark, folder).groupBy("tab", "field", "method").agg(F.count(F.lit(1)).alias("cells"))


def outage_periods(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "outages")
    r = F.col("timerange")
    return merge_periods(df, F.col("name"), millis(r["begin"]), millis(r["end"]), F.col("outage_id"), F.col("received_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("kind") == "gap", "gap").when(F.col("n_records") > 1, "merged")
    return outage_periods(spark, folder).select(F.col("entity").alias("name"), kind.alias("kind"), "begin_ms", "end_ms").where("kind is not null")


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    return outage_periods(spark, folder).where("kind = 'period'").select(F.col("entity").alias("name"), "begin_ms", "end_ms", "n_records")


def regular(spark: SparkSession, folder: str) -> DataFrame:
    # the step is read once per batch, before its points become rows
    df = table(spark, folder, "series_points").select(F.col("name").alias("source"), step_millis(F.col("step")).alias("step_ms"), "points")
    df = df.select("source", "step_ms", F.explode("points").alias("p"))
    return regular_series(df.select("source", "step_ms", millis(F.col("p")["time"]).alias("ms"), F.col("p")["value"].alias("value")))


def p3_regular(spark: SparkSession, folder: str) -> DataFrame:
    """The regular series, its doubles to six places."""
    return regular(spark, folder).withColumns({c: F.round(c, 6) for c in ("value", "support")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return regular(spark, folder).where("n = 0 and mark in ('filled', 'missing')").select(F.col("source").alias("name"), "slot_ms")


def flagged(spark: SparkSession, folder: str, by_chart: bool = False) -> DataFrame:
    kinds = table(spark, folder, "interface_kinds").select(plain("kind").alias("k_kind"), "speed")
    df = table(spark, folder, "traffic").join(kinds, plain("kind") == F.col("k_kind"), "left")
    return flag_readings(df, F.col("reading_id"), F.col("name"), millis("time"), F.col("value"), F.col("speed"), reading_missing(F.col("value"), F.col("status")), by_chart=by_chart)


def p4_method(spark: SparkSession, folder: str) -> DataFrame:
    """What the control chart marks by itself, without the exact check."""
    return flagged(spark, folder, by_chart=True).select("reading_id", "flaw").distinct()


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged readings with their distance from the level and the source's scatter."""
    return flagged(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_flags(spark, folder).select("reading_id", "flaw").distinct()


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "traffic")
    return df.where(~reading_missing(F.col("value"), F.col("status"))).select("name", "value", "reading_id", "time")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles(_readings(spark, folder), "name", "value", MARKS, distinct_by="reading_id")


def p5_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles, put together from the value counts of separate days."""
    once = _readings(spark, folder).withColumn("day", F.floor(millis("time") / 86_400_000)).repartition("name", "day").dropDuplicates(["name", "day", "reading_id"])
    days = value_counts(once, ["name", "day"], "value")
    return percentiles(days, "name", "value", MARKS, count="n")


def data_queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_cells": p1_cells,
        "p1_methods": p1_methods,
        "p2_found": p2_found,
        "p2_periods": p2_periods,
        "p3_found": p3_found,
        "p3_regular": p3_regular,
        "p4_method": p4_method,
        "p4_found": p4_found,
        "p4_flags": p4_flags,
        "p5_percentiles": p5_percentiles,
        "p5_merged_days": p5_merged_days,
    }
