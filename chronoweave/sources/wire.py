"""The JSON wire format: {"name", "columns": [key kind, data columns ..], "points": [[key, values ..], ..], metadata ..}."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.errors import FieldError, SeriesError
from chronoweave.functions import timekeys as tk
from chronoweave.operators.series import INDEX, RANGE, TIME, Series, TimeRange


def _infer(values: list[Any]) -> T.DataType:
    """The Spark type of some JSON values; numbers and texts together become text."""
    seen = [v for v in values if v is not None]
    if seen and all(isinstance(v, Mapping) for v in seen):
        names = list(dict.fromkeys(k for v in seen for k in v))
        return T.StructType([T.StructField(n, _infer([v.get(n) for v in seen])) for n in names])
    if seen and all(isinstance(v, list) for v in seen):
        return T.ArrayType(_infer([x for v in seen for x in v]))
    if seen and all(isinstance(v, bool) for v in seen):
        return T.BooleanType()
    if seen and all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
        return T.LongType()
    if seen and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen):
        return T.DoubleType()
    return T.StringType()


def _fit(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in v]
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        return json.dumps(v)
    return v


def read_wire(spark: SparkSession, doc: Mapping[str, Any] | str, schema: T.StructType | str | None = None, tz: str = "UTC") -> Series:
    """A series of one wire document; `schema` gives the data types, else they are inferred from the points.

    Points are in the order of the document and must be in time order. A document whose first column is none of time,
    timerange and index is an error; so are bad indexes and reversed ranges.
    """
    doc = json.loads(doc) if isinstance(doc, str) else doc
    kind, *names = doc["columns"]
    if kind not in (TIME, RANGE, INDEX):
        raise SeriesError(f"the first column must be time, timerange or index, not {kind!r}")
    points = doc.get("points", [])
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if types is None:
        types = T.StructType([T.StructField(n, _infer([p[i + 1] for p in points])) for i, n in enumerate(names)])
    rows = []
    last = None
    for i, p in enumerate(points):
        if kind == TIME:
            head = (tk.to_ms(p[0]),)
        elif kind == RANGE:
            r = TimeRange.of(p[0])
            head = (r.begin, r.end)
        else:
            head = (*tk.range_of_index(p[0], tz), p[0])
        if last is not None and head[0] < last:
            raise SeriesError("points must be in time order")
        last = head[0]
        rows.append((*head, i, *[_fit(v, f.dataType) for v, f in zip(p[1:], types, strict=True)]))
    key = {TIME: ["_t"], RANGE: ["_t", "_e"], INDEX: ["_t", "_e", "_k"]}[kind]
    full = T.StructType([T.StructField(k, T.StringType() if k == "_k" else T.LongType()) for k in key] + [T.StructField("_ord", T.LongType())] + list(types))
    meta = {k: v for k, v in doc.items() if k not in ("columns", "points")}
    return Series(spark.createDataFrame(rows, full), kind, {"name": "", "utc": True, **meta}, (), None, tz)


class WireEncoder(json.JSONEncoder):
    """JSON of series, ranges and indexes in the wire format; times become epoch milliseconds."""

    def default(self, o: Any) -> Any:
        if isinstance(o, datetime):
            return tk.to_ms(o)
        return o.to_json() if hasattr(o, "to_json") else super().default(o)


def payload(value: Any) -> dict[str, Any]:
    """A payload: a mapping as it is, a number, truth value or text as {'value': it}; anything else raises, None too."""
    if isinstance(value, Mapping):
        return dict(value)
    if isinstance(value, (bool, int, float, str)):
        return {"value": value}
    raise FieldError(f"not a payload: {value!r}")


def read_bag(spark: SparkSession, events: Any, kind: str = TIME, schema: T.StructType | str | None = None) -> Series:
    """`read_events` of whatever comes: what is no list of (key, payload) pairs gives a warning and an empty series."""
    fine = isinstance(events, (list, tuple)) and all(isinstance(e, (list, tuple)) and len(e) == 2 for e in events)
    if not fine:
        warnings.warn(f"not a list of events: {type(events).__name__}", stacklevel=2)
    return read_events(spark, [(k, payload(v)) for k, v in events] if fine else [], kind, schema=schema)


def read_events(spark: SparkSession, events: list[tuple[Any, Mapping[str, Any]]], kind: str = TIME, meta: Mapping[str, Any] | None = None, schema: T.StructType | str | None = None) -> Series:
    """A series of (key, payload) pairs in order; a payload that is a plain value stands for {'value': it}."""
    rows = [(k, v if isinstance(v, Mapping) else {"value": v}) for k, v in events]
    given = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema) if schema is not None else None
    names = given.names if given is not None else list(dict.fromkeys(n for _, v in rows for n in v))
    return read_wire(spark, {**(meta or {}), "columns": [kind, *names], "points": [[k, *[v.get(n) for n in names]] for k, v in rows]}, schema)


def read_wire_files(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = TIME) -> DataFrame:
    """Many wire documents as JSON lines, in parallel: name, the internal key columns, `_ord`, and the typed data columns.

    Every document must have the key kind and the data columns of `schema`, in that order. Points whose key cannot be read
    have a null time.
    """
    types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    docs = spark.read.schema("name string, columns array<string>, points array<string>").json(path)
    x = docs.select("name", F.posexplode("points").alias("_ord", "p"))
    cell = F.from_json("p", "array<string>")
    x = x.withColumn("c", cell)
    keys = {TIME: [F.get("c", F.lit(0)).try_cast("long").alias("_t")], RANGE: [F.from_json(F.get("c", F.lit(0)), "array<long>")[i].alias(n) for i, n in enumerate(("_t", "_e"))], INDEX: []}[kind]
    if kind == INDEX:
        b, e = tk.index_range(F.get("c", F.lit(0)))
        keys = [b.alias("_t"), e.alias("_e"), F.get("c", F.lit(0)).alias("_k")]
    data = []
    for i, f in enumerate(types):
        raw = F.get("c", F.lit(i + 1))
        plain = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        data.append((F.from_json(raw, f.dataType) if plain else raw.try_cast(f.dataType)).alias(f.name))
    return x.select("name", *keys, F.col("_ord").cast("long").alias("_ord"), *data)


def write_wire(df: DataFrame, name: str = "name") -> DataFrame:
    """One wire document (text) per series of a frame with columns name, `_t`, `_ord` and data: `wire`.

    A series' points come together in one row, which is what a document is; the points are ordered by time and arrival.
    """
    data = [c for c in df.columns if c not in ("_t", "_e", "_k", "_ord", name)]
    kind = INDEX if "_k" in df.columns else RANGE if "_e" in df.columns else TIME
    head = {TIME: F.to_json(F.array("_t")), RANGE: F.to_json(F.array(F.array(*["_t", "_e"]))) if kind == RANGE else None, INDEX: F.to_json(F.array("_k")) if kind == INDEX else None}[kind]
    cells = [F.regexp_extract(F.to_json(F.array(F.col(f"`{c}`"))), r"(?s)^\[(.*)\]$", 1) for c in data]
    point = F.concat(F.lit("["), F.concat_ws(",", F.regexp_extract(head, r"(?s)^\[(.*)\]$", 1), *cells), F.lit("]"))
    rows = df.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_t", "_ord", point.alias("p")))).alias("ps"))
    columns = json.dumps([kind, *data])
    points = F.concat(F.lit("["), F.array_join(F.transform("ps", lambda x: x["p"]), ","), F.lit("]"))
    return rows.select(name, F.concat(F.lit('{"name":'), F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1), F.lit(f',"columns":{columns},"points":'), points, F.lit("}")).alias("wire"))
