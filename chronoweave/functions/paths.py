"""Addressing of columns: a field path names one column, a field spec names several.

A path is dotted ('a.b') or a list of segments; a spec is one path or a list of paths. None means 'value', or every column
where an operator says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.errors import FieldError

Path = str | Sequence[str] | None
Spec = str | Sequence[str] | None


def segments(path: Path) -> tuple[str, ...]:
    """The segments of one path; an existing dotted top-level name is not looked for here."""
    if path is None:
        return ("value",)
    if isinstance(path, str):
        return tuple(path.split("."))
    if isinstance(path, (list, tuple)) and path and all(isinstance(p, str) for p in path):
        return tuple(path)
    raise FieldError(f"not a field path: {path!r}")


def spec(fields: Spec, default: Iterable[str] = ("value",)) -> list[tuple[str, ...]]:
    """The paths of a spec, each as segments."""
    if fields is None:
        return [segments(f) for f in default]
    if isinstance(fields, str):
        return [segments(fields)]
    if isinstance(fields, (list, tuple)) and all(isinstance(f, str) for f in fields):
        return [segments(f) for f in fields]
    raise FieldError(f"not a field spec: {fields!r}")


def quoted(path: Sequence[str]) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in path)


def resolve(df: DataFrame, path: Path) -> tuple[str, ...]:
    """Segments of a path as the columns of `df` have it: a top-level column with dots in its name wins."""
    if isinstance(path, str) and path in df.columns:
        return (path,)
    return segments(path)


def type_at(schema: T.StructType, path: Sequence[str]) -> T.DataType | None:
    """The type at a path; None where the path ends before a missing field. A step into what is no struct is an error."""
    at: T.DataType = schema
    for p in path:
        if not isinstance(at, T.StructType):
            raise FieldError(f"{'.'.join(path)}: {p} is looked for in what is no structure")
        if p not in at.names:
            return None
        at = at[p].dataType
    return at


def column(df: DataFrame, path: Sequence[str]) -> Column:
    """The column at a path; null where it does not exist."""
    return F.lit(None) if type_at(df.schema, path) is None else F.col(quoted(path))


def need(df: DataFrame, path: Sequence[str]) -> Column:
    """The column at a path; an error where it does not exist."""
    if type_at(df.schema, path) is None:
        raise FieldError(f"no column {'.'.join(path)} in {', '.join(df.columns)}")
    return F.col(quoted(path))


def put(df: DataFrame, path: Sequence[str], value: Column) -> DataFrame:
    """`df` with the column at a path replaced or added."""
    if len(path) == 1:
        return df.withColumn(path[0], value)
    return df.withColumn(path[0], F.col(quoted(path[:1])).withField(quoted(path[1:]), value))
