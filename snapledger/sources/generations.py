"""One scan over folders of Parquet files that were written under different schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Unreadable(ValueError):
    """A folder has none of the columns that a declared column may be read from."""


def _readable(spark: SparkSession, schema: T.StructType, expression: str) -> bool:
    """Whether an SQL expression can be resolved over a schema; nothing runs."""
    try:
        spark.createDataFrame([], schema).selectExpr(expression)
    except AnalysisException:
        return False
    return True


def choices(spark: SparkSession, schema: T.StructType, layout: Mapping[str, tuple[str, ...]]) -> dict[str, str]:
    """For each declared column the first of its expressions that the schema can be read by.

    layout names the columns with `type, expression, ...`: the type that comes out, and SQL expressions from the newest spelling to the oldest; a
    constant such as `NULL` as the last takes the place of what a generation lacks. Raises Unreadable, naming the column, if none fits.
    """
    found = {}
    for name, (kind, *expressions) in layout.items():
        typed = (f"CAST({e} AS {kind})" for e in expressions)
        first = next((e for e in typed if _readable(spark, schema, e)), None)
        if first is None:
            raise Unreadable(f"{name}: none of {expressions} can be read from {schema.simpleString()}")
        found[name] = first
    return found


def scan(spark: SparkSession, folders: list[str], layout: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """The rows of all folders in the declared columns and types, whatever generation a folder is of.

    Schemas are read from the files' footers, one per folder, as a folder is one commit's work; folders of one schema share one
    scan. Selections and column lists reach every scan below the union, through the chosen expressions: a column that a
    generation lacks is a constant there, and a filter on it is decided without reading. A cast that fails raises, as in any query.
    """
    generations: dict[str, tuple[T.StructType, list[str]]] = {}
    for folder in folders:
        schema = spark.read.parquet(folder).schema
        generations.setdefault(schema.json(), (schema, []))[1].append(folder)
    out = None
    for schema, paths in generations.values():
        chosen = choices(spark, schema, layout)
        part = spark.read.schema(schema).parquet(*paths).selectExpr(*(f"{e} AS `{name}`" for name, e in chosen.items()))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T._parse_datatype_string(kind)) for n, (kind, *_) in layout.items()]))
    return out
