"""Reports as JSON: nested rows with sorted keys, ISO dates, and non-finite numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(x: Column) -> Column:
    """A double as JSON may hold it: "nan", "inf" and "-inf" where it is not finite."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def number_from(text: Column) -> Column:
    return text.cast("double")


def encoded(df: DataFrame, numbers: tuple[str, ...] = ()) -> DataFrame:
    """One column ``json``: each row with its fields in order of their names."""
    fields = [(number_text(F.col(c)) if c in numbers else F.col(c)).alias(c) for c in sorted(df.columns)]
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}
    return df.select(F.to_json(F.struct(*fields), options).alias("json"))


def decoded(lines: DataFrame, schema: T.StructType, numbers: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``encoded``; a version's new optional fields are null in old reports."""
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in numbers else f.dataType) for f in schema.fields])
    row = F.from_json("json", as_text).alias("r")
    return lines.select(row).select(*((number_from(F.col(f"r.{f.name}")) if f.name in numbers else F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields))


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def without_local_paths(df: DataFrame, *columns: str) -> DataFrame:
    """Paths and URLs as file names alone."""
    return df.withColumns({c: F.substring_index(F.col(c), "/", -1) for c in columns})


def suggested_name(first: Column, last: Column, suffix: Column) -> Column:
    """first-last with the part of last that differs, whole runs of digits kept, and a suffix."""
    n = F.least(F.length(first), F.length(last))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(first, F.lit(1), i) == F.substr(last, F.lit(1), i)))
    common = F.coalesce(F.array_max(same), F.lit(0))
    shared = F.substr(first, F.lit(1), common)
    kept = F.length(F.regexp_replace(shared, "[0-9]+$", ""))
    tail = F.substr(last, kept + 1)
    return F.when(first == last, F.concat(first, suffix)).otherwise(F.concat(first, F.lit("-"), tail, suffix))
