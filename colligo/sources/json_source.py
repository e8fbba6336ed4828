"""JSON: files that hold an array of objects of a declared type, and JSON texts in a column."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colligo.collection import Collection
from colligo.functions import types as K
from colligo.functions.types import Ty


def read_json(spark: SparkSession, path: str, ty: Ty | None = None) -> Collection:
    """A file whose top level is an array, with the given type or one inferred; the order is that of the file."""
    texts = spark.read.text(path, wholetext=True)
    head = texts.select(F.substring(F.ltrim(F.regexp_replace("value", "^﻿", "")), 1, 1).alias("c")).first()
    if head is None or head[0] != "[":
        raise ValueError(f"{path} holds no array at its top level")
    if ty is None:
        df = spark.read.option("multiLine", True).json(path)
        return Collection.of(df, None, df.columns)
    schema = T.ArrayType(K.to_spark(ty))
    df = texts.select(F.posexplode(F.from_json(F.regexp_replace("value", "^﻿", ""), schema)).alias("at", "x")).select("x.*", "at")
    made = Collection.of(df, ty.name, ["at"])
    return Collection(made.df, K.record(list(ty.fields), ty.name, ty.bases), made.order)


def read_csv(spark: SparkSession, path: str, ty: Ty | None = None) -> Collection:
    reader = spark.read.option("header", True)
    df = reader.schema(K.to_spark(ty)).csv(path) if ty is not None else reader.option("inferSchema", True).csv(path)
    return Collection.of(df, ty.name if ty else None)


def read_parquet(spark: SparkSession, path: str, ty: Ty | None = None) -> Collection:
    return Collection.of(spark.read.parquet(path), ty.name if ty else None)


READERS = {"json": read_json, "csv": read_csv, "parquet": read_parquet}


def with_json(c: Collection, column: str, ty: Ty, field: str) -> Collection:
    """A field with the parsed JSON of a text column; null where it does not parse."""
    df = c.df.withColumn(field, F.from_json(F.col(f"`{column}`"), K.to_spark(ty), {"mode": "PERMISSIVE"}))
    return Collection(df, K.record([*c.ty.fields, (field, ty)], c.ty.name, c.ty.bases), c.order, c.planner)
