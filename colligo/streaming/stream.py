"""Streams: the same expressions over Structured Streaming, filter → transform → sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from colligo.collection import Collection
from colligo.engine import Engine, RuleError
from colligo.lang.ast import ForEach, Literal
from colligo.lang.planner import Scope
from colligo.runtime import ensure_checkpoint_dir


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a single file is read through its folder; a folder of parts as it is
    import os

    if os.path.isfile(path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def register_stream(engine: Engine, namespace: str, name: str, df: DataFrame, item: str) -> None:
    """A streaming collection; it has no order, its items are taken as they come."""
    engine.catalog.register(namespace, name, Collection(df, Collection.of(df.limit(0) if not df.isStreaming else df, item, []).ty, (), engine.planner))
    engine.catalog.built.pop((namespace, name), None)


def streaming_statements(engine: Engine) -> list[ForEach]:
    """The foreach statements whose collection is a stream."""
    return [s for s in engine.statements if isinstance(s, ForEach) and engine.planner.collection(s.source).df.isStreaming]


def run_stream(engine: Engine, sinks: dict[str, Callable[[DataFrame, int], None]] | None = None, available_now: bool = False, checkpoint: str | None = None) -> list[StreamingQuery]:
    """Starts each streaming statement: every micro-batch goes through filters and the transform to its sink."""
    out = []
    for k, s in enumerate(streaming_statements(engine)):
        c = engine.planner.collection(s.source)
        scope = Scope.of_collection(c)
        kind, args = s.action.kind, s.action.args
        if args and isinstance(args[0], Literal) and isinstance(args[0].value, str):
            c = c.project(engine.planner.template(args[0].value, scope))
        elif args:
            c = c.project(engine.planner.as_value(engine.planner.evaluate(args[0], scope), scope))
        name = f"{s.sink.namespace}.{s.sink.name}" if s.sink and s.sink.namespace else s.sink.name if s.sink else "console.WriteLine"
        given = {**BATCH_SINKS, **{n: f for n, f in engine.sinks.items()}, **(sinks or {})}
        if name not in given:
            raise RuleError(f"no sink {name}")
        target = given[name]
        sink_args = s.sink.args if s.sink else ()
        writer = c.rows().writeStream.foreachBatch(lambda df, i, f=target, a=sink_args: f(df, i, *a)).option("checkpointLocation", f"{checkpoint or _location(engine.spark)}/{k}")
        out.append((writer.trigger(availableNow=True) if available_now else writer).start())
    return out


def _location(spark: SparkSession) -> str:
    """A new folder for a query's progress, in the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _print(df: DataFrame, _: int, *args: Any) -> None:
    for row in df.toLocalIterator():
        print(row[0])


def _append(df: DataFrame, batch: int, path: str) -> None:
    """Lines to a file, which pass the driver a part at a time; to a folder (``…/``), as text files that the tasks write, those of
    one batch in a folder of their own, so that a batch that is run again does not write twice."""
    if path.endswith("/"):
        df.select(df[0].cast("string").alias("value")).write.mode("overwrite").text(f"{path}batch={batch}")
        return
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{row[0]}\n" for row in df.toLocalIterator())


BATCH_SINKS: dict[str, Callable[..., None]] = {"console.WriteLine": _print, "file.Write": _append}


def run_to_table(engine: Engine, path: str, name: str, expression: str, item: str) -> DataFrame:
    """All of a Parquet stream through an expression into a table of Parquet files in the shared folder; the table."""
    spark = engine.spark
    stream = parquet_stream(spark, path)
    engine.catalog.register("stream", name, Collection(stream, Collection.of(stream, item, []).ty, (), engine.planner))
    engine.catalog.factories.pop(("db", name), None)
    c = replace(engine.planner.collection(expression), planner=engine.planner)
    where = _location(spark)
    query = c.rows().writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(c.rows().schema).parquet(f"{where}/out")


__all__ = ["parquet_stream", "register_stream", "run_stream", "run_to_table", "streaming_statements"]
