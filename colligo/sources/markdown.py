"""Markdown: headings, links, sections and fenced blocks.

A file is scanned inside its row, by functions over its array of lines; nothing is shuffled. Fenced text holds no headings
or links; a heading has one to six marks; images are no links; a section ends before the next heading.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.collection import Collection
from colligo.sources.text import content_hash, lf, read_texts

_FENCE = r"^\s{0,3}(`{3,}|~{3,})"
_HEADING = r"^\s{0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$"
_LINK = r"(?<!!)\[([^\]\[]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)"


def _lines(text: Column) -> Column:
    return F.transform(F.split(lf(text), "\n"), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))


def scanned(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Keys, ``lines array<n, t>`` and ``fences array<o, c>``: each fence's opening and closing line, ``c`` null if it stays
    open. Only the lines that look like fences are folded over; a fence closes with its own mark, at least as long."""
    base = texts.where(F.col(text).isNotNull()).select(*keys, _lines(F.col(text)).alias("lines"))
    marks = F.filter("lines", lambda x: x["t"].rlike(_FENCE))
    zero = F.struct(F.array().cast("array<struct<o:int,c:int>>").alias("out"), F.lit("").alias("mark"), F.lit(0).alias("o"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line["t"], _FENCE, 1)
        inside = acc["mark"] != ""
        closes = inside & F.startswith(mark, acc["mark"]) & (F.trim(line["t"]) == mark)
        done = F.array_append(acc["out"], F.struct(acc["o"].alias("o"), line["n"].cast("int").alias("c")))
        return F.struct(F.when(closes, done).otherwise(acc["out"]).alias("out"), F.when(closes, F.lit("")).when(inside, acc["mark"]).otherwise(mark).alias("mark"), F.when(inside, acc["o"]).otherwise(line["n"].cast("int")).alias("o"))

    last = lambda a: F.when(a["mark"] != "", F.array_append(a["out"], F.struct(a["o"].alias("o"), F.lit(None).cast("int").alias("c")))).otherwise(a["out"])
    return base.withColumn("fences", F.aggregate(marks, zero, step, last))


def _outside(x: Column) -> Column:
    return ~F.exists("fences", lambda f: (x["n"] >= f["o"]) & (f["c"].isNull() | (x["n"] <= f["c"])))


def headings(texts: DataFrame, keys: Sequence[str], text: str = "text") -> Collection:
    rows = scanned(texts, keys, text).select(*keys, F.explode(F.filter("lines", lambda x: x["t"].rlike(_HEADING) & _outside(x))).alias("x"))
    df = rows.select(*keys, F.coalesce(F.regexp_extract("x.t", _HEADING, 2), F.lit("")).alias("Text"), F.length(F.regexp_extract("x.t", _HEADING, 1)).cast("bigint").alias("Level"), F.col("x.n").cast("bigint").alias("Line"))
    return Collection.of(df, "Heading", [*keys, "Line"])


def links(texts: DataFrame, keys: Sequence[str], text: str = "text") -> Collection:
    rows = scanned(texts, keys, text).select(*keys, F.explode(F.filter("lines", lambda x: x["t"].contains("](") & _outside(x))).alias("x"))
    found = rows.select(*keys, F.col("x.n").cast("bigint").alias("Line"), F.regexp_extract_all("x.t", F.lit(_LINK), 0).alias("all"))
    df = found.select(*keys, "Line", F.posexplode("all").alias("at", "one")).select(*keys, F.regexp_extract("one", r"\]\(\s*<?([^)\s>]+)", 1).alias("Url"), F.regexp_extract("one", r"^\[([^\]]*)\]", 1).alias("Text"), "Line", "at")
    return Collection.of(df, "Link", [*keys, "Line", "at"])


def sections(texts: DataFrame, keys: Sequence[str], text: str = "text") -> Collection:
    base = scanned(texts, keys, text)
    marks = F.filter("lines", lambda x: x["t"].rlike(_HEADING) & _outside(x))
    rows = base.withColumn("h", marks).select(*keys, "lines", "h", F.posexplode("h").alias("i", "x"))
    end = F.coalesce(F.get("h", F.col("i") + 1)["n"] - 1, F.size("lines"))
    body = F.array_join(F.transform(F.slice("lines", F.col("x.n") + 1, F.greatest(end - F.col("x.n"), F.lit(0))), lambda x: x["t"]), "\n")
    df = rows.select(*keys, F.regexp_extract("x.t", _HEADING, 2).alias("Heading"), F.length(F.regexp_extract("x.t", _HEADING, 1)).cast("bigint").alias("Level"), body.alias("Content"), F.col("x.n").cast("bigint").alias("StartLine"), end.cast("bigint").alias("EndLine"))
    return Collection.of(df, "Section", [*keys, "StartLine"])


def fence_blocks(texts: DataFrame, keys: Sequence[str], text: str = "text") -> Collection:
    rows = scanned(texts, keys, text).select(*keys, "lines", F.explode("fences").alias("f"))
    rows = rows.withColumn("x", F.get("lines", F.col("f.o") - 1))
    end = F.coalesce(F.col("f.c"), F.size("lines") + 1)
    body = F.array_join(F.transform(F.slice("lines", F.col("x.n") + 1, F.greatest(end - F.col("x.n") - 1, F.lit(0))), lambda x: x["t"]), "\n")
    info = F.trim(F.regexp_replace("x.t", _FENCE, ""))
    df = rows.select(*keys, F.nullif(F.regexp_extract(info, r"^([^\s{]+)", 1), F.lit("")).alias("Language"), F.nullif(F.trim(F.regexp_replace(info, r"^[^\s{]+", "")), F.lit("")).alias("Tag"), F.col("x.n").cast("bigint").alias("StartLine"), F.least(end, F.size("lines")).cast("bigint").alias("EndLine"), body.alias("Content"))
    return Collection.of(df.withColumn("ContentHash", content_hash(F.col("Content"))), "FenceBlock", [*keys, "StartLine"])


def source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
    texts = read_texts(spark, root, "*.{md,markdown}").withColumnRenamed("Text", "text")
    make = {"Headings": headings, "Links": links, "Sections": sections, "FenceBlocks": fence_blocks}
    return {n: make[n](texts, ["Path"]) for n in names if n in make}
