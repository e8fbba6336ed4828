"""Text files: whole texts, numbered lines, regions, content hashes, languages by extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.collection import Collection

#: Extension to language (fixed values).
LANGUAGES = {
    "cs": "csharp", "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "md": "markdown", "txt": "text", "xml": "xml", "json": "json", "csproj": "xml", "props": "xml", "targets": "xml",
    "yml": "yaml", "yaml": "yaml", "config": "xml", "editorconfig": "editorconfig", "sln": "text", "bicep": "bicep", "tsp": "typespec",
}


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(slashes(path), r"\.([^./]+)$", 1)), F.lit(""))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 in lower-case hex of the text with LF line ends and outer white space cut off."""
    return F.sha2(F.regexp_replace(lf(text), r"^[\s]+|[\s]+$", ""), 256)


def read_texts(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``Path, Text``: every file under a root as one row; binary content does not stop the read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\."), "")
    return files.select(path.alias("Path"), F.decode("content", "UTF-8").alias("Text"))


def files_of(texts: DataFrame, root: str = "") -> Collection:
    """``File`` items: Path, Language, Source."""
    df = texts.select("Path", F.coalesce(language_of(F.col("Path")), F.lit("unknown")).alias("Language"), F.col("Path").alias("Source"))
    return Collection.of(df, "File", ["Path"])


def lines_of(texts: DataFrame, text: str, keys: Sequence[str], item: str = "Line") -> Collection:
    """Numbered lines of each text, from 1, without their line ends."""
    at, line = "at", "line_text"
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(lf(F.col(text)), "\n")).alias(at, line))
    df = rows.select(*keys, (F.col(at) + 1).cast("bigint").alias("number"), F.col(line).alias("text"))
    return Collection.of(df, item, [*keys, "number"])


def regions_of(texts: DataFrame, text: str, keys: Sequence[str]) -> Collection:
    """``#region`` blocks: name, lines, content between the marks, hash. A mark's partner is found by nesting depth, all
    within the row of a file."""
    marks = F.filter(F.transform(F.split(lf(F.col(text)), "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(x).alias("t"))), lambda m: m["t"].rlike(r"^#\s*(?:region|endregion)\b"))
    step = F.transform(marks, lambda m: F.struct(m["n"].alias("n"), m["t"].alias("t"), F.when(m["t"].rlike(r"^#\s*region"), F.lit(1)).otherwise(F.lit(-1)).alias("d")))
    df = texts.where(F.col(text).contains("#")).select(*keys, F.col(text).alias("__t"), step.alias("__m"))
    # depth before each mark: openings minus closings so far
    deep = F.transform("__m", lambda m, i: F.struct(m["n"].alias("n"), m["t"].alias("t"), m["d"].alias("d"), F.aggregate(F.slice(F.col("__m"), F.lit(1), i), F.lit(0), lambda a, x: a + x["d"]).alias("before")))
    df = df.withColumn("__m", deep)
    opened = df.select("*", F.explode("__m").alias("o")).where("o.d = 1")
    close = F.get(F.filter("__m", lambda m: (m["n"] > F.col("o.n")) & (m["d"] == -1) & (m["before"] == F.col("o.before") + 1)), F.lit(0))
    found = opened.withColumn("c", close).where("c IS NOT NULL")
    content = F.array_join(F.slice(F.split(lf(F.col("__t")), "\n"), F.col("o.n") + 1, F.greatest(F.col("c.n") - F.col("o.n") - 1, F.lit(0))), "\n")
    out = found.select(*keys, F.trim(F.regexp_replace("o.t", r"^#\s*region", "")).alias("Name"), F.col("o.n").cast("bigint").alias("StartLine"), F.col("c.n").cast("bigint").alias("EndLine"), content.alias("Content"))
    return Collection.of(out.withColumn("ContentHash", content_hash(F.col("Content"))), "Region", [*keys, "EndLine"])


def source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
    """The text source: Files, Lines, Regions of all files under a root."""
    texts = read_texts(spark, root)
    make = {"Files": lambda: files_of(texts, root), "Lines": lambda: lines_of(texts, "Text", ["Path"]), "Regions": lambda: regions_of(texts, "Text", ["Path"])}
    return {n: make[n]() for n in names if n in make}
