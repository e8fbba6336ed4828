"""Queries of the training-data operators over the tables of a data directory, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.llm import credentials, generated, mixing, moderation, packing, parsing, spans
from colligo.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


#: Owners whose licence on a file is no sign of foreign code: the project's own.
OWN_OWNERS = ("Lanternworks",)


def _not_hand_written(files: DataFrame) -> DataFrame:
    return generated.not_hand_written(files, OWN_OWNERS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_hand_written(table(spark, d, "source_files")).select("file_id").distinct()


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = _not_hand_written(table(spark, d, "source_files"))
    return found.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def p1_hand_written(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return files.join(_not_hand_written(files), "file_id", "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "fence_blocks"), "block_id", "content", 160)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found_in_files(table(spark, d, "source_files")).unionAll(credentials.found_in_statements(table(spark, d, "code_statements")))


def p4_redacted_files(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "source_files"), "file_id", "raw_text")


def p4_redacted_statements(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "code_statements"), "stmt_id", "expression").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.check_syntax(table(spark, d, "source_files"), only_invalid=True).select("file_id").distinct()


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    checked = parsing.check_syntax(table(spark, d, "source_files"), only_invalid=True)
    return checked.select("file_id", "language", "first_cause", F.explode("faults").alias("fault")).select("file_id", "language", "first_cause", "fault.line", "fault.message")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(parsing.check_syntax(table(spark, d, "source_files")))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d))


_MIXTURES: dict[tuple[str, str], mixing.Mixture] = {}


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    """One plan, measured once, for the three reports over a directory; the last one asked for is kept, as long as what it
    wrote into the checkpoint folder is there."""
    key = (spark.sparkContext.applicationId, d)
    if key in _MIXTURES:
        try:
            _MIXTURES[key].texts.isEmpty()
        except Exception:  # noqa: BLE001  whatever the file system says of a folder that was cleared
            del _MIXTURES[key]
    if key not in _MIXTURES:
        _MIXTURES.clear()
        _MIXTURES[key] = mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return _MIXTURES[key]


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).usage()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).order()


def _moderated(spark: SparkSession, d: str) -> DataFrame:
    return moderation.moderate(table(spark, d, "documents"), table(spark, d, "moderation_examples"), keep=["source"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _moderated(spark, d).where("toxic").select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _moderated(spark, d).select("doc_id", "source", F.round("score", 6).alias("score"), "toxic")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.rates(_moderated(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    p1_found, p1_reasons, p1_hand_written, p2_found, p4_found, p4_redacted_files, p4_redacted_statements, p5_found, p5_faults, p5_rates,
    p6_packed, p6_fill, p7_usage, p7_shares, p7_order, p8_found, p8_scores, p8_rates,
)}

#: The others need a tokenizer, a parser or a trained model, which SQL has not: they are tested against brute force, exact
#: round trips and held-out accuracy.
ORACLE: dict[str, str] = {
    "p2_found": """
WITH t AS (SELECT DISTINCT block_id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM fence_blocks WHERE block_id IS NOT NULL AND content IS NOT NULL),
w AS (SELECT block_id, c, i, md5(substr(c, i, 160)) AS h FROM t, LATERAL (SELECT unnest(range(1, length(c) - 158)) AS i) WHERE length(c) >= 160),
s AS (SELECT block_id, c, i, lead(i) OVER (PARTITION BY block_id, c ORDER BY i) AS following FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT block_id) > 1))
SELECT block_id, max(n) AS shared_chars FROM (SELECT block_id, CAST(sum(least(160, coalesce(following - i, 160))) AS BIGINT) AS n FROM s GROUP BY block_id, c) GROUP BY block_id""",
}
