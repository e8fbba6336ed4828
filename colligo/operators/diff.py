"""Differences between two copies of a keyed data set.

Method: a column-by-bucket checksum matrix. A row is reduced where it is read to its key, its version and a 64-bit hash of
(key, value) per compared column; only these cross the shuffle that finds the row that counts of each key. Every copy then
becomes one row per key bucket that holds, for the key and for each column, the sums of both halves of the hashes. Sums do
not depend on the order of rows, so equal buckets have equal rows. The two matrices are compared; only buckets that differ
are read again, and of them only the values of columns that differ are moved and joined on the key. Values of equal buckets
never leave the task that reads them.

A bucket holds keys of one shuffle partition only (both follow the same hash), so the sums of a bucket are complete before
the matrix is shuffled.

Cases
* ``null`` equals only ``null``; white space (Unicode) anywhere in a value is ignored where ``ignore_whitespace``.
* several rows of a key: the row with the greatest ``version`` column counts; of equal versions the one whose hashes of
  (key, value) are greatest, first column first, so repeats and row order have no effect. A null version is older than any
  other.
* a null key names no entry; such rows are left out.
* an empty side: every key of the other one is missing. Two empty sides: no rows.
* other columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.runtime import cut

#: Rows of a bucket, about: few enough that a difference drags few equal rows along.
ROWS_PER_BUCKET = 8
#: Unequal buckets, counted, up to which their list (a few bytes each) goes to every task; beyond, rows meet it by a shuffle.
BROADCAST_BUCKETS = 200_000
_SPACE = r"(?U)\s+"


def _value(column: str, ignore_whitespace: bool) -> Column:
    text = F.col(column).cast("string")
    return F.regexp_replace(text, _SPACE, "") if ignore_whitespace else text


def value_hash(key: Column, value: Column) -> Column:
    """Hash of key and value; null and text are told apart by the marker."""
    return F.xxhash64(key, F.coalesce(F.concat(F.lit("="), value), F.lit("-")))


def _bucket(buckets: int, partitions: int) -> Column:
    """Bucket of ``k``, a bigint: the shuffle partition the key falls into, and a part of it."""
    parts = max(1, -(-buckets // partitions))
    return F.pmod(F.hash("k"), F.lit(partitions)).cast("bigint") * F.lit(parts).cast("bigint") + F.pmod(F.xxhash64(F.lit("bucket"), F.col("k")), F.lit(parts).cast("bigint"))


def _rows(df: DataFrame, key: str, version: str | None, columns: dict[str, Column]) -> DataFrame:
    """``k, v, h0, …`` of the rows with a key, and their columns."""
    named = df.where(F.col(key).isNotNull())
    return named.select(F.col(key).alias("k"), (F.col(version) if version else F.lit(0)).alias("v"), *(c.alias(n) for n, c in columns.items()))


def _latest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each ``k`` the row with the greatest ``v`` and ``columns``, in this order. Partial aggregation comes before the
    shuffle, so a hot key costs one row a task."""
    best = rows.groupBy("k").agg(F.max(F.struct("v", *columns)).alias("best"))
    return best.select("k", *(F.col(f"best.{n}").alias(n) for n in columns))


def checksum_matrix(hashes: DataFrame, columns: int, buckets: int, partitions: int) -> DataFrame:
    """``bucket, n, s_<column>_<part>``: additive checksums of ``k, h0, …``."""
    wide = {"s_k": F.xxhash64(F.lit("key"), F.col("k"))} | {f"s_{i}": F.col(f"h{i}") for i in range(columns)}
    halves = {f"{n}_{j}": h.bitwiseAND(F.lit(0xFFFFFFFF)) if j else F.shiftrightunsigned(h, 32) for n, h in wide.items() for j in range(2)}
    rows = hashes.select(_bucket(buckets, partitions).alias("bucket"), *(h.alias(n) for n, h in halves.items()))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in halves))


def unequal_buckets(left: DataFrame, right: DataFrame, columns: int) -> DataFrame:
    """``bucket, d_k, d_0, …``: buckets whose checksums differ, and in which columns."""
    def differs(prefix: str) -> Column:
        return reduce(lambda a, b: a | b, (~F.col(f"l.{prefix}_{j}").eqNullSafe(F.col(f"r.{prefix}_{j}")) for j in range(2)))

    flags = [(differs("s_k") | ~F.col("l.n").eqNullSafe(F.col("r.n"))).alias("d_k")] + [differs(f"s_{i}").alias(f"d_{i}") for i in range(columns)]
    joined = left.alias("l").join(right.alias("r"), F.col("l.bucket") == F.col("r.bucket"), "full")
    out = joined.select(F.coalesce("l.bucket", "r.bucket").alias("bucket"), *flags)
    return out.where(reduce(lambda a, b: a | b, (F.col(c) for c in out.columns[1:])))


def table_diff(
    baseline: DataFrame,
    current: DataFrame,
    key: str,
    columns: Sequence[str],
    version: str | None = None,
    ignore_whitespace: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """``<key>, difference`` with ``missing_in_current``, ``missing_in_baseline`` or the name of a differing column.

    ``buckets``: number of key buckets; without it, one for every ``ROWS_PER_BUCKET`` rows of the larger side (a count of
    footers). The list of unequal buckets is counted: up to ``BROADCAST_BUCKETS`` it filters the second read inside the scan's
    tasks, so that rows of equal buckets are not shuffled; a longer list is joined by a shuffle.
    """
    spark, n = baseline.sparkSession, len(columns)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if buckets is None:
        buckets = max(baseline.count(), current.count()) // ROWS_PER_BUCKET + 1
    hashes = [f"h{i}" for i in range(n)]
    hashed = {h: value_hash(F.col(key), _value(c, ignore_whitespace)) for h, c in zip(hashes, columns)}
    matrices = [checksum_matrix(_latest(_rows(side, key, version, hashed), hashes), n, buckets, partitions) for side in (baseline, current)]
    unequal = cut(unequal_buckets(*matrices, n))
    listed = unequal.select("bucket")
    if unequal.count() <= BROADCAST_BUCKETS:
        listed = F.broadcast(listed)
    seen = unequal.agg(*(F.max(f"d_{i}").alias(f"d_{i}") for i in range(n))).first() if n else {}
    read = [i for i in range(n) if seen[f"d_{i}"]]

    def side(df: DataFrame) -> DataFrame:
        # only the rows of unequal buckets, with the values of unequal columns alone; the hashes choose among equal versions
        texts = {f"c{i}": _value(columns[i], ignore_whitespace) for i in read}
        hit = _rows(df, key, version, hashed | texts).withColumn("bucket", _bucket(buckets, partitions)).join(listed, "bucket", "left_semi")
        return _latest(hit, [*hashes, *texts]).select("k", *texts, F.lit(True).alias("here"))

    joined = side(baseline).alias("l").join(side(current).alias("r"), F.col("l.k") == F.col("r.k"), "full")
    flags = [F.when(~F.col(f"l.c{i}").eqNullSafe(F.col(f"r.c{i}")), F.lit(columns[i])) for i in read]
    both = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    found = F.when(F.col("r.here").isNull(), F.array(F.lit("missing_in_current"))).when(F.col("l.here").isNull(), F.array(F.lit("missing_in_baseline"))).otherwise(both)
    return joined.select(F.coalesce("l.k", "r.k").alias(key), F.explode(found).alias("difference"))
