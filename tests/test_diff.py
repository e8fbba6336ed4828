import random

import pytest

from pyspark.sql import functions as F

from colligo.operators.diff import _bucket, table_diff, value_hash

SCHEMA = "entry_id bigint, kind string, type_name string, signature string, exported_at timestamp, bucket string, c0 string"


def ranks(spark, sides):
    """Hashes of (key, value), which choose among rows of one version, as the engine computes them."""
    rows = {(k, None if v is None else "".join(v.split())) for side in sides for r in side for k in [r[0]] for v in (r[3], r[2], r[1]) if k is not None}
    if not rows:
        return {}
    frame = spark.createDataFrame(list(rows), "k bigint, v string")
    return {(r[0], r[1]): r[2] for r in frame.select("k", "v", value_hash(F.col("k"), F.col("v"))).collect()}


def brute(spark, left, right):
    rank = ranks(spark, (left, right))

    def latest(rows):
        out = {}
        for r in rows:
            if r[0] is None:
                continue
            key = (r[4] is not None, r[4] or 0, *(rank[r[0], clean(v)] for v in (r[3], r[2], r[1])))
            if r[0] not in out or key > out[r[0]][0]:
                out[r[0]] = (key, r)
        return {k: v[1] for k, v in out.items()}

    def clean(v):
        return None if v is None else "".join(v.split())

    a, b = latest(left), latest(right)
    out = [(k, "missing_in_current") for k in a if k not in b] + [(k, "missing_in_baseline") for k in b if k not in a]
    out += [(k, n) for k in a if k in b for n, i in (("signature", 3), ("type_name", 2), ("kind", 1)) if clean(a[k][i]) != clean(b[k][i])]
    return sorted(out)


def run(spark, left, right, **more):
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    return sorted(tuple(r) for r in table_diff(*frames, "entry_id", ["signature", "type_name", "kind"], "exported_at", **more).collect())


def test_random_copies_against_brute_force(spark):
    from datetime import datetime, timedelta

    rng, start = random.Random(7), datetime(2024, 1, 1)
    values = [None, "", "a", " a", "a b", "ab\t", "A", "x y", "xy"]
    for _ in range(3):
        sides = [[(rng.choice([None, *range(60)]), rng.choice(values), rng.choice(values), rng.choice(values), rng.choice([None, start + timedelta(days=rng.randint(0, 3))]), "z", "z") for _ in range(120)] for _ in range(2)]
        assert run(spark, *sides, buckets=8) == brute(spark, *sides)
        assert run(spark, *sides) == brute(spark, *sides)


@pytest.mark.parametrize("sides", [([], []), ([(1, None, None, None, None, None, None)], []), ([], [(1, "k", "t", "s", None, None, None)]), ([(1, "k", "t", "s", None, None, None)] * 3, [(1, "k ", "t", "s", None, "other", None)])])
def test_edges(spark, sides):
    assert run(spark, *sides) == brute(spark, *sides)


def test_null_is_not_empty_and_swapped_values_are_found(spark):
    left = [(1, None, "t", "a", None, None, None), (2, "", "t", "b", None, None, None)]
    right = [(1, "", "t", "b", None, None, None), (2, "", "t", "a", None, None, None)]
    assert run(spark, left, right, buckets=1) == run(spark, left, right, buckets=6 * 10**9) == [(1, "kind"), (1, "signature"), (2, "signature")]


def test_buckets_beyond_32_bits_stay_in_their_partition(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k").repartition(7, "k")
    found = keys.select(F.spark_partition_id().alias("at"), F.pmod(F.hash("k"), F.lit(7)).alias("p"), _bucket(6 * 10**9, 7).alias("b")).agg(F.max("b"), F.max(F.abs(F.col("at") - F.col("p"))), F.min("b")).first()
    assert found[0] > 2**32 and found[1] == 0 and found[2] >= 0
