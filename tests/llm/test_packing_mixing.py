import random

import pytest
from pyspark.sql import functions as F

from colligo.llm.mixing import Mixture, demands, segments
from colligo.llm.packing import SumOfSquares, fill_report, pack, pack_documents
from colligo.llm.tokens import count


def naive_place(counts, size, capacity):
    """The fill level of least sum of squares, by trying all."""
    best = None
    for level in range(0, capacity - size + 1):
        if level and not counts.get(level):
            continue
        after = dict(counts)
        if level:
            after[level] -= 1
        if level + size < capacity:
            after[level + size] = after.get(level + size, 0) + 1
        cost = sum(v * v for v in after.values())
        if best is None or cost <= best[0]:
            best = (cost, level)
    return best[1]


def test_levels_follow_the_sum_of_squares():
    rng, state, counts = random.Random(2), SumOfSquares(20), {}
    for _ in range(400):
        size = rng.randint(1, 20)
        level = naive_place(counts, size, 20)
        container, _, offset = state.place(size)
        assert offset == level
        if level:
            counts[level] -= 1
        if level + size < 20:
            counts[level + size] = counts.get(level + size, 0) + 1


@pytest.mark.parametrize("sizes", [[], [0, 0], [5], [25, 0, 7], [10] * 30, random.Random(4).choices(range(61), k=500)])
def test_packing_is_exact(sizes):
    parts = pack(sizes, 20)
    fill, seen = {}, {}
    for item, piece, start, n, container, position, offset in sorted(parts, key=lambda p: (p[4], p[5])):
        assert offset == fill.get(container, 0) and offset + n <= 20
        fill[container] = offset + n
        seen.setdefault(item, []).append((piece, start, n))
    assert sorted(seen) == list(range(len(sizes)))
    for item, pieces in seen.items():
        assert sum(n for _, _, n in pieces) == sizes[item] and [p[1] for p in sorted(pieces)] == [i * 20 for i in range(len(pieces))]
        assert len(pieces) == (1 if sizes[item] <= 20 else -(-sizes[item] // 20))
    if len(sizes) > 100:
        assert sum(sizes) / (len({p[4] for p in parts}) * 20) > 0.95


DOCS = "doc_id bigint, text string, source string, n_tokens string"


def test_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("alpha beta gamma".split()) for _ in range(rng.randint(0, 80))), "s", "z") for i in range(200)] + [(None, "null id", "s", None), (500, None, None, None), (501, "", None, None), (502, "word " * 3000, None, None), (0, "again", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    classes = spark.createDataFrame([("a", 64), ("b", 500), ("c", None), ("d", 0)], "container_class string, capacity_tokens int")
    packed = pack_documents(df, classes, docs_per_lane=60).collect()
    assert {p["container_class"] for p in packed} == {"a", "b"}
    for kind, capacity in (("a", 64), ("b", 500)):
        own = [p for p in packed if p["container_class"] == kind]
        fill = {}
        for p in sorted(own, key=lambda p: (p["container_id"], p["position"])):
            assert p["offset_tokens"] == fill.get(p["container_id"], 0)
            fill[p["container_id"]] = p["offset_tokens"] + p["n_tokens"]
            assert fill[p["container_id"]] <= capacity
        assert sum(p["n_tokens"] for p in own) == sum(count(r[1]) for r in rows)
        assert sum(p["piece"] == 0 for p in own) == len(rows)
        assert all(p["n_tokens"] == 0 for p in own if p["doc_id"] in (500, 501))
    assert fill_report(pack_documents(df, classes)).count() == 2
    assert pack_documents(df.limit(0), classes).count() == 0


def test_repeated_and_null_ids_fill_no_lane(spark):
    rows = [(7, "same words", None, None)] * 2500 + [(None, "same words", None, None)] * 2500
    packed = pack_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 10)], "container_class string, capacity_tokens int"), docs_per_lane=1000)
    lanes = packed.groupBy(F.element_at(F.split("container_id", "-"), -2)).count().collect()
    assert sum(r[1] for r in lanes) == 5000 and len(lanes) > 2 and max(r[1] for r in lanes) <= 3000
    assert packed.rdd.getNumPartitions() >= 5


def test_demands():
    assert demands({"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 10, "b": 100, "c": 0}) == {"a": 10.0, "b": 10.0, "c": 0.0}
    assert demands({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 60) == {"a": 10.0, "b": 50.0}
    assert demands({"a": 0.5}, {}) == {"a": 0.0}
    with pytest.raises(ValueError):
        segments([(0, 1), (0.5, 2)])


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, f"text {i} " + "word " * rng.randint(5, 120), rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny"]), "x") for i in range(600)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "x") for i in range(20)] + [(2000, None, "big", None), (2001, "", "big", None), (2002, "out", "other", None), (2003, "null", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "mid", 0.3, 4), ("m", "tiny", 0.2, 5), ("m", "gone", 0.1, 9), ("n", "mid", 1.0, 2), ("n", "tiny", None, 2)], "mix_name string, source string, target_share double, max_repeats int")
    m = Mixture(df, targets)
    used = {(r["mix_name"], r["doc_id"]): r["times_used"] for r in m.usage().collect()}
    caps = {("m", "big"): 1, ("m", "mid"): 4, ("m", "tiny"): 5, ("n", "mid"): 2}
    by_text = {}
    for (mix, doc), n in used.items():
        text, source = next((t, s) for i, t, s, _ in rows if i == doc)
        by_text[mix, source, text] = by_text.get((mix, source, text), 0) + n
        assert n == 0 or text
    assert all(n <= caps.get((mix, source), 2) for (mix, source, _), n in by_text.items())
    tokens = {}
    for (mix, source, text), n in by_text.items():
        tokens[mix, source] = tokens.get((mix, source), 0) + n * count(text)
    total = sum(v for (mix, _), v in tokens.items() if mix == "m")
    for source, share in (("big", 0.4), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(tokens["m", source] / total - share / 0.9) < 0.01
    shares = {(r["mix_name"], r["source"]): r for r in m.shares().collect()}
    assert shares["m", "gone"]["actual_share"] == 0 and shares["m", "big"]["tokens"] == tokens["m", "big"] and (2002 not in {d for _, d in used})
    order = sorted(m.order().collect(), key=lambda r: (r["mix_name"], r["position"]))
    assert [r["position"] for r in order if r["mix_name"] == "m"] == list(range(sum(n for (mix, _), n in used.items() if mix == "m")))
    assert all(a["time"] <= b["time"] for a, b in zip(order, order[1:]) if a["mix_name"] == b["mix_name"])
    counted = {}
    for r in order:
        counted[r["mix_name"], r["doc_id"]] = counted.get((r["mix_name"], r["doc_id"]), 0) + 1
    assert counted == {k: v for k, v in used.items() if v}
    # the curriculum: weights of all sources add up to 1 at any time, so positions advance with the tokens
    spent = 0
    for r in (r for r in order if r["mix_name"] == "m"):
        assert abs(spent - r["time"] * total) < 0.03 * total + 400
        spent += r["n_tokens"]


def test_mixture_follows_given_schedules(spark):
    rows = [(i, f"t{i} " + "w " * 20, "a" if i % 2 else "b", None) for i in range(400)]
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    order = Mixture(spark.createDataFrame(rows, DOCS), targets, schedules={"a": [(0, 1.0), (0.5, 0.0), (1, 0.0)], "b": [(0, 0.0), (0.5, 0.0), (1, 1.0)]}).order().collect()
    assert max(r["time"] for r in order if r["source"] == "a") <= 0.5 <= min(r["time"] for r in order if r["source"] == "b")


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("m", "a", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    m = Mixture(spark.createDataFrame([], DOCS), targets)
    assert m.usage().count() == 0 and m.order().count() == 0 and m.shares().first()["actual_share"] == 0
