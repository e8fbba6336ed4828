import random

import numpy as np
import pytest

from colligo.llm import spans
from colligo.llm.spans import _gram_hashes, _sliding_min, shared_spans, super_kmers


def brute(rows, span):
    records = {}
    for i, t in rows:
        if i is not None and t is not None:
            records.setdefault(i, set()).add(t.replace("\r\n", "\n").replace("\r", "\n"))
    owners = {}
    for i, texts in records.items():
        for t in texts:
            for k in range(len(t) - span + 1):
                owners.setdefault(t[k : k + span], set()).add(i)
    out = {}
    for i, texts in records.items():
        best = 0
        for t in texts:
            covered = set()
            for k in range(len(t) - span + 1):
                if len(owners[t[k : k + span]]) > 1:
                    covered.update(range(k, k + span))
            best = max(best, len(covered))
        if best:
            out[i] = best
    return out


def rows_of(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (30, 45, 80)] + ["𝄞é" * 25]
    out = []
    for i in range(70):
        parts = ["".join(rng.choice("abcdé𝄞 ") for _ in range(rng.randint(0, 60))) if rng.random() < 0.5 else rng.choice(passage) for _ in range(rng.randint(1, 4))]
        text = "\r\n".join(parts) if rng.random() < 0.3 else "\n".join(parts)
        out.append((i, text))
    out += [(200 + i, passage[2]) for i in range(30)] + out[:5] + [(None, passage[2]), (300, None), (301, ""), (302, "x"), (303, "y" * 200), (304, "y" * 90)]
    return out


@pytest.mark.parametrize("hot", [4000, 20, 1])
def test_against_brute_force(spark, hot):
    rows = rows_of(3)
    df = spark.createDataFrame([(*r, "z") for r in rows], "block_id bigint, content string, shared_chars string").repartition(5)
    got = shared_spans(df, "block_id", "content", 25, hot)
    assert got.columns == ["block_id", "shared_chars"]
    assert {r[0]: r[1] for r in got.collect()} == brute(rows, 25)


@pytest.mark.parametrize("listed", [100, 0])
def test_super_kmers_of_many_texts(spark, monkeypatch, listed):
    """Sent to every task, and salted."""
    monkeypatch.setattr(spans, "BROADCAST_HOT", listed)
    rows = rows_of(4)
    got = shared_spans(spark.createDataFrame(rows, "block_id bigint, content string"), "block_id", "content", 25, hot=3, hot_texts=3)
    assert {r[0]: r[1] for r in got.collect()} == brute(rows, 25)


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "block_id bigint, content string"), "block_id", "content").count() == 0


def test_super_kmers_cover_every_window_once():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(20, 300))) for _ in range(40)]
    seen = {}
    for i, start, length, minimiser in super_kmers(texts, 20, 8):
        for k in range(start, start + length - 19):
            assert (i, k) not in seen
            seen[i, k] = minimiser
    assert len(seen) == sum(len(t) - 19 for t in texts)
    by_window = {}
    for (i, k), m in seen.items():
        assert by_window.setdefault(texts[i][k : k + 20], m) == m


def test_hashes_and_minimum():
    codes = np.arange(50, dtype=np.uint32) % 7
    h = _gram_hashes(codes, 5)
    assert len(h) == 46 and all(h[i] == h[i + 7] for i in range(39)) and h[0] != h[1]
    v = np.array([5, 3, 9, 1, 7, 8, 2], np.uint64)
    assert _sliding_min(v, 3).tolist() == [3, 1, 1, 1, 2]
