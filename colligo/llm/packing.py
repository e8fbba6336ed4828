"""Filling containers of fixed capacity with texts measured in tokens.

Method: sum-of-squares online packing. For each capacity an array counts the partially filled containers of each fill level.
A document goes to the level (or a new container) that makes the sum of the squares of these counts least; a container that
becomes full leaves the array. This keeps every level about equally common, so that a fitting gap is near for any size.

Documents are split among lanes by a hash of their id and size; a group of one lane and one capacity is packed by itself, and
the groups are dealt to as many tasks as there are groups, about. A lane's arrays are bounded by the capacity, and only (id,
size, times) rows travel. The number of lanes follows the number of documents: at most the levels' worth of containers stays
partly filled per lane, a share that falls with the size of a lane (``DOCS_PER_LANE``). Rows equal in id and size are counted
first and dealt to lanes in portions of ``PORTION``, so an id, or the null id, that is repeated without end fills no lane.

Cases
* a document larger than the capacity is cut into full containers and a rest that is packed like any other; no other one is
  split. ``piece`` counts the parts from 0, ``token_from`` is where a part begins in its document.
* a document without tokens (null, empty) takes no room: it stands at the end of the container its lane filled last.
* a null id is kept. Repeated ids are packed as often as they come.
* ties go to the fullest level, then to the container that was opened first: the result depends on the data alone.
* a capacity that is null or below 1 gives no containers; equal capacities of two classes are packed for each class.
* no documents: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.tokens import VOCABULARY, token_sizes
from colligo.runtime import cut, parallelism

DOCS_PER_LANE = 10_000
#: Rows equal in id and size that go to one lane together.
PORTION = 1_000
#: Tasks of the packing stage for each group, and at most for each partition of a shuffle: more groups share tasks.
TASKS_PER_GROUP, TASKS_PER_PARTITION = 2, 8
_COLUMNS = "container_class string, capacity_tokens int, container_id string, position int, doc_id bigint, piece int, token_from bigint, n_tokens bigint, offset_tokens int"


class SumOfSquares:
    """The level array of one capacity: ``counts[f]`` containers are filled up to ``f``; which ones, the queues tell."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, deque[int]] = {}
        self.fill: list[int] = []
        self.items: list[int] = []

    def place(self, size: int) -> tuple[int, int, int]:
        """Container, position in it and token offset of an item of ``1 .. capacity`` tokens."""
        counts, cap = self.counts, self.capacity
        best, cost = 0, (2 * int(counts[size]) + 1) if size < cap else 0
        last = cap - size  # fills 1 .. last leave room
        if last >= 1:
            change = -2 * counts[1 : last + 1] + 1
            change[: last - 1] += 2 * counts[1 + size : cap] + 1
            change[counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
            k = last - 1 - int(change[::-1].argmin())
            if change[k] <= cost and counts[k + 1]:
                best, cost = k + 1, int(change[k])
        if best:
            container = self.open[best].popleft()
            counts[best] -= 1
        else:
            container = len(self.fill)
            self.fill.append(0)
            self.items.append(0)
        offset = self.fill[container]
        level = offset + size
        self.fill[container] = level
        position = self.items[container]
        self.items[container] += 1
        if level < cap:
            counts[level] += 1
            self.open.setdefault(level, deque()).append(container)
        return container, position, offset


def pack(sizes: Iterable[int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(item, piece, token_from, n_tokens, container, position, offset)`` for items in the given order."""
    state, out, empty, last = SumOfSquares(capacity), [], [], 0
    for i, n in enumerate(sizes):
        at = piece = 0
        if n <= 0:
            empty.append(i)
        while at < n:
            part = min(capacity, n - at)
            container, position, offset = state.place(part)
            out.append((i, piece, at, part, container, position, offset))
            last, at, piece = container, at + part, piece + 1
    fill, items = (state.fill[last], state.items[last]) if state.fill else (0, 0)
    out += [(i, 0, 0, 0, last, items + k, fill) for k, i in enumerate(empty)]
    return out


def pack_documents(documents: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, docs_per_lane: int = DOCS_PER_LANE) -> DataFrame:
    """Container and position of each document for each class of ``classes`` (``container_class, capacity_tokens``).

    ``classes`` is a table of settings, a few rows by its nature; it is read by the driver."""
    wanted = [(r[0], int(r[1])) for r in classes.select("container_class", "capacity_tokens").distinct().collect() if r[1] is not None and r[1] >= 1]
    wanted.sort(key=lambda w: (w[1], str(w[0])))
    sized = token_sizes(documents, [key], text, vocabulary).select(F.col(key).cast("bigint").alias("doc_id"), "n_tokens")
    counted = cut(sized.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("times")))
    total = counted.agg(F.sum("times")).first()[0] or 0
    lanes = max(1, -(-total // docs_per_lane))
    lane = F.pmod(F.xxhash64(F.lit("lane"), "doc_id", "n_tokens", "portion"), F.lit(lanes)).cast("int")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "doc_id", "n_tokens", "portion"], kind="stable")
        frame = frame.loc[frame.index.repeat(frame["times"])]
        name, sizes, ids = int(frame["lane"].iloc[0]), frame["n_tokens"].tolist(), pd.array(frame["doc_id"], "Int64")
        kind, capacity = wanted[int(frame["class"].iloc[0])]
        item, piece, start, n, container, position, offset = (np.array(c, np.int64) for c in zip(*pack(sizes, capacity)))
        return pd.DataFrame({"container_class": kind, "capacity_tokens": capacity, "container_id": [f"{kind}-{name}-{c}" for c in container], "position": position.astype("int32"), "doc_id": ids.take(item), "piece": piece.astype("int32"), "token_from": start, "n_tokens": n, "offset_tokens": offset.astype("int32")})

    portions = counted.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / PORTION))))
    rows = portions.select(lane.alias("lane"), F.xxhash64(F.lit("order"), "doc_id", "n_tokens").alias("h"), "doc_id", "n_tokens", "portion", F.least(F.lit(PORTION), F.col("times") - F.col("portion") * PORTION).alias("times"))
    each = rows.withColumn("class", F.explode(F.array(*(F.lit(i) for i in range(len(wanted)))) if wanted else F.array().cast("array<int>")))
    tasks = max(1, min(TASKS_PER_GROUP * lanes * len(wanted), TASKS_PER_PARTITION * parallelism(documents.sparkSession)))
    return each.repartition(tasks, "lane", "class").groupBy("lane", "class").applyInPandas(run, _COLUMNS)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per class: documents, containers, tokens, and the share of room used."""
    per = packed.groupBy("container_class", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    return per.groupBy("container_class", "capacity_tokens").agg(
        F.sum("parts").alias("parts"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.col("capacity_tokens")), 6).alias("fill_share"), F.max("tokens").alias("fullest"))
