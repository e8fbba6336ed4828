"""Mixing sources to target shares of the tokens, along a curriculum.

Method: time-varying curriculum. Each source has a weight schedule over training time 0 … 1, piecewise linear. Its integral,
times the size of the mix, is the source's cumulative demand for tokens. The texts of a source stand in the order of a hash;
a text whose copies begin at token ``u`` of the source's stream is due when the demand reaches ``u``: the integral is
inverted in closed form, and a range sort by that time gives the training order.

The size of a mix is the largest at which every source meets its share within its repeats; sources of the mix without any
tokens are set aside and the other shares scaled up. With a given ``total_tokens`` beyond that, a source stops at its cap
and what it leaves is shared out among the rest in proportion. A source's demand of ``k`` streams and a rest uses each text
``k`` times, and once more those that lie in the rest; the text that crosses its end counts if half of it lies before.

The prefix sums over a source are taken in two steps, over hash buckets and within a bucket, so no source, however large,
meets in one task.

Cases
* equal texts of one source are one text: the least ``doc_id`` stands for them and carries the uses, the others have 0.
* null or empty texts have no tokens and are used 0 times; a null source, or one outside the mix, is in no mix.
* a target that is null or not positive counts as absent, a null number of repeats as 1; of repeated rows of a source in
  one mix the greatest share counts.
* no documents: the shares are reported as 0. ``mix_targets`` is a table of settings and read by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colligo.llm.tokens import VOCABULARY, token_sizes
from colligo.runtime import cut

#: Texts of a hash bucket, about; a window function holds one bucket of one source.
TEXTS_PER_BUCKET = 50_000
#: How far the default curriculum tilts: the weight of the source with the shortest texts falls from 1 + TILT to 1 - TILT.
TILT = 0.5
Knots = Sequence[tuple[float, float]]


@dataclass
class SourcePlan:
    mix: str
    source: str
    target: float | None
    repeats: int
    tokens: int = 0
    texts: int = 0
    demand: float = 0.0
    knots: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 1.0), (1.0, 1.0)])

    @property
    def full(self) -> int:
        return int(self.demand // self.tokens) if self.tokens else 0

    @property
    def rest(self) -> float:
        return self.demand - self.full * self.tokens if self.tokens else 0.0


def demands(shares: Mapping[str, float], caps: Mapping[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens of each source: ``total`` times its share, or its cap, what a cap leaves going to the others in proportion."""
    live = {s: w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    out = dict.fromkeys(shares, 0.0)
    if not live:
        return out
    scale = sum(live.values())
    if total is None:
        total = min(caps[s] / (w / scale) for s, w in live.items())
    left = float(total)
    while live and left > 1e-9:
        scale = sum(live.values())
        full = [s for s, w in live.items() if left * w / scale >= caps[s]]
        if not full:
            for s, w in live.items():
                out[s] = left * w / scale
            break
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
            del live[s]
    return out


def segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """``(q0, q1, t0, w0, slope)`` of the pieces of a schedule whose integral over 0 … 1 is scaled to 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if area <= 0 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from 0 to 1 with weights that are not negative and not all 0")
    knots = [(float(t), float(w)) for t, w in knots]
    out, q = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0:
            raise ValueError("the times of a schedule rise")
        q1 = q + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((q, q1, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        q = q1
    return out


def due(q: Column, pieces: Column) -> Column:
    """Time at which the share ``q`` of a source's demand is reached."""
    piece = F.coalesce(F.get(F.filter(pieces, lambda s: (q >= s["q0"]) & (q < s["q1"])), F.lit(0)), F.element_at(pieces, -1))
    need = F.greatest(q - piece["q0"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * need, F.lit(0.0)))
    x = F.when(need <= 0, 0.0).otherwise(2 * need / (piece["w0"] + root))
    return F.least(piece["t0"] + x, F.lit(1.0))


def _tilted(plans: list[SourcePlan], tilt: float) -> None:
    """Default curriculum: sources with short texts early, with long ones late; the weights add up to 1 at every time."""
    live = [p for p in plans if p.demand > 0]
    size = sum(p.demand for p in live)
    live.sort(key=lambda p: (p.tokens / max(p.texts, 1), p.source))
    if len(live) < 2 or not size:
        return
    slope = [2 * i / (len(live) - 1) - 1 for i in range(len(live))]
    mean = sum(a * p.demand for a, p in zip(slope, live)) / size
    widest = max(abs(a - mean) for a in slope)
    for a, p in zip(slope, live):
        s = tilt * (a - mean) / widest
        p.knots = [(0.0, 1 - s), (1.0, 1 + s)]


class Mixture:
    """The plan of all mixes over a set of documents; its methods are the reports."""

    def __init__(self, documents: DataFrame, targets: DataFrame, schedules: Mapping[str, Knots] | None = None, total_tokens: int | None = None, vocabulary: str = VOCABULARY, tilt: float = TILT, seed: str = "mix"):
        self.spark = documents.sparkSession
        rows = targets.select("mix_name", "source", "target_share", "max_repeats").collect()
        best: dict[tuple[str, str], SourcePlan] = {}
        for mix, source, share, repeats in rows:
            if mix is None or source is None:
                continue
            plan = SourcePlan(mix, source, share, max(0, 1 if repeats is None else int(repeats)))
            old = best.get((mix, source))
            if old is None or (share or 0, plan.repeats) > (old.target or 0, old.repeats):
                best[mix, source] = plan
        self.plans = sorted(best.values(), key=lambda p: (p.mix, p.source))
        names = sorted({p.source for p in self.plans})
        self.documents = documents.where(F.col("source").isin(names)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_id"), "text")
        sized = token_sizes(self.documents.where(F.length("text") > 0), ["doc_id", "source", "text_id"], "text", vocabulary)
        # one row per text of a source; partial aggregation takes care of a text with many copies
        self.texts = cut(sized.groupBy("source", "text_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "text_id")))
        self.have = {r[0]: (int(r[1]), int(r[2])) for r in self.texts.groupBy("source").agg(F.sum("n"), F.count(F.lit(1))).collect()}
        for p in self.plans:
            p.tokens, p.texts = self.have.get(p.source, (0, 0))
        for mix in sorted({p.mix for p in self.plans}):
            own = [p for p in self.plans if p.mix == mix]
            wanted = demands({p.source: p.target or 0.0 for p in own}, {p.source: p.tokens * p.repeats for p in own}, total_tokens)
            for p in own:
                p.demand = wanted[p.source]
            if schedules is None:
                _tilted(own, tilt)
            else:
                for p in own:
                    p.knots = list(schedules.get(p.source, p.knots))

    def _settings(self) -> DataFrame:
        size = {m: sum(p.demand for p in self.plans if p.mix == m) for m in {p.mix for p in self.plans}}
        rows = [(p.mix, p.source, p.tokens, p.full, float(p.rest), float(p.demand), float(size[p.mix]), segments(p.knots)) for p in self.plans if p.demand > 0]
        return self.spark.createDataFrame(rows, "mix_name string, source string, tokens bigint, full int, rest double, demand double, mix_tokens double, pieces array<struct<q0:double,q1:double,t0:double,w0:double,slope:double>>")

    def streams(self) -> DataFrame:
        """``source, doc_id, n, before``: the texts with the tokens before them in the stream of their source."""
        bits = max(0, math.ceil(math.log2(max(1, sum(t for _, t in self.have.values()) / TEXTS_PER_BUCKET))))
        bucket = F.shiftright(F.col("h"), 64 - bits) if bits else F.lit(0).cast("bigint")
        placed = self.texts.where("n > 0").withColumn("bucket", bucket)
        sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("m"))
        above = sums.select("source", "bucket", (F.sum("m").over(W.partitionBy("source").orderBy("bucket")) - F.col("m")).alias("above"))
        within = F.sum("n").over(W.partitionBy("source", "bucket").orderBy("h", "text_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
        return placed.withColumn("within", within).join(above, ["source", "bucket"]).select("source", "doc_id", "n", (F.col("above") + F.col("within")).alias("before"))

    def used(self) -> DataFrame:
        """``mix_name, source, doc_id, n_tokens, times_used`` and what ``order`` needs, for the texts that stand for themselves."""
        extra = ((F.col("before") + F.col("n") / 2) <= F.col("rest")).cast("int")
        return self.streams().join(self._settings(), "source").withColumn("times_used", F.col("full") + extra)

    def usage(self) -> DataFrame:
        """``mix_name, doc_id, source, times_used`` of every document whose source is in the mix."""
        pairs = self.spark.createDataFrame([(p.mix, p.source) for p in self.plans], "mix_name string, source string")
        every = self.documents.select("doc_id", "source").join(pairs, "source")
        uses = self.used().select("mix_name", "source", "doc_id", "times_used")
        joined = every.alias("d").join(uses.alias("u"), (F.col("d.doc_id") == F.col("u.doc_id")) & (F.col("d.mix_name") == F.col("u.mix_name")) & (F.col("d.source") == F.col("u.source")), "left")
        return joined.select("d.mix_name", "d.doc_id", "d.source", F.coalesce("u.times_used", F.lit(0)).alias("times_used"))

    def shares(self) -> DataFrame:
        """Per mix and source: target and reached share, tokens drawn, the most uses of a text."""
        rows = [(p.mix, p.source, p.target, p.repeats, p.tokens, p.texts) for p in self.plans]
        plan = self.spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int, source_tokens bigint, source_texts bigint")
        drawn = self.used().groupBy("mix_name", "source").agg(F.sum(F.col("n") * F.col("times_used")).alias("tokens"), F.max("times_used").alias("most_uses"))
        joined = plan.join(drawn, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_uses"])
        total = F.sum("tokens").over(W.partitionBy("mix_name"))
        return joined.withColumn("actual_share", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(F.lit(0.0)))

    def order(self) -> DataFrame:
        """Every use of a document in training order: ``mix_name, position, time, source, doc_id, copy, n_tokens``. ``time`` is
        when it is due; ``position`` counts the uses of a mix from 0, without gaps or repeats.

        The uses are range-sorted and written once. A position is that of the row in its written part, plus the rows of the
        mix in the parts before: a sum over as many rows as there are parts and mixes."""
        copies = self.used().where("times_used > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times_used") - 1)))
        q = (F.col("copy") * F.col("tokens") + F.col("before")) / F.col("demand")
        timed = copies.withColumn("time", due(q, F.col("pieces"))).select("mix_name", "time", "source", "doc_id", "copy", F.col("n").alias("n_tokens"))
        written = cut(timed.orderBy("mix_name", "time", "source", "doc_id", "copy")).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
        parts = written.groupBy("mix_name", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
        starts = parts.select("mix_name", "part", "first", (F.sum("rows").over(W.partitionBy("mix_name").orderBy("part")) - F.col("rows")).alias("start"))
        return written.join(starts, ["mix_name", "part"]).select("mix_name", (F.col("start") + F.col("row") - F.col("first")).alias("position"), F.round("time", 9).alias("time"), "source", "doc_id", "copy", "n_tokens")
