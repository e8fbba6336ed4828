"""Long exact spans shared between records.

Method: super-k-mer partitioning. Every window of ``span`` code points of a text has a minimiser, the least hash of its
``MINIMISER``-grams. Consecutive windows with one minimiser travel as a single packed string, a super-k-mer, to the bucket
of that minimiser; equal windows have equal minimisers and so meet in one bucket, where sorting counts them exactly.

1. equal texts become one row (partial aggregation), with the least and the greatest record id that holds them;
2. texts are cut into super-k-mers, once; they are written, since they are counted, bucketed and asked for their places;
3. the strings of a bucket are sorted by minimiser and streamed; equal ones are merged, and windows of a minimiser with
   several strings are sorted and counted. A minimiser with more than ``HOT`` strings never enters one task: its equal strings
   are merged by partial aggregation first, and where more than ``HOT`` different ones remain, their windows become rows and
   are counted by partial aggregation over all tasks;
4. shared windows go back, as ranges, to the texts by the hash of their super-k-mer, and ranges are merged per text. A
   super-k-mer of more than ``HOT_TEXTS`` texts meets them without a shuffle, its ranges sent to every task, or, where such
   ranges are many, salted over ``SALTS`` tasks.

A window is shared if it occurs in two different records, that is if least and greatest id differ: no pairs are made.

Cases
* null id or null text: no record. Texts shorter than ``span`` share nothing; empty ones neither.
* repeated rows of an id are one record; if their texts differ, each version counts and the greatest result is reported.
* line ends are made LF (``normalise``); nothing else changes. A character is a code point, also beyond the BMP.
* other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.runtime import cut, parallelism

MINIMISER = 16
#: Distinct super-k-mers of one minimiser that one task may hold; at most HOT * (2 * span) characters.
HOT = 4000
#: Hot minimisers up to which their list (24 bytes each) is sent to every task.
BROADCAST_HOT = 100_000
#: Texts of one super-k-mer above which its texts are not brought together; tasks that share them where it is salted.
HOT_TEXTS, SALTS = 20_000, 64
#: Characters that one numpy pass handles; a longer text is handled alone.
_CHUNK = 1_000_000
_PRIME = 0x9E3779B97F4A7C15


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _gram_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """Hash of each ``m``-gram of ``codes`` by doubling (wrapping 64-bit arithmetic), scrambled so that order is random."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) + np.uint64(1)
        parts: list[tuple[np.ndarray, int]] = []
        bit, left = 1, m
        while left:
            if left & 1:
                parts.append((h, bit))
            left >>= 1
            if left:
                h = h[: len(h) - bit] * np.uint64(pow(0x100000001B3, bit, 1 << 64)) + h[bit:]
                bit *= 2
        out = np.zeros(len(codes) - m + 1, np.uint64)
        at = 0
        for part, width in parts:
            out = out * np.uint64(pow(0x100000001B3, width, 1 << 64)) + part[at : at + len(out)]
            at += width
        out ^= out >> np.uint64(31)
        out *= np.uint64(_PRIME)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(texts: list[str], span: int, m: int = MINIMISER) -> Iterator[tuple[int, int, int, int]]:
    """``(text, start, length, minimiser)`` of each super-k-mer of ``texts``, all of ``span`` characters or more."""
    group: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if text is None or size + len(text) > _CHUNK and group:
            joined = "".join(texts[j] for j in group)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            least = _sliding_min(_gram_hashes(codes, m), span - m + 1)
            lengths = np.array([len(texts[j]) for j in group])
            ends = np.cumsum(lengths)
            begins = ends - lengths
            change = np.flatnonzero(least[1:] != least[:-1]) + 1
            # windows may not cross from one text into the next: cut at the first and behind the last window of each
            cuts = np.unique(np.concatenate((change, begins, ends - span + 1)))
            cuts = cuts[cuts <= len(least)]
            owner = np.searchsorted(ends, cuts, side="right")
            stops = np.append(cuts[1:], len(least))
            for a, b, o in zip(cuts.tolist(), stops.tolist(), owner.tolist()):
                if o < len(group) and a <= ends[o] - span:
                    yield group[o], a - int(begins[o]), b - a + span - 1, int(least[a].astype(np.int64))
            group, size = [], 0
        if text is not None:
            group.append(i)
            size += len(text)


_PIECES = pa.schema([("text_id", pa.binary()), ("start", pa.int32()), ("minimiser", pa.int64()), ("piece_id", pa.binary()), ("piece", pa.string()), ("low", pa.int64()), ("high", pa.int64())])


def _cutter(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            low, high = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[list] = [[] for _ in _PIECES]
            size = 0
            for i, start, length, minimiser in super_kmers(texts, span):
                piece = texts[i][start : start + length]
                for column, value in zip(out, (ids[i], start, minimiser, xxhash.xxh3_128_digest(piece.encode("utf-8", "surrogatepass")), piece, low[i], high[i])):
                    column.append(value)
                size += length
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)
                    out, size = [[] for _ in _PIECES], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return run


def _shared_ranges(pieces: list[str], low: list[int], high: list[int], span: int) -> list[list[tuple[int, int]]]:
    """For each distinct piece of one minimiser, the ranges ``[first, last]`` of its windows that two records hold."""
    windows = sorted((piece[k : k + span], i, k) for i, piece in enumerate(pieces) for k in range(len(piece) - span + 1))
    hits: list[list[int]] = [[] for _ in pieces]
    a = 0
    while a < len(windows):
        b = a + 1
        while b < len(windows) and windows[b][0] == windows[a][0]:
            b += 1
        run = windows[a:b]
        if min(low[i] for _, i, _ in run) != max(high[i] for _, i, _ in run):
            for _, i, k in run:
                hits[i].append(k)
        a = b
    return [_runs(sorted(h)) for h in hits]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k in starts:
        if out and out[-1][1] >= k - 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def _counter(span: int):
    """Counts the windows of a partition that is sorted by minimiser and string; holds the strings of one minimiser at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, str, int, int]] = []
        out: list[tuple[bytes, list[tuple[int, int]]]] = []

        def close() -> None:
            if len(held) == 1:
                _, digest, piece, low, high = held[0]
                if low != high:
                    out.append((digest, [(0, len(piece) - span)]))
            elif held and min(h[3] for h in held) != max(h[4] for h in held):
                for h, ranges in zip(held, _shared_ranges([h[2] for h in held], [h[3] for h in held], [h[4] for h in held], span)):
                    if ranges:
                        out.append((h[1], ranges))
            held.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for row in zip(*columns):
                if held and held[0][0] != row[0]:
                    close()
                if held and held[-1][1] == row[1]:
                    _, digest, piece, low, high = held[-1]
                    held[-1] = (row[0], digest, piece, min(low, row[3]), max(high, row[4]))
                else:
                    held.append(row)
            yield _ranges(out)
            out.clear()
        close()
        yield _ranges(out)

    return run


def _ranges(out: list[tuple[bytes, list[tuple[int, int]]]]) -> pa.RecordBatch:
    flat = [(d, a, b) for d, ranges in out for a, b in ranges]
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.binary()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int32())], names=["piece_id", "first", "last"])


_RANGES = "piece_id binary, first int, last int"


_COLUMNS = ["minimiser", "piece_id", "piece", "low", "high"]


def _listed(rows: DataFrame) -> tuple[DataFrame, int]:
    """A list of hot keys, written and counted: at most one for so many rows; sent to every task only up to a bound."""
    rows = cut(rows)
    number = rows.count()
    return F.broadcast(rows) if number <= BROADCAST_HOT else rows, number


def shared_ranges(pieces: DataFrame, span: int, hot: int = HOT, hot_texts: int = HOT_TEXTS) -> tuple[DataFrame, DataFrame | None, int]:
    """``piece_id, first, last``: runs of window starts within a super-k-mer that several records hold; and the list and number of
    super-k-mers (``piece_id``) in more than ``hot_texts`` texts."""
    buckets = parallelism(pieces.sparkSession)
    listed, number = _listed(pieces.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("minimiser"))
    calm, windows, widely, wide = pieces.select(_COLUMNS), None, None, 0
    if number:
        merged = cut(pieces.join(listed, "minimiser", "left_semi").groupBy("minimiser", "piece_id", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("uses")))
        still, _ = _listed(merged.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("high").alias("most")).where(F.col("n") > hot).select("minimiser", "least", "most"))
        calm = pieces.join(listed, "minimiser", "left_anti").select(_COLUMNS).unionAll(merged.join(still, "minimiser", "left_anti").select(_COLUMNS))
        windows = merged.join(still.where("least <> most").select("minimiser"), "minimiser", "left_semi")  # else of one record alone
        widely, wide = _listed(merged.where(F.col("uses") > hot_texts).select("piece_id"))
    counted = calm.repartition(buckets, "minimiser").sortWithinPartitions("minimiser", "piece_id").mapInArrow(_counter(span), _RANGES)
    if windows is None:
        return counted, widely, wide
    # one window each, so that no task holds a hot minimiser
    at = F.explode(F.sequence(F.lit(0), F.length("piece") - span)).alias("k")
    rows = windows.select("piece_id", "piece", "low", "high", at).select("piece_id", "k", F.xxhash64(F.substring("piece", F.col("k") + 1, span)).alias("h1"), F.md5(F.substring("piece", F.col("k") + 1, span).cast("binary")).alias("h2"), "low", "high")
    several = rows.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("h1", "h2")
    found = rows.join(several, ["h1", "h2"], "left_semi").select("piece_id", F.col("k").alias("first"), F.col("k").alias("last"))
    return counted.unionAll(found), widely, wide


def _meet(single: DataFrame, ranges: DataFrame, listed: DataFrame | None, number: int, salts: int = SALTS) -> DataFrame:
    """``text_id, start, first, last``: the super-k-mers of the texts with their shared ranges. ``listed`` are the ``number``
    super-k-mers (``piece_id``) of very many texts; a super-k-mer has at most as many ranges as windows."""
    columns = ["text_id", "start", "first", "last"]
    if not number:
        return single.join(ranges, "piece_id").select(columns)
    if number > BROADCAST_HOT:
        salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return single.withColumn("salt", F.pmod(F.xxhash64("text_id", "start"), F.lit(salts)).cast("int")).join(salted, ["piece_id", "salt"]).select(columns)
    ranges = cut(ranges)
    cold = single.join(listed, "piece_id", "left_anti").join(ranges.join(listed, "piece_id", "left_anti"), "piece_id")
    return single.join(F.broadcast(ranges.join(listed, "piece_id", "left_semi")), "piece_id").select(columns).unionAll(cold.select(columns))


def shared_spans(records: DataFrame, key: str, text: str, span: int = 160, hot: int = HOT, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``<key>, shared_chars bigint``: records of which characters lie in a span of ``span`` or more that another record holds."""
    clean = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), normalise(F.col(text)).alias("text")).where(F.length("text") >= span)
    text_id = F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_id")
    # equal texts are one: partial aggregation leaves one row of a hot text per task
    texts = cut(clean.groupBy("text").agg(F.min("id").alias("low"), F.max("id").alias("high")).select(text_id, "text", "low", "high"))
    pieces = cut(texts.mapInArrow(_cutter(span), "text_id binary, start int, minimiser bigint, piece_id binary, piece string, low bigint, high bigint"))
    ranges, widely, wide = shared_ranges(pieces, span, hot, hot_texts)
    # whole copies are shared from end to end; for the others the ranges come back by the hash of the super-k-mer
    found = _meet(pieces.where("low = high").select("text_id", "start", "piece_id"), ranges, widely, wide)
    spans = found.select("text_id", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + span).alias("b")).alias("r"))
    # a text's ranges are fewer than its characters, and a text is one row as it is
    merged = spans.groupBy("text_id").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("text_id", _covered(F.col("rs")).alias("shared_chars"))
    copies = texts.where("low <> high").select("text_id", F.length("text").cast("bigint").alias("shared_chars"))
    owners = clean.select("id", text_id).distinct()
    # a hot text has many owners: its side is split by adaptive skew handling, the other holds one row per text
    return owners.join(merged.unionAll(copies), "text_id").groupBy("id").agg(F.max("shared_chars").alias("shared_chars")).select(F.col("id").alias(key), "shared_chars")


def _covered(ranges: Column) -> Column:
    """Characters under sorted half-open ranges ``(a, b)``, each counted once."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def step(acc: Column, r: Column) -> Column:
        begin = F.greatest(acc["end"], r["a"].cast("bigint"))
        return F.struct((acc["n"] + F.greatest(r["b"].cast("bigint") - begin, F.lit(0).cast("bigint"))).alias("n"), F.greatest(acc["end"], r["b"].cast("bigint")).alias("end"))

    return F.aggregate(ranges, zero, step, lambda acc: acc["n"])
