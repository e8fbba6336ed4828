"""Abusive, hateful and sexual passages in documents.

Method: compression-distance classification. Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A document is cut into windows, sentences and overlapping runs of words, each cleaned of disguises; the window is compressed
with either dictionary, and the difference of the two lengths, per character, is its score: text like the toxic side
compresses better with that dictionary. A document's score is the margin of its best window over the threshold for windows
of that length. Thresholds are calibrated: all training text takes its turn outside the dictionaries, frames with all their
fillings and labelled rows that share three words in a row together, and the threshold of a length is where a normal tail
through the scores of ordinary windows leaves ``FALSE_ALARM`` of them. An exact check follows: compression matches letters and knows no words, so a window over its
threshold counts only if it holds a word or pair of words of the toxic text that the ordinary text does not have.

Training text: the labelled examples handed over (a bounded table, ``max_examples`` at most) and the passages of
``moderation_text``, in English, German, French and Spanish. Documents are never trained on.

Cases
* null, empty or blank text: score -1, not toxic. Texts of any length are read whole, window by window, code in back quotes
  and lone words too.
* badly decoded text (UTF-8 read as Latin-1) is repaired per line before scoring; a line end is a blank, an empty line ends a
  sentence.
* disguises undone: look-alike letters, zero-width marks, digits for letters, spaced or dotted letters, stretched letters,
  mixed case; a starred word stands for the training word of the toxic side that fits it letter by letter, if there is one.
* repeated rows are scored each by itself; other columns are not read; no labelled examples: the passages alone are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from statistics import fmean, NormalDist, pstdev

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.moderation_text import passages
from colligo.runtime import spread

MAX_EXAMPLES = 20_000
#: Words of a window, and from one window to the next; sentences of up to ``WHOLE`` words are judged whole too.
WORDS, STEP, WHOLE = 5, 1, 8
#: Shorter windows are repeated up to this length in bytes, else zstandard would store them as they are.
FULL = 64
#: Windows of which a worker remembers the score.
REMEMBERED = 100_000
LEVEL = 12
#: Turns of the calibration; classes of window length, in characters, and where the first ends.
FOLDS, BINS, BIN_CHARS, SHORT = 4, 3, 16, 24
#: Share of ordinary windows that a calibrated threshold lets pass, before the check on words. The ordinary text held out is
#: the hard kind, harsh words of software and technical terms; of everyday windows far fewer pass.
FALSE_ALARM = 0.02
#: Score of a window over its threshold without a word or pair of words of the toxic side only.
UNMARKED = 0.001

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKE = str.maketrans("аеорсухіјѕкмтвнԁɡⅼοαερτυκνιｅßøæœ", "aeopcyxijskmtbhdgloaeptukvies" "oao")
_LEET = str.maketrans("0134578@$!", "oieastba" "si")
_MOJIBAKE = re.compile(r"[ÃÂâ][-¿¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]{1,2}){3,}[^\W\d_](?![^\W_])")
_MASKED = re.compile(r"(?<![^\W_*])[^\W\d_]+\*+[^\W\d_]*(?![\w*])")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_LEETED = re.compile(r"(?<![^\W_])[^\W\d_]*(?:[\d@$]|!(?=\w))(?:[\w@$]|!(?=\w))*")
_INVISIBLE = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\x00-\x08\x0e-\x1f]")
#: Words, and what ends a sentence.
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[!?:;]|\.(?!\S)|\n[^\S\n]*(?=\n)")
_ENDS = frozenset("!?:;\n.")


def _unleet(m: re.Match) -> str:
    w = m[0]
    if w.isdigit():
        return "0"
    letters = sum(c.isalpha() for c in w)
    marks = len(w) - letters
    return w.translate(_LEET) if letters and marks and (marks <= 3 * letters) else w


def fold(text: str) -> str:
    """A text in lower-case Latin letters without marks; badly decoded lines are repaired."""
    if not text.isascii():
        if _MOJIBAKE.search(text):
            text = "\n".join(_repaired(line) for line in text.split("\n"))
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_LOOKALIKE)
        return text
    return text.lower()


def _repaired(line: str) -> str:
    if _MOJIBAKE.search(line):
        for codec in ("cp1252", "latin-1"):
            try:
                return line.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return line


def _unmasked(word: str, vocabulary: Sequence[str]) -> str:
    """The first word of ``vocabulary`` that a starred word may stand for, a star for a letter; else the word's parts."""
    return next((v for v in vocabulary if len(v) == len(word) and all(a in ("*", b) for a, b in zip(word, v))), word.replace("*", " "))


def _undisguised(text: str, vocabulary: Sequence[str] = ()) -> str:
    """A folded text without the other disguises: starred, spaced and stretched letters, digits for letters; numbers are 0."""
    if "*" in text:
        text = _MASKED.sub(lambda m: _unmasked(m[0], vocabulary), text)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), text)
    return _REPEAT.sub(r"\1", _LEETED.sub(_unleet, text))


def clean(text: str) -> str:
    """A passage without its disguises, one blank between words."""
    return " ".join(t for t in _TOKEN.findall(_undisguised(fold(text))) if t[0] not in _ENDS)


def windows(text: str, vocabulary: Sequence[str] = ()) -> Iterator[str]:
    """Sentences, and of longer ones runs of ``WORDS`` words, cleaned. The whole text is cleaned and cut at once."""
    words: list[str] = []
    for t in [*_TOKEN.findall(_undisguised(fold(text), vocabulary)), "\n"]:
        if t[0] not in _ENDS:
            words.append(t)
            continue
        if words:
            n = len(words)
            if n <= WHOLE:
                yield " ".join(words)
            if n > WORDS:
                for a in range(0, n - WORDS + STEP, STEP):
                    yield " ".join(words[a : a + WORDS])
            words = []


def _runs(cleaned: str) -> Iterator[str]:
    """Words, and pairs of words that follow each other."""
    words = cleaned.split()
    yield from words
    yield from map(" ".join, zip(words, words[1:]))


def _bin(window: str) -> int:
    """Thresholds differ by length: in a short window a single match decides."""
    return 0 if len(window) < SHORT else min(1 + (len(window) - SHORT) // BIN_CHARS, BINS - 1)


class Model:
    """Two dictionaries and the thresholds by window length."""

    def __init__(self, toxic: Sequence[str], ordinary: Sequence[str], thresholds: Sequence[float] = (), level: int = LEVEL):
        self.toxic, self.ordinary = list(dict.fromkeys(map(clean, toxic))), list(dict.fromkeys(map(clean, ordinary)))
        plain = {w for t in self.ordinary for w in t.split()}
        self.vocabulary = list(dict.fromkeys(w for t in toxic for w in fold(t).split() if w.isalpha() and len(w) > 3 and _REPEAT.sub(r"\1", w) not in plain))
        self.marks = {r for t in self.toxic for r in _runs(t)} - {r for t in self.ordinary for r in _runs(t)}
        self.thresholds, self.level = list(thresholds), level
        self._make()

    def _make(self) -> None:
        self._seen: dict[str, float] = {}
        self._compress = [zstandard.ZstdCompressor(level=self.level, dict_data=_dictionary(side, [*self.toxic, *self.ordinary], self.level), write_content_size=False, write_checksum=False, write_dict_id=False).compress for side in (self.toxic, self.ordinary)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_compress", "_seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._make()

    def score(self, window: str) -> float:
        """Bytes that the toxic dictionary saves against the ordinary one, per character of a cleaned window."""
        data = window.encode()
        if len(data) < FULL:  # the further copies cost either side the same
            data = b" ".join([data] * -(-FULL // len(data)))
        toxic, ordinary = (len(c(data)) for c in self._compress)
        return (ordinary - toxic) / (len(window) + 6)

    def judge(self, text: str | None) -> tuple[float, str | None]:
        """Best margin over the threshold among the windows, and that window. The score of a window is remembered: the same
        phrases come again and again in a corpus."""
        best, where, seen, last = -1.0, None, self._seen, len(self.thresholds) - 1
        for w in windows(text, self.vocabulary) if text else ():
            margin = seen.get(w)
            if margin is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                margin = self.score(w) - self.thresholds[min(_bin(w), last)]
                if margin >= 0 and self.marks.isdisjoint(_runs(w)):
                    margin = -UNMARKED
                seen[w] = margin
            if margin > best:
                best, where = margin, w
        return best, where


#: The three recent offsets that end the header of a zstandard dictionary (fixed value of its format).
_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def _dictionary(samples: Sequence[str], both: Sequence[str], level: int) -> zstandard.ZstdCompressionDict:
    """A dictionary whose entropy tables are trained on both sides, so that letters cost the same on either, and whose content
    is all of this side's samples: the trainer alone would keep but the most frequent parts."""
    content = b"\n".join(s.encode() for s in samples) + b"\n" * 8
    data = [s.encode() for s in both if s]
    try:
        trained = zstandard.train_dictionary(max(256, min(112_640, sum(map(len, data)))), data * max(1, 4000 // max(1, len(data))), level=level, k=200, d=6).as_bytes()
        made = zstandard.ZstdCompressionDict(trained[: trained.index(_OFFSETS) + len(_OFFSETS)] + content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        made.precompute_compress(level=level)
        return made
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _groups(texts: Sequence[str]) -> list[list[str]]:
    """Texts that share three words in a row, directly or through others, together: rows made from one sentence."""
    first: dict[str, int] = {}
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, t in enumerate(texts):
        words = clean(t).split()
        for k in range(max(1, len(words) - 2)):
            parent[root(i)] = root(first.setdefault(" ".join(words[k : k + 3]), i))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[root(i)].append(t)
    return list(groups.values())


def training(examples: Sequence[tuple[str | None, bool]]) -> tuple[list[list[str]], list[list[str]]]:
    """Toxic and ordinary text in groups that must not be parted by a fold."""
    sides = passages()
    for side, wanted in zip(sides, (True, False)):
        side += _groups(list(dict.fromkeys(t for t, y in examples if t and t.strip() and bool(y) is wanted)))
    return sides


def held_out(toxic: list[list[str]], ordinary: list[list[str]]) -> Iterator[tuple[str, bool, float]]:
    """``(window, is toxic, score)`` of all training text, scored by dictionaries that its group was left out of."""
    for turn in range(FOLDS):
        part = Model(*([t for i, g in enumerate(side) if i % FOLDS != turn for t in g] for side in (toxic, ordinary)))
        for side, bad in ((toxic, True), (ordinary, False)):
            for t in dict.fromkeys(t for g in side[turn::FOLDS] for t in g):
                for w in windows(t):
                    yield w, bad, part.score(w)


def fit(examples: Sequence[tuple[str | None, bool]]) -> Model:
    """Dictionaries from all examples and passages; thresholds from the scores of ordinary text held out in turn."""
    toxic, ordinary = training(examples)
    by_bin: dict[int, list[float]] = defaultdict(list)
    for w, bad, score in held_out(toxic, ordinary):
        if not bad:
            by_bin[_bin(w)].append(score)
    every = [s for scores in by_bin.values() for s in scores]
    z = NormalDist().inv_cdf(1 - FALSE_ALARM)
    thresholds = [fmean(scores) + z * pstdev(scores) for scores in (by_bin.get(b) or every for b in range(BINS))]
    return Model([t for g in toxic for t in g], [t for g in ordinary for t in g], thresholds)


def examples_of(table: DataFrame, max_examples: int = MAX_EXAMPLES) -> list[tuple[str | None, bool]]:
    """Labelled rows for ``fit``: at most ``max_examples``, taken by a hash of the text; a null label counts as 0."""
    toxic = (F.coalesce(F.col("abusive"), F.lit(0)) + F.coalesce(F.col("hateful"), F.lit(0)) + F.coalesce(F.col("sexual"), F.lit(0))) > 0
    rows = table.where(F.col("text").isNotNull()).select("text", toxic.alias("y")).orderBy(F.xxhash64("text"), "text").limit(max_examples)
    return [(r[0], r[1]) for r in rows.collect()]


def moderate(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``<key>, <keep…>, score, toxic, passage``: the margin of the best window over its threshold, whether it reaches it,
    and that window as cleaned. One narrow pass; the model travels with the task."""
    model = fit(examples_of(examples, max_examples))
    columns = [key, *keep]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = lru_cache(maxsize=1)(model.judge)
        for b in batches:
            found = [judge(t) for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(columns))), pa.array([max(s, -1.0) for s, _ in found], pa.float64()), pa.array([s >= 0 for s, _ in found], pa.bool_()), pa.array([w if s >= 0 else None for s, w in found], pa.string())],
                names=[*columns, "score", "toxic", "passage"])

    return spread(documents.select(*columns, text), documents).mapInArrow(run, f"{fields}, score double, toxic boolean, passage string")


def rates(moderated: DataFrame, by: str = "source") -> DataFrame:
    """Per source: documents, toxic ones and their share."""
    return moderated.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("toxic").cast("bigint")).alias("toxic_documents"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("toxic_rate"))
