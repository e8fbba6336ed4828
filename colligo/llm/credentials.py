"""Credentials in source code and configuration: where they are, and the text without them.

Method: a linear-chain conditional random field over the lexical tokens of a line, with labels O (other), B (a credential
begins) and I (it goes on). Features are the shape of a token (classes of characters, length, variety, known prefixes,
place holders), where it stands (inside quotes, after which separator, in a comment) and its context (the nearest name on
the left, the call around it). The Viterbi labelling decides which characters are redacted; a private key in PEM form is
one token, over as many lines as it takes. The field was trained by ``colligo.llm.credential_training`` on lines made from
templates; its weights are in ``credential_weights.json`` beside this file.

For speed, the field first meets only lines on which it could find something (``candidates``): those with a name of secrecy, a
known prefix, a URL with user data or a pair in a comment, and beside it anything but plain words; and those with a long run of
mixed letters and digits. ``find(text, every=True)`` asks the field about all lines; the README tells how far the two differ.
A line that ends in ``=`` or ``:`` is read together with the next where that is but a quoted text. ``find`` is the only way to
a credential: rows found and redacted texts both come from it.

Cases
* null or empty text: nothing found, null or empty text comes back. Texts are read whole; a line may be of any length.
* line numbers count LF only, from 1; CR and a byte order mark are ordinary characters.
* several credentials on a line give one row; a value of several lines counts where it begins.
* a statement's row carries its own ``line``; repeated deliveries of a statement give one row. Null ids are kept.
* other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from math import log2

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.runtime import spread

LABELS = "OBI"
REDACTED = "[redacted]"

#: Kinds of names by the words in them; the first that fits counts. Fixed values.
NAME_KINDS = (
    ("placeholder", ("example", "sample", "dummy", "placeholder")),
    ("reference", ("secretname", "secret_name", "endpoint", "_url", "uri", "_file", "_path", "keyname", "key_name", "keyid", "key_id", "vaultname", "namespace", "reference", "ref", "getenv", "environ", "environment")),
    ("public", ("public", "verifier", "verify", "pubkey", "fingerprint")),
    ("hash", ("integrity", "checksum", "etag", "commit", "sha", "md5", "digest", "hash", "revision", "crc", "signature")),
    ("id", ("correlation", "clientid", "client_id", "requestid", "request_id", "traceid", "trace_id", "tenantid", "uuid", "guid", "session_id", "sessionid", "buildid", "instanceid")),
    ("password", ("password", "_pass", "passwd", "passphrase", "passwort", "kennwort", "pwd", "passcode")),
    ("secret", ("secret", "credential", "private", "signing", "webhook")),
    ("key", ("apikey", "api_key", "api-key", "accesskey", "access_key", "storagekey", "storage_key", "sharedkey", "sharedaccesskey", "account_key", "accountkey", "licensekey", "encryptionkey", "-key", "_key", "key")),
    ("token", ("token", "bearer", "auth", "jwt", "pat")),
    ("login", ("login", "signin", "logon", "authenticate", "connect", "credentials")),
    ("user", ("user", "uid", "account", "username")),
    ("connection", ("connection", "server", "database", "endpoint=")),
    ("data", ("icon", "image", "data:", "font", "base64", "blob", "payload", "logo")),
    ("prompt", ("show", "prompt", "label", "title", "message", "log", "write", "print", "throw", "error", "raise")),
)
PREFIXES = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|sk_test_|rk_live_|pk_live_|sk-|npm_|pypi-|glpat-|AIza|ya29\.|eyJ[\w-]{8,}\.|SG\.|[a-z]{2,4}_live_|[a-z]{2,4}_[A-Za-z0-9]{20,}$|[a-z]{2}\.[A-Za-z0-9]{20,}$)")
PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-{3,}|_{3,}|0{6,}|1234\w*|your[ _\-]?.*|(?:my|some|the|insert|enter|add|put)[ _\-].*|.*(?:_here|-here|placeholder|redacted|changeme|change_me|example|dummy|todo|fixme|set at deploy|not set|unset).*|null|none|nil|true|false|undefined|test|secret|password|token)$")
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
KEBAB = re.compile(r"^[a-z]+(?:[-_][a-z]+)*[-_]\d+$|^[a-z]+(?:[-_ ][a-z]+)*$")
IDENT_PATH = re.compile(r"^[A-Za-z_$@][\w$]*(?:\.[A-Za-z_$][\w$]*)*\.?$")

PEM = r"-----BEGIN [A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z ]*-----(?:(?!-----BEGIN)[\s\S])*?(?:-----END [A-Z0-9 ]*-----|(?=\n\s*\n)|\Z)"
TOKEN = re.compile(PEM + r"|data:[a-z\-]+/[\w.+\-]+;base64,[A-Za-z0-9+/=]+|\$\{[^}\n]*\}|\{\{[^}\n]*\}\}|<[A-Za-z][^<>\n\"']*>|%[A-Z_]+%|={3,}|://|//|/\*|\*/|--(?=[a-z])|[\"'`]+|[A-Za-z0-9_+/\-.!%*#$~^&?|\\]+(?:={1,2}(?![A-Za-z0-9\"'`=]))?|[^\sA-Za-z0-9]")
#: Words of secrecy, known prefixes and other marks beside which a credential can stand, in lower case (fixed values).
KEYWORDS = ("passw", "passp", "passc", "pass=", "pass:", "_pass", "pwd", "kennwort", "secret", "credential", "bearer", "basic", "login", "log_in", "log-in", "log in", "logon", "signin", "sign_in", "sign-in", "sign in", "account", "auth", "key", "token", "webhook", "connect", "dial", "_live_", "_test_", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "glpat-", "eyj", "aiza", "ya29.", "npm_", "pypi-", "sg.", "sk-", "://", "-----begin", " / ")
#: Beside a word: a token with a digit or sign among its letters, a quoted word, or a value after a sign.
VALUE = re.compile(r"(?i)-----BEGIN|://[^\s/:@\"'<>]+:[^\s/@\"'<>]+@|(?<![\w.\-])(?=[^\s\"'`(){}\[\],;]*[a-z])(?=[^\s\"'`(){}\[\],;]*[\d!#%*^&+$])[^\s\"'`(){}\[\],;]{5,}|[\"'][a-z+/!_\-]{6,}[\"']|[=:/] ?[a-z_]{7,}(?=[\"';,\s]|\Z)|-(?:p|-pass(?:word)?|-token|-secret|-api-key)[ =]\S{5,}")
LONG = re.compile(r"(?=[A-Za-z+/_\-]*\d)(?=[\d+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{20,}")
_PEM = re.compile(PEM)
#: What may follow a line that ends in ``=`` or ``:``: a quoted text alone.
_ALONE = re.compile(r"\n[^\S\n]*([\"'`])[^\"'`\n]+\1[;,)]*[^\S\n]*(?=\r?\n|\r?\Z)")
_UPPER = re.compile("[A-Z]+")


def name_kind(name: str) -> str:
    low = re.sub(r"author(?!iz)s?", "", name.lower())
    for kind, words in NAME_KINDS:
        if any(w in low for w in words):
            return kind
    return "other"


name_kind = lru_cache(maxsize=50_000)(name_kind)


def shape_features(t: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    n = len(t)
    if n == 1 or not any(c.isalnum() for c in t):
        if n >= 3 and (len(set(t)) == 1 or PLACEHOLDER.match(t)):
            return ("place",)
        return ("mark", "mark=" + t[:3])
    if t.startswith("-----BEGIN"):
        head = t[:60].split("-----")[1]
        return ("pem", "pem=" + ("private" if "PRIVATE" in head else "public"))
    if t[0] in "${<%" and t[-1] in "}>%" or t.startswith("data:"):
        return ("place", "place=" + t[0])
    lower = upper = digit = other = 0
    for c in t:
        if c.islower():
            lower += 1
        elif c.isupper():
            upper += 1
        elif c.isdigit():
            digit += 1
        else:
            other += 1
    out = ["len=%d" % min(n.bit_length() if n < 16 else 5 + n // 12, 12), "mix=%d%d%d%d" % (lower > 0, upper > 0, digit > 0, other > 0)]
    if PLACEHOLDER.match(t):
        out.append("place")
    if PREFIXES.match(t):
        out.append("prefix")
    if UUID.match(t):
        out.append("uuid")
    elif digit and n in (32, 40, 56, 64, 96, 128) and not other and all(c in "0123456789abcdefABCDEF" for c in t):
        out.append("hex")
    elif KEBAB.match(t):
        out.append("kebab")
    elif IDENT_PATH.match(t) and not digit:
        out.append("ident" if "." not in t else "path")
    elif n >= 16:
        counts: dict[str, int] = {}
        for c in t:
            counts[c] = counts.get(c, 0) + 1
        entropy = -sum(k / n * log2(k / n) for k in counts.values())
        out.append("entropy=%d" % int(entropy * 2))
    if digit == n:
        out.append("number")
    if t[-1] in "!%*#$^&@?" or "!" in t[1:-1]:
        out.append("tail")
    if t[-1] == "=":
        out.append("pad")
    if t.startswith(("/", ".", "\\")):
        out.append("lead=" + t[0])
    if t.startswith("sha") and t[3:4].isdigit():
        out.append("sri")
    if n >= 12 and t[-1] in "=AQgwEIMUYcko048sBHX" and _basic(t):
        out.append("basic")
    return tuple(out)


shape_features = lru_cache(maxsize=200_000)(shape_features)


def _basic(t: str) -> bool:
    """Base64 of ``user:password``."""
    try:
        plain = base64.b64decode(t + "=" * (-len(t) % 4), validate=True).decode("ascii")
    except (ValueError, binascii.Error):
        return False
    return bool(re.fullmatch(r"[\w.@\-]+:[\x21-\x7e]{4,}", plain))


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, len(text) if end is None else end)]


def sentence_features(spans: list[tuple[int, int, str]], text: str) -> list[list[str]]:
    """Features of each token of a line, in context."""
    out: list[list[str]] = []
    quote, comment, call, name, word, sep, user = "", False, "-", "-", "-", "^", False
    gap_end = spans[0][0] if spans else 0
    for i, (a, b, t) in enumerate(spans):
        f = list(shape_features(t))
        near = spans[i + 1][2][:3] if i + 1 < len(spans) else "$"
        tight = i + 1 < len(spans) and spans[i + 1][0] == b
        is_word = t[0].isalnum() or t[0] in "_$@" and len(t) > 1
        where = "q" if quote else "c" if comment else "u"
        if len(t) > 1 and f[0] != "mark" or is_word:
            spaced = a > gap_end
            f += [
                "at=" + where, "name=" + name, "word=" + word + "|" + where, "call=" + call, "sep=" + sep + (" " if spaced else ""), "near=" + (near if tight else " " + near),
                "name=%s|at=%s|sep=%s" % (name, where, sep), "call=%s|at=%s|name=%s" % (call, where, name), "user" if user else "nouser",
            ]
            kind = next((x for x in f if x in ("place", "prefix", "uuid", "hex", "kebab", "ident", "path", "number", "sri", "basic")), f[1] if len(f) > 1 else f[0])
            f += ["kind=%s|name=%s" % (kind, name), "kind=%s|word=%s|%s" % (kind, word, where), "kind=%s|call=%s" % (kind, call), "kind=%s|user=%d|sep=%s" % (kind, user, sep), "kind=%s|near=%s" % (kind, near if tight else " ")]
            if "tail" in f:
                f.append("tail|name=" + name)
        out.append(f)
        gap_end = b
        # the context that the next token sees
        if f[0].startswith("pem"):
            continue
        if t[0] in "\"'`" and len(set(t)) == 1:
            quote = "" if quote else t
            sep = "''" if not quote else sep
        elif t in ("//", "/*") or t == "#" and not quote or t.startswith("#") and not quote and i == 0:
            comment = comment or not quote
        elif not is_word:
            if t in ("(", "[") and not quote:
                call = word
            elif t == ":" and sep == "://" or t == "@":
                pass
            sep = t[:3]
        else:
            k = name_kind(t)
            if k == "user":
                user = True
            if quote or comment:
                # inside a text only a name of some kind changes the context, so that a key does not hide behind its value
                if k != "other" and len(t) < 24 and (IDENT_PATH.match(t) or "-" in t):
                    word = k
                    if comment:
                        name = k
            else:
                word = k
                if near in ("=", ":", "+=") or (near[:1] in "=:" and near not in ("==", "=>")):
                    name = k
            sep = "w"
        if quote == "" and t[0] in "\"'`":
            # a quoted key of JSON names what follows
            if near == ":" and i and spans[i - 1][2][0].isalnum():
                name = name_kind(spans[i - 1][2])
                word = name
    return out


class Field:
    """The trained field: weights of (feature, label) and of label pairs."""

    def __init__(self, weights: dict[str, list[float]], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def load(cls) -> Field:
        data = json.loads(resources.files("colligo.llm").joinpath("credential_weights.json").read_text())
        return cls(data["weights"], data["pairs"])

    def scores(self, features: list[str]) -> list[float]:
        o = b = i = 0.0
        get = self.weights.get
        for f in features:
            w = get(f)
            if w:
                o += w[0]
                b += w[1]
                i += w[2]
        return [o, b, i]

    def viterbi(self, sentence: list[list[str]]) -> list[int]:
        back: list[tuple[int, int, int]] = []
        pairs = self.pairs
        best = [0.0, 0.0, -1e9]
        for k, features in enumerate(sentence):
            s = self.scores(features)
            if not k:
                best = [s[0], s[1], s[2] - 1e9]
                continue
            new, come = [], []
            for y in range(3):
                c0, c1, c2 = best[0] + pairs[0][y], best[1] + pairs[1][y], best[2] + pairs[2][y]
                if y == 2:
                    c0 -= 1e9  # I follows B or I only
                if c0 >= c1 and c0 >= c2:
                    new.append(c0 + s[y])
                    come.append(0)
                elif c1 >= c2:
                    new.append(c1 + s[y])
                    come.append(1)
                else:
                    new.append(c2 + s[y])
                    come.append(2)
            back.append((come[0], come[1], come[2]))
            best = new
        if not sentence:
            return []
        y = max(range(3), key=best.__getitem__)
        path = [y]
        for come in reversed(back):
            y = come[y]
            path.append(y)
        return path[::-1]


@lru_cache(maxsize=1)
def field() -> Field:
    return Field.load()


def _label(text: str, start: int, end: int, model: Field) -> list[tuple[int, int]]:
    spans = tokens(text, start, end)
    if not spans:
        return []
    labels = model.viterbi(sentence_features(spans, text))
    out: list[tuple[int, int]] = []
    for (a, b, t), y in zip(spans, labels):
        if y == 0:
            continue
        if y == 2 and out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in KEYWORDS:
        out.add_word(word, len(word))
    out.make_automaton()
    return out


def candidates(text: str) -> Iterator[int]:
    """Places, in order within each kind, on whose lines a credential could stand."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case
        low = _UPPER.sub(lambda m: m[0].lower(), text)
    done = -1
    for end, size in _automaton().iter(low):
        if end > done:
            start, done = text.rfind("\n", 0, end) + 1, text.find("\n", end)
            done = len(text) if done < 0 else done
            if VALUE.search(text, start, done) or text[start:done].rstrip()[-1:] in ("=", ":") and _ALONE.match(text, done):
                yield end
    for m in LONG.finditer(text):
        yield m.start()


def find(text: str | None, model: Field | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Ranges of the characters of ``text`` that belong to credentials."""
    if not text:
        return []
    model = model or field()
    places = [0, *(m.end() for m in re.finditer("\n", text))] if every else sorted(candidates(text))
    out: list[tuple[int, int]] = []
    done = -1
    for place in places:
        if place <= done:
            continue
        start, end = text.rfind("\n", 0, place) + 1, text.find("\n", place)
        end = len(text) if end < 0 else end
        at = text.find("-----BEGIN", start, end)
        if at >= 0 and (pem := _PEM.match(text, at)):
            end = text.find("\n", pem.end())
            end = len(text) if end < 0 else end
        elif text[start:end].rstrip()[-1:] in ("=", ":") and (alone := _ALONE.match(text, end)):
            end = alone.end()
        elif start and text[: start - 1].rstrip()[-1:] in ("=", ":") and _ALONE.match(text, start - 1):
            start = text.rfind("\n", 0, start - 1) + 1
        done = end
        out += _label(text, start, end, model)
    return out


def lines(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Numbers of the lines on which the ranges begin."""
    out, at, line = [], 0, 1
    for a, _ in spans:
        line += text.count("\n", at, a)
        at = a
        if not out or out[-1] != line:
            out.append(line)
    return out


def redact(text: str | None, mask: str = REDACTED) -> str | None:
    """The text with only the credentials replaced; quotes, names and line ends around them stay. A PEM body goes, its
    first and last line stay."""
    if not text:
        return text
    out, at = [], 0
    for a, b in find(text):
        secret = text[a:b]
        pem = re.fullmatch(r"(-----BEGIN [^-]*-----)([\s\S]*?)(-----END [^-]*-----)?", secret)
        out += [text[at:a], (pem[1] + mask + (pem[3] or "")) if pem else mask]
        at = b
    return "".join(out) + text[at:] if out else text


def found(records: DataFrame, origin: str, key: str, text: str, line: str | None = None) -> DataFrame:
    """``origin, record_id, line_no`` of records: the line of the text on which a credential begins, or the record's own
    ``line``. One pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field()
        for b in batches:
            at, numbers = [], []
            own = b.column(2).to_pylist() if line else None
            for k, t in enumerate(b.column(1).to_pylist()):
                if spans := find(t, model):
                    rows = [own[k]] if own else lines(t, spans)
                    at += [k] * len(rows)
                    numbers += rows
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(at), pa.string()), b.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32())], names=["origin", "record_id", "line_no"])

    columns = [F.col(key).cast("bigint").alias("record_id"), text, *([F.col(line).cast("int").alias("line_no")] if line else [])]
    return spread(records.where(F.col(text) != "").select(*columns), records).mapInArrow(run, "origin string, record_id bigint, line_no int")


def found_in_files(files: DataFrame, key: str = "file_id", text: str = "raw_text") -> DataFrame:
    """``origin, record_id, line_no`` of source files; a value over several lines shows on its first."""
    return found(files, "file", key, text)


def found_in_statements(statements: DataFrame, key: str = "stmt_id", line: str = "line", text: str = "expression") -> DataFrame:
    """The same for statements; repeated deliveries of a statement count once."""
    return found(statements, "statement", key, text, line).distinct()


def redacted(records: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, <text>`` of the records that hold a credential, with only the credentials replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(i, t, redact(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            kept = [(i, r) for i, t, r in pairs if r != t]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], b.schema.field(0).type), pa.array([r for _, r in kept], pa.string())], names=[key, text])

    return spread(records.where(F.col(text) != "").select(key, text), records).mapInArrow(run, f"`{key}` {records.schema[key].dataType.simpleString()}, `{text}` string")
