"""Generated, minified, vendored and data files among source files.

Method: the header of a file (its leading comments, at whatever depth they end) is searched with a multi-pattern automaton
(Aho–Corasick) for notices of generators and of foreign owners; path rules cover vendored folders, build output, lockfiles
and the suffixes of generated and minified files; measures of the whole text find minified code and data saved as code.

Each rule gives a reason; ``classify`` returns the reasons of a file, which is hand-written if there is none.

Cases
* null path: only the text counts; null or empty text: only the path counts; both null: hand-written.
* a notice counts only inside a leading comment or attribute, never inside a string literal or later code.
* an own licence (a copyright line that names ``own_owners``) is no sign of a foreign owner.
* very long texts are read whole; the measures are linear in the text.
* repeated rows and later scans are judged each by itself; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from colligo.runtime import spread

# Notices that tools write, in lower case. "#" before a phrase of weak force is added by the rules below.
GENERATED_NOTICES = (
    "<auto-generated", "</auto-generated", "<autogenerated", "@generated", "auto-generated by", "autogenerated by", "auto generated by", "autogenerated from", "auto-generated from",
    "automatically generated", "auto-generated file", "autogenerated file", "auto generated file", "this is an auto-generated", "this is a generated file", "this file is generated", "this file was generated", "this file is auto",
    "this file has been generated", "this file was auto", "this file has been auto", "this code was generated", "this code is generated", "this source code was auto", "this class was generated", "this module was generated", "this document was generated",
    "code generated by", "code generated from", "file generated by", "source generated by", "class generated by", "generated by the", "generated by a tool", "generated code", "generated file", "generated from", "generated with", "generated using", "generated by", "generated on build", "generated at build", "machine generated", "machine-generated", "machine written", "machine-written",
    "produced by", "was produced from", "emitted by", "written by a tool", "output of a tool", "created by a tool", "do not edit", "do not modify", "don't edit", "do not change by hand", "do not hand edit", "do not hand-edit", "do not alter by hand", "not meant to be edited", "changes will be lost", "changes will be overwritten", "edits will be lost", "edits will be overwritten", "will be overwritten", "any changes made", "manual changes", "edit the source", "edit the template", "regenerate with", "to regenerate", "re-generate this",
    "von einem werkzeug erzeugt", "von einem tool generiert", "automatisch generiert", "automatisch erzeugt", "maschinell erzeugt", "wird ueberschrieben", "wird überschrieben", "nicht bearbeiten", "nicht von hand",
    "généré automatiquement", "genere automatiquement", "généré par", "genere par", "ne pas modifier", "sera écrasé",
    "generado automáticamente", "generado automaticamente", "generado por", "no editar", "no modificar",
)
VENDORED_NOTICES = (
    "vendored from", "vendored copy", "copied verbatim", "verbatim copy", "copied from", "taken from", "imported from upstream", "upstream:", "from upstream", "forked from", "mirrored from", "third-party code", "third party code", "bundled copy of", "ported from",
)
#: Phrases that people write as well: they count only with a second one of the list, or with a tool's name and version.
WEAK_NOTICES = frozenset((
    "do not edit", "do not modify", "don't edit", "generated from", "generated by the", "generated code", "generated file", "to regenerate", "will be overwritten", "any changes made", "manual changes", "edit the source", "edit the template", "generated with", "generated using", "generated by", "produced by", "emitted by",
    "no editar", "no modificar", "ne pas modifier", "nicht bearbeiten", "nicht von hand", "copied from", "taken from", "ported from", "upstream:", "from upstream", "not meant to be edited",
))
COPYRIGHT_WORDS = ("copyright", "(c)", "©", "all rights reserved", "license", "licence", "licensed under")

VENDOR_DIRS = frozenset(("third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "vendor", "vendors", "vendored", "external", "externals", "extern", "deps", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "virtualenv", "venv", ".venv", "pods", "carthage", "godeps", "libs", "imported", "_vendor", "packages"))
#: Of these, the ones that hold foreign code whatever follows; the others need a package folder after them.
VENDOR_SURE = frozenset(("third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "virtualenv", "venv", ".venv", "pods", "carthage", "godeps", "_vendor"))
GENERATED_DIRS = frozenset(("generated", "__generated__", "_generated", "autogen", "autogenerated", "auto-generated", "auto_generated", "gen-src", "generated-sources", "generated_src", "generated-src", "__pycache__", ".next", ".nuxt"))
GENERATED_PAIRS = frozenset((("gen", "out"), ("obj", "debug"), ("obj", "release"), ("bin", "debug"), ("bin", "release"), ("target", "generated-sources"), ("build", "generated"), ("wwwroot", "lib"), ("wwwroot", "vendor"), ("contrib", "imported"), ("build", "output"), ("dist", "bundle")))
LOCK_FILES = frozenset(("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml", "packages.lock.json", "project.assets.json", "poetry.lock", "pipfile.lock", "uv.lock", "pdm.lock", "composer.lock", "cargo.lock", "gemfile.lock", "go.sum", "bun.lock", "deno.lock", "paket.lock"))
_NAME_GENERATED = re.compile(r"(?:\.(?:g|g\.i|gen|generated|designer|pb|auto|autogen)\.[a-z]+|_(?:generated|pb2|pb2_grpc|gen|autogen)\.[a-z]+|(?:^|/)generated_[^/]*|\.(?:bundle|chunk)\.(?:js|css)|(?:^|/)(?:assemblyinfo|temporarygeneratedfile_[^/]*)\.cs)$", re.I)
_NAME_MINIFIED = re.compile(r"(?:[.\-_]min\.(?:js|mjs|css)|\.packed\.js|[.\-](?=[0-9a-f]*\d)[0-9a-f]{8,32}\.(?:js|mjs|css))$", re.I)
_VERSIONED = re.compile(r"^[a-z][\w.\-]*?[-.@]v?\d+\.\d+(?:\.\d+)?[\w.\-]*$", re.I)

_ATTRIBUTE = re.compile(r"^\s*\[?\s*(?:assembly\s*:\s*)?(?:System\.CodeDom\.Compiler\.)?(?:GeneratedCode|CompilerGenerated)(?:Attribute)?\b[^\n]*\]\s*$|^__generated_by__\s*=", re.M)
_TOOL_VERSION = re.compile(r"(?:generated|produced|emitted|written|created|compiled)\s+(?:by|with|using|from)\s+(?:the\s+)?[\w.\-/]+(?:\s+(?:v(?:ersion)?\s*)?\d+(?:\.\d+)*|\.(?:tsp|proto|json|ya?ml|xml|xsd|wsdl|idl|g4|thrift|tt|y|l)\b)", re.I)
_BANNER = re.compile(r"/\*!\s*(?P<name>[\w.\-]+)\s+v?\d+\.\d+[^*]*?\(c\)", re.I)
_NAMED_RELEASE = re.compile(r"^\W*(?P<name>[a-z][\w\-]*)\s+v?\d+\.\d+\.\d+\s*$", re.I)
_PACKER = re.compile(r"eval\(function\(p,a,c,k,e,[dr]\)")
_SOURCE_MAP = re.compile(r"^(?://|/\*)[#@]\s*sourceMappingURL=", re.M)

_LONG_LINE, _DENSE = 500, 0.06
_LITERAL = re.compile(r"(?P<block>/\*.*?\*/)|(?P<line>(?://|#(?!region|endregion))[^\n]*)|(?P<text>[bru]{0,2}(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`))|(?P<number>(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\w?)|(?P<name>[^\W\d]\w*)", re.S)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_\-]{24,}")
#: A file of data has at least so many literals, or encoded characters, else its table is small; and at most so many different
#: names, as a share of its tokens as well.
_DATA_LITERALS, _DATA_ENCODED, _DATA_NAMES, _DATA_SHARE = 60, 400, 18, 0.06


@lru_cache(maxsize=4)
def automaton(own_owners: tuple[str, ...] = ()) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, phrases in (("generated", GENERATED_NOTICES), ("vendored", VENDORED_NOTICES), ("copyright", COPYRIGHT_WORDS), ("own", own_owners)):
        for phrase in phrases:
            out.add_word(phrase, (kind, phrase))
    out.make_automaton()
    return out


_SKIP_CODE = re.compile(r"(?:using\s[^;\n]*;|import\s[^\n]*|from\s[^\n]*import[^\n]*|\"use strict\";?|'use strict';?|const\s+\w+\s*=\s*require\([^\n]*|#!.*|package\s[^\n]*)[ \t]*(?:\r?\n|$)")

_COMMENT_KEY = re.compile(r'\{\s*"(?:\$comment|_comment|//|comment|generatedBy|_generated)"\s*:\s*"((?:[^"\\\n]|\\.)*)"')


def header(text: str) -> str:
    """The comments (and attributes) at the head of a file: before the first statement other than an import.

    Comments of both ``//`` and ``#`` style, blocks, XML and doc strings are taken whole, each line without its marks."""
    out: list[str] = []
    i, n = 0, len(text)
    if text.startswith("﻿"):
        i = 1
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif text.startswith(("//", "--"), i) or c == "#" and not re.match(r"#\w+ ?\w*\s*$", text[i : text.find("\n", i) if "\n" in text[i:] else n]) or c == "#" and text.startswith("#!", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            out.append(text[i:end])
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append(text[i:end])
            i = end
        elif text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            end = n if end < 0 else end + 3
            out.append(text[i:end])
            i = end
        elif text.startswith(('"""', "'''"), i):
            end = text.find(text[i : i + 3], i + 3)
            end = n if end < 0 else end + 3
            out.append(text[i:end])
            i = end
        elif m := _SKIP_CODE.match(text, i):
            i = m.end()
        elif c == "{":
            # JSON has no comments; a leading comment key takes their place
            if m := _COMMENT_KEY.match(text, i):
                out.append(m[0])
            break
        else:
            break
    return "\n".join(out)


def footer(text: str) -> str:
    """The last line of a file, if it is a comment: some tools mark their output there."""
    tail = text[text.rstrip().rfind("\n", 0, max(0, len(text.rstrip()) - 1)) + 1 :] if "\n" in text.rstrip() else ""
    return tail.strip() if tail.lstrip().startswith(("//", "#", "/*", "--", "<!--")) else ""


def _notices(head: str, own_owners: tuple[str, ...]) -> list[str]:
    reasons, lower = [], head.lower()
    hits: dict[str, set[str]] = {}
    for _, (kind, phrase) in automaton(own_owners).iter(lower):
        hits.setdefault(kind, set()).add(phrase)
    generated = hits.get("generated", set())
    strong = generated - WEAK_NOTICES
    # a weak phrase that only ends another one ("do not edit the numbers below …") needs support
    tool = bool(generated) and bool(_TOOL_VERSION.search(head))
    upper = "DO NOT EDIT" in head and bool(re.search(r"DO NOT EDIT\W*(?:$|\n|\*/|BY HAND|THIS FILE|MANUALLY)", head))
    if strong or tool or upper or len({p for p in generated if p.startswith(("do not", "don't"))}) and len(generated) > 1 and tool:
        reasons.append("generated notice")
    vendored = hits.get("vendored", set())
    if vendored - WEAK_NOTICES or vendored and re.search(r"https?://|\d+\.\d+", head):
        reasons.append("vendored notice")
    if "copyright" in hits:
        foreign = [ln for ln in lower.splitlines() if ("copyright" in ln or "(c)" in ln or "©" in ln) and re.search(r"(?:copyright|\(c\)|©)\W*(?:\(c\)|©)?\W*(?:\d{4}[-–, \d]*)?\W*(?:by\s+|the\s+)?[a-z]", ln)]
        if any(not any(o in ln for o in own_owners) for ln in foreign) and "own" not in hits:
            reasons.append("foreign licence")
    elif any(_NAMED_RELEASE.match(ln) for ln in head.splitlines()[:2]):
        reasons.append("foreign licence")
    return reasons


def path_reasons(path: str | None) -> list[str]:
    if not path:
        return []
    parts = path.replace("\\", "/").lower().split("/")
    dirs, name = parts[:-1], parts[-1]
    out = []
    if name in LOCK_FILES:
        out.append("lockfile")
    if _NAME_GENERATED.search(name):
        out.append("generated suffix")
    if _NAME_MINIFIED.search(name):
        out.append("minified suffix")
    for i, d in enumerate(dirs):
        after = dirs[i + 1] if i + 1 < len(dirs) else ""
        if d in VENDOR_SURE or d in VENDOR_DIRS and (_VERSIONED.match(after) or d in ("external", "externals", "extern") and after and not re.search(r"\d$", after)) or (d, after) in GENERATED_PAIRS and d in ("wwwroot", "contrib"):
            out.append("vendored folder")
        if d in GENERATED_DIRS or (d, after) in GENERATED_PAIRS and d not in ("wwwroot", "contrib"):
            out.append("generated folder")
    return list(dict.fromkeys(out))


def text_reasons(text: str | None, own_owners: tuple[str, ...] = (), path: str | None = None) -> list[str]:
    """Reasons that the text itself gives."""
    if not text or not text.strip():
        return []
    head, tail = header(text), footer(text)
    out = _notices(head, own_owners) if head else []
    if tail and not out and any(kind == "generated" and phrase not in WEAK_NOTICES for _, (kind, phrase) in automaton(own_owners).iter(tail.lower())):
        out.append("generated notice")
    if _ATTRIBUTE.search(text):
        out.append("generated attribute")
    if (m := _BANNER.search(head)) and m["name"].lower() not in own_owners:
        out.append("vendored notice")
    is_code = not (path or "").lower().endswith((".md", ".json", ".yml", ".yaml"))
    if is_code:
        if _PACKER.search(text):
            out.append("packed")
        if _minified(text):
            out.append("minified")
        elif _SOURCE_MAP.search(text):
            out.append("compiled")
        if _data(text):
            out.append("data as code")
    return out


def _minified(text: str) -> bool:
    """Long lines of dense code make up most of the text: few blanks for the punctuation around them."""
    lines = text.split("\n")
    long = [ln for ln in lines if len(ln) >= _LONG_LINE]
    size = sum(map(len, long))
    if size < 0.6 * len(text):
        return False
    code = "".join(long)
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "''", code)
    if len(bare) < 0.3 * len(code) and not _PACKER.search(code):
        return False  # one long string literal, not dense code
    blanks = bare.count(" ") + bare.count("\t")
    marks = sum(bare.count(c) for c in ";,(){}[]=")
    return marks > 0.08 * len(bare) and blanks < max(_DENSE * len(bare), 0.5 * marks)


def _data(text: str) -> bool:
    """Literals, table branches or encoded bytes make up a file: many tokens, but hardly a name that differs from the others."""
    names: set[str] = set()
    literals = tokens = encoded = 0
    for m in _LITERAL.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            tokens += 1
            names.add(re.sub(r"\d+", "", m[0]))
            left = len(text) - m.end()  # no more tokens and no more encoded characters can follow
            if len(names) > max(_DATA_NAMES, 0.01 * (tokens + left)) and encoded + left <= 0.6 * len(text):
                return False
        elif kind in ("text", "number"):
            tokens += 1
            literals += 1
            if kind == "text" and len(m[0]) > 48 and "-----BEGIN" not in m[0]:  # a key is no data
                encoded += sum(map(len, _ENCODED.findall(m[0])))
    if encoded > max(_DATA_ENCODED, 0.6 * len(text)):
        return True
    return literals >= _DATA_LITERALS and len(names) <= max(_DATA_NAMES, 0.01 * tokens) and len(names) <= _DATA_SHARE * tokens


def classify(path: str | None, text: str | None, own_owners: tuple[str, ...] = ()) -> list[str]:
    """Reasons for which a file is not hand-written; empty: it is."""
    return path_reasons(path) + text_reasons(text, own_owners, path)


def not_hand_written(files: DataFrame, own_owners: Sequence[str] = (), key: str = "file_id", path: str = "path", text: str = "raw_text") -> DataFrame:
    """``<key>, reasons array<string>`` of the files that are generated, minified, vendored or data.

    One narrow pass over three columns in Arrow batches, without a shuffle."""
    owners = tuple(o.lower() for o in own_owners)
    kind = files.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [classify(p, t, owners) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = [i for i, r in enumerate(reasons) if r]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([reasons[i] for i in keep], pa.list_(pa.string()))], names=[key, "reasons"])

    return spread(files.select(key, path, text), files).mapInArrow(run, f"`{key}` {kind.simpleString()}, reasons array<string>")
