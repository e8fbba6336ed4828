"""Parsers that judge whether a text is valid in its language."""

from __future__ import annotations

import sys
from collections.abc import Callable

from colligo.llm.syntax.base import SyntaxFault, TooDeep, first_cause
from colligo.llm.syntax.csharp import CSharp
from colligo.llm.syntax.javascript import JavaScript
from colligo.llm.syntax.jsonlang import Json
from colligo.llm.syntax.python import Python, refused
from colligo.llm.syntax.yaml import Yaml

# Spellings of languages, and extensions.
SPELLINGS = {
    "csharp": ("csharp", "c#", "cs", "c-sharp", "c sharp", "dotnet"), "python": ("python", "py", "python3", "py3"), "javascript": ("javascript", "js", "ecmascript", "node", "nodejs", "mjs", "cjs"),
    "json": ("json",), "yaml": ("yaml", "yml"), "markdown": ("markdown", "md"),
}
EXTENSIONS = {".cs": "csharp", ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".md": "markdown", ".markdown": "markdown"}
_BY_SPELLING = {s: language for language, spellings in SPELLINGS.items() for s in spellings}
_PARSERS: dict[str, Callable] = {"csharp": CSharp, "python": Python, "javascript": JavaScript, "json": Json, "yaml": Yaml}


def language_of(language: str | None, path: str | None) -> str | None:
    """The language by any spelling, else by the extension of the path, else None."""
    named = _BY_SPELLING.get((language or "").strip().lower())
    if named:
        return named
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return EXTENSIONS.get("." + name.rsplit(".", 1)[-1]) if "." in name else None


def judged(text: str, language: str | None) -> tuple[list[SyntaxFault], bool]:
    """All faults of a text, and whether it was judged whole. A language without a parser, as Markdown, has no faults.

    A text nested deeper than the parser follows keeps the faults found before; its brackets, and for Python Python's own
    parser, may add one. If all of these find none, it is not judged."""
    parser = _PARSERS.get(language or "")
    if parser is None or not text.strip("﻿ \t\r\n\x0c") and language != "json":
        return [], True
    if sys.getrecursionlimit() < 60_000:
        sys.setrecursionlimit(60_000)
    judge = None
    try:
        judge = parser(text)
        return judge.parse(), True
    except (TooDeep, RecursionError):
        if judge is None:
            return [], False
        if not judge.faults:
            judge.balance()
        if not judge.faults and language == "python" and refused(text):
            judge.fault(0, "refused by Python's own parser")
        return judge.result(), bool(judge.faults)


def faults_of(text: str, language: str | None) -> list[SyntaxFault]:
    return judged(text, language)[0]


__all__ = ["EXTENSIONS", "SPELLINGS", "SyntaxFault", "faults_of", "first_cause", "judged", "language_of"]
