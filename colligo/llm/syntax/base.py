"""What the parsers of all languages share: tokens, errors, panic-mode recovery."""

from __future__ import annotations

import re
from dataclasses import dataclass

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f]")


@dataclass(frozen=True)
class SyntaxFault:
    line: int
    message: str


class Failed(Exception):
    """Left to the statement list that recovers."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class TooDeep(Exception):
    """The nesting passes what a parser follows; the text is then judged by the faults so far and by its brackets."""


class Parser:
    """Recursive descent over ``kinds`` and ``values``; the last token is the end of the text.

    A fault inside a statement is raised as ``Failed``; ``recover`` stores it and skips to a place where the next statement
    may begin. ``limit`` bounds the nesting, so that no text can exhaust the stack."""

    limit = 4000

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.values: list[str] = []
        self.starts: list[int] = []
        self.i = 0
        self.depth = 0
        self.faults: list[tuple[int, str]] = []

    def push(self, kind: str, value: str, start: int) -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.starts.append(start)

    def fault(self, start: int, message: str) -> None:
        self.faults.append((start, message))

    def fail(self, message: str = "") -> None:
        v = self.values[self.i]
        raise Failed(self.starts[self.i], message or ("the text ends too early" if self.kinds[self.i] == "end" else f"unexpected {v[:20]!r}"))

    def at(self, value: str) -> bool:
        return self.values[self.i] == value and self.kinds[self.i] != "text"

    def at_any(self, values: frozenset[str] | tuple[str, ...]) -> bool:
        return self.values[self.i] in values and self.kinds[self.i] != "text"

    def take(self, value: str) -> bool:
        if self.values[self.i] == value and self.kinds[self.i] != "text":
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail("" if self.kinds[self.i] != "end" else f"the text ends before {value!r}")

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > self.limit:
            raise TooDeep

    def balance(self) -> None:
        """The brackets of all tokens on a stack of their own; the first that does not fit is a fault."""
        stack: list[int] = []
        for i, (kind, v) in enumerate(zip(self.kinds, self.values)):
            if kind == "text":
                continue
            if v in ("(", "[", "{"):
                stack.append(i)
            elif v in (")", "]", "}"):
                if not stack or self.values[stack.pop()] + v not in ("()", "[]", "{}"):
                    return self.fault(self.starts[i], f"unexpected {v!r}")
            elif kind == "end" and stack:
                return self.fault(self.starts[i], f"the text ends before {self.values[stack[-1]]!r} is closed")

    def recover(self, fault: Failed, stops: frozenset[str]) -> None:
        """Panic mode: behind the next ``;`` on this level, or before a token of ``stops``."""
        self.fault(fault.at, fault.message)
        level, begin = 0, self.i
        while self.kinds[self.i] != "end":
            v = self.values[self.i]
            if self.kinds[self.i] != "text":
                if v in ("{", "(", "["):
                    level += 1
                elif v in (")", "]", "}"):
                    if v == "}" and level <= 0:
                        break
                    level = max(0, level - 1)
                elif level == 0 and (v == ";" or v in stops and self.i > begin):
                    self.i += v == ";"
                    break
            self.i += 1
        if self.i == begin and self.kinds[self.i] != "end" and not self.at("}"):
            self.i += 1

    def result(self) -> list[SyntaxFault]:
        out, at, line = [], 0, 1
        for start, message in sorted(set(self.faults)):
            line += self.text.count("\n", at, start)
            at = start
            out.append(SyntaxFault(line, message))
        return out


def first_cause(text: str, faults: list[SyntaxFault], language: str) -> str | None:
    """Why a text does not parse, told from its first fault and the text around it."""
    if not faults:
        return None
    head = text.lstrip("﻿ \t\r\n")
    if head.startswith("PK\x03\x04") or "\x00" in head or len(_CONTROL.findall(head)) > len(head) // 20 + 1:
        return "binary content"
    line = text.split("\n")[faults[0].line - 1] if faults[0].line <= text.count("\n") + 1 else ""
    if _CONFLICT.search(line.rstrip("\r")) or _CONFLICT.search(text.replace("\r\n", "\n")) and faults[0].message.startswith("unexpected"):
        return "merge conflict"
    if re.match(r"(?i)<!doctype|<html|<\?xml", head):
        return "other language"
    message = faults[0].message
    if "ends" in message or "never closed" in message:
        return "truncated"
    if "string" in message or "comment" in message:
        return "open string or comment"
    if language != "csharp" and re.match(r"using\s+[\w.]+;|namespace\s", head) or language != "python" and re.match(r"(?:import\s+\w+\s*$|from\s+\w+\s+import|def\s+\w+\(|\"\"\")", head, re.M) and language in ("csharp", "json", "yaml") or language != "javascript" and re.match(r"(?:const|let|var)\s+\w+\s*=", head):
        return "other language"
    return "syntax"
