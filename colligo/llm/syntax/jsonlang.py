"""Strict JSON (RFC 8259). A byte order mark before the value is let pass."""

from __future__ import annotations

import re

from colligo.llm.syntax.base import Failed, Parser, SyntaxFault

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)(?!\w)|(?P<mark>[{}\[\],:]))')
_SPACE = re.compile(r"[ \t\r\n]*")


class Json(Parser):
    def parse(self) -> list[SyntaxFault]:
        text, i = self.text, 1 if self.text.startswith("﻿") else 0
        while True:
            m = _TOKEN.match(text, i)
            if m:
                self.push(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup))
                i = m.end()
                continue
            i = _SPACE.match(text, i).end()
            if i >= len(text):
                break
            self.fault(i, "open string" if text[i] == '"' else f"unexpected {text[i]!r}")
            # panic mode of the lexer: on to the next mark
            n = re.compile(r"[{}\[\],:\n]").search(text, i + 1)
            i = n.start() if n else len(text)
            self.push("bad", "?", i)
        self.push("end", "", len(text))
        try:
            self.value()
            if self.kinds[self.i] != "end":
                self.fail()
        except Failed as f:
            self.fault(f.at, f.message)
        return self.result()

    def value(self) -> None:
        """One value; nesting is kept on a list, not on the stack."""
        stack: list[str] = []
        while True:
            # a value begins here
            kind, v = self.kinds[self.i], self.values[self.i]
            if kind == "mark" and v in "{[":
                self.i += 1
                if self.take("}" if v == "{" else "]"):
                    pass
                else:
                    stack.append(v)
                    if v == "{":
                        self.key()
                    continue
            elif kind in ("text", "number", "word", "bad"):
                self.i += 1
            else:
                self.fail()
            # a value has ended
            while stack:
                if self.take(","):
                    if stack[-1] == "{":
                        self.key()
                    break
                if not self.take("}" if stack[-1] == "{" else "]"):
                    self.fail()
                stack.pop()
            else:
                return

    def key(self) -> None:
        if self.kinds[self.i] not in ("text", "bad"):
            self.fail()
        self.i += 1
        if not self.take(":"):
            self.fail()
