"""Python 3.13: indentation, statements, match, type parameters, expressions, f-strings as single tokens."""

from __future__ import annotations

import ast
import re
import warnings

from colligo.llm.syntax.base import Failed, Parser, SyntaxFault

_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n|\\\r)|(?P<comment>#[^\n\r]*)|(?P<line>\r\n|\n|\r)"
    r"|(?P<prefix>(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?=[\"']))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?P<tail>\w?)"
    r"|(?P<mark>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|<<|>>|\*\*|//|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\],:.;+\-*/%@&|^~<>=])"
)
_BODY = {
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'), "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"),
}
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = {"or": 1, "and": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_COMPARE = frozenset("< > == >= <= != in is not".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Python(Parser):
    def lex(self) -> None:
        text, n = self.text, len(self.text)
        i = 1 if text.startswith("﻿") else 0
        indents = [0]
        brackets: list[tuple[str, int]] = []
        fresh, some = True, False
        while i < n:
            if fresh and not brackets:
                m = re.compile(r"[ \t\f]*").match(text, i)
                width = 0
                for c in m[0]:
                    width = width // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else width + 1
                i = m.end()
                if i >= n:
                    break
                if text[i] in "#\n\r":
                    fresh = False
                    if text[i] == "#":
                        i = re.compile(r"[^\n\r]*").match(text, i).end()
                    if i < n:
                        i += 2 if text.startswith("\r\n", i) else 1
                    fresh = True
                    continue
                fresh = False
                if width > indents[-1]:
                    indents.append(width)
                    self.push("indent", "", i)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        self.push("dedent", "", i)
                    if width != indents[-1]:
                        self.fault(i, "the indentation fits no outer level")
                        indents.append(width)
                        self.push("indent", "", i)
            m = _TOKEN.match(text, i)
            if not m or m.end() == i and m.lastgroup != "prefix":
                self.fault(i, f"unexpected {text[i]!r}")
                i += 1
                continue
            kind = m.lastgroup if m.lastgroup != "tail" else "number"
            if kind == "prefix":
                i = self._string(m.end(), m[0], i)
                some = True
                continue
            if kind == "line":
                if not brackets:
                    if some:
                        self.push("newline", "", m.start())
                    fresh, some = True, False
            elif kind not in ("space", "comment"):
                some = True
                if kind == "number" and (m["tail"] and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, m.end() - 1) or re.match(r"0\d*[1-9]\d*$", m[0])):
                    self.fault(m.start(), "bad number")
                if kind == "number" and m["tail"]:
                    if re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, m.end() - 1):
                        self.push("number", m["number"], m.start())
                        i = m.end() - 1
                        continue
                v = m[0]
                if kind == "mark":
                    if v in _OPEN:
                        brackets.append((v, m.start()))
                    elif v in ")]}":
                        if not brackets or _OPEN[brackets[-1][0]] != v:
                            self.fault(m.start(), f"unexpected {v!r}")
                        if brackets:
                            brackets.pop()
                self.push(kind, v, m.start())
            i = m.end()
        if brackets:
            self.fault(brackets[-1][1], f"{brackets[-1][0]!r} is never closed: the text ends before")
        if some:
            self.push("newline", "", n)
        for _ in indents[1:]:
            self.push("dedent", "", n)
        for _ in range(5):  # so that looking ahead stays inside
            self.push("end", "", n)

    def _string(self, i: int, prefix: str, start: int) -> int:
        text, quote = self.text, self.text[i]
        if text.startswith(quote * 3, i):
            quote *= 3
        i += len(quote)
        if "f" in prefix.lower():
            end, fault = self._formatted(i, quote, "r" in prefix.lower(), 0)
            if fault:
                self.fault(start, fault)
        else:
            m = _BODY[quote].match(text, i)
            end = m.end() if m else -1
            if end >= 0 and "b" in prefix.lower() and not text[i:end].isascii():
                self.fault(start, "a string of bytes holds other characters")
        if end < 0:
            self.fault(start, "open string" if len(quote) == 1 else "open string: the text ends before it")
            e = re.compile(r"[\n\r]").search(text, i)
            end = e.start() if e and len(quote) == 1 else len(text)
        self.push("text", "b" if "b" in prefix.lower() else "s", start)
        return end

    def _formatted(self, i: int, quote: str, raw: bool, nest: int) -> tuple[int, str]:
        """End of an f-string's body, and what is wrong with it."""
        text, n = self.text, len(self.text)
        while i < n:
            c = text[i]
            if text.startswith(quote, i):
                return i + len(quote), ""
            if c == "\\":
                if text.startswith("\\N{", i) and not raw:
                    e = text.find("}", i)
                    i = e + 1 if e >= 0 else n
                else:
                    i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
            elif c in "\n\r" and len(quote) == 1:
                return -1, ""
            elif text.startswith(("{{", "}}"), i):
                i += 2
            elif c == "}":
                return _skip(text, i, quote), "a single '}' in an f-string"
            elif c == "{":
                i, fault = self._field(i + 1, quote, raw, nest)
                if fault:
                    return _skip(text, i, quote), fault
                if i < 0:
                    return -1, ""
            else:
                i += 1
        return -1, ""

    def _field(self, i: int, quote: str, raw: bool, nest: int) -> tuple[int, str]:
        """Behind the ``}`` of a replacement field. Its expression is parsed by a parser of its own."""
        text, n, begin, level = self.text, len(self.text), i, 0
        while i < n:
            c = text[i]
            if c in "([{":
                level += 1
            elif c in ")]}" and level:
                level -= 1
            elif c == "#":
                return i, "a comment in an f-string" if len(quote) == 1 else ""
            elif c in "\"'" or c in "fFrRbBuU" and (m := re.compile(r"(?:[rRbBuUfF]{1,2})(?=[\"'])").match(text, i)) and (i == begin or not text[i - 1].isalnum()):
                m = re.compile(r"[rRbBuUfF]*").match(text, i)
                q = text[m.end()]
                q = q * 3 if text.startswith(q * 3, m.end()) else q
                if "f" in m[0].lower():
                    e, fault = self._formatted(m.end() + len(q), q, "r" in m[0].lower(), nest + 1)
                    if fault:
                        return i, fault
                else:
                    b = _BODY[q].match(text, m.end() + len(q))
                    e = b.end() if b else -1
                if e < 0:
                    return -1, ""
                i = e
                continue
            elif c in "\n\r" and len(quote) == 1 and not level and nest == 0 and False:
                return -1, ""
            elif level == 0 and (c == "}" or c == ":" or c == "!" and not text.startswith("!=", i) or c == "=" and text[i + 1 : i + 2] != "=" and text[i - 1] not in "=!<>:"):
                inner = text[begin:i]
                if not inner.strip():
                    return i, "an empty expression in an f-string"
                part = Python("(" + inner + ")\n")
                part.lex()
                if not part.faults:
                    try:
                        part.star_expressions()
                        if part.kinds[part.i] != "newline":
                            part.fail()
                    except Failed as f:
                        return i, "in an f-string: " + f.message
                else:
                    return i, "in an f-string: " + part.faults[0][1]
                if c == "=":
                    i = re.compile(r"=\s*").match(text, i).end()
                    c = text[i : i + 1]
                if c == "!":
                    if not re.compile(r"![rsa]\s*[:}]").match(text, i):
                        return i, "a bad conversion in an f-string"
                    i = re.compile(r"![rsa]\s*").match(text, i).end()
                    c = text[i]
                if c == ":":
                    i += 1
                    while i < n and text[i] != "}":
                        if text.startswith(quote, i) or text[i] in "\n\r" and len(quote) == 1:
                            return -1, ""
                        if text[i] == "{":
                            i, fault = self._field(i + 1, quote, raw, nest)
                            if fault or i < 0:
                                return i, fault
                        else:
                            i += 1
                    c = text[i : i + 1]
                if c != "}":
                    return i, "an f-string's field does not end"
                return i + 1, ""
            elif text.startswith(quote, i):
                return -1, ""
            i += 1
        return -1, ""

    # statements
    def parse(self) -> list[SyntaxFault]:
        self.lex()
        while self.kinds[self.i] != "end":
            self.guarded()
        return self.result()

    def guarded(self) -> None:
        depth = self.depth
        if self.kinds[self.i] in ("indent", "dedent", "newline"):
            if self.kinds[self.i] == "indent":
                self.fault(self.starts[self.i], "unexpected indentation")
            self.i += 1
            return
        try:
            self.statement()
        except Failed as f:
            self.depth = depth
            self.fault(f.at, f.message)
            # panic mode: to the next line
            while self.kinds[self.i] not in ("newline", "end", "dedent", "indent"):
                self.i += 1
            if self.kinds[self.i] == "newline":
                self.i += 1

    def fail(self, message: str = "") -> None:
        if not message and self.kinds[self.i] in ("newline", "dedent", "indent"):
            message = "the text ends too early" if self.kinds[self.i + 1 :] and all(k in ("dedent", "end", "newline") for k in self.kinds[self.i :]) else "unexpected end of line" if self.kinds[self.i] == "newline" else "unexpected indentation"
        super().fail(message)

    def at(self, value: str) -> bool:
        return self.values[self.i] == value and self.kinds[self.i] in ("name", "mark")

    def take(self, value: str) -> bool:
        if self.values[self.i] == value and self.kinds[self.i] in ("name", "mark"):
            self.i += 1
            return True
        return False

    def at_any(self, values) -> bool:
        return self.values[self.i] in values and self.kinds[self.i] in ("name", "mark")

    def name(self) -> None:
        if self.kinds[self.i] != "name" or self.values[self.i] in _KEYWORDS:
            self.fail()
        self.i += 1

    def newline(self) -> None:
        if self.kinds[self.i] != "newline":
            self.fail()
        self.i += 1

    def suite(self) -> None:
        self.need(":")
        if self.kinds[self.i] != "newline":
            self.simple_line()
            return
        self.i += 1
        if self.kinds[self.i] != "indent":
            raise Failed(self.starts[self.i], "an indented block is missing" if self.kinds[self.i] != "end" and not all(k in ("dedent", "end") for k in self.kinds[self.i :]) else "the text ends before an indented block")
        self.i += 1
        self.deeper()
        while self.kinds[self.i] not in ("dedent", "end"):
            self.guarded()
        if self.kinds[self.i] == "dedent":
            self.i += 1
        self.depth -= 1

    def statement(self) -> None:
        v = self.values[self.i] if self.kinds[self.i] == "name" else ""
        if v in _COMPOUND:
            getattr(self, "c_" + v)()
        elif self.at("@"):
            while self.take("@"):
                self.named()
                self.newline()
            if self.at("async"):
                self.i += 1
            if self.at("def"):
                self.c_def()
            elif self.at("class"):
                self.c_class()
            else:
                self.fail()
        elif v == "match" and self.soft_match():
            pass
        else:
            self.simple_line()

    def simple_line(self) -> None:
        self.simple()
        while self.take(";"):
            if self.kinds[self.i] == "newline":
                break
            self.simple()
        self.newline()

    def ended(self) -> bool:
        return self.kinds[self.i] in ("newline", "end") or self.at(";")

    def simple(self) -> None:
        v = self.values[self.i] if self.kinds[self.i] == "name" else ""
        if v in ("pass", "break", "continue"):
            self.i += 1
        elif v == "return":
            self.i += 1
            if not self.ended():
                self.star_expressions()
        elif v == "raise":
            self.i += 1
            if not self.ended():
                self.expression()
                if self.take("from"):
                    self.expression()
        elif v in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif v == "del":
            self.i += 1
            self.star_expressions()
        elif v == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif v == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif v == "from":
            self.i += 1
            dots = False
            while self.take(".") or self.take("..."):
                dots = True
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            paren = self.take("(")
            while True:
                self.name()
                if self.take("as"):
                    self.name()
                if not self.take(",") or paren and self.at(")"):
                    break
                if not paren and self.ended():
                    self.fail()
            if paren:
                self.need(")")
        elif v == "type" and self.kinds[self.i + 1] == "name" and self.values[self.i + 1] not in _KEYWORDS and (self.values[self.i + 2] in ("=", "[")):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def assignment(self) -> None:
        start = self.i
        if self.at("yield"):
            self.yield_()
        else:
            self.star_expressions()
        if self.take(":"):
            if not self.target(start, self.i - 1, single=True):
                self.i = start
                self.fail("this cannot be annotated")
            self.expression()
            if self.take("="):
                self.value()
            return
        if self.at_any(_AUGMENTED):
            if not self.target(start, self.i, single=True):
                self.fail("this cannot be assigned to")
            self.i += 1
            self.value()
            return
        begin = start
        while self.at("="):
            if not self.target(begin, self.i):
                self.fail("this cannot be assigned to")
            self.i += 1
            begin = self.i
            self.value()

    def target(self, a: int, b: int, single: bool = False) -> bool:
        """Whether tokens ``a`` to ``b`` may be assigned to: names, attributes, subscripts, and groups of these."""
        level, item = 0, a
        words = {"(", "[", "{"}
        parts: list[tuple[int, int]] = []
        for k in range(a, b):
            v, kind = self.values[k], self.kinds[k]
            if kind == "mark":
                if v in words:
                    level += 1
                elif v in (")", "]", "}"):
                    level -= 1
                elif v == "," and level == 0:
                    parts.append((item, k))
                    item = k + 1
        if item < b:
            parts.append((item, b))
        if single and len(parts) > 1:
            return False
        for x, y in parts:
            if self.values[x] == "*" and self.kinds[x] == "mark" and not single:
                x += 1
            if y <= x:
                return False
            first, last = self.values[x], self.values[y - 1]
            if self.kinds[y - 1] == "name":
                if last in _KEYWORDS or y - x > 1 and self.values[y - 2] != ".":
                    return False
                if y - x > 1:
                    continue
            elif self.kinds[y - 1] == "mark" and last == "]" and self.matching(x, y) != x:
                continue
            elif self.kinds[x] == "mark" and (first, last) in (("(", ")"), ("[", "]")) and self.matching(x, y) == x:
                if y - x > 2 and not self.target(x + 1, y - 1):
                    return False
                continue
            else:
                return False
        return True

    def matching(self, a: int, b: int) -> int:
        """Where the bracket opens that token ``b - 1`` closes."""
        level = 0
        for k in range(b - 1, a - 1, -1):
            if self.kinds[k] == "mark":
                if self.values[k] in (")", "]", "}"):
                    level += 1
                elif self.values[k] in ("(", "[", "{"):
                    level -= 1
                    if not level:
                        return k
        return -1

    def value(self) -> None:
        if self.at("yield"):
            self.yield_()
        else:
            self.star_expressions()

    def yield_(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif not (self.ended() or self.at_any((")", "]", "}", "="))):
            self.star_expressions()

    # compound statements
    def c_if(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        while self.take("elif"):
            self.named()
            self.suite()
        if self.take("else"):
            self.suite()

    def c_while(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        if self.take("else"):
            self.suite()

    def c_for(self) -> None:
        self.i += 1
        start = self.i
        self.targets()
        if not self.target(start, self.i):
            self.fail("this cannot be assigned to")
        self.need("in")
        self.star_expressions()
        self.suite()
        if self.take("else"):
            self.suite()

    def targets(self) -> None:
        while True:
            self.take("*")
            self.binary(5)
            if not self.take(",") or self.at("in"):
                return

    def c_try(self) -> None:
        self.i += 1
        self.suite()
        handlers = False
        while self.take("except"):
            handlers = True
            self.take("*")
            if not self.at(":"):
                self.expression()
                if self.at(","):
                    self.fail("several exceptions need parentheses")
                if self.take("as"):
                    self.name()
            self.suite()
        if handlers and self.take("else"):
            self.suite()
        if self.take("finally"):
            handlers = True
            self.suite()
        if not handlers:
            self.fail("'try' without 'except' or 'finally'" if self.kinds[self.i] != "end" else "")

    def c_with(self) -> None:
        self.i += 1
        mark = self.i
        if self.take("("):
            try:
                while True:
                    self.expression()
                    if self.take("as"):
                        self.star_target()
                    if not self.take(",") or self.at(")"):
                        break
                self.need(")")
                if self.at(":"):
                    self.suite()
                    return
            except Failed:
                pass
            self.i = mark
        while True:
            self.expression()
            if self.take("as"):
                self.star_target()
            if not self.take(","):
                break
        self.suite()

    def star_target(self) -> None:
        start = self.i
        self.postfix()
        if not self.target(start, self.i, single=True) and not self.values[start] in ("(", "["):
            self.fail("this cannot be assigned to")

    def c_async(self) -> None:
        self.i += 1
        v = self.values[self.i]
        if v == "def":
            self.c_def()
        elif v == "for":
            self.c_for()
        elif v == "with":
            self.c_with()
        else:
            self.fail()

    def c_def(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.suite()

    def type_parameters(self) -> None:
        if self.take("["):
            while not self.at("]"):
                if not self.take("**"):
                    self.take("*")
                self.name()
                if self.take(":"):
                    self.expression()
                if self.take("="):
                    self.star_expressions()
                if not self.take(","):
                    break
            self.need("]")

    def parameters(self, close: str, annotated: bool) -> None:
        default = star = False
        while not self.at(close):
            if self.take("/"):
                if star:
                    self.fail()
            elif self.take("**"):
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                self.take(",")
                if not self.at(close):
                    self.fail()
                return
            elif self.take("*"):
                if star:
                    self.fail()
                star = True
                if not self.at(","):
                    self.name()
                    if annotated and self.take(":"):
                        self.take("*")
                        self.expression()
                elif self.values[self.i + 1] in (close, "**"):
                    self.fail("named arguments must follow a bare *")
            else:
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without a default follows one with a default")
            if not self.take(","):
                return

    def c_class(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.suite()

    def soft_match(self) -> bool:
        start, faults = self.i, len(self.faults)
        self.i += 1
        if self.kinds[self.i] == "newline" or self.at_any(("=", ".", ",", ")", ":", ";")) or self.kinds[self.i] == "mark" and self.values[self.i] in _AUGMENTED:
            self.i = start
            return False
        try:
            self.star_expressions()
            if not (self.at(":") and self.kinds[self.i + 1] == "newline" and self.kinds[self.i + 2] == "indent" and self.values[self.i + 3] == "case"):
                raise Failed(0, "")
        except Failed:
            self.i = start
            del self.faults[faults:]
            return False
        self.i += 3
        while self.kinds[self.i] not in ("dedent", "end"):
            if not self.take("case"):
                self.fail()
            self.patterns()
            if self.take("if"):
                self.named()
            self.suite()
        if self.kinds[self.i] == "dedent":
            self.i += 1
        return True

    def patterns(self) -> None:
        while True:
            self.take("*")
            self.pattern()
            if not self.take(",") or self.at(":") or self.at("if"):
                return

    def pattern(self) -> None:
        self.deeper()
        while True:
            self.pattern_unit()
            if not self.take("|"):
                break
        if self.take("as"):
            self.name()
        self.depth -= 1

    def pattern_unit(self) -> None:
        kind, v = self.kinds[self.i], self.values[self.i]
        if kind == "text":
            while self.kinds[self.i] == "text":
                self.i += 1
        elif kind == "number" or v == "-":
            self.take("-")
            if self.kinds[self.i] != "number":
                self.fail()
            self.i += 1
            if self.at_any(("+", "-")):
                self.i += 1
                if self.kinds[self.i] != "number":
                    self.fail()
                self.i += 1
        elif v in ("None", "True", "False") and kind == "name":
            self.i += 1
        elif v in ("(", "[") and kind == "mark":
            self.i += 1
            while not self.at(_OPEN[v]):
                self.take("*")
                self.pattern()
                if not self.take(","):
                    break
            self.need(_OPEN[v])
        elif v == "{" and kind == "mark":
            self.i += 1
            while not self.at("}"):
                if self.take("**"):
                    self.name()
                else:
                    self.pattern_unit()
                    self.need(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.dotted()
            if self.take("("):
                while not self.at(")"):
                    if self.kinds[self.i] == "name" and self.values[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")

    # expressions
    def star_expressions(self) -> None:
        while True:
            if self.take("*"):
                self.binary(5)
            else:
                self.named()
            if not self.take(",") or self.ended() or self.at_any(("=", ")", "]", "}", ":")) or self.at_any(_AUGMENTED):
                return

    def named(self) -> None:
        if self.kinds[self.i] == "name" and self.values[self.i + 1] == ":=" and self.kinds[self.i + 1] == "mark":
            self.name()
            self.i += 1
        self.expression()

    def expression(self) -> None:
        self.deeper()
        if self.take("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.expression()
        else:
            self.binary(1)
            if self.take("if"):
                self.binary(1)
                self.need("else")
                self.expression()
        self.depth -= 1

    def binary(self, least: int) -> None:
        if self.at("not") and least <= 3:
            self.i += 1
            self.binary(3)
        else:
            self.unary()
        while True:
            v = self.values[self.i]
            if self.kinds[self.i] not in ("name", "mark"):
                return
            if v in _COMPARE and least <= 4:
                if v == "not":
                    if self.values[self.i + 1] != "in":
                        return
                    self.i += 1
                self.i += 1
                if v == "is":
                    self.take("not")
                self.binary(5)
                continue
            p = _BINARY.get(v, 0)
            if not p or p < least:
                return
            self.i += 1
            self.binary(p + 1)

    def unary(self) -> None:
        self.deeper()
        if self.kinds[self.i] == "mark" and self.values[self.i] in ("+", "-", "~"):
            self.i += 1
            self.unary()
        else:
            if self.at("await"):
                self.i += 1
            self.postfix()
            if self.take("**"):
                self.unary()
        self.depth -= 1

    def postfix(self) -> None:
        self.atom()
        while self.kinds[self.i] == "mark":
            if self.take("."):
                self.name()
            elif self.take("("):
                self.arguments()
            elif self.take("["):
                if self.at("]"):
                    self.fail()
                while not self.at("]"):
                    self.slice()
                    if not self.take(","):
                        break
                self.need("]")
            else:
                return

    def slice(self) -> None:
        if self.take("*"):
            self.binary(5)
            return
        if not self.at(":"):
            self.named()
        for _ in range(2):
            if self.take(":") and not self.at_any((":", "]", ",")):
                self.expression()

    def arguments(self) -> None:
        named = double = False
        while not self.at(")"):
            if self.take("**"):
                self.expression()
                double = True
            elif self.take("*"):
                self.expression()
            elif self.kinds[self.i] == "name" and self.values[self.i + 1] == "=" and self.kinds[self.i + 1] == "mark":
                self.name()
                self.i += 1
                self.expression()
                named = True
            else:
                if named or double:
                    mark = self.i
                    self.named()
                    if not self.at("for") and not self.at("async"):
                        self.i = mark
                        self.fail("a positional argument follows a named one")
                else:
                    self.named()
                if self.at("for") or self.at("async"):
                    self.comprehension()
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while self.at("for") or self.at("async"):
            self.take("async")
            self.need("for")
            start = self.i
            self.targets()
            if not self.target(start, self.i):
                self.fail("this cannot be assigned to")
            self.need("in")
            self.binary(1)
            while self.take("if"):
                if self.at("lambda"):
                    self.expression()
                elif self.kinds[self.i] == "name" and self.values[self.i + 1] == ":=":
                    self.named()
                else:
                    self.binary(1)

    def atom(self) -> None:
        kind, v = self.kinds[self.i], self.values[self.i]
        if kind == "number":
            self.i += 1
        elif kind == "text":
            first = v
            while self.kinds[self.i] == "text":
                if self.values[self.i] != first:
                    self.fail("strings of characters and of bytes are joined")
                self.i += 1
        elif kind == "name":
            if v in ("None", "True", "False"):
                self.i += 1
            else:
                self.name()
        elif kind == "mark" and v == "...":
            self.i += 1
        elif kind == "mark" and v in ("(", "["):
            self.deeper()
            self.i += 1
            close = _OPEN[v]
            if v == "(" and self.at("yield"):
                self.yield_()
            else:
                count = 0
                while not self.at(close):
                    star = self.take("*")
                    if star:
                        self.binary(5)
                    else:
                        self.named()
                    count += 1
                    if count == 1 and (self.at("for") or self.at("async")):
                        if star:
                            self.fail()
                        self.comprehension()
                        break
                    if not self.take(","):
                        if star and count == 1 and v == "(":
                            self.fail()
                        break
            self.need(close)
            self.depth -= 1
        elif kind == "mark" and v == "{":
            self.deeper()
            self.i += 1
            pairs: bool | None = None
            count = 0
            while not self.at("}"):
                if self.take("**"):
                    if pairs is False:
                        self.fail()
                    pairs = True
                    self.binary(5)
                elif self.take("*"):
                    if pairs:
                        self.fail()
                    pairs = False
                    self.binary(5)
                else:
                    self.named()
                    if self.take(":"):
                        if pairs is False:
                            self.fail()
                        pairs = True
                        self.expression()
                    elif pairs:
                        self.fail()
                    else:
                        pairs = False
                count += 1
                if count == 1 and (self.at("for") or self.at("async")):
                    self.comprehension()
                    break
                if not self.take(","):
                    break
            self.need("}")
            self.depth -= 1
        else:
            self.fail()


_COMPOUND = frozenset(n[2:] for n in dir(Python) if n.startswith("c_"))


def _skip(text: str, i: int, quote: str) -> int:
    e = text.find(quote, max(i, 0))
    return e + len(quote) if e >= 0 else len(text)


def refused(text: str) -> bool:
    """Whether Python's own parser refuses a text too deep for this one, and not for a bound on nesting of its own."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("﻿"))
    except SyntaxError as e:
        return not (e.msg or "").startswith("too many")
    except ValueError:
        return True
    except (RecursionError, MemoryError):
        return False
    return False
