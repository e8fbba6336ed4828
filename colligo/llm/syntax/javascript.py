"""JavaScript (ES2024), as a script or a module: what either allows is let pass."""

from __future__ import annotations

import re

from colligo.llm.syntax.base import Failed, Parser, SyntaxFault

_NAME = r"(?:[^\W\d]|\$|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:\w|\$|‌|‍|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_TOKEN = re.compile(
    r"(?P<line>\n|\r\n?| | )|(?P<space>[^\S\n\r  ]+|﻿)|(?P<comment>//[^\n\r]*|/\*.*?\*/)|(?P<name>#?" + _NAME + r")"
    r"|(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)n?)(?P<tail>[\w$]?)"
    r"|(?P<text>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|/(?!\*)|[{}()\[\];,<>+\-*%&|^!~?:=.@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => == === != !== && || ?? += -= *= %= <= >= ... ++ -- ** << >> >>> &= |= ^= &&= ||= ??= return typeof instanceof in of new delete void throw case do else yield await".split())
_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - typeof void delete".split())
_STOPS = frozenset("var let const function class if for while do switch try return throw import export break continue".split())


class JavaScript(Parser):
    def lex(self) -> None:
        text, i, n, fresh = self.text, 0, len(self.text), True
        self.newline: list[bool] = []
        braces: list[int] = []  # template nesting: braces open since each ${
        if text.startswith("﻿"):
            i = 1
        if text.startswith("#!", i):
            i = text.find("\n") if "\n" in text else n
        parens: list[bool] = []  # whether a parenthesis belongs to if, while, for or with
        after_head = False
        while i < n:
            c = text[i]
            last = self.values[-1] if self.values else ""
            if c == "/" and not text.startswith(("//", "/*"), i) and (not self.values or last in _BEFORE_REGEX and self.kinds[-1] in ("mark", "name") or after_head):
                m = _REGEX.match(text, i)
                if m:
                    self._add("regex", m[0], i, fresh)
                    i, fresh, after_head = m.end(), False, False
                    continue
            if c == "`" or c == "}" and braces and braces[-1] == 0:
                if c == "}":
                    braces.pop()
                j = self._template(i + 1)
                if j < 0:
                    self.fault(i, "open template string")
                    j = n
                    self._add("text", "`", i, fresh)
                elif text[j - 1] == "`":
                    self._add("end-template" if c == "}" else "text", "`", i, fresh)
                else:
                    self._add("mid-template" if c == "}" else "template", "`{", i, fresh)
                    braces.append(0)
                i, fresh = j, False
                continue
            m = _TOKEN.match(text, i)
            if not m:
                self.fault(i, "open string" if c in "\"'" else "open comment" if text.startswith("/*", i) else f"unexpected {c!r}")
                i += 1
                if c in "\"'":
                    e = re.compile(r"[\n\r]").search(text, i)
                    i = e.start() if e else n
                    self._add("text", "''", i, fresh)
                elif c == "/" and text.startswith("*", i):
                    i = n
                continue
            kind = m.lastgroup if m.lastgroup != "tail" else "number"
            i = m.end()
            if kind == "line":
                fresh = True
            elif kind == "comment":
                fresh = fresh or "\n" in m[0]
            elif kind != "space":
                if kind == "number" and m["tail"]:
                    self.fault(m.start(), "bad number")
                elif kind == "number" and re.match(r"0\d*[_n]|0\d+\.", m[0]) and not re.match(r"0[._n]", m[0]):
                    self.fault(m.start(), "bad number")
                if kind == "mark":
                    if m[0] == "{" and braces:
                        braces[-1] += 1
                    elif m[0] == "}" and braces:
                        braces[-1] -= 1
                    if m[0] == "(":
                        parens.append(last in ("if", "while", "for", "with"))
                after_head = kind == "mark" and m[0] == ")" and bool(parens) and parens.pop()
                self._add(kind, m[0], m.start(), fresh)
                fresh = False
        for _ in range(4):  # so that looking ahead stays inside
            self._add("end", "", n, True)

    def _add(self, kind: str, value: str, start: int, fresh: bool) -> None:
        self.push(kind, value, start)
        self.newline.append(fresh)

    def _template(self, i: int) -> int:
        """Behind the closing back quote or the ``${`` of a template's next part."""
        m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)").match(self.text, i)
        return m.end() if m else -1

    # statements
    def parse(self) -> list[SyntaxFault]:
        self.lex()
        self.statements("")
        return self.result()

    def statements(self, close: str) -> None:
        while True:
            if close and self.at(close):
                return
            if self.kinds[self.i] == "end":
                if close:
                    raise Failed(self.starts[self.i], "the text ends before '}'")
                return
            depth = self.depth
            try:
                self.statement()
            except Failed as f:
                self.depth = depth
                self.recover(f, _STOPS)
                if self.at("}") and not close:
                    self.i += 1

    def semicolon(self) -> None:
        if not (self.take(";") or self.at("}") or self.newline[self.i]):
            self.fail()

    def block(self) -> None:
        self.need("{")
        self.deeper()
        self.statements("}")
        self.need("}")
        self.depth -= 1

    def statement(self) -> None:
        self.deeper()
        v, kind = self.values[self.i], self.kinds[self.i]
        nxt = self.values[self.i + 1] if kind != "end" else ""
        if kind == "mark" and v == "{":
            self.block()
        elif kind == "mark" and v == ";":
            self.i += 1
        elif kind == "mark" and v == "@":
            self.decorators()
            self.statement()
        elif kind == "name" and v in _WORDS and not (v in ("let", "async", "import") and not self.word_statement(v, nxt)):
            getattr(self, "s_" + v)()
        elif kind == "name" and nxt == ":" and v not in _RESERVED:
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.semicolon()
        self.depth -= 1

    def word_statement(self, v: str, nxt: str) -> bool:
        if v == "let":
            return self.kinds[self.i + 1] == "name" and nxt not in ("in", "instanceof", "of") or nxt in ("[", "{")
        if v == "async":
            return nxt == "function" and not self.newline[self.i + 1]
        return nxt not in ("(", ".")

    def s_var(self, in_for: bool = False) -> None:
        self.i += 1
        while True:
            pattern = self.at_any(("[", "{"))
            self.binding()
            if self.take("="):
                self.assignment(not in_for)
            elif pattern and not in_for:
                self.fail("a pattern needs a value")
            if not self.take(","):
                break
        if not in_for:
            self.semicolon()

    s_let = s_const = s_var

    def s_function(self) -> None:
        self.function(True)

    def s_async(self) -> None:
        self.i += 1
        self.function(True)

    def function(self, named: bool) -> None:
        self.need("function")
        self.take("*")
        if self.kinds[self.i] == "name":
            self.identifier()
        elif named:
            self.fail()
        self.parameters()
        self.block()

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            rest = self.take("...")
            self.binding()
            if not rest and self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need(")")

    def identifier(self) -> None:
        if self.kinds[self.i] != "name" or self.values[self.i] in _RESERVED or self.values[self.i][0] == "#":
            self.fail()
        self.i += 1

    def binding(self) -> None:
        self.deeper()
        if self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.need("]")
        elif self.take("{"):
            while not self.at("}"):
                if self.take("..."):
                    self.binding()
                else:
                    plain = self.kinds[self.i] == "name"
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.identifier()
        self.depth -= 1

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.kinds[self.i] in ("name", "text", "number"):
            self.i += 1
        else:
            self.fail()

    def decorators(self) -> None:
        while self.take("@"):
            self.unary()

    def s_class(self) -> None:
        self.need("class")
        if self.kinds[self.i] == "name" and not self.at("extends"):
            self.identifier()
        if self.take("extends"):
            self.unary()
        self.need("{")
        while not self.at("}"):
            if self.kinds[self.i] == "end":
                self.fail()
            if self.take(";"):
                continue
            depth = self.depth
            try:
                self.member()
            except Failed as f:
                self.depth = depth
                self.recover(f, frozenset())
                if self.kinds[self.i] == "end":
                    raise Failed(self.starts[self.i], "the text ends before '}'") from None
        self.need("}")

    def member(self) -> None:
        self.decorators()
        stop = ("(", "=", ";", "}", ",")
        if self.at("static"):
            if self.values[self.i + 1] == "{":
                self.i += 1
                self.block()
                return
            if self.values[self.i + 1] not in stop:
                self.i += 1
        for word in ("async", "get", "set", "accessor"):
            if self.at(word) and self.values[self.i + 1] not in stop and not (word == "async" and self.newline[self.i + 1]):
                self.i += 1
                break
        self.take("*")
        self.property_name()
        if self.at("("):
            self.parameters()
            self.block()
        else:
            if self.take("="):
                self.assignment()
            self.semicolon()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.at(";"):
            if self.at("var") or self.at("const") or self.at("let") and self.word_statement("let", self.values[self.i + 1]):
                self.s_var(True)
            else:
                self.expression(False)
        if self.take("of"):
            self.assignment()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.i += 1
        if not (self.at(";") or self.at("}") or self.newline[self.i]):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.i += 1
        if self.newline[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def s_break(self) -> None:
        self.i += 1
        if self.kinds[self.i] == "name" and not self.newline[self.i]:
            self.identifier()
        self.semicolon()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.take("catch"):
            done = True
            if self.take("("):
                self.binding()
                self.need(")")
            self.block()
        if self.take("finally"):
            done = True
            self.block()
        if not done:
            self.fail()

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.at("}"):
            if self.take("case"):
                self.expression()
            elif not self.take("default"):
                self.fail()
            self.need(":")
            while not self.at_any(("case", "default", "}")):
                if self.kinds[self.i] == "end":
                    self.fail()
                self.statement()
        self.need("}")

    def s_import(self) -> None:
        self.i += 1
        if self.kinds[self.i] == "text":
            self.i += 1
        else:
            if self.kinds[self.i] == "name":
                self.identifier()
                more = self.take(",")
            else:
                more = True
            if more:
                if self.take("*"):
                    self.need("as")
                    self.identifier()
                else:
                    self.names()
            self.need("from")
            self.string()
        self.attributes()
        self.semicolon()

    def names(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.kinds[self.i] not in ("name", "text"):
                self.fail()
            self.i += 1
            if self.take("as"):
                if self.kinds[self.i] not in ("name", "text"):
                    self.fail()
                self.i += 1
            if not self.take(","):
                break
        self.need("}")

    def string(self) -> None:
        if self.kinds[self.i] != "text":
            self.fail()
        self.i += 1

    def attributes(self) -> None:
        if self.at("with") and not self.newline[self.i] or self.at("assert"):
            self.i += 1
            self.primary()

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function") or self.at("async") and self.values[self.i + 1] == "function":
                self.take("async")
                self.function(False)
            elif self.at_any(("class", "@")):
                self.decorators()
                self.s_class()
            else:
                self.assignment()
                self.semicolon()
        elif self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.string()
            self.attributes()
            self.semicolon()
        elif self.at("{"):
            self.names()
            if self.take("from"):
                self.string()
                self.attributes()
            self.semicolon()
        elif self.at_any(("var", "let", "const", "function", "async", "class", "@")):
            self.statement()
        else:
            self.fail()

    # expressions
    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.take(","):
            self.assignment(allow_in)

    def assignment(self, allow_in: bool = True) -> None:
        self.deeper()
        if self.arrow():
            self.depth -= 1
            return
        if self.at("yield") and self.values[self.i + 1] not in (".", "=", "("):
            self.i += 1
            self.take("*")
            if not (self.newline[self.i] or self.at_any((")", "]", "}", ",", ";", ":")) or self.kinds[self.i] == "end"):
                self.assignment(allow_in)
            self.depth -= 1
            return
        start = self.i
        self.binary(1, allow_in)
        if self.take("?"):
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
        elif self.at_any(_ASSIGN):
            if not self.target(start):
                self.fail("this cannot be assigned to")
            self.i += 1
            self.assignment(allow_in)
        self.depth -= 1

    def target(self, start: int) -> bool:
        """Whether the tokens from ``start`` may stand left of ``=``."""
        last, kind = self.values[self.i - 1], self.kinds[self.i - 1]
        if self.i - start == 1:
            return kind == "name" and last not in _RESERVED
        return kind == "name" and self.values[self.i - 2] in (".", "?.") or kind == "mark" and last in ("]", "}", ")")

    def arrow(self) -> bool:
        """Parses an arrow function if one begins here."""
        i = self.i
        if self.at("async") and not self.newline[i + 1] and (self.kinds[i + 1] == "name" and self.values[i + 2] == "=>" or self.values[i + 1] == "(" and self._arrow_after(i + 1)):
            self.i += 1
        elif not (self.kinds[i] == "name" and self.values[i + 1] == "=>" or self.at("(") and self._arrow_after(i)):
            return False
        if self.at("("):
            self.parameters()
        else:
            self.identifier()
        self.need("=>")
        if self.at("{"):
            self.block()
        else:
            self.assignment()
        return True

    def _arrow_after(self, i: int) -> bool:
        level = 0
        while self.kinds[i] != "end":
            if self.kinds[i] == "mark":
                v = self.values[i]
                if v in ("(", "[", "{"):
                    level += 1
                elif v in (")", "]", "}"):
                    level -= 1
                    if level == 0:
                        return self.values[i + 1] == "=>" and not self.newline[i + 1]
            i += 1
        return False

    def binary(self, least: int, allow_in: bool) -> None:
        self.unary()
        while True:
            op = self.values[self.i]
            p = _BINARY.get(op, 0) if self.kinds[self.i] in ("mark", "name") else 0
            if p < least or op == "in" and not allow_in or not p:
                return
            self.i += 1
            self.binary(p if op == "**" else p + 1, allow_in)

    def unary(self) -> None:
        self.deeper()
        v, kind = self.values[self.i], self.kinds[self.i]
        if kind in ("mark", "name") and (v in _UNARY or v in ("++", "--") or v == "await" and self.values[self.i + 1] not in (".", "=", ",", ")", ";", "=>", ":", "]", "}")):
            self.i += 1
            self.unary()
        else:
            self.postfix()
        self.depth -= 1

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.kinds[self.i] == "mark":
                v = self.values[self.i]
                if v in (".", "?."):
                    self.i += 1
                    if v == "?." and self.at_any(("(", "[")):
                        continue
                    if v == "?." and self.kinds[self.i] in ("text", "template") and self.values[self.i][0] == "`":
                        self.fail()
                    if self.kinds[self.i] != "name":
                        self.fail()
                    self.i += 1
                    continue
                if v == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                    continue
                if v == "(":
                    self.arguments()
                    continue
                if v in ("++", "--") and not self.newline[self.i]:
                    self.i += 1
                return
            if self.kinds[self.i] in ("text", "template") and self.values[self.i][0] == "`":
                self.template()
                continue
            return

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.need(")")

    def template(self) -> None:
        if self.kinds[self.i] == "text":
            self.i += 1
            return
        self.i += 1
        while True:
            self.expression()
            if self.kinds[self.i] == "mid-template":
                self.i += 1
                continue
            if self.kinds[self.i] != "end-template":
                self.fail()
            self.i += 1
            return

    def primary(self) -> None:
        kind, v = self.kinds[self.i], self.values[self.i]
        if kind in ("number", "regex") or kind == "text" and v[0] != "`":
            self.i += 1
        elif kind in ("text", "template"):
            self.template()
        elif kind == "name":
            if v == "function":
                self.function(False)
            elif v == "async" and self.values[self.i + 1] == "function" and not self.newline[self.i + 1]:
                self.i += 1
                self.function(False)
            elif v == "class":
                self.s_class()
            elif v == "new":
                self.i += 1
                if self.take("."):
                    self.i += 1
                    return
                self.deeper()
                self.primary()
                while self.at(".") or self.at("["):
                    if self.take("."):
                        if self.kinds[self.i] != "name":
                            self.fail()
                        self.i += 1
                    else:
                        self.i += 1
                        self.expression()
                        self.need("]")
                if self.at("("):
                    self.arguments()
                self.depth -= 1
            elif v == "import":
                self.i += 1
                if not self.at_any(("(", ".")):
                    self.fail()
            elif v in ("this", "null", "true", "false", "super"):
                self.i += 1
            elif v[0] == "#":
                self.i += 1
                if not self.at("in"):
                    self.fail()
            else:
                self.identifier()
        elif kind == "mark" and v == "(":
            self.i += 1
            self.deeper()
            self.expression()
            self.need(")")
            self.depth -= 1
        elif kind == "mark" and v == "[":
            self.i += 1
            self.deeper()
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.at("]"):
                    self.need(",")
            self.need("]")
            self.depth -= 1
        elif kind == "mark" and v == "{":
            self.deeper()
            self.literal()
            self.depth -= 1
        elif kind == "mark" and v == "@":
            self.decorators()
            self.s_class()
        else:
            self.fail()

    def literal(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.take("..."):
                self.assignment()
            else:
                stop = (",", ":", "(", "}", "=")
                start = self.i
                for word in ("async", "get", "set"):
                    if self.at(word) and self.values[self.i + 1] not in stop:
                        self.i += 1
                        break
                star = self.take("*")
                plain = self.kinds[self.i] == "name"
                word = self.values[self.i]
                self.property_name()
                if self.at("("):
                    self.parameters()
                    self.block()
                elif self.i - start > 1 and plain and star:
                    self.fail()
                elif self.take(":"):
                    self.assignment()
                elif not plain or word in _RESERVED:
                    self.fail()
                elif self.take("="):  # only a pattern may have it; patterns are read as literals first
                    self.assignment()
            if not self.take(","):
                break
        self.need("}")


_WORDS = frozenset(n[2:] for n in dir(JavaScript) if n.startswith("s_"))
