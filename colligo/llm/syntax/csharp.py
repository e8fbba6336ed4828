"""C# 12: compilation units, types, members, statements, expressions, patterns, queries, raw and interpolated strings."""

from __future__ import annotations

import re

from colligo.llm.syntax.base import Failed, Parser, SyntaxFault

_TOKEN = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<comment>//[^\n\r]*|/\*.*?\*/)"
    r"|(?P<name>@?[^\W\d]\w*|@?\\u[0-9a-fA-F]{4}\w*)"
    r"|(?P<number>0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[uUlL]*|0[bB][01](?:_*[01])*[uUlL]*|(?:\d(?:_*\d)*(?:\.\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?(?:[fFdDmM]|[uUlL]{1,2})?)(?P<tail>\w?)"
    r"|(?P<raw>\"\"\"+)|(?P<text>@\"(?:[^\"]|\"\")*\"(?:u8)?|\"(?:[^\"\\\n\r]|\\[^\n\r])*\"(?:u8)?|'(?:[^'\\\n\r]|\\[^\n\r]{1,9}?)'(?!'))"
    r"|(?P<mark>\?\?=|<<=|\.\.(?!\.)|::|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|->|<<|/(?!\*)|[{}()\[\];,<>+\-*%&|^!~?:=.])",
    re.S,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?P<word>\w+)(?P<rest>[^\n\r]*)")
_DIRECTIVES = frozenset("if elif else endif define undef region endregion pragma nullable line error warning r load".split())
_KEYWORDS = frozenset("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())
_BUILTIN = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort object string void".split())
_MODIFIERS = frozenset("abstract async const extern file fixed internal new override partial private protected public readonly required sealed static unsafe virtual volatile ref event".split())
_TYPE_WORDS = frozenset("class struct interface enum record delegate".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "is": 8, "as": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "switch": 12, "with": 12, "..": 13}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= ??= >>= >>>=".split())
_AFTER_GENERIC = frozenset("( ) ] } : ; , . ? == != | ^ && || & [ => > ?. ?? { =".split())
_STOPS = frozenset("public private protected internal static class struct interface enum record namespace using return if for foreach while do switch try throw var case default".split())
#: Words that end a pattern rather than name what it matched.
_NO_NAME = frozenset("and or when not from where select group into orderby join let in on equals by ascending descending".split())


class CSharp(Parser):
    def lex(self) -> None:
        text, i, n = self.text, 0, len(self.text)
        conditions = regions = 0
        fresh = True
        while i < n:
            c = text[i]
            if fresh and c in "# \t﻿":
                m = _DIRECTIVE.match(text, i + (c == "﻿"))
                if m:
                    word = m["word"]
                    if word not in _DIRECTIVES:
                        self.fault(i, f"unknown directive {word[:20]!r}")
                    conditions += (word == "if") - (word == "endif")
                    regions += (word == "region") - (word == "endregion")
                    if conditions < 0 or regions < 0 or word in ("elif", "else") and conditions == 0:
                        self.fault(i, f"#{word} without a beginning")
                        conditions, regions = max(0, conditions), max(0, regions)
                    i = m.end()
                    continue
            if c in "$@" and (m := re.compile(r"(?:\$+@?|@\$+)(?=\")").match(text, i)):
                end = self._interpolated(m.end(), m[0].count("$"), "@" in m[0])
                self.push("text", "$", i)
                if end < 0:
                    self.fault(i, "open string")
                    e = re.compile(r"[\n\r]").search(text, i)
                    end = e.start() if e else n
                i, fresh = end, False
                continue
            m = _TOKEN.match(text, i)
            if not m:
                self.fault(i, "open string" if c in "\"'@" else "open comment" if text.startswith("/*", i) else f"unexpected {c!r}")
                if text.startswith("/*", i):
                    i = n
                elif c in "\"'@":
                    e = re.compile(r"[\n\r]").search(text, i)
                    i = e.start() if e and c != "@" else n
                    self.push("text", '""', i)
                else:
                    i += 1
                continue
            kind = m.lastgroup if m.lastgroup != "tail" else "number"
            if kind == "raw":
                end = self._raw(m.end(), len(m[0]))
                self.push("text", '"""', i)
                if end < 0:
                    self.fault(i, "open string")
                    end = n
                i, fresh = end, False
                continue
            if kind == "space":
                fresh = fresh or "\n" in m[0] or "\r" in m[0]
            elif kind == "comment":
                fresh = fresh and True or "\n" in m[0]
            else:
                fresh = False
                if kind == "number" and m["tail"]:
                    self.fault(m.start(), "bad number")
                if kind == "name" and m[0][0] == "@":
                    self.push("word", m[0], i)  # an escaped name is never a keyword
                else:
                    self.push("name" if kind == "name" else kind, m[0], i)
            i = m.end()
        if conditions:
            self.fault(n, "the text ends before #endif")
        if regions:
            self.fault(n, "the text ends before #endregion")
        self.push("end", "", n)
        self.values += ["", "", ""]
        self.kinds += ["end", "end", "end"]
        self.starts += [n, n, n]

    def _raw(self, i: int, quotes: int) -> int:
        m = re.compile(r'"{%d,}' % quotes).search(self.text, i)
        return m.end() if m else -1

    def _interpolated(self, i: int, dollars: int, verbatim: bool) -> int:
        """End of an interpolated string whose opening quote stands at ``i``."""
        text, n = self.text, len(self.text)
        if text.startswith('"""', i) and not verbatim:
            m = re.compile(r'"{3,}').match(text, i)
            return self._raw(m.end(), len(m[0]))
        i += 1
        while i < n:
            c = text[i]
            if c == '"':
                if verbatim and text.startswith('""', i):
                    i += 2
                    continue
                return i + 1
            if c == "\\" and not verbatim:
                i += 2
            elif c in "\n\r" and not verbatim:
                return -1
            elif c == "{" and text.startswith("{{", i) or c == "}":
                i += 2 if text.startswith(("{{", "}}"), i) else 1
                if c == "}" and not text.startswith("}}", i - 2):
                    return -1
            elif c == "{":
                level = 1
                i += 1
                while i < n and level:
                    d = text[i]
                    if d in "{([":
                        level += 1
                    elif d in "})]":
                        level -= 1
                    elif d in "\"'" or d in "$@" and re.compile(r'[$@]+"').match(text, i):
                        m = re.compile(r"[$@]*").match(text, i)
                        if "$" in m[0]:
                            e = self._interpolated(m.end(), 1, "@" in m[0])
                        else:
                            t = _TOKEN.match(text, i)
                            e = t.end() if t and t.lastgroup == "text" else -1
                        if e < 0:
                            return -1
                        i = e
                        continue
                    i += 1
                if level:
                    return -1
            else:
                i += 1
        return -1

    def parse(self) -> list[SyntaxFault]:
        self.lex()
        if self.kinds[0] != "end":
            self.members(top=True)
        return self.result()

    # names and types
    def is_name(self, i: int | None = None) -> bool:
        i = self.i if i is None else i
        return self.kinds[i] == "word" or self.kinds[i] == "name" and self.values[i] not in _KEYWORDS

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def try_type(self, nullable: bool = True) -> bool:
        """Moves over a type; else stays and says so."""
        start = self.i
        if self.take("ref"):
            self.take("readonly")
        if self.take("("):
            count = 0
            while True:
                if not self.try_type():
                    self.i = start
                    return False
                if self.is_name():
                    self.i += 1
                count += 1
                if not self.take(","):
                    break
            if count < 2 or not self.take(")"):
                self.i = start
                return False
        elif self.kinds[self.i] == "name" and self.values[self.i] in _BUILTIN:
            self.i += 1
        elif self.at("delegate") and self.values[self.i + 1] == "*":
            self.i += 2
            while self.is_name():
                self.i += 1
            if not self.try_arguments():
                self.i = start
                return False
        elif self.is_name():
            while True:
                self.i += 1
                if self.at("<") and not self.try_arguments():
                    break
                if (self.at(".") or self.at("::")) and self.is_name(self.i + 1):
                    self.i += 1
                    continue
                break
        else:
            self.i = start
            return False
        while True:
            if self.at("?") and nullable:
                self.i += 1
            elif self.at("*"):
                self.i += 1
            elif self.at("[") and (self.values[self.i + 1] in ("]", ",")):
                j = self.i + 1
                while self.values[j] == ",":
                    j += 1
                if self.values[j] != "]":
                    break
                self.i = j + 1
            else:
                break
        return True

    def try_arguments(self) -> bool:
        start = self.i
        self.i += 1
        if self.at(">") or self.at(","):
            while self.take(","):
                pass
            if self.take(">"):
                return True
            self.i = start
            return False
        while True:
            if self.at("["):
                self.attributes()
            for word in ("in", "out"):
                self.take(word)
            if not self.try_type():
                self.i = start
                return False
            if not self.take(","):
                break
        if not self.take(">"):
            self.i = start
            return False
        return True

    def type(self) -> None:
        if not self.try_type():
            self.fail()

    def qualified(self) -> None:
        self.name()
        while self.take(".") or self.take("::"):
            self.name()

    def attributes(self) -> None:
        while self.at("["):
            self.i += 1
            if self.kinds[self.i] == "name" and self.values[self.i + 1] == ":":
                self.i += 2
            while not self.at("]"):
                self.qualified()
                if self.at("<"):
                    self.try_arguments()
                if self.at("("):
                    self.call_arguments()
                if not self.take(","):
                    break
            self.need("]")

    # declarations
    def members(self, top: bool = False, owner: str = "") -> None:
        while True:
            if self.kinds[self.i] == "end":
                if not top:
                    raise Failed(self.starts[self.i], "the text ends before '}'")
                return
            if self.at("}"):
                if not top:
                    return
                self.fault(self.starts[self.i], "unexpected '}'")
                self.i += 1
                continue
            depth = self.depth
            try:
                self.member(top, owner)
            except Failed as f:
                self.depth = depth
                self.recover(f, _STOPS)

    def member(self, top: bool, owner: str) -> None:
        if self.take(";"):
            return
        if owner in ("", "namespace"):
            if self.at("extern") and self.values[self.i + 1] == "alias":
                self.i += 2
                self.name()
                self.need(";")
                return
            if (self.at("using") or self.at("global") and self.values[self.i + 1] == "using") and self.values[self.i + (2 if self.at("global") else 1)] not in ("(", "var") and self.using_directive():
                return
            if self.at("namespace"):
                self.i += 1
                self.qualified()
                if self.take(";"):
                    return
                self.need("{")
                self.deeper()
                self.members(owner="namespace")
                self.need("}")
                self.take(";")
                self.depth -= 1
                return
        self.attributes()
        start = self.i
        while self.kinds[self.i] == "name" and self.values[self.i] in _MODIFIERS and not (self.values[self.i] in ("partial", "async", "required", "file") and self.values[self.i + 1] in ("=", "(", ".", ";", ",", ")", "=>")):
            if self.at("fixed") and owner == "":
                break
            self.i += 1
        modified = self.i > start
        v = self.values[self.i]
        if v in _TYPE_WORDS and self.kinds[self.i] == "name" and not (v == "record" and not (self.is_name(self.i + 1) or self.values[self.i + 1] in ("struct", "class"))) and not (v == "delegate" and self.values[self.i + 1] in ("*", "(", "{")):
            self.type_declaration(v)
            return
        if owner == "":
            if modified and v in ("void",) or modified and not (start + 1 == self.i and self.values[start] in ("static", "async", "const", "unsafe", "ref", "readonly", "fixed", "new")):
                self.fail() if not (self.try_member_head()) else None
                return
            self.i = start
            self.statement()
            return
        if owner == "namespace":
            self.fail()
        self.class_member()

    def try_member_head(self) -> bool:
        """A member at the top level: a local function with modifiers."""
        self.class_member()
        return True

    def using_directive(self) -> bool:
        start = self.i
        self.take("global")
        self.i += 1
        self.take("static")
        self.take("unsafe")
        if self.is_name() and self.values[self.i + 1] == "=":
            self.i += 2
            if not self.try_type():
                self.fail()
        elif not self.try_type():
            self.fail()
        if self.take(";"):
            return True
        if self.is_name() and self.values[self.i + 1] == "=":  # using declaration of a variable
            self.i = start
            return False
        self.fail()
        return False

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.attributes()
                if not self.take("in"):
                    self.take("out")
                self.name()
                if not self.take(","):
                    break
            self.need(">")

    def constraints(self) -> None:
        while self.at("where") and self.is_name(self.i + 1):
            self.i += 1
            self.name()
            self.need(":")
            while True:
                if self.at("new"):
                    self.i += 1
                    self.need("(")
                    self.need(")")
                elif self.at("default"):
                    self.i += 1
                elif self.at("class") or self.at("struct"):
                    self.i += 1
                    self.take("?")
                else:
                    self.type()
                if not self.take(","):
                    break

    def type_declaration(self, word: str) -> None:
        self.i += 1
        if word == "delegate":
            self.type()
            self.name()
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.need(";")
            return
        if word == "record" and not self.take("struct"):
            self.take("class")
        self.name()
        self.type_parameters()
        if self.at("("):
            self.parameters()
        if self.take(":"):
            while True:
                self.type()
                if self.at("("):
                    self.call_arguments()
                if not self.take(","):
                    break
        self.constraints()
        if self.take(";"):
            return
        self.need("{")
        self.deeper()
        if word == "enum":
            while not self.at("}"):
                self.attributes()
                self.name()
                if self.take("="):
                    self.expression()
                if not self.take(","):
                    break
        else:
            self.members(owner=word)
        self.need("}")
        self.take(";")
        self.depth -= 1

    def class_member(self) -> None:
        v = self.values[self.i]
        if v == "~":
            self.i += 1
            self.name()
            self.parameters()
            self.body()
            return
        if self.is_name() and self.values[self.i + 1] == "(":  # constructor
            self.i += 1
            self.parameters()
            if self.take(":"):
                if not (self.take("base") or self.take("this")):
                    self.fail()
                self.call_arguments()
            self.body()
            return
        if v in ("implicit", "explicit"):
            self.i += 1
            self.operator(True)
            return
        if v == "static" and self.values[self.i + 1] == "{":
            self.fail()
        self.type()
        if self.at("operator"):
            self.operator(False)
            return
        if self.at("this") and self.values[self.i + 1] == "[":
            self.indexer()
            return
        # explicit interface names: Some.Type<T>.Member
        self.name()
        while self.at("<") or self.at(".") or self.at("::"):
            if self.at("<"):
                mark = self.i
                if not self.try_arguments():
                    self.i = mark
                    self.type_parameters()
            else:
                self.i += 1
                if self.at("this"):
                    self.indexer()
                    return
                if self.at("operator"):
                    self.operator(False)
                    return
                self.name()
        if self.at("("):
            self.parameters()
            self.constraints()
            self.body()
        elif self.at("{") or self.at("=>"):
            self.accessors()
        else:
            self.declarators()
            self.need(";")

    def operator(self, conversion: bool) -> None:
        self.need("operator")
        self.take("checked")
        if conversion:
            self.type()
        elif self.kinds[self.i] == "mark" or self.at("true") or self.at("false"):
            self.i += 1
            while self.at(">") or self.at("="):
                self.i += 1
        else:
            self.fail()
        self.parameters()
        self.body()

    def indexer(self) -> None:
        self.need("this")
        self.need("[")
        self.parameter_list("]")
        self.need("]")
        self.accessors()

    def accessors(self) -> None:
        if self.take("=>"):
            self.expression()
            self.need(";")
            return
        self.need("{")
        while not self.at("}"):
            self.attributes()
            while self.at_any(("public", "private", "protected", "internal", "readonly")):
                self.i += 1
            if not self.at_any(("get", "set", "init", "add", "remove")):
                self.fail()
            self.i += 1
            self.body()
        self.need("}")
        if self.take("="):
            self.initial()
            self.need(";")

    def body(self) -> None:
        if self.take(";"):
            return
        if self.take("=>"):
            self.take("ref")
            self.expression()
            self.need(";")
            return
        self.block()

    def parameters(self) -> None:
        self.need("(")
        self.parameter_list(")")
        self.need(")")

    def parameter_list(self, close: str) -> None:
        while not self.at(close):
            self.attributes()
            while self.at_any(("this", "ref", "out", "in", "params", "scoped", "readonly")) and not (self.at("scoped") and self.values[self.i + 1] in (",", ")", "=")):
                self.i += 1
            self.type()
            self.name()
            if self.take("="):
                self.expression()
            if not self.take(","):
                return
            if self.at(close):
                self.fail()

    def declarators(self) -> None:
        """After the first name: ``= value, name = value …``."""
        while True:
            if self.at("[") and self.values[self.i + 1] != "]":  # fixed buffer
                self.i += 1
                self.expression()
                self.need("]")
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.name()

    def initial(self) -> None:
        self.take("ref")
        if self.at("{"):
            self.collection()
        else:
            self.expression()

    # statements
    def block(self) -> None:
        self.need("{")
        self.deeper()
        while not self.at("}"):
            if self.kinds[self.i] == "end":
                raise Failed(self.starts[self.i], "the text ends before '}'")
            depth = self.depth
            try:
                self.statement()
            except Failed as f:
                self.depth = depth
                self.recover(f, _STOPS)
        self.need("}")
        self.depth -= 1

    def statement(self) -> None:
        self.deeper()
        if self.at("["):
            mark = self.i
            try:
                self.attributes()
            except Failed:
                self.i = mark
            if self.i > mark and self.at_any((";", ".", "=", ",", "]", "[")):
                self.i = mark
        v, kind = self.values[self.i], self.kinds[self.i]
        nxt = self.values[self.i + 1]
        if kind == "mark" and v == "{":
            self.block()
        elif kind == "mark" and v == ";":
            self.i += 1
        elif kind == "name" and (f := _STATEMENTS.get(v)) and not (v in ("checked", "unchecked") and nxt == "(") and not (v == "unsafe" and nxt != "{") and not (v == "yield" and nxt not in ("return", "break")) and not (v == "await" and nxt not in ("foreach", "using")):
            f(self)
        elif self.is_name() and nxt == ":" :
            self.i += 2
            self.statement()
        elif not self.declaration():
            self.expression()
            self.need(";")
        self.depth -= 1

    def declaration(self) -> bool:
        """A local variable or function, if one begins here."""
        start = self.i
        while self.at_any(("const", "static", "async", "unsafe", "scoped", "extern", "readonly")) and (self.is_name(self.i + 1) or self.values[self.i + 1] in _BUILTIN or self.values[self.i + 1] in ("(", "static", "async", "unsafe", "extern", "ref")):
            self.i += 1
        constant = self.i > start and self.values[start] == "const"
        if self.at("var") and self.values[self.i + 1] == "(":
            mark = self.i
            self.i += 1
            try:
                self.designation()
                if self.take("="):
                    self.expression()
                    self.need(";")
                    return True
            except Failed:
                pass
            self.i = mark
        if not self.try_type() or not self.is_name() or self.kinds[self.i] == "name" and self.values[self.i] in ("is", "as", "switch", "with") or not (self.values[self.i + 1] in ("=", ";", ",", "(", "<", "[", ")", "}") or self.kinds[self.i + 1] == "end" or self.i > start + 1 or True):
            self.i = start
            return False
        if self.values[self.i + 1] in (".", "?.", "++", "--") or self.values[self.i] in ("and", "or", "in", "when", "into", "on", "equals", "by") and self.values[self.i + 1] not in ("=", ";", ","):
            self.i = start
            return False
        self.name()
        if self.at("(") or self.at("<"):
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.body()
            return True
        if constant and not self.at("="):
            self.fail()
        self.declarators()
        self.need(";")
        return True

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def s_lock(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.i += 1
        self.need("(")
        if not self.take(";"):
            mark = self.i
            if not self.declaration():
                self.i = mark
                self.expressions()
                self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expressions()
        self.need(")")
        self.statement()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def s_foreach(self) -> None:
        self.i += 1
        self.need("(")
        self.take("scoped")
        if self.at("var") and self.values[self.i + 1] == "(":
            self.i += 1
            self.designation()
        elif self.at("(") and not self._typed():
            self.expression()
        else:
            self.type()
            self.name()
        self.need("in")
        self.expression()
        self.need(")")
        self.statement()

    def _typed(self) -> bool:
        mark = self.i
        ok = self.try_type() and self.is_name()
        self.i = mark
        return ok

    def s_await(self) -> None:
        self.i += 1
        self.statement()

    def s_using(self) -> None:
        self.i += 1
        if self.take("("):
            mark = self.i
            if self.try_type() and self.is_name() and self.values[self.i + 1] == "=":
                self.name()
                self.declarators()
            else:
                self.i = mark
                self.expression()
            self.need(")")
            self.statement()
            return
        self.type()
        self.name()
        if not self.at("="):
            self.fail()
        self.declarators()
        self.need(";")

    def s_fixed(self) -> None:
        self.i += 1
        self.need("(")
        self.type()
        self.name()
        self.declarators()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.i += 1
        if not self.at(";"):
            self.take("ref")
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.s_return()

    def s_break(self) -> None:
        self.i += 1
        self.need(";")

    def s_continue(self) -> None:
        self.s_break()

    def s_goto(self) -> None:
        self.i += 1
        if self.take("case"):
            self.expression()
        elif not self.take("default"):
            self.name()
        self.need(";")

    def s_yield(self) -> None:
        self.i += 1
        if self.take("return"):
            self.expression()
        else:
            self.need("break")
        self.need(";")

    def s_checked(self) -> None:
        self.i += 1
        self.block()

    s_unchecked = s_unsafe = s_checked

    def s_try(self) -> None:
        self.i += 1
        self.block()
        done = False
        while self.take("catch"):
            done = True
            if self.take("("):
                self.type()
                if self.is_name():
                    self.i += 1
                self.need(")")
            if self.take("when"):
                self.condition()
            self.block()
        if self.take("finally"):
            done = True
            self.block()
        if not done:
            self.fail()

    def s_switch(self) -> None:
        self.i += 1
        if self.at("("):
            self.condition_or_tuple()
        else:
            self.expression()
        self.need("{")
        while not self.at("}"):
            if self.take("case"):
                self.pattern()
                if self.take("when"):
                    self.expression()
            elif not self.take("default"):
                self.fail()
            self.need(":")
            while not self.at_any(("case", "}")) and not (self.at("default") and self.values[self.i + 1] == ":"):
                if self.kinds[self.i] == "end":
                    self.fail()
                self.statement()
        self.need("}")

    def condition_or_tuple(self) -> None:
        self.need("(")
        self.expressions()
        self.need(")")

    # expressions
    def expression(self) -> None:
        self.deeper()
        if not self.lambda_():
            if self.at("from") and self.query():
                self.depth -= 1
                return
            self.binary(1)
            if self.take("?"):
                self.take("ref")
                self.expression()
                self.need(":")
                self.take("ref")
                self.expression()
            elif self.kinds[self.i] == "mark" and (self.values[self.i] in _ASSIGN or self.shift_assign()):
                if self.shift_assign():
                    self.i += 2 if self.values[self.i + 1] != ">" else 3
                else:
                    self.i += 1
                self.initial()
        self.depth -= 1

    def shift_assign(self) -> bool:
        return self.at(">") and self.starts[self.i + 1] == self.starts[self.i] + 1 and (self.values[self.i + 1] == ">=" or self.values[self.i + 1] == ">" and self.values[self.i + 2] == ">=")

    def lambda_(self) -> bool:
        start = self.i
        if self.at("[") and self._lambda_attributes():
            self.attributes()
        while self.at_any(("static", "async")) and (self.is_name(self.i + 1) or self.values[self.i + 1] in ("(", "static", "async", "delegate") or self.values[self.i + 1] in _BUILTIN) and self.values[self.i + 1] != "=>":
            self.i += 1
        if self.at("delegate") and self.values[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.at("("):
                self.parameters()
            self.block()
            self.i -= 1
            self.i += 1
            return True
        if self.is_name() and self.values[self.i + 1] == "=>":
            self.i += 2
        else:
            mark = self.i
            if not self.at("(") and self.try_type() and self.at("(") and self._lambda_parens():
                pass  # explicit return type
            else:
                self.i = mark
            if not (self.at("(") and self._lambda_parens()):
                self.i = start
                return False
            self.need("(")
            if not self.at(")"):
                mark = self.i
                try:
                    self.parameter_list(")")
                    if not self.at(")"):
                        self.fail()
                except Failed:
                    self.i = mark
                    while True:
                        while self.at_any(("ref", "out", "in", "scoped")):
                            self.i += 1
                        self.name()
                        if not self.take(","):
                            break
            self.need(")")
            self.need("=>")
        if self.at("{"):
            self.block()
        else:
            self.take("ref")
            self.expression()
        return True

    def _lambda_attributes(self) -> bool:
        level, j = 0, self.i
        while self.kinds[j] != "end":
            if self.values[j] == "[":
                level += 1
            elif self.values[j] == "]":
                level -= 1
                if not level:
                    return self.values[j + 1] in ("(", "async", "static") and "=>" in self.values[j : j + 60]
            j += 1
        return False

    def _lambda_parens(self) -> bool:
        level, j = 0, self.i
        while self.kinds[j] != "end":
            if self.kinds[j] == "mark":
                v = self.values[j]
                if v in ("(", "[", "{"):
                    level += 1
                elif v in (")", "]", "}"):
                    level -= 1
                    if level == 0:
                        return self.values[j + 1] == "=>"
                elif v == ";":
                    return False
            j += 1
        return False

    def query(self) -> bool:
        start = self.i
        self.i += 1
        if not (self.is_name() and self.values[self.i + 1] == "in"):
            if not (self.try_type() and self.is_name() and self.values[self.i + 1] == "in"):
                self.i = start
                return False
        self.name()
        self.need("in")
        self.expression()
        self.query_body()
        return True

    def query_body(self) -> None:
        while True:
            if self.at("from"):
                if not self.query_from():
                    self.fail()
            elif self.take("where"):
                self.expression()
            elif self.take("let"):
                self.name()
                self.need("=")
                self.expression()
            elif self.take("join"):
                if not (self.is_name() and self.values[self.i + 1] == "in"):
                    self.type()
                self.name()
                for word in ("in", "on", "equals"):
                    self.need(word)
                    self.expression()
                if self.take("into"):
                    self.name()
            elif self.take("orderby"):
                while True:
                    self.expression()
                    if not self.take("ascending"):
                        self.take("descending")
                    if not self.take(","):
                        break
            else:
                break
        if self.take("select"):
            self.expression()
        elif self.take("group"):
            self.expression()
            self.need("by")
            self.expression()
        else:
            self.fail()
        if self.take("into"):
            self.name()
            self.query_body()

    def query_from(self) -> bool:
        self.i += 1
        if not (self.is_name() and self.values[self.i + 1] == "in"):
            self.type()
        self.name()
        self.need("in")
        self.expression()
        return True

    def operator_here(self) -> tuple[str, int]:
        """The binary operator at hand and its number of tokens."""
        kind, v = self.kinds[self.i], self.values[self.i]
        if kind not in ("mark", "name"):
            return "", 0
        if v == ">" and self.values[self.i + 1] == ">" and self.starts[self.i + 1] == self.starts[self.i] + 1:
            if self.values[self.i + 2] == ">" and self.starts[self.i + 2] == self.starts[self.i] + 2:
                return ">>>", 3
            return (">>", 2) if self.values[self.i + 2] != ">=" or self.starts[self.i + 2] != self.starts[self.i] + 2 else ("", 0)
        if v == ">" and self.values[self.i + 1] == ">=" and self.starts[self.i + 1] == self.starts[self.i] + 1:
            return "", 0
        if kind == "name" and v not in ("is", "as", "switch", "with"):
            return "", 0
        return v, 1

    def binary(self, least: int) -> None:
        if self.at(".."):
            self.i += 1
            if not self.at_any(("]", ")", ",", ";", "}", ":")):
                self.binary(14)
        else:
            self.unary()
        while True:
            op, count = self.operator_here()
            p = _BINARY.get(op, 0)
            if not p or p < least:
                return
            if op in ("switch", "with") and self.values[self.i + 1] != "{":
                return
            self.i += count
            if op == "is":
                self.pattern()
            elif op == "as":
                self.as_type()
            elif op == "switch":
                self.switch_arms()
            elif op == "with":
                self.collection()
            elif op == "..":
                if not self.at_any(("]", ")", ",", ";", "}", ":")):
                    self.binary(14)
            elif op == "??":
                self.expression_tail(1)
            else:
                self.binary(p + 1)

    def expression_tail(self, least: int) -> None:
        if self.at("throw"):
            self.i += 1
            self.expression()
        elif not self.lambda_():
            self.binary(least)

    def as_type(self) -> None:
        if not self.try_type(False):
            self.fail()
        if self.at("?") and not self._ternary():
            self.i += 1

    def _ternary(self) -> bool:
        """Whether ``?`` here begins a conditional expression: something follows that can."""
        k, v = self.kinds[self.i + 1], self.values[self.i + 1]
        return not (k == "mark" and v in (")", "]", "}", ",", ";", "&&", "||", "?", "=", "==", "!=", ":", "??") or k == "end")

    def switch_arms(self) -> None:
        self.need("{")
        self.deeper()
        while not self.at("}"):
            self.pattern()
            if self.take("when"):
                self.expression()
            self.need("=>")
            self.expression()
            if not self.take(","):
                break
        self.need("}")
        self.depth -= 1

    def pattern(self) -> None:
        self.deeper()
        self.pattern_unit()
        while self.at_any(("and", "or")):
            self.i += 1
            self.pattern_unit()
        self.depth -= 1

    def pattern_unit(self) -> None:
        while self.at("not") and self.values[self.i + 1] not in (")", "=>", ",", "}"):
            self.i += 1
        if self.at_any(("<", ">", "<=", ">=", "==", "!=")):
            self.i += 1
            self.binary(9)
            return
        if self.at("var"):
            self.i += 1
            self.designation()
            return
        if self.at("["):
            self.i += 1
            while not self.at("]"):
                if self.take(".."):
                    if not self.at_any((",", "]")):
                        self.pattern()
                else:
                    self.pattern()
                if not self.take(","):
                    break
            self.need("]")
            self.pattern_name()
            return
        if self.at("{"):
            self.properties()
            self.pattern_name()
            return
        if self.at("("):
            self.positional()
            if self.at("{"):
                self.properties()
            self.pattern_name()
            return
        mark = self.i
        if self.try_type(False):
            if self.at("(") or self.at("{"):
                if self.at("("):
                    self.positional()
                if self.at("{"):
                    self.properties()
                self.pattern_name()
                return
            if self.is_name() and self.values[self.i] not in _NO_NAME:
                self.i += 1
                return
            if self.kinds[self.i] != "mark" or self.at_any((")", "]", "}", ",", ";", ":", "=>", "&&", "||", "?", "==", "!=", "??", "&", "|", "^")):
                return
        self.i = mark
        self.binary(9)

    def pattern_name(self) -> None:
        if self.is_name() and self.values[self.i] not in _NO_NAME:
            self.i += 1

    def positional(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.is_name() and self.values[self.i + 1] == ":":
                self.i += 2
            self.pattern()
            if not self.take(","):
                break
        self.need(")")

    def properties(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.name()
            while self.take("."):
                self.name()
            self.need(":")
            self.pattern()
            if not self.take(","):
                break
        self.need("}")

    def designation(self) -> None:
        if self.take("("):
            while not self.at(")"):
                self.designation()
                if not self.take(","):
                    break
            self.need(")")
        else:
            self.name()

    def unary(self) -> None:
        self.deeper()
        v, kind = self.values[self.i], self.kinds[self.i]
        if kind == "mark" and v in ("+", "-", "!", "~", "++", "--", "&", "*", "^"):
            self.i += 1
            self.unary()
        elif kind == "name" and v == "await" and (self.is_name(self.i + 1) or self.values[self.i + 1] in ("(", "this", "base", "new", "typeof", "default", "checked") or self.kinds[self.i + 1] in ("text", "number")):
            self.i += 1
            self.unary()
        elif kind == "name" and v == "throw":
            self.i += 1
            self.expression()
        elif kind == "mark" and v == "(" and self.cast():
            self.unary()
        else:
            self.postfix()
        self.depth -= 1

    def cast(self) -> bool:
        """Moves over ``(type)`` if a cast begins here."""
        mark = self.i
        self.i += 1
        builtin = self.values[self.i] in _BUILTIN and self.kinds[self.i] == "name"
        if self.try_type() and self.take(")"):
            k, v = self.kinds[self.i], self.values[self.i]
            if k in ("word", "text", "number") or k == "mark" and v in ("(", "!", "~") or k == "name" and v not in ("is", "as", "switch", "with", "and", "or", "in", "when", "where", "select", "orderby", "equals", "on", "into", "by", "group", "join", "let", "ascending", "descending") or builtin and k == "mark" and v in ("+", "-", "&", "*", "++", "--", "^", "["):
                return True
        self.i = mark
        return False

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.kinds[self.i] != "mark":
                return
            v = self.values[self.i]
            if v in (".", "?.", "->", "::"):
                self.i += 1
                self.name()
                self.generic_name()
            elif v == "(":
                self.call_arguments()
            elif v == "[" or v == "?" and self.values[self.i + 1] == "[" and self._indexed():
                self.i += 1 + (v == "?")
                self.index_arguments()
            elif v in ("++", "--"):
                self.i += 1
            elif v == "!" and self.values[self.i + 1] != "=":
                self.i += 1
            else:
                return

    def _indexed(self) -> bool:
        """``a?[i]`` and not ``a ? [x] : y``: no colon follows on this level before the statement ends."""
        level, j = 0, self.i + 1
        while self.kinds[j] != "end":
            v = self.values[j]
            if self.kinds[j] == "mark":
                if v in ("(", "[", "{"):
                    level += 1
                elif v in (")", "]", "}"):
                    level -= 1
                    if level < 0:
                        return True
                elif level == 0 and v == ":":
                    return False
                elif level == 0 and v in (";", ","):
                    return True
            j += 1
        return True

    def generic_name(self) -> None:
        if self.at("<"):
            mark = self.i
            if not (self.try_arguments() and (self.kinds[self.i] == "mark" and self.values[self.i] in _AFTER_GENERIC or self.kinds[self.i] == "end" or self.is_name() and self.values[self.i - 1] == ">" and self.values[self.i + 1] in (")", ",", "=", ";"))):
                self.i = mark

    def call_arguments(self) -> None:
        self.need("(")
        self.arguments(")")
        self.need(")")

    def index_arguments(self) -> None:
        if self.at("]"):
            self.fail()
        self.arguments("]")
        self.need("]")

    def arguments(self, close: str) -> None:
        while not self.at(close):
            if self.is_name() and self.values[self.i + 1] == ":" and self.values[self.i + 2] != ":":
                self.i += 2
            if self.at_any(("ref", "out", "in")):
                out = self.at("out")
                self.i += 1
                mark = self.i
                if out:
                    if self.at("var") and self.values[self.i + 1] == "(":
                        self.i += 1
                        self.designation()
                    elif not (self.try_type() and self.is_name() and self.values[self.i + 1] in (",", ")")):
                        self.i = mark
                        self.expression()
                    else:
                        self.name()
                else:
                    self.expression()
            else:
                if self.at("=") and close == ")":
                    self.fail()
                self.expression()
            if not self.take(","):
                return
            if self.at(close):
                self.fail()

    def collection(self) -> None:
        """``{ a, b = 1, [k] = v, { x, y } }`` of an initialiser."""
        self.need("{")
        self.deeper()
        while not self.at("}"):
            if self.at("{"):
                self.collection()
            elif self.at("[") and self._index_initial():
                self.i += 1
                self.index_arguments()
                self.need("=")
                self.initial()
            else:
                self.expression()
            if not self.take(","):
                break
        self.need("}")
        self.depth -= 1

    def _index_initial(self) -> bool:
        level, j = 0, self.i
        while self.kinds[j] != "end":
            if self.kinds[j] == "mark":
                if self.values[j] in ("(", "[", "{"):
                    level += 1
                elif self.values[j] in (")", "]", "}"):
                    level -= 1
                    if level == 0:
                        return self.values[j + 1] == "="
            j += 1
        return False

    def primary(self) -> None:
        kind, v = self.kinds[self.i], self.values[self.i]
        if kind in ("number", "text"):
            self.i += 1
        elif kind == "mark" and v == "(":
            self.i += 1
            self.deeper()
            while True:
                if self.is_name() and self.values[self.i + 1] == ":":
                    self.i += 2
                mark = self.i
                if self.at("var") and self.values[self.i + 1] == "(":
                    self.i += 1
                    self.designation()
                elif self.try_type() and self.is_name() and self.values[self.i + 1] in (",", ")") and self.values[self.i] not in ("is", "as"):
                    self.name()  # deconstruction: (int a, var b)
                else:
                    self.i = mark
                    self.expression()
                if not self.take(","):
                    break
            self.need(")")
            self.depth -= 1
        elif kind == "mark" and v == "[":  # collection expression
            self.i += 1
            self.deeper()
            while not self.at("]"):
                self.take("..")
                self.expression()
                if not self.take(","):
                    break
            self.need("]")
            self.depth -= 1
        elif kind == "name" and v == "new":
            self.new()
        elif kind == "name" and v in ("typeof", "sizeof", "checked", "unchecked", "nameof") and self.values[self.i + 1] == "(":
            self.i += 2
            mark = self.i
            if v in ("typeof", "sizeof"):
                if not (self.try_type() and self.at(")")):
                    self.fail()
            elif not (v == "nameof" and self.try_type() and self.at(")")):
                self.i = mark
                self.expression()
            self.need(")")
        elif kind == "name" and v == "default":
            self.i += 1
            if self.take("("):
                self.type()
                self.need(")")
        elif kind == "name" and v == "stackalloc":
            self.i += 1
            self.array_rest()
        elif kind == "name" and v in ("this", "base", "true", "false", "null"):
            self.i += 1
        elif kind == "name" and v in _BUILTIN:
            self.i += 1
            if not self.at("."):
                self.fail()
        elif kind == "name" and v == "delegate":
            self.i += 1
            if self.at("("):
                self.parameters()
            self.block()
        elif self.is_name():
            self.i += 1
            self.generic_name()
        else:
            self.fail()

    def array_rest(self) -> None:
        mark = self.i
        if self.try_type(False) and not self.at("["):
            if self.at("{"):
                self.collection()
            return
        if self.i == mark and not self.at("["):
            self.fail()
        while self.at("["):
            self.i += 1
            if self.at("]") or self.at(","):
                while self.take(","):
                    pass
            else:
                self.arguments("]")
            self.need("]")
            self.take("?")
        if self.at("{"):
            self.collection()

    def new(self) -> None:
        self.i += 1
        if self.at("{"):
            self.collection()
        elif self.at("("):
            self.call_arguments()
            if self.at("{"):
                self.collection()
        elif self.at("["):
            self.array_rest()
        else:
            # the type stops before array ranks with sizes
            if not self.try_type(False):
                self.fail()
            if self.at("?") and self.values[self.i + 1] in ("[", "("):
                self.i += 1
            if self.at("("):
                self.call_arguments()
                if self.at("{"):
                    self.collection()
            elif self.at("{"):
                self.collection()
            elif self.at("["):
                self.array_rest()
            else:
                self.fail()


_STATEMENTS = {n[2:]: getattr(CSharp, n) for n in dir(CSharp) if n.startswith("s_")}
