"""YAML 1.2: block and flow collections, all scalar styles, anchors, tags, several documents."""

from __future__ import annotations

import re

from colligo.llm.syntax.base import Failed, Parser, SyntaxFault, TooDeep

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\ufffe\uffff]")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\t\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|\Z)")
_PROPERTY = re.compile(r"(?:&[^\s\[\]{},]+|!<[^>\s]*>|![^\s\[\]{},]*)(?=\s|\Z)[ \t]*")
_ALIAS = re.compile(r"\*[^\s\[\]{},]+")
_PLAIN_START = re.compile(r"[^\s,\[\]{}#&*!|>'\"%@`\-?:]|[\-?:](?=[^\s])")
_PLAIN = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#)+(?:[ \t]+(?:[^\s:#]|:(?=\S)|(?<=\S)#)(?:[^\s:#]|:(?=\S)|(?<=\S)#)*)*")
_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)+(?:[ \t]+(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)+)*")
_MARKER = re.compile(r"(?:---|\.\.\.)(?=[ \t\n]|\Z)")


class Yaml(Parser):
    def parse(self) -> list[SyntaxFault]:
        source = self.text
        self.text = source.replace("\r\n", "\n").replace("\r", "\n")
        if self.text.startswith("﻿"):
            self.text = " " + self.text[1:] if False else self.text[1:]
        self.n = len(self.text)
        self.p = 0
        if m := _CONTROL.search(self.text):
            self.fault(m.start(), "a control character")
        self.stream()
        return self.result()

    # positions
    def line_start(self, p: int) -> int:
        return self.text.rfind("\n", 0, p) + 1

    def column(self, p: int) -> int:
        return p - self.line_start(p)

    def line_end(self, p: int) -> int:
        e = self.text.find("\n", p)
        return self.n if e < 0 else e

    def content(self) -> bool:
        """Moves to the next content; False at the end or before a document marker. The position must be at a line's
        start, or behind content of a line of which only blanks and a comment may follow."""
        text = self.text
        while self.p < self.n:
            p = self.p
            m = re.compile(r"[ \t]*").match(text, p)
            q = m.end()
            if q >= self.n:
                self.p = q
                return False
            if text[q] == "\n":
                self.p = q + 1
                continue
            if text[q] == "#" and (q == self.line_start(q) or text[q - 1] in " \t"):
                self.p = self.line_end(q)
                continue
            if self.column(q) == 0 and _MARKER.match(text, q):
                self.p = q
                return False
            if "\t" in m[0] and self.line_start(q) == p:
                # a tab may not indent a block
                self.p = q
                raise Broken(q, "a tab in the indentation")
            self.p = q
            return True
        return False

    def rest_of_line(self) -> None:
        m = re.compile(r"[ \t]*(?:(?<=[ \t])#[^\n]*|(?<=\n)#[^\n]*)?").match(self.text, self.p)
        if m.end() < self.n and self.text[m.end()] != "\n":
            raise Broken(m.end(), f"unexpected {self.text[m.end()]!r} behind a value")
        self.p = m.end()

    def next_line(self) -> None:
        self.p = min(self.n, self.line_end(self.p) + 1)

    # documents
    def stream(self) -> None:
        while self.p < self.n:
            try:
                if self.text.startswith("%", self.p) and self.column(self.p) == 0:
                    self.next_line()
                    continue
                if self.content():
                    self.block(-1)
                    if self.content():
                        raise Broken(self.p, "unexpected content behind the document")
                if self.p < self.n:
                    marker = self.text[self.p : self.p + 3]
                    self.p += 3
                    if marker == "---":
                        m = re.compile(r"[ \t]*").match(self.text, self.p)
                        self.p = m.end()
                        if self.p < self.n and self.text[self.p] not in "\n#":
                            if self.text[self.p] in "|>&!\"'[{":
                                self.block(-1)
                            else:
                                self.inline(-1)
                    else:
                        self.rest_of_line()
            except Broken as f:
                self.fault(f.at, f.message)
                self.depth = 0
                # panic mode: on with the next line, as a document of its own
                self.p = max(self.p, f.at)
                self.next_line()

    def inline(self, indent: int) -> None:
        start = self.p
        self.scalar(indent)
        if self.p == start:
            raise Broken(start, "unexpected content")

    def block(self, parent: int) -> None:
        """The node whose first character is here, in a block indented by more than ``parent``."""
        self.down()
        text = self.text
        column = self.column(self.p)
        if re.compile(r"-(?=[ \t\n]|\Z)").match(text, self.p):
            self.sequence(column, parent)
        elif re.compile(r"\?(?=[ \t\n]|\Z)").match(text, self.p) or self.is_key():
            self.mapping(column)
        else:
            m = None
            while (m := _PROPERTY.match(text, self.p)) and m.end() > self.p:
                self.p = m.end()
            if self.p >= self.n or text[self.p] in "\n#":
                if self.content() and self.column(self.p) > parent:
                    self.block(parent)
                self.depth -= 1
                return
            if self.column(self.p) > column and (self.is_key() or re.compile(r"-(?=[ \t\n]|\Z)").match(text, self.p)):
                raise Broken(self.p, "a collection begins behind a property on its line")
            self.scalar(parent)
        self.depth -= 1

    def down(self) -> None:
        self.depth += 1
        if self.depth > self.limit:
            raise TooDeep

    def is_key(self) -> bool:
        """Whether an implicit key stands here: one line up to a colon and a blank."""
        mark = self.p
        try:
            return self.key()
        except Broken:
            return False
        finally:
            self.p = mark

    def key(self) -> bool:
        """Moves over an implicit key and its colon, if there is one."""
        text, start = self.text, self.p
        while (m := _PROPERTY.match(text, self.p)) and m.end() > self.p:
            self.p = m.end()
        c = text[self.p : self.p + 1]
        if c == '"' or c == "'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(text, self.p)
            if not m or "\n" in m[0]:
                self.p = start
                return False
            self.p = m.end()
        elif c in ("[", "{"):
            self.flow()
            if "\n" in text[start : self.p]:
                self.p = start
                return False
        elif c == "*":
            m = _ALIAS.match(text, self.p)
            self.p = m.end() if m else self.p
        elif _PLAIN_START.match(text, self.p):
            m = _PLAIN.match(text, self.p)
            self.p = m.end()
        elif c != ":":
            self.p = start
            return False
        m = re.compile(r"[ \t]*:(?=[ \t\n]|\Z)").match(text, self.p)
        if not m:
            self.p = start
            return False
        self.p = m.end()
        return True

    def mapping(self, column: int) -> None:
        text = self.text
        while True:
            if m := re.compile(r"\?(?=[ \t\n]|\Z)").match(text, self.p):
                self.p = m.end()
                self.value(column, True)
                if self.content() and self.column(self.p) == column and re.compile(r":(?=[ \t\n]|\Z)").match(text, self.p):
                    self.p += 1
                    self.value(column, True)
            elif self.key():
                self.value(column, False)
            else:
                raise Broken(self.p, "a line of a mapping has no key" if text[self.p] not in "\"'" else "open string or missing ':'")
            if not self.content():
                return
            here = self.column(self.p)
            if here < column:
                return
            if here > column:
                raise Broken(self.p, "the indentation fits no outer level")

    def value(self, column: int, explicit: bool) -> None:
        """What follows a key's colon: on its line, or indented below it."""
        text = self.text
        m = re.compile(r"[ \t]*").match(text, self.p)
        q = m.end()
        if q < self.n and text[q] != "\n" and not (text[q] == "#" and m[0]):
            self.p = q
            if explicit or re.compile(r"-(?=[ \t\n]|\Z)").match(text, q):
                if not explicit:
                    raise Broken(q, "a sequence begins on the line of its key")
                self.block(column)
                return
            while (m := _PROPERTY.match(text, self.p)) and m.end() > self.p:
                self.p = m.end()
            if self.p < self.n and text[self.p] not in "\n#":
                self.scalar(column)
                return
        if not self.content():
            return
        here = self.column(self.p)
        if here > column or here == column and re.compile(r"-(?=[ \t\n]|\Z)").match(text, self.p):
            self.block(column if here > column else column - 1)

    def sequence(self, column: int, parent: int) -> None:
        text = self.text
        while True:
            self.p += 1
            m = re.compile(r"[ \t]*").match(text, self.p)
            if m.end() < self.n and text[m.end()] != "\n" and not (text[m.end()] == "#" and m[0]):
                self.p = m.end()
                self.block(column)
            elif self.content() and self.column(self.p) > column:
                self.block(column)
            if not self.content():
                return
            here = self.column(self.p)
            if here < column or here == column and not re.compile(r"-(?=[ \t\n]|\Z)").match(text, self.p):
                if here == column and parent != column - 1:
                    raise Broken(self.p, "a line of a sequence has no dash")
                return
            if here > column:
                raise Broken(self.p, "the indentation fits no outer level")

    def scalar(self, parent: int) -> None:
        """A scalar, alias or flow collection, to the end of its last line."""
        text, c = self.text, self.text[self.p]
        if c in "|>":
            m = _BLOCK.match(text, self.p)
            if not m:
                raise Broken(self.p, f"unexpected {c!r}")
            self.block_scalar(parent, m)
            return
        if c == '"' or c == "'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(text, self.p)
            if not m:
                raise Broken(self.p, "open string" if c == "'" or not re.compile(r'"(?:[^"\\]|\\[\s\S])*"').match(text, self.p) else "a bad escape in a string")
            self.continued(m[0], self.p, parent)
            self.p = m.end()
            self.rest_of_line()
            return
        if c in "[{":
            start = self.p
            self.flow()
            self.continued(text[start : self.p], start, parent)
            self.rest_of_line()
            return
        if c == "*":
            m = _ALIAS.match(text, self.p)
            if not m:
                raise Broken(self.p, "unexpected '*'")
            self.p = m.end()
            self.rest_of_line()
            return
        if not _PLAIN_START.match(text, self.p):
            raise Broken(self.p, f"unexpected {c!r}")
        while True:
            m = _PLAIN.match(text, self.p)
            self.p = m.end()
            if re.compile(r"[ \t]*:(?=[ \t\n]|\Z)").match(text, self.p):
                raise Broken(self.p, "a mapping is not allowed here")
            commented = re.compile(r"[ \t]+#").match(text, self.p)
            self.rest_of_line()
            # a plain scalar goes on on lines indented by more than its parent
            q = re.compile(r"\s*").match(text, self.p).end()
            if commented or q >= self.n or text[q] == "#" or self.column(q) <= parent or self.column(q) == 0 and _MARKER.match(text, q):
                return
            if "\t" in text[self.line_start(q) : q] and not text[self.line_start(q) : q].strip("\t ") == "" :
                raise Broken(q, "a tab in the indentation")
            self.p = q
            if not re.compile(r"[^\s#:]|:(?=\S)").match(text, q):
                raise Broken(q, f"unexpected {text[q]!r}")

    def continued(self, value: str, start: int, parent: int) -> None:
        """Lines of a quoted or flow value must stand right of their parent."""
        if "\n" not in value or parent < 0:
            return
        for m in re.finditer(r"\n([ \t]*)(?=\S)", value):
            if len(m[1]) <= parent and not value[m.end()] in "]}":
                raise Broken(start + m.end(), "a continued line is not indented")
            if self.column(start + m.end()) == 0 and _MARKER.match(self.text, start + m.end()):
                raise Broken(start + m.end(), "a document marker inside a value")

    def block_scalar(self, parent: int, header: re.Match) -> None:
        text = self.text
        digit = re.search(r"[1-9]", header[0].split("#")[0])
        self.p = min(self.n, header.end() + 1)
        least = max(parent, -1) + 1 if not digit else max(parent, 0) + int(digit[0])
        indent = least if digit else -1
        while self.p < self.n:
            end = self.line_end(self.p)
            line = text[self.p : end]
            if line.strip(" ") == "":
                self.p = min(self.n, end + 1)
                continue
            here = len(line) - len(line.lstrip(" "))
            if indent < 0:
                if here < least:
                    break
                indent = here
                if line.lstrip(" ")[:1] == "\t" and here < least:
                    raise Broken(self.p, "a tab in the indentation")
            if here < indent:
                if here > parent and not line.lstrip(" ").startswith("#"):
                    self.p += here
                    raise Broken(self.p, "the indentation fits no outer level")
                break
            if here == 0 and parent < 0 and _MARKER.match(line):
                break
            self.p = min(self.n, end + 1)
        # back to a line's end, as behind any other value
        if self.p > 0 and self.p <= self.n and text[self.p - 1 : self.p] == "\n":
            return

    def flow(self) -> None:
        """A flow collection; over lines, without regard to indentation."""
        text = self.text
        stack: list[str] = []
        begin = self.p
        state = "item"  # what may come: item, or sep (a comma or an end)
        keyed = False
        while True:
            m = re.compile(r"(?:\s+|(?<=\s)#[^\n]*)*").match(text, self.p)
            self.p = m.end()
            if self.p >= self.n:
                raise Broken(begin, "a flow collection is never closed: the text ends before")
            c = text[self.p]
            if c in "[{" and state == "item":
                stack.append("]" if c == "[" else "}")
                self.p += 1
                keyed = False
                continue
            if c in "]}":
                if not stack or stack[-1] != c:
                    raise Broken(self.p, f"unexpected {c!r}")
                stack.pop()
                self.p += 1
                if not stack:
                    return
                state, keyed = "sep", False
                continue
            if c == ",":
                if state == "item" and text[:self.p].rstrip()[-1:] in ("[", "{", ","):
                    raise Broken(self.p, "unexpected ','")
                self.p += 1
                state, keyed = "item", False
                continue
            if c == ":" and (state == "sep" and not keyed or state == "item") and (text[self.p + 1 : self.p + 2] in (" ", "\t", "\n", ",", "]", "}", "") or text[self.p - 1] in "\"'}]"):
                self.p += 1
                state, keyed = "item", True
                continue
            if state != "item":
                raise Broken(self.p, f"unexpected {c!r} in a flow collection")
            if (m := _PROPERTY.match(text, self.p)) and m.end() > self.p:
                self.p = m.end()
                continue
            if c == "?" and text[self.p + 1 : self.p + 2] in (" ", "\n"):
                self.p += 1
                continue
            m = _DOUBLE.match(text, self.p) if c == '"' else _SINGLE.match(text, self.p) if c == "'" else _ALIAS.match(text, self.p) if c == "*" else _PLAIN_FLOW.match(text, self.p) if _PLAIN_START.match(text, self.p) else None
            if not m:
                raise Broken(self.p, "open string" if c in "\"'" else f"unexpected {c!r}")
            self.p = m.end()
            # plain scalars may go on on the next line
            if c not in "\"'*":
                while (k := re.compile(r"[ \t]*\n\s*").match(text, self.p)) and (m := _PLAIN_FLOW.match(text, k.end())) and text[k.end()] not in "#\"'[{":
                    self.p = m.end()
            state = "sep"


class Broken(Failed):
    """A fault at a position of the text."""
