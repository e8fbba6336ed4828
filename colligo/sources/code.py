"""Source code as collections: types, members, statements, regions and the public interface of C#, Python and JavaScript.

Each file is parsed once in an Arrow batch, into one nested row; the collections are explosions of that row. A statement
appears once, with its parent and the chain of what encloses it; types nested in others are theirs alone.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colligo.collection import Collection
from colligo.functions import types as K
from colligo.runtime import spread
from colligo.sources.text import language_of, read_texts, regions_of

# Modifier flags.
MODIFIERS = {"public": 1, "private": 2, "protected": 4, "internal": 8, "static": 16, "sealed": 32, "abstract": 64, "virtual": 128, "async": 256, "override": 512, "readonly": 1024, "const": 2048}

_REF = "struct<name:string,namespace:string,generic:boolean,text:string>"
_PARAM = f"struct<Name:string,Type:{_REF},Variadic:boolean,Kwargs:boolean,Defaulted:boolean,DefaultValue:string>"
_METHOD = f"struct<Name:string,Modifiers:bigint,ReturnType:{_REF},Parameters:array<{_PARAM}>,Decorators:array<string>,Line:bigint,Documented:boolean>"
_FIELD = f"struct<Name:string,Type:{_REF},Modifiers:bigint,Line:bigint,HasGetter:boolean,HasSetter:boolean,Documented:boolean>"
_TYPE = f"struct<Name:string,Kind:string,Modifiers:bigint,BaseTypes:array<string>,Constructors:array<{_METHOD}>,Methods:array<{_METHOD}>,Fields:array<{_FIELD}>,Properties:array<{_FIELD}>,Events:array<{_FIELD}>,EnumValues:array<string>,Decorators:array<string>,NestedTypes:array<string>,Parent:string,Line:bigint,Documented:boolean>"
_STATEMENT = "struct<Id:bigint,ParentId:bigint,Kind:string,Keywords:array<string>,TypeName:string,MemberName:string,Arguments:array<string>,Line:bigint,InMethod:boolean,Method:string,Rethrows:boolean,Generic:boolean,ErrorHandler:boolean,Condition:string,Expression:string,Ancestors:array<struct<Kind:string,Condition:string>>>"
PARSED = {"types": f"types array<{_TYPE}>", "statements": f"statements array<{_STATEMENT}>"}


def _ref(text: str | None) -> dict | None:
    """A type reference from its text: qualified names split, generics and arrays reduced to the element's name."""
    if not text:
        return None
    plain = re.sub(r"(?:\?|\[[,\s]*\])+$", "", text.strip())
    head = re.split(r"[<\[]", plain, maxsplit=1)[0].strip()
    namespace, _, name = head.rpartition(".")
    return {"name": name, "namespace": namespace or None, "generic": "<" in plain or "[" in plain, "text": text.strip()}


def _statement(statements: list[dict], stack: list[dict], method: str | None, **fields) -> dict:
    row = {"Id": len(statements), "ParentId": stack[-1]["Id"] if stack else None, "Keywords": [], "TypeName": None, "MemberName": None, "Arguments": [], "InMethod": method is not None, "Method": method, "Rethrows": False, "Generic": False, "ErrorHandler": False, "Condition": None, "Expression": None, "Ancestors": [{"Kind": s["Kind"], "Condition": s["Condition"]} for s in reversed(stack)]} | fields
    statements.append(row)
    return row


# Python
#: Lines of one top-level statement that are taken out, one by one, before the statement is given up.
MAX_REPAIRS = 25
_CONTINUES = re.compile(r"[\s)\]}#]|(?:else|elif|except|finally|case)\b|$")


def _python_body(text: str) -> list[ast.stmt]:
    """The statements of a text by Python's own grammar. A text that does not parse is cut before its top-level statements, and
    from those that do not parse lines at fault are taken out; what still does not parse is left out alone."""
    try:
        return ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    lines = text.replace("\0", " ").split("\n")
    starts = [i for i, line in enumerate(lines) if not _CONTINUES.match(line) and not (i and lines[i - 1].startswith("@"))]
    body: list[ast.stmt] = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        part = lines[a:b]
        for _ in range(MAX_REPAIRS):
            try:
                tree = ast.parse("\n".join(part))
            except SyntaxError as e:
                at = min(max(e.lineno or 1, 1), len(part)) - 1
                blank = re.match(r"\s*", part[at])[0]
                if isinstance(e, IndentationError) and "indent" in e.msg and "expected an" not in e.msg:
                    # what is left of a block whose head was taken out
                    while at < len(part) and (not part[at].strip() or part[at].startswith(blank)):
                        part[at], at = "", at + 1
                    continue
                if part[at] == blank + "pass":  # the fault is what this line leaves behind: an empty block, an open bracket
                    at = next((i for i in range(at - 1, -1, -1) if part[i].strip() not in ("", "pass")), -1)
                    if at < 0:
                        break
                    blank = re.match(r"\s*", part[at])[0]
                part[at] = blank + "pass"
            except (ValueError, RecursionError, MemoryError):
                break
            else:
                ast.increment_lineno(tree, a)
                body += [n for n in tree.body if not isinstance(n, ast.Pass)]
                break
    return body


def parse_python(text: str, bodies: bool = True) -> dict:
    """By Python's own grammar; of a file that does not parse, what of it does."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.Module(_python_body(text.removeprefix("﻿")), [])
    types: list[dict] = []
    statements: list[dict] = []
    src = lambda n: ast.unparse(n) if n is not None else None

    def method(f) -> dict:
        names = [src(d).split("(")[0].rsplit(".", 1)[-1] for d in f.decorator_list]
        mods = MODIFIERS["private" if f.name.startswith("_") else "public"]
        mods |= MODIFIERS["async"] * isinstance(f, ast.AsyncFunctionDef) | MODIFIERS["static"] * bool({"staticmethod", "classmethod"} & set(names)) | MODIFIERS["abstract"] * ("abstractmethod" in names)
        a, params = f.args, []
        plain = a.posonlyargs + a.args
        offset = len(plain) - len(a.defaults)
        for i, p in enumerate(plain):
            d = a.defaults[i - offset] if i >= offset else None
            params.append({"Name": p.arg, "Type": _ref(src(p.annotation)), "Variadic": False, "Kwargs": False, "Defaulted": d is not None, "DefaultValue": src(d)})
        if a.vararg:
            params.append({"Name": a.vararg.arg, "Type": _ref(src(a.vararg.annotation)), "Variadic": True, "Kwargs": False, "Defaulted": False, "DefaultValue": None})
        params += [{"Name": p.arg, "Type": _ref(src(p.annotation)), "Variadic": False, "Kwargs": False, "Defaulted": d is not None, "DefaultValue": src(d)} for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        if a.kwarg:
            params.append({"Name": a.kwarg.arg, "Type": _ref(src(a.kwarg.annotation)), "Variadic": False, "Kwargs": True, "Defaulted": False, "DefaultValue": None})
        return {"Name": f.name, "Modifiers": mods, "ReturnType": _ref(src(f.returns)), "Parameters": params, "Decorators": names, "Line": f.lineno, "Documented": ast.get_docstring(f) is not None}

    def cls(c: ast.ClassDef, parent: str | None) -> None:
        functions = [n for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        inner = [n for n in c.body if isinstance(n, ast.ClassDef)]
        fields = [{"Name": n.target.id, "Type": _ref(src(n.annotation)), "Modifiers": MODIFIERS["public"], "Line": n.lineno, "HasGetter": False, "HasSetter": False, "Documented": False} for n in c.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
        types.append({"Name": c.name, "Kind": "Class", "Modifiers": MODIFIERS["public"], "BaseTypes": [src(b) for b in c.bases], "Constructors": [method(f) for f in functions if f.name == "__init__"], "Methods": [method(f) for f in functions if f.name != "__init__"], "Fields": fields, "Properties": [], "Events": [], "EnumValues": [], "Decorators": [src(d).split("(")[0] for d in c.decorator_list], "NestedTypes": [n.name for n in inner], "Parent": parent, "Line": c.lineno, "Documented": ast.get_docstring(c) is not None})
        for n in inner:
            cls(n, c.name)

    def call(n: ast.Call, stack, meth) -> None:
        f = n.func
        receiver, member = (src(f.value), f.attr) if isinstance(f, ast.Attribute) else (None, src(f))
        _statement(statements, stack, meth, Kind="call", TypeName=receiver, MemberName=member, Arguments=[src(x) for x in n.args] + [f"{k.arg}={src(k.value)}" if k.arg else f"**{src(k.value)}" for k in n.keywords], Line=n.lineno, Expression=src(n))

    def visit(body, stack, meth) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(n.body, [], n.name)
            elif isinstance(n, ast.ClassDef):
                visit(n.body, [], None)
            elif isinstance(n, (ast.If, ast.While)):
                row = _statement(statements, stack, meth, Kind="if" if isinstance(n, ast.If) else "while", Condition=src(n.test), Line=n.lineno)
                visit(n.body, [*stack, row], meth)
                if n.orelse:
                    other = _statement(statements, [*stack, row], meth, Kind="else", Line=n.orelse[0].lineno)
                    visit(n.orelse, [*stack, row, other], meth)
            elif isinstance(n, (ast.For, ast.AsyncFor)):
                row = _statement(statements, stack, meth, Kind="foreach", Condition=src(n.iter), Line=n.lineno)
                visit(n.body + n.orelse, [*stack, row], meth)
            elif isinstance(n, (ast.With, ast.AsyncWith)):
                row = _statement(statements, stack, meth, Kind="using", Expression=", ".join(src(i.context_expr) for i in n.items), Line=n.lineno)
                visit(n.body, [*stack, row], meth)
            elif isinstance(n, (ast.Try, ast.TryStar)):
                row = _statement(statements, stack, meth, Kind="try", Line=n.lineno)
                visit(n.body, [*stack, row], meth)
                for h in n.handlers:
                    first = h.type.elts[0] if isinstance(h.type, ast.Tuple) and h.type.elts else h.type
                    name = src(first)
                    again = any(isinstance(x, ast.Raise) and x.exc is None for b in h.body for x in ast.walk(b))
                    c = _statement(statements, stack, meth, Kind="catch", TypeName=name, Generic=name in (None, "Exception", "BaseException"), Rethrows=again, ErrorHandler=True, Line=h.lineno)
                    visit(h.body, [*stack, c], meth)
                visit(n.orelse + n.finalbody, stack, meth)
            elif isinstance(n, ast.Raise):
                f = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                _statement(statements, stack, meth, Kind="throw", TypeName=src(f), Arguments=[src(x) for x in n.exc.args] if isinstance(n.exc, ast.Call) else [], Line=n.lineno, Expression=src(n.exc))
            elif isinstance(n, ast.Return):
                _statement(statements, stack, meth, Kind="return", Line=n.lineno, Expression=src(n.value))
            elif isinstance(n, ast.Import):
                for x in n.names:
                    _statement(statements, stack, meth, Kind="using", TypeName=x.name, Line=n.lineno, Expression=x.name)
            elif isinstance(n, ast.ImportFrom):
                _statement(statements, stack, meth, Kind="using", TypeName="." * n.level + (n.module or ""), Line=n.lineno, Expression=n.module)
            elif isinstance(n, ast.Match):
                row = _statement(statements, stack, meth, Kind="switch", Condition=src(n.subject), Line=n.lineno)
                for k in n.cases:
                    visit(k.body, [*stack, row], meth)
            elif isinstance(n, (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign)):
                v = n.value
                if not isinstance(n, ast.Expr):
                    target = n.targets[0] if isinstance(n, ast.Assign) else n.target
                    _statement(statements, stack, meth, Kind="declaration", MemberName=src(target), TypeName=src(getattr(n, "annotation", None)), Line=n.lineno, Expression=src(v))
                if isinstance(v, ast.Await):
                    _statement(statements, stack, meth, Kind="await", Line=n.lineno, Expression=src(v.value))
                    v = v.value
                if isinstance(v, ast.Call):
                    call(v, stack, meth)

    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            cls(n, None)
    if bodies:
        visit(tree.body, [], None)
    return {"types": types, "statements": statements}


# C# and JavaScript: a scanner of tokens and braces
_SKIP = re.compile(r"(?P<doc>///[^\n]*)|//[^\n]*|/\*.*?\*/|(?P<text>\$?@?\"\"\"[\s\S]*?\"\"\"|\$?@\"(?:[^\"]|\"\")*\"|@?\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S)


#: A pattern between slashes: where an operand may stand, so that a division is none.
_JS_SKIP = re.compile(_SKIP.pattern + r"|(?P<before>[=(,:\[!&|?{};+]\s*|\breturn\s+)(?P<pattern>/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)", re.S)


def _blank(text: str, patterns: bool = False) -> str:
    """The text with comments and the insides of literals blanked, so that braces and words are code; offsets stay.
    ``patterns``: those between slashes are literals as well."""
    def cover(m: re.Match) -> str:
        body = m[0]
        if m.lastgroup == "text":
            return body[0] + re.sub(r"[^\n]", "_", body[1:-1]) + body[-1] if len(body) > 1 else body
        if m.lastgroup == "pattern":
            return m["before"] + '"' + "_" * (len(m["pattern"]) - 2) + '"'
        return re.sub(r"[^\n]", " ", body)

    return (_JS_SKIP if patterns else _SKIP).sub(cover, text)


def _without_mark(text: str) -> str:
    """A byte order mark as a blank, so that offsets stay."""
    return " " + text[1:] if text.startswith("﻿") else text


def _close(code: str, i: int, pair: str = "{}") -> int:
    level = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, i):
        level += 1 if m[0] == pair[0] else -1
        if level == 0:
            return m.start()
    return len(code)


def _split(text: str, mark: str = ",") -> list[tuple[int, int]]:
    """Ranges of the parts of a list, separated on the outer level."""
    out, level, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            level += 1
        elif c in ")]}>" and text[i - 1 : i + 1] != "=>":
            level -= 1
        elif c == mark and level <= 0:
            out.append((start, i))
            start = i + 1
    if text[start:].strip():
        out.append((start, len(text)))
    return out


_CS_TYPE = re.compile(r"(?P<attrs>(?:\[[^\]\n]*\]\s*)*)(?P<mods>(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|new|file|ref)\s+)*)(?P<kind>class|struct|interface|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>@?\w+)(?P<generic>\s*<[^>{;]*>)?(?P<primary>\s*\([^{;]*?\))?\s*(?::\s*(?P<bases>[^{;]+?))?(?:\s+where\s[^{;]*)?\s*(?P<end>[{;])")
_CS_MEMBER = re.compile(
    r"(?P<attrs>(?:\[[^\]\n]*\]\s*)*)(?P<mods>(?:(?:public|private|protected|internal|static|sealed|abstract|virtual|override|async|readonly|const|extern|new|partial|unsafe|required|volatile|event)\s+)*)"
    r"(?:(?P<type>(?:[\w.:]+\s*(?:<[^;{}()=]*?>)?|\([^()]*\))(?:\?|\[[,\s]*\])*)\s+)?(?P<name>~?[\w.]+)\s*(?P<generic><[\w\s,]*>)?\s*(?P<mark>\(|\{|=>|=(?!=)|;)"
)
_WORDS = frozenset("if else for foreach while do switch case return throw try catch finally using lock new await var yield break continue goto fixed checked unchecked unsafe default in is as out ref params this base typeof nameof namespace get set init add remove where select from".split())


def _modifiers(words: str) -> int:
    out = 0
    for w in words.split():
        out |= MODIFIERS.get(w, 0)
    return out


def _attributes(text: str) -> list[str]:
    return [re.sub(r"Attribute$", "", a) for a in re.findall(r"[\[,]\s*(?:\w+:\s*)?([A-Za-z_][\w.]*)", text)]


def _parameters(text: str) -> list[dict]:
    out = []
    for a, b in _split(text):
        p = re.sub(r"^\s*(?:\[[^\]]*\]\s*)*", "", text[a:b]).strip()
        head, eq, default = p.partition("=")
        words = head.strip().rsplit(None, 1)
        kind = re.sub(r"^(?:(?:this|ref|out|in|params|scoped|readonly)\s+)+", "", words[0]) if len(words) > 1 else None
        out.append({"Name": words[-1] if words else "", "Type": _ref(kind), "Variadic": bool(re.match(r"params\s", p)), "Kwargs": False, "Defaulted": bool(eq), "DefaultValue": default.strip() or None})
    return out


def parse_csharp(text: str, bodies: bool = True) -> dict:
    text = _without_mark(text)
    code = _blank(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    from bisect import bisect_right

    line = lambda i: bisect_right(starts, i)
    documented = lambda i: "///" in text[max(0, text.rfind("\n", 0, max(0, text.rfind("\n", 0, i))) ) : i]
    types: list[dict] = []
    statements: list[dict] = []
    spans: list[tuple[str, int, int]] = []

    def scan(begin: int, end: int, parent: str | None) -> list[str]:
        names, i = [], begin
        while i < end:
            m = _CS_TYPE.search(code, i, end)
            if not m:
                break
            if m["end"] == ";" and not m["kind"].startswith("record"):
                i = m.end()
                continue
            close = _close(code, m.end() - 1) if m["end"] == "{" else m.end()
            kind = "Struct" if "struct" in m["kind"] else "Class" if m["kind"].startswith(("record", "class")) else m["kind"].capitalize()
            bases = [m["bases"][a:b].split("(")[0].strip() for a, b in _split(m["bases"])] if m["bases"] else []
            row = {"Name": m["name"], "Kind": kind, "Modifiers": _modifiers(m["mods"]), "BaseTypes": bases, "Constructors": [], "Methods": [], "Fields": [], "Properties": [], "Events": [], "EnumValues": [], "Decorators": _attributes(m["attrs"]), "NestedTypes": [], "Parent": parent, "Line": line(m.start("kind")), "Documented": documented(m.start())}
            types.append(row)
            names.append(m["name"])
            if m["end"] == "{":
                if kind == "Enum":
                    row["EnumValues"] = [v for v in (re.sub(r"\[[^\]]*\]", "", code[m.end() : close][a:b]).partition("=")[0].strip() for a, b in _split(code[m.end() : close])) if v]
                else:
                    members(row, m.end(), close)
                    row["NestedTypes"] = scan(m.end(), close, m["name"])
            i = close + 1
        return names

    def members(row: dict, begin: int, end: int) -> None:
        i = begin
        while i < end:
            t = _CS_TYPE.match(code, i, end)
            if t:
                i = (_close(code, t.end() - 1) if t["end"] == "{" else t.end()) + 1
                continue
            m = _CS_MEMBER.match(code, i, end)
            if not m or m["name"] in _WORDS or not m["type"] and m["mark"] != "(":
                i += 1
                nxt = re.compile(r"[A-Za-z_~\[(]").search(code, i, end)
                i = nxt.start() if nxt else end
                # stay at word starts
                while i < end and i > begin and (code[i - 1].isalnum() or code[i - 1] == "_"):
                    i += 1
                continue
            at = m.start("type") if m["type"] else m.start("name")
            common = {"Modifiers": _modifiers(m["mods"]), "Line": line(at), "Documented": documented(m.start())}
            name = m["name"].rsplit(".", 1)[-1]
            if m["mark"] == "(":
                stop = _close(code, m.end() - 1, "()")
                after = re.compile(r"\s*(?::\s*(?:base|this)\s*)?").match(code, stop + 1)
                rest = after.end()
                if code[rest : rest + 1] == "(":
                    rest = _close(code, rest, "()") + 1
                w = re.compile(r"(?:\s*where\s[^{;=]*)?\s*(\{|=>|;)").match(code, rest)
                if not w:
                    i = m.end()
                    continue
                method = common | {"Name": ".ctor" if not m["type"] else name, "ReturnType": _ref(text[m.start("type") : m.end("type")]) if m["type"] else None, "Parameters": _parameters(text[m.end() : stop]), "Decorators": _attributes(m["attrs"])}
                (row["Constructors"] if not m["type"] else row["Methods"]).append(method)
                if w[1] == "{":
                    close = _close(code, w.end() - 1)
                    spans.append((method["Name"], w.end(), close))
                    i = close + 1
                elif w[1] == "=>":
                    close = code.find(";", w.end(), end)
                    close = end if close < 0 else close
                    spans.append((method["Name"], w.end(), close + 1))
                    i = close + 1
                else:
                    i = w.end()
                continue
            item = common | {"Name": name, "Type": _ref(text[m.start("type") : m.end("type")]), "HasGetter": False, "HasSetter": False}
            if re.search(r"\bevent\b", m["mods"]):
                row["Events"].append(item)
            elif m["mark"] in ("{", "=>"):
                close = _close(code, m.end() - 1) if m["mark"] == "{" else code.find(";", m.end(), end)
                body = code[m.end() : close]
                item["HasGetter"], item["HasSetter"] = m["mark"] == "=>" or bool(re.search(r"\bget\b", body)), bool(re.search(r"\b(?:set|init)\b", body))
                row["Properties"].append(item)
                i = (close if close >= 0 else end) + 1
                continue
            else:
                row["Fields"].append(item)
            close = code.find(";", m.end() - 1, end)
            if "{" in code[m.end() : close if close >= 0 else end]:
                brace = code.index("{", m.end())
                close = code.find(";", _close(code, brace), end)
            i = (close if close >= 0 else end) + 1

    scan(0, len(code), None)
    for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", code):
        _statement(statements, [], None, Kind="using", TypeName=m[1], Line=line(m.start(1)), Expression=m[1])
    for m in re.finditer(r"(?m)^\s*\[assembly:\s*(\w+?)(?:Attribute)?\s*(?:\(([^\n]*)\))?\s*\]", text):
        _statement(statements, [], None, Kind="attribute", TypeName=m[1], Arguments=[m[2][a:b].strip().strip('"') for a, b in _split(m[2] or "")], Line=line(m.start(1)), Expression=m[0].strip())
    for name, a, b in () if not bodies else sorted(spans, key=lambda x: x[1]):
        _block(text, code, a, b, [], name, statements, line, "csharp")
    return {"types": types, "statements": statements}


_HEAD = re.compile(r"(?P<word>if|else\s+if|else|for|foreach|while|switch|using|lock|try|catch|finally|do)\b\s*")
_CALL = re.compile(r"(?P<new>new\s+)?(?P<path>(?:this|base|super|[A-Za-z_$][\w$]*)(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)(?P<generic><[\w\s,.<>]*>)?\s*\(")


def _simple(text: str, code: str, a: int, b: int, stack: list[dict], method: str | None, out: list[dict], line, language: str) -> None:
    """One statement without a block: declaration, call, throw, return, await."""
    body = code[a:b]
    lead = len(body) - len(body.lstrip())
    a += lead
    body = code[a:b].rstrip()
    if not body:
        return
    source = text[a : a + len(body)]
    at = line(a)
    m = re.match(r"(throw|return|yield\s+return)\b\s*", body)
    if m and m[1] == "throw":
        n = re.match(r"new\s+([\w.]+)", body[m.end() :])  # of a variable that is thrown the type is not written
        inner = body.find("(")
        _statement(out, stack, method, Kind="throw", TypeName=n[1] if n else None, Arguments=_arguments(source, body, inner), Line=at, Expression=source[m.end() :] or None)
        return
    if m:
        _statement(out, stack, method, Kind="return", Line=at, Expression=source[m.end() :] or None)
        start = m.end()
    elif language == "javascript" and re.match(r"debugger\b", body):
        _statement(out, stack, method, Kind="call", MemberName="debugger", Line=at, Expression="debugger")
        return
    else:
        start = 0
        if language == "csharp" and (held := re.match(r"(?:await\s+)?using\s+(?=[\w.<>\[\]?]+\s+@?\w+\s*=)", body)):
            a, body, source = a + held.end(), body[held.end() :], source[held.end() :]
        d = re.match(r"(?:(const|let|var)\s+([\w$]+|\{[^}]*\}|\[[^\]]*\])|(?:(const)\s+)?((?:[\w.]+(?:<[^=;()]*>)?(?:\[\])*\??))\s+(@?\w+))\s*(?:=(?!=|>)|$)", body) if language == "javascript" else re.match(r"(?:(const)\s+)?(var|dynamic|(?:[\w.]+(?:<[^=;()]*>)?(?:\[[,]*\])*\??))\s+(@?\w+)\s*(?:=(?!=|>)|$)", body)
        if d and d[1 if language == "javascript" else 2] not in ("await", "return", "throw", "new", "goto"):
            word, name = (d[1], d[2]) if language == "javascript" else (d[2], d[3])
            kind = None if word in ("var", "dynamic", "const", "let") else word
            _statement(out, stack, method, Kind="declaration", Keywords=[word] if kind is None else [], TypeName=kind, MemberName=name, Line=at, Expression=source[d.end() :].strip() or None)
            start = d.end()
        else:
            s = re.match(r"[\w.\[\]$]+\s*(?:[-+*/%&|^]|\?\?|<<|>>)?=(?![=>])\s*", body)
            start = s.end() if s else 0
    rest = body[start:]
    w = re.match(r"\s*await\s+", rest)
    if w:
        _statement(out, stack, method, Kind="await", Line=at, Expression=source[start + w.end() :])
        start += w.end()
        rest = body[start:]
    c = re.match(r"\s*", rest)
    k = _CALL.match(rest, c.end())
    if k:
        # the outermost call of a chain: the last one on the outer level
        last, pos = k, None
        i = k.end() - 1
        while True:
            stop = _close(rest, i, "()")
            pos = (i, stop)
            n = re.compile(r"\s*\??\.\s*([A-Za-z_$][\w$]*)(?:<[\w\s,.<>]*>)?\s*\(").match(rest, stop + 1)
            if not n:
                break
            last, i = n, n.end() - 1
        raw = source[start:]
        if last is k:
            path = re.sub(r"\s", "", k["path"]).replace("?.", ".")
            receiver, _, member = path.rpartition(".")
            if k["new"]:
                receiver, member = path, ""
        else:
            receiver, member = raw[c.end() : last.start()].strip(), last[1]
        _statement(out, stack, method, Kind="call", TypeName=receiver or None, MemberName=member or None, Arguments=_arguments(raw, rest, pos[0]), Line=at, Expression=raw[c.end() : pos[1] + 1])


def _arguments(source: str, code: str, i: int) -> list[str]:
    if i < 0 or code[i : i + 1] != "(":
        return []
    stop = _close(code, i, "()")
    inner = code[i + 1 : stop]
    return [source[i + 1 + a : i + 1 + b].strip() for a, b in _split(inner)]


def _block(text: str, code: str, a: int, b: int, stack: list[dict], method: str | None, out: list[dict], line, language: str) -> None:
    """The statements between two offsets."""
    i, last_if = a, None
    while i < b:
        m = re.compile(r"\s*").match(code, i, b)
        i = m.end()
        if i >= b:
            return
        c = code[i]
        if c in ";}":
            i += 1
            continue
        if c == "{":
            close = _close(code, i)
            _block(text, code, i + 1, min(close, b), stack, method, out, line, language)
            i = close + 1
            continue
        awaited = re.compile(r"await\s+(?=foreach\b|using\s*\()").match(code, i, b) if language == "csharp" else None
        h = _HEAD.match(code, awaited.end() if awaited else i, b)
        if h and not (h["word"] == "using" and code[h.end() : h.end() + 1] != "("):
            word = re.sub(r"\s+", " ", h["word"])
            j, condition = h.end(), None
            if language == "javascript" and word == "for" and code.startswith("await", j):
                j += 5
                j = re.compile(r"\s*").match(code, j).end()
            inner = ""
            if code[j : j + 1] == "(":
                stop = _close(code, j, "()")
                inner = text[j + 1 : stop].strip()
                j = stop + 1
            at = line(i)
            if word in ("if", "else if", "while"):
                condition = inner
            elif word == "for" and language == "csharp":
                marks = [m.start() for m in re.finditer(";", _blank(inner))]
                condition = inner[marks[0] + 1 : marks[1]].strip() or None if len(marks) > 1 else None
            row = None
            if word == "else if" and last_if is not None:
                other = _statement(out, [*stack, last_if], method, Kind="else", Line=at)
                row = _statement(out, [*stack, last_if, other], method, Kind="if", Condition=condition, Line=at)
                outer = [*stack, last_if, other]
                last_if = row
            elif word == "else":
                outer = [*stack, last_if] if last_if is not None else stack
                row = _statement(out, outer, method, Kind="else", Line=at)
            elif word == "catch":
                name = re.match(r"[\w.]+", inner)
                kind = name[0] if name and language == "csharp" else None
                row = _statement(out, stack, method, Kind="catch", TypeName=kind, Generic=language == "javascript" or kind in (None, "Exception", "System.Exception"), ErrorHandler=True, Line=at)
                outer = stack
            elif word == "finally":
                outer, row = stack, None
            else:
                outer = stack
                kind = "foreach" if word == "foreach" or word == "for" and re.search(r"\b(?:of|in)\b", inner) and language == "javascript" else word
                if kind == "foreach":
                    condition = re.sub(r"^.*?\b(?:in|of)\b\s*", "", inner, flags=re.S)
                held = re.match(r"(?P<type>.+?)\s+(?P<name>@?\w+)\s+in\b", inner, re.S) if word == "foreach" else None
                row = _statement(out, outer, method, Kind=kind, TypeName=held["type"] if held else None, MemberName=held["name"] if held else None, Condition=condition, Line=at, Expression=inner if word in ("using", "switch") else None)
                if word == "if":
                    last_if = row
            inside = [*outer, row] if row is not None else outer
            j = re.compile(r"\s*(?:when\s*)?").match(code, j).end()
            if word == "catch" and code[j : j + 1] == "(":
                j = re.compile(r"\s*").match(code, _close(code, j, "()") + 1).end()
            if code[j : j + 1] == "{":
                close = _close(code, j)
                _block(text, code, j + 1, min(close, b), inside, method, out, line, language)
                if word == "catch":
                    row["Rethrows"] = bool(re.search(r"\bthrow\b", code[j:close]))
                i = close + 1
            else:
                end = _end(code, j, b)
                if _HEAD.match(code, j, b):
                    _block(text, code, j, end, inside, method, out, line, language)
                else:
                    _simple(text, code, j, end, inside, method, out, line, language)
                i = end + 1
            continue
        k = re.compile(r"(?:case\b[^:;{}]*|default\s*):(?!:)").match(code, i, b)
        if k:
            i = k.end()
            continue
        end = _end(code, i, b)
        _simple(text, code, i, end, stack, method, out, line, language)
        i = end + 1


def _end(code: str, i: int, b: int) -> int:
    """Where a simple statement ends: a semicolon on its level, or a line end that closes it in JavaScript."""
    level = 0
    while i < b:
        c = code[i]
        if c in "([{":
            level += 1
        elif c in ")]}":
            level -= 1
            if level < 0:
                return i
        elif c == ";" and level == 0:
            return i
        i += 1
    return b


_JS_CLASS = re.compile(r"(?P<export>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+)[^{]*)?[^{;]*\{")
_JS_METHOD = re.compile(r"(?P<mods>(?:(?:static|async|public|private|protected|override|readonly|get|set)\s+)*)\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^(]*>)?\((?P<params>[^{}]*?)\)\s*(?::\s*(?P<ret>[^{;]+?))?\s*\{")


def parse_javascript(text: str, bodies: bool = True) -> dict:
    text = _without_mark(text)
    code = _blank(text, patterns=True)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    from bisect import bisect_right

    line = lambda i: bisect_right(starts, i)
    types: list[dict] = []
    statements: list[dict] = []
    covered: list[tuple[int, int]] = []
    pieces: list[tuple[int, int, str | None]] = []
    for m in _JS_CLASS.finditer(code):
        close = _close(code, m.end() - 1)
        row = {"Name": m["name"], "Kind": "Class", "Modifiers": MODIFIERS["public"] if m["export"] else 0, "BaseTypes": [m["base"]] if m["base"] else [], "Constructors": [], "Methods": [], "Fields": [], "Properties": [], "Events": [], "EnumValues": [], "Decorators": [], "NestedTypes": [], "Parent": None, "Line": line(m.start("name")), "Documented": "*/" in text[max(0, m.start() - 4) : m.start()]}
        i = m.end()
        while f := _JS_METHOD.search(code, i, close):
            if f["name"] in ("if", "for", "while", "switch", "catch", "function", "return"):
                i = f.end()
                continue
            end = _close(code, f.end() - 1)
            params = []
            for a, b in _split(f["params"]):
                p = text[f.start("params") + a : f.start("params") + b].strip()
                head, eq, default = p.partition("=")
                name, _, kind = head.strip().lstrip(".").partition(":")
                params.append({"Name": name.strip().rstrip("?"), "Type": _ref(kind.strip()), "Variadic": p.startswith("..."), "Kwargs": False, "Defaulted": bool(eq), "DefaultValue": default.strip() or None})
            words = f["mods"].split()
            method = {"Name": f["name"], "Modifiers": MODIFIERS["public"] | _modifiers(" ".join(w for w in words if w in ("static", "async"))), "ReturnType": _ref(f["ret"]), "Parameters": params, "Decorators": [], "Line": line(f.start("name")), "Documented": "*/" in text[max(0, f.start() - 8) : f.start()]}
            row["Constructors" if f["name"] == "constructor" else "Methods"].append(method)
            pieces.append((f.end(), end, f["name"]))
            i = end + 1
        types.append(row)
        covered.append((m.start(), close + 1))
    for m in re.finditer(r"\bfunction\s*\*?\s*([\w$]+)\s*\([^{]*?\)\s*\{", code):
        if not any(a <= m.start() < b for a, b in covered):
            close = _close(code, m.end() - 1)
            pieces.append((m.end(), close, m[1]))
            covered.append((m.start(), close + 1))
    at = 0
    for a, b in sorted(covered):
        if a > at:
            pieces.append((at, a, None))
        at = max(at, b)
    pieces.append((at, len(code), None))
    for a, b, name in () if not bodies else sorted(pieces, key=lambda p: (p[0], p[1])):
        _block(text, code, a, b, [], name, statements, line, "javascript")
    return {"types": types, "statements": statements}


PARSERS = {"csharp": parse_csharp, "python": parse_python, "javascript": parse_javascript, "typescript": parse_javascript}


def parsed_files(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "raw_text", parts: Sequence[str] = ("types", "statements")) -> DataFrame:
    """``<key>, path, language`` and the wanted ``parts`` of files in a language with a parser; one pass in batches. Without
    ``statements`` the bodies of methods are not read, and nothing but what is asked for comes back from Python."""
    kind = files.schema[key].dataType
    wanted = ", ".join(PARSED[p] for p in parts)
    fields, bodies = to_arrow_schema(StructType.fromDDL(wanted)), "statements" in parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for language, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                try:
                    out.append(PARSERS[language](t, bodies) if t else {"types": [], "statements": []})
                except RecursionError:
                    out.append({"types": [], "statements": []})
            arrays = [pa.array([o[f.name] for o in out], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays], names=[*b.schema.names[:3], *parts])

    named = files.select(key, F.col(path).alias("path"), language_of(F.col(path)).alias("language"), F.col(text).alias("raw_text")).where(F.col("language").isin(list(PARSERS)))
    return spread(named, files).mapInArrow(run, f"`{key}` {kind.simpleString()}, path string, language string, {wanted}")


def _file() -> Column:
    return F.struct(F.col("path").alias("Path"), F.col("language").alias("Language")).alias("File")


def _source(line: str) -> Column:
    return F.concat(F.col("path"), F.lit(":"), F.col(line).cast("string"))


def types(parsed: DataFrame, key: str = "file_id", top_only: bool = True) -> Collection:
    """``Type`` items: types that are nested in no other one."""
    rows = parsed.select(key, "path", _file(), F.posexplode("types").alias("at", "t"))
    if top_only:
        rows = rows.where("t.Parent IS NULL")
    df = rows.select(key, "File", "at", "t.*", F.concat(F.col("path"), F.lit(":"), F.col("t.Name")).alias("Source"), F.transform("t.Methods", lambda m: m["Name"]).alias("MethodNames"))
    c = Collection.of(df, "Type", [key, "at"])
    return Collection(c.df.drop("at"), K.record([f for f in c.ty.fields if f[0] != "at"], "Type"), c.order)


def statements(parsed: DataFrame, key: str = "file_id") -> Collection:
    rows = parsed.select(key, "path", _file(), F.explode("statements").alias("s"))
    df = rows.select(key, "File", "s.*", F.concat(F.col("path"), F.lit(":"), F.coalesce("s.MemberName", "s.TypeName", "s.Kind")).alias("Source"))
    return Collection.of(df, "Statement", [key, "Id"])


def members(parsed: DataFrame, key: str = "file_id") -> Collection:
    """Flat members of top-level types: methods, properties, events, fields."""
    base = parsed.select(key, F.posexplode("types").alias("at", "t")).where("t.Parent IS NULL")
    pairs = F.concat(*(F.transform(f"t.{n}", lambda m: F.struct(m["Name"].alias("Name"), m["Line"].alias("Line"))) for n in ("Methods", "Properties", "Events", "Fields")))
    df = base.select(key, "at", F.col("t.Name").alias("DeclaringType"), F.posexplode(pairs).alias("k", "m")).select(key, "m.Name", "DeclaringType", "m.Line", "at", "k")
    return Collection.of(df, "Member", [key, "at", "k"])


def _signature(kind: str, m: Column) -> Column:
    params = F.array_join(F.transform(m["Parameters"], lambda p: F.concat_ws(" ", p["Type"]["text"], p["Name"])), ", ")
    if kind == "Constructors":
        return F.concat(m["Name"], F.lit("("), params, F.lit(")"))
    return F.concat(F.coalesce(F.concat(m["ReturnType"]["text"], F.lit(" ")), F.lit("")), m["Name"], F.lit("("), params, F.lit(")"))


def api(parsed: DataFrame, key: str = "file_id") -> Collection:
    """The public interface: public types, their enum values, and public or protected members, each with its signature."""
    visible = lambda m: m["Modifiers"].bitwiseAND(F.lit(MODIFIERS["public"] | MODIFIERS["protected"])) != 0
    base = parsed.select(key, "path", F.posexplode("types").alias("at", "t")).where((F.col("t.Parent").isNull()) & (F.col("t.Modifiers").bitwiseAND(F.lit(1)) != 0))
    entry = lambda kind, member, signature, line: F.struct(F.lit(kind).alias("Kind"), member.alias("MemberName"), signature.alias("Signature"), line.alias("Line"))
    own = F.array(entry("Type", F.lit(None).cast("string"), F.concat(F.lower("t.Kind"), F.lit(" "), F.col("t.Name"), F.when(F.size("t.BaseTypes") > 0, F.concat(F.lit(" : "), F.array_join("t.BaseTypes", ", "))).otherwise(F.lit(""))), F.col("t.Line")))
    values = F.transform("t.EnumValues", lambda v: entry("EnumValue", v, v, F.col("t.Line")))
    parts = [own, values]
    def method(name: str, kind: str):
        return lambda m: entry(kind, m["Name"], _signature(name, m), m["Line"])

    def field(kind: str):
        return lambda m: entry(kind, m["Name"], F.concat_ws(" ", m["Type"]["text"], m["Name"]), m["Line"])

    parts += [F.transform(F.filter(f"t.{n}", visible), method(n, k)) for n, k in (("Constructors", "Constructor"), ("Methods", "Method"))]
    parts += [F.transform(F.filter(f"t.{n}", visible), field(k)) for n, k in (("Properties", "Property"), ("Fields", "Field"), ("Events", "Event"))]
    rows = base.select(key, "path", "at", F.col("t.Name").alias("TypeName"), F.posexplode(F.concat(*parts)).alias("k", "e"))
    df = rows.select(key, "e.Kind", "TypeName", "e.MemberName", "e.Signature", "e.Line", F.col("path").alias("File"), "at", "k")
    return Collection.of(df, "Api", [key, "at", "k"])


def api_stub(listing: Collection) -> Collection:
    """One text per type: its signatures as an indented stub."""
    return listing.group_by("TypeName").select_record(TypeName="Key", Text="Items.Text('{Signature}')")


def inherits_from(v, args):
    """``Type:inheritsFrom('X')``: a base named so, or qualified so; case counts."""
    from colligo.functions.values import as_text, boolean

    name = as_text(args[0])
    return boolean(F.coalesce(F.exists(v.col["BaseTypes"], lambda b: (b == name) | F.endswith(b, F.concat(F.lit("."), name))), F.lit(False)))


METHODS = {("Type", "inheritsFrom"): inherits_from}
NAMES = ("Files", "Types", "Statements", "Members", "Api", "Regions")


def source_for(language: str):
    """A source of one language's collections under a root."""
    extensions = {"csharp": "*.cs", "python": "*.py", "javascript": "*.{js,ts,jsx,tsx}"}

    def source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
        from colligo.sources.text import files_of

        texts = read_texts(spark, root, extensions[language])
        named = texts.withColumnsRenamed({"Path": "path", "Text": "raw_text"}).withColumn("file_id", F.col("path"))
        parsed = lambda part: parsed_files(named, parts=[part])
        make = {"Files": lambda: files_of(texts), "Types": lambda: types(parsed("types")), "Statements": lambda: statements(parsed("statements")), "Members": lambda: members(parsed("types")), "Api": lambda: api(parsed("types")), "Regions": lambda: regions_of(texts, "Text", ["Path"])}
        return {n: make[n]() for n in names if n in make}

    return source
