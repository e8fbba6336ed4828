"""TypeSpec: the declarations of spec files, and the HTTP operations they describe.

Declarations are parsed file by file where the files are read. HTTP operations are resolved over all files of a spec together,
since templates, models and routes reach across them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.collection import Collection
from colligo.functions import types as K
from colligo.sources.text import read_texts

_DECORATORS = "array<struct<Name:string,Arguments:array<string>>>"
_PROPERTY = f"struct<Name:string,Type:string,Optional:boolean,Default:string,Decorators:{_DECORATORS}>"
_OPERATION = f"struct<Name:string,Namespace:string,Interface:string,Parameters:array<{_PROPERTY}>,ReturnType:string,Decorators:{_DECORATORS}>"
SCHEMAS = {
    "Models": f"Name string, Namespace string, Properties array<{_PROPERTY}>, BaseModel string, Decorators {_DECORATORS}",
    "Operations": f"Name string, Namespace string, Interface string, Parameters array<{_PROPERTY}>, ReturnType string, Decorators {_DECORATORS}",
    "Interfaces": f"Name string, Namespace string, Operations array<{_OPERATION}>, TemplateParameters array<string>, Extends array<string>, Decorators {_DECORATORS}",
    "Enums": f"Name string, Namespace string, Members array<struct<Name:string,Value:string,Decorators:{_DECORATORS}>>, Decorators {_DECORATORS}",
    "Unions": f"Name string, Namespace string, Variants array<struct<Name:string,Type:string>>, Decorators {_DECORATORS}",
    "Scalars": f"Name string, Namespace string, BaseScalar string, Decorators {_DECORATORS}",
    "Namespaces": f"Name string, FullName string, Decorators {_DECORATORS}",
}
_HTTP_OPERATION = f"struct<Name:string,Verb:string,Path:string,UriTemplate:string,Parameters:array<struct<Name:string,Type:string,In:string,Optional:boolean,Style:string>>,Responses:array<struct<StatusCode:string,Description:string,Body:string,Headers:array<struct<Name:string,Type:string>>>>,Interface:string,Decorators:{_DECORATORS}>"
HTTP_SCHEMAS = {"Operations": _HTTP_OPERATION.removeprefix("struct<")[:-1], "Services": f"Name string, Namespace string, Operations array<{_HTTP_OPERATION}>, Auth string"}
ITEMS = {"Models": "TspModel", "Operations": "TspOperation", "Interfaces": "TspInterface", "Enums": "TspEnum", "Unions": "TspUnion", "Scalars": "TspScalar", "Namespaces": "TspNamespace"}
_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<text>\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\]|\\.)*\")|(?P<name>`[^`]+`|[A-Za-z_$][\w$]*)|(?P<number>-?\d[\w.]*)|(?P<mark>\.\.\.|@@?|::|#\{|#\[|=>|[{}()\[\]<>:;,.|&=?*#+\-/])", re.S)
VERBS = ("get", "put", "post", "patch", "delete", "head")


class SpecError(ValueError):
    pass


@dataclass
class Graph:
    """All declarations, as plain rows."""

    rows: dict[str, list[dict]] = field(default_factory=lambda: {k: [] for k in SCHEMAS})


class SpecParser:
    def __init__(self, source: str, graph: Graph):
        self.source, self.graph = source, graph
        self.tokens: list[tuple[str, str, int, int]] = []
        i = 0
        while i < len(source):
            m = _TOKEN.match(source, i)
            if not m:
                raise SpecError(f"unexpected {source[i]!r} at line {source.count(chr(10), 0, i) + 1}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0].strip("`") if m.lastgroup == "name" else m[0], m.start(), m.end()))
            i = m.end()
        self.tokens.append(("end", "", i, i))
        self.i = 0

    def value(self, n: int = 0) -> str:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)][1]

    def kind(self) -> str:
        return self.tokens[self.i][0]

    def take(self, v: str) -> bool:
        if self.value() == v and self.kind() != "text":
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            line = self.source.count("\n", 0, self.tokens[self.i][2]) + 1
            raise SpecError(f"line {line}: expected {v!r}, found {self.value()!r}")

    def name(self) -> str:
        if self.kind() not in ("name", "text"):
            self.need("a name")
        self.i += 1
        return self.tokens[self.i - 1][1].strip('"')

    def dotted(self) -> str:
        out = self.name()
        while self.take("."):
            out += "." + self.name()
        return out

    def until(self, stops: tuple[str, ...]) -> str:
        """Source text up to one of the marks on the outer level."""
        start, level = self.tokens[self.i][2], 0
        while self.kind() != "end":
            v = self.value()
            if level == 0 and v in stops and self.kind() == "mark":
                break
            if self.kind() == "mark" and v in ("(", "[", "{", "<", "#{", "#["):
                level += 1
            elif self.kind() == "mark" and v in (")", "]", "}", ">"):
                if level == 0:
                    break
                level -= 1
            self.i += 1
        end = self.tokens[self.i - 1][3] if self.i else start
        return re.sub(r"\s+", " ", self.source[start : max(start, end)]).strip()

    def decorators(self) -> list[dict]:
        out = []
        while self.take("@"):
            name, args = self.dotted(), []
            if self.take("("):
                while self.value() != ")" and self.kind() != "end":
                    a = self.until((",", ")"))
                    args.append(a[1:-1] if a.startswith('"') and a.endswith('"') and not a.startswith('"""') else a)
                    if not self.take(","):
                        break
                self.need(")")
            out.append({"Name": name, "Arguments": args})
        return out

    def parse(self, namespace: str = "") -> None:
        space = namespace
        while self.kind() != "end" and self.value() != "}":
            if self.take(";"):
                continue
            if self.take("#"):  # a directive to the end of its line
                line_end = self.source.find("\n", self.tokens[self.i - 1][3])
                while self.kind() != "end" and (line_end < 0 or self.tokens[self.i][2] < line_end):
                    self.i += 1
                continue
            if self.take("@@"):
                self.until((";",))
                continue
            decorators = self.decorators()
            v = self.value()
            if v in ("import", "using", "alias", "const", "dec", "fn", "extern"):
                self.until((";",))
                self.take(";")
            elif v == "namespace":
                self.i += 1
                name = self.dotted()
                full = f"{space}.{name}" if space else name
                self.graph.rows["Namespaces"].append({"Name": name, "FullName": full, "Decorators": decorators})
                if self.take("{"):
                    self.parse(full)
                    self.need("}")
                else:
                    self.take(";")
                    space = full
            elif v == "model":
                self.model(space, decorators)
            elif v == "interface":
                self.interface(space, decorators)
            elif v == "op":
                self.graph.rows["Operations"].append(self.operation(space, None, decorators))
                self.take(";")
            elif v == "enum":
                self.i += 1
                name, members = self.name(), []
                self.need("{")
                while not self.take("}"):
                    d = self.decorators()
                    if self.take("..."):
                        self.until((",", ";"))
                    else:
                        n = self.name()
                        members.append({"Name": n, "Value": self.until((",", ";", "}")).strip('"') if self.take(":") else None, "Decorators": d})
                    self.take(",") or self.take(";")
                self.graph.rows["Enums"].append({"Name": name, "Namespace": space or None, "Members": members, "Decorators": decorators})
            elif v == "union":
                self.i += 1
                name, variants = self.name(), []
                self.template()
                self.need("{")
                while not self.take("}"):
                    self.decorators()
                    first = self.until((":", ",", ";", "}"))
                    variants.append({"Name": first.strip('"'), "Type": self.until((",", ";", "}"))} if self.take(":") else {"Name": "", "Type": first})
                    self.take(",") or self.take(";")
                self.graph.rows["Unions"].append({"Name": name, "Namespace": space or None, "Variants": variants, "Decorators": decorators})
            elif v == "scalar":
                self.i += 1
                name = self.name()
                self.template()
                base = self.until((";", "{")) if self.take("extends") else None
                if self.take("{"):
                    self.until(("}",))
                    self.need("}")
                self.take(";")
                self.graph.rows["Scalars"].append({"Name": name, "Namespace": space or None, "BaseScalar": base, "Decorators": decorators})
            else:
                self.until((";", "}"))
                if not self.take(";") and self.value() != "}":
                    self.i += 1

    def template(self) -> list[str]:
        if not self.take("<"):
            return []
        out = []
        while self.value() != ">" and self.kind() != "end":
            out.append(re.split(r"\s|=", self.until((",", ">")))[0])
            if not self.take(","):
                break
        self.need(">")
        return out

    def properties(self, close: str) -> list[dict]:
        out = []
        while self.value() != close and self.kind() != "end":
            d = self.decorators()
            if self.take("..."):
                out.append({"Name": "...", "Type": self.until((",", ";", close)), "Optional": False, "Default": None, "Decorators": d})
            else:
                name = self.name()
                optional = self.take("?")
                self.need(":")
                kind = self.until((",", ";", "=", close))
                default = self.until((",", ";", close)) if self.take("=") else None
                out.append({"Name": name, "Type": kind, "Optional": optional, "Default": default, "Decorators": d})
            if not (self.take(",") or self.take(";")):
                break
        return out

    def model(self, space: str, decorators: list[dict]) -> None:
        self.i += 1
        name = self.name()
        self.template()
        base, props = None, []
        if self.value() in ("extends", "is"):
            self.i += 1
            base = self.until(("{", ";"))
        elif self.take("="):
            base = self.until((";",))
        if self.take("{"):
            props = self.properties("}")
            self.need("}")
        self.take(";")
        self.graph.rows["Models"].append({"Name": name, "Namespace": space or None, "Properties": props, "BaseModel": base, "Decorators": decorators})

    def operation(self, space: str, interface: str | None, decorators: list[dict]) -> dict:
        self.take("op")
        name = self.name()
        self.template()
        row = {"Name": name, "Namespace": space or None, "Interface": interface, "Parameters": [], "ReturnType": "", "Decorators": decorators}
        if self.take("("):
            row["Parameters"] = self.properties(")")
            self.need(")")
            if self.take(":"):
                row["ReturnType"] = self.until((";", "}"))
        elif self.take("is"):
            row["ReturnType"] = "is " + self.until((";", "}"))
        return row

    def interface(self, space: str, decorators: list[dict]) -> None:
        self.i += 1
        name = self.name()
        parameters, extends, operations = self.template(), [], []
        if self.take("extends"):
            while True:
                extends.append(self.until((",", "{")))
                if not self.take(","):
                    break
        self.need("{")
        while self.value() != "}" and self.kind() != "end":
            if self.take(";"):
                continue
            operations.append(self.operation(space, name, self.decorators()))
            self.take(";")
        self.need("}")
        row = {"Name": name, "Namespace": space or None, "Operations": operations, "TemplateParameters": parameters, "Extends": extends, "Decorators": decorators}
        self.graph.rows["Interfaces"].append(row)
        self.graph.rows["Operations"] += operations if not parameters else []


def parse_specs(sources: Sequence[str]) -> Graph:
    graph = Graph()
    for s in sources:
        SpecParser(s, graph).parse()
    return graph


# HTTP
def _has(decorators: list[dict], *names: str) -> dict | None:
    return next((d for d in decorators if d["Name"].rsplit(".", 1)[-1] in names), None)


def _put(text: str, arguments: dict[str, str]) -> str:
    """Template parameters replaced by what was given for them."""
    return re.sub(r"\b\w+\b", lambda m: arguments.get(m[0], m[0]), text) if arguments else text


#: Plurals without a rule (fixed values).
IRREGULAR = {
    "person": "people", "child": "children", "man": "men", "woman": "women", "mouse": "mice", "goose": "geese", "ox": "oxen", "datum": "data", "index": "indices", "matrix": "matrices", "vertex": "vertices", "radius": "radii", "status": "statuses",
}


def _plural(name: str) -> str:
    low = name.lower()
    if low in IRREGULAR:
        return IRREGULAR[low]
    if re.search(r"[^aeiou]y$", low):
        return low[:-1] + "ies"
    return low + ("es" if re.search(r"(?:s|x|z|ch|sh)$", low) else "s")


def _join(*parts: str) -> str:
    out = "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))
    return out


def _route(decorators: list[dict]) -> str:
    d = _has(decorators, "route")
    return d["Arguments"][0] if d and d["Arguments"] else ""


def _union(text: str) -> list[str]:
    out, level, start = [], 0, 0
    for i, c in enumerate(text):
        level += (c in "([{<") - (c in ")]}>")
        if c == "|" and level == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text.strip() else []


def _responses(kind: str) -> list[dict]:
    """A response per member of the returned union: void is 204, an error is 'default', anything else 200."""
    out = []
    for part in _union(kind):
        code = re.search(r"@statusCode\s+\w+\s*:\s*(\d+)", part)
        if part == "void":
            out.append({"StatusCode": "204", "Description": None, "Body": None, "Headers": []})
        elif code:
            body = re.search(r"@body\s+\w+\s*:\s*([^;,}]+)", part)
            headers = [{"Name": n, "Type": t.strip()} for n, t in re.findall(r"@header\s+(\w+)\s*:\s*([^;,}]+)", part)]
            out.append({"StatusCode": code[1], "Description": None, "Body": body[1].strip() if body else None, "Headers": headers})
        else:
            known = {"OkResponse": "200", "CreatedResponse": "201", "AcceptedResponse": "202", "NoContentResponse": "204", "NotFoundResponse": "404", "ConflictResponse": "409", "UnauthorizedResponse": "401", "ForbiddenResponse": "403", "BadRequestResponse": "400"}.get(part)
            error = re.search(r"Error(?:Response)?$", part)
            out.append({"StatusCode": known or ("default" if error else "200"), "Description": None, "Body": None if known else part, "Headers": []})
    return out


def http_graph(graph: Graph) -> dict[str, list[dict]]:
    """``Operations`` and ``Services``: verb, path, where parameters go, responses."""
    spaces = {n["FullName"]: n for n in graph.rows["Namespaces"]}
    models = {m["Name"]: m for m in graph.rows["Models"]}
    interfaces = {i["Name"]: i for i in graph.rows["Interfaces"]}

    def space_route(full: str | None) -> str:
        """The route of the most specific namespace that has one."""
        while full:
            route = _route(spaces[full]["Decorators"]) if full in spaces else ""
            if route:
                return route
            full = full.rpartition(".")[0]
        return ""

    def inherited(i: dict, seen: frozenset[str] = frozenset()) -> tuple[list[tuple[dict, dict[str, str]]], str, bool, str | None]:
        """Operations with their template arguments, the route, whether it is automatic, and the resource's model."""
        ops = [(o, {}) for o in i["Operations"]]
        route, auto, resource = _route(i["Decorators"]), _has(i["Decorators"], "autoRoute") is not None, None
        for e in i["Extends"]:
            m = re.match(r"([\w.]+)\s*(?:<(.*)>)?$", e)
            base = interfaces.get(m[1].rsplit(".", 1)[-1]) if m else None
            if base is None or base["Name"] in seen:
                continue
            given = [g.strip() for g in (m[2] or "").split(",") if g.strip()]
            arguments = dict(zip(base["TemplateParameters"], given))
            more, r, a, res = inherited(base, seen | {i["Name"]})
            ops += [(o, {k: _put(v, arguments) for k, v in inner.items()} | {k: v for k, v in arguments.items() if k not in inner}) for o, inner in more]
            route, auto = route or r, auto or a
            resource = resource or next((g.rstrip("[]?") for g in given if g.rstrip("[]?") in models), None) or res
        return ops, route, auto, resource

    def returned(i: dict) -> str | None:
        """The first model among what the operations of an interface return."""
        parts = (p.rstrip("[]?") for o in i["Operations"] for p in _union(o["ReturnType"]))
        return next((p for p in parts if p in models), None)

    def keys_of(model: str | None) -> set[str]:
        """Key properties of a model and of the models it extends, in lower case."""
        out, seen = set(), set()
        while model in models and model not in seen:
            seen.add(model)
            out |= {p["Name"].lower() for p in models[model]["Properties"] if _has(p["Decorators"], "key")}
            model = models[model]["BaseModel"]
        return out

    out: list[dict] = []

    def add(o: dict, arguments: dict[str, str], container: str, interface: str | None, auto: bool, resource: str | None) -> None:
        verb = next((d["Name"].rsplit(".", 1)[-1] for d in o["Decorators"] if d["Name"].rsplit(".", 1)[-1] in VERBS), None)
        if verb is None:
            return
        params, missing = [], []
        keys = keys_of(resource) if auto else set()
        path = _join(container, _route(o["Decorators"]))
        for p in o["Parameters"]:
            if p["Name"] == "...":
                continue
            d = p["Decorators"]
            where = "path" if _has(d, "path") or p["Name"].lower() in keys or "{" + p["Name"] + "}" in path else "query" if _has(d, "query") else "header" if _has(d, "header") else "body" if _has(d, "body", "bodyRoot") else "query" if verb in ("get", "head", "delete") else "body"
            if where == "path" and "{" + p["Name"] + "}" not in path:
                missing.append(p["Name"])
            params.append({"Name": p["Name"], "Type": _put(p["Type"], arguments), "In": where, "Optional": p["Optional"], "Style": None})
        path = _join(path, *("{" + m + "}" for m in missing))
        query = [p["Name"] for p in params if p["In"] == "query"]
        out.append({"Name": o["Name"], "Verb": verb, "Path": path, "UriTemplate": path + ("{?" + ",".join(query) + "}" if query else ""), "Parameters": params, "Responses": _responses(_put(o["ReturnType"], arguments)), "Interface": interface, "Decorators": o["Decorators"], "_space": o["Namespace"]})

    for i in graph.rows["Interfaces"]:
        if i["TemplateParameters"]:
            continue  # a template gives its operations through extends only
        ops, route, auto, resource = inherited(i)
        auto = auto and not route  # a route that is written down leaves nothing to compute
        resource = resource or returned({"Operations": [o for o, _ in ops]})
        # the route of the interface alone, else that of its namespace
        container = route or (auto and resource and "/" + _plural(resource)) or space_route(i["Namespace"])
        for o, arguments in ops:
            add(o, arguments, container, i["Name"], auto, resource)
    for o in graph.rows["Operations"]:
        if o["Interface"] is None:
            add(o, {}, space_route(o["Namespace"]), None, False, None)
    services: dict[tuple[str, str], dict] = {}
    for o in out:
        space = o.pop("_space") or ""
        key = (o["Interface"] or space.rpartition(".")[2], space)
        auth = _has(spaces[space]["Decorators"], "useAuth") if space in spaces else None
        s = services.setdefault(key, {"Name": key[0], "Namespace": space, "Operations": [], "Auth": auth["Arguments"][0] if auth and auth["Arguments"] else None})
        s["Operations"].append(o)
    return {"Operations": out, "Services": list(services.values())}


#: Most that the spec files behind one set of HTTP operations may hold, in characters: templates, models and routes reach
#: across its files, so a spec is resolved as one program, on the driver.
MAX_SPEC_CHARS = 256_000_000


def _graph_at(spark: SparkSession, root: str) -> Graph:
    texts = read_texts(spark, root, "*.tsp")
    size = texts.agg(F.sum(F.length("Text"))).first()[0] or 0
    if size > MAX_SPEC_CHARS:
        raise SpecError(f"{root} holds {size} characters of specs, more than one program has; name a folder below it")
    return parse_specs([t["Text"] for t in texts.orderBy("Path").collect()])


def declared(texts: DataFrame, kind: str) -> Collection:
    """The declarations of one kind, each file parsed where it is read."""
    schema = f"struct<{_colons(SCHEMAS[kind])}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, rows, at = [], [], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = parse_specs([text or ""]).rows[kind]
                paths += [path] * len(found)
                at += range(len(found))
                rows += [json.dumps(r) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(rows, pa.string())], names=["__path", "__n", "__json"])

    parsed = texts.select("Path", "Text").mapInArrow(run, "__path string, __n bigint, __json string")
    df = parsed.select("__path", "__n", F.from_json("__json", schema).alias("__r")).select("__path", "__n", "__r.*")
    made = Collection.of(df, ITEMS[kind], ["__path", "__n"])
    return Collection(made.df.drop("__path", "__n"), K.record([f for f in made.ty.fields if not f[0].startswith("__")], ITEMS[kind]), made.order)


def _colons(columns: str) -> str:
    """``a b, c d`` as the body of a struct type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", columns)


def _collection(spark: SparkSession, rows: list[dict], schema: str, item: str) -> Collection:
    import pyspark.sql.types as T

    kind = T.StructType.fromDDL(schema + ", `__n` bigint")
    df = spark.createDataFrame([_tuple(r | {"__n": i}, kind) for i, r in enumerate(rows)], kind)
    made = Collection.of(df, item, ["__n"])
    return Collection(made.df.drop("__n"), made.ty, made.order)


def _tuple(value, kind):
    import pyspark.sql.types as T

    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_tuple(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_tuple(v, kind.elementType) for v in value]
    return value


def source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
    texts = read_texts(spark, root, "*.tsp")
    return {n: declared(texts, n) for n in names if n in SCHEMAS}


def http_source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
    graph = http_graph(_graph_at(spark, root))
    schemas = {"Operations": _top_level(HTTP_SCHEMAS["Operations"]), "Services": HTTP_SCHEMAS["Services"]}
    return {n: _collection(spark, graph[n], schemas[n], {"Operations": "HttpOperation", "Services": "HttpService"}[n]) for n in names if n in graph}


def _top_level(struct_body: str) -> str:
    """``a:b,c:d`` of a struct's body as columns."""
    parts, level, start = [], 0, 0
    for i, c in enumerate(struct_body):
        level += (c == "<") - (c == ">")
        if c == "," and level == 0:
            parts.append(struct_body[start:i])
            start = i + 1
    parts.append(struct_body[start:])
    return ", ".join(re.sub(r"^\s*(\w+)[: ]", r"\1 ", p) for p in parts)
