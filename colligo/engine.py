"""Programs of the rule language: declarations, commands, runs, checks and assertions."""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.catalog import Catalog
from colligo.collection import Collection
from colligo.functions import types as K
from colligo.functions import values as V
from colligo.functions.types import Ty
from colligo.lang.ast import Action, CommandDecl, ForEach, Literal, Name, Output, Reference, Run, Script
from colligo.lang.parser import parse_expression, parse_script
from colligo.lang.planner import Planner, Program, Scope, UnknownName
from colligo.lang.template import parts_of

log = logging.getLogger("colligo")
STYLES = {"red": "31", "green": "32", "yellow": "33", "blue": "34", "magenta": "35", "cyan": "36", "white": "37", "gray": "90", "grey": "90", "bold": "1", "dim": "2", "italic": "3", "underline": "4"}
SIMPLE = {"string": K.STRING, "int": K.INT, "number": K.NUMBER, "bool": K.BOOL, "byte": K.INT, "object": K.OTHER}


class RuleError(ValueError):
    pass


@dataclass
class Printed:
    """The output of one command: a frame with a column ``message``, in order."""

    command: str | None
    messages: Collection

    def lines(self) -> Iterator[str]:
        for row in self.messages.sorted_rows().toLocalIterator():
            yield row[0]


@dataclass
class SavedFile:
    path: str
    text: str


@dataclass
class Assertion:
    name: str
    passed: bool
    message: str
    count: int


@dataclass
class Result:
    printed: list[Printed] = field(default_factory=list)
    saved: list[Collection] = field(default_factory=list)
    assertions: list[Assertion] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        return [line for p in self.printed for line in p.lines()]

    @property
    def files(self) -> Iterator[SavedFile]:
        """The files to be saved, one by one; ``Engine.write_files`` writes them without a way over the driver."""
        return (SavedFile(r[0], r[1]) for c in self.saved for r in c.sorted_rows().toLocalIterator())

    def as_json(self) -> str:
        return json.dumps([{"message": line} for line in self.lines()], ensure_ascii=False)

    @property
    def exit_code(self) -> int:
        """0: nothing to say, 1: output or a failed assertion."""
        return 1 if any(not a.passed for a in self.assertions) or any(not p.messages.df.isEmpty() for p in self.printed) else 0


class Engine:
    """Declarations from any number of scripts over one catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, arguments: Sequence[str] = (), lenient: bool = False, output_limit: int | None = None, diagnostics: bool = False, packages: Mapping[str, str] | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.program = Program()
        self.planner = Planner(spark, self.catalog, self.program, lenient, arguments)
        self.commands: dict[str, CommandDecl] = {}
        self.statements: list[ForEach | Output | Run] = []
        self.exported: dict[str, set[str]] = {}
        self.packages = dict(packages or {})
        self.loaded: set[str] = set()
        self.output_limit, self.diagnostics = output_limit, diagnostics
        self.sinks: dict[str, Any] = {}
        self.observed: list[tuple[str, int, int]] = []

    # loading
    def load(self, source: str, package: str = "") -> Engine:
        script = parse_script(source)
        for name in script.imports:
            self.load_package(name)
        self._declare(script, package)
        self.statements += script.statements
        return self

    def load_package(self, name: str) -> None:
        """An imported package, with all that it imports in turn; each is loaded once, its statements do not run."""
        if name in self.loaded:
            return
        if name not in self.packages:
            raise RuleError(f"no package {name}")
        self.loaded.add(name)
        script = parse_script(self.packages[name])
        for inner in script.imports:
            self.load_package(inner)
        self._declare(script, name)

    def _declare(self, script: Script, package: str) -> None:
        p = self.program
        for t in script.types:
            self._declare_type(t)
        for f in script.flags:
            for i, member in enumerate(f.members):
                if member in p.flags and p.flags[member] != 1 << i:
                    raise RuleError(f"the flag {member} is declared twice")
                p.flags[member] = 1 << i
            SIMPLE.setdefault(f.name, K.INT)
            p.types.setdefault(f.name, K.INT)
        for c in script.collections:
            if not self.catalog.has(c.name):
                ty = self.type_named(c.type)
                empty = self.spark.createDataFrame([], K.to_spark(ty) if ty.kind == "record" else K.to_spark(K.record([("value", ty)])))
                self.catalog.register(package or "declared", c.name, Collection(empty, ty, (), self.planner))
        for let in script.lets:
            p.lets[let.name] = let.value
            self.planner.planned.pop(let.name, None)
        for pred in script.predicates:
            p.predicates.setdefault(pred.name, []).append(pred)
        for fn in script.functions:
            p.functions.setdefault(fn.name, []).append(fn)
        for cmd in script.commands:
            self.commands[cmd.name] = cmd
        self._subsets(script)
        self.exported.setdefault(package, set()).update(script.exported)

    def _declare_type(self, decl: Any) -> None:
        p, fields, bases = self.program, [], ()
        if decl.name in p.types:  # the first registration stands
            return
        if decl.base:
            if decl.base.lower() == decl.name.lower():
                raise RuleError(f"the type {decl.name} inherits from itself")
            base = p.types.get(decl.base)
            if base is None:
                raise RuleError(f"no type {decl.base}")
            fields, bases = list(base.fields), (decl.base, *base.bases)
        for name, kind, is_list, _ in decl.fields:
            if any(n.lower() == name.lower() for n, _ in fields):
                raise RuleError(f"the type {decl.name} has {name} twice")
            ty = self.type_named(kind, inside=decl.name)
            fields.append((name, K.list_of(ty) if is_list else ty))
        p.types[decl.name] = K.record(fields, decl.name, bases)

    def type_named(self, name: str, inside: str | None = None) -> Ty:
        if name in SIMPLE:
            return SIMPLE[name]
        if name == inside:
            return K.STRING  # recursive types are kept by id or text
        found = self.program.types.get(name)
        if found is None:
            raise RuleError(f"no type {name}")
        return found

    def _subsets(self, script: Script) -> None:
        """``predicate Clients(Types) => …`` over the name of a collection is a named subset of it."""
        for pred in script.predicates:
            if not pred.is_list and not pred.guard and (pred.param in self.program.lets or self.catalog.has(pred.param)) and pred.param not in self.program.types and not self._is_item_name(pred.param):
                self.program.lets.setdefault(pred.name, parse_expression(f"{pred.param}:{pred.name}"))
                self.subset_names = getattr(self, "subset_names", set()) | {pred.name}
                base = self._item_type_of(pred.param)
                if base:
                    decl = self.program.predicates[pred.name]
                    decl[:] = [replace(d, param=base) if d is pred else d for d in decl]

    def _is_item_name(self, name: str) -> bool:
        return self.catalog.has(name) and self.catalog.find(name).ty.name == name

    def _item_type_of(self, name: str) -> str | None:
        c = self.planner.collection(name)
        return c.ty.name

    # expressions
    def collection(self, expression: str) -> Collection:
        if expression in self.program.lets and expression in getattr(self, "subset_names", ()):  # the subset, not its predicate
            return self.planner.as_collection(self.planner.let(expression))
        return self.planner.collection(expression)

    def value(self, expression: str) -> Any:
        """A value outside of any row, computed now."""
        v = self.planner.value(expression, Scope.empty())
        if v.is_const:
            return v.const
        return self.spark.range(1).select(v.col.alias("x")).first()[0]

    # running
    def run(self, names: Sequence[str] | None = None) -> Result:
        """The unnamed statements, or the named commands. Commands that save or assert run by name only."""
        out = Result()
        if names is None:
            for s in self.statements:
                self._statement(s, out, None, explicit=False)
            for c in self.commands.values():
                if not c.params and not self._has_action(c, ("SAVE", "ASSERT", "ASSERT_EMPTY")):
                    self._command(c, out, explicit=False)
        else:
            unknown = [n for n in names if n not in self.commands]
            if unknown:
                raise RuleError(f"no command {', '.join(unknown)}; there are {', '.join(self.commands) or 'none'}")
            for n in names:
                self._command(self.commands[n], out, explicit=True)
        if not out.saved and not out.assertions and all(p.messages.df.isEmpty() for p in out.printed):
            self._warn_empty(out)
        return out

    def test(self) -> Result:
        """All assertions."""
        out = Result()
        for s in self.statements:
            if isinstance(s, Output) and s.action.kind in ("ASSERT", "ASSERT_EMPTY"):
                self._statement(s, out, None, explicit=True)
        for c in self.commands.values():
            if self._has_action(c, ("ASSERT", "ASSERT_EMPTY")):
                self._command(c, out, explicit=True)
        return out

    def check(self, packages: Iterable[str] | None = None, names: Iterable[str] | None = None) -> Collection:
        """All exported collections of violations in one frame, each row with its ``rule``: one job for all rules."""
        parts = []
        wanted = list(names) if names is not None else [n for p in (packages if packages is not None else self.exported) for n in sorted(self.exported.get(p, ())) if n in self.program.lets]
        for n in wanted:
            c = self.collection(n)
            if c.is_record and all(c.ty.field(f) for f in ("Severity", "Message")):
                sources = {f: (V.as_text(V.Val(F.col(c.ty.field(f)[0]), c.ty.field(f)[1])) if c.ty.field(f) else F.lit(None).cast("string")) for f in ("Severity", "Message", "File", "Line", "Source")}
                df = c.df.select(F.lit(n).alias("Rule"), *(col.alias(f) for f, col in sources.items()), *(F.col(o.column) for o in c.order))
                parts.append(Collection(df, K.record([(f, K.STRING) for f in ("Rule", *sources)], "Violation"), c.order, self.planner))
        if not parts:
            raise RuleError("no exported collection has violations")
        return Collection.concat_all(parts)

    @staticmethod
    def format_violations(violations: Collection) -> Collection:
        """``file(line): severity: message`` of each."""
        place = F.concat(F.coalesce("File", "Source", F.lit("")), F.when(F.col("Line").isNotNull(), F.concat(F.lit("("), F.col("Line"), F.lit(")"))).otherwise(F.lit("")))
        return violations.project(V.Val(F.concat(place, F.lit(": "), F.col("Severity"), F.lit(": "), F.col("Message")), K.STRING))

    def _has_action(self, c: CommandDecl, kinds: Sequence[str], seen: frozenset[str] = frozenset()) -> bool:
        for part in c.parts:
            if isinstance(part, Reference):
                if part.name in self.commands and part.name not in seen and self._has_action(self.commands[part.name], kinds, seen | {c.name}):
                    return True
            elif part.action.kind in kinds:
                return True
        return False

    def _command(self, c: CommandDecl, out: Result, explicit: bool, args: Sequence[Any] = (), seen: frozenset[str] = frozenset()) -> None:
        if c.name in seen:
            return
        if len(args) != len(c.params):
            raise RuleError(f"the command {c.name} takes {len(c.params)} arguments")
        saved = {p: (self.program.lets.get(p), self.planner.planned.get(p)) for p in c.params}
        for p, a in zip(c.params, args):
            self.program.lets[p] = Literal(None)
            self.planner.planned[p] = a
        try:
            for part in c.parts:
                if isinstance(part, Reference):
                    inner = self.commands.get(part.name)
                    if inner is None:
                        raise RuleError(f"no command {part.name}")
                    if self._allowed(part.guard):
                        self._command(inner, out, explicit, (), seen | {c.name})
                else:
                    self._statement(part, out, c.name, explicit)
        finally:
            for p, (let, planned) in saved.items():
                self.program.lets.pop(p, None) if let is None else self.program.lets.__setitem__(p, let)
                self.planner.planned.pop(p, None) if planned is None else self.planner.planned.__setitem__(p, planned)

    def _allowed(self, guard: Any) -> bool:
        """A guard, over the program's arguments: decided while planning."""
        if guard is None:
            return True
        if isinstance(guard, Name) and guard.name in self.program.predicates:
            body = self.program.predicates[guard.name][0].body
            v = self.planner.value(body, Scope.empty().bind(Program=self.planner.name("Program", Scope.empty())))
        else:
            v = self.planner.value(guard, Scope.empty())
        if v.is_const:
            return bool(v.const) if isinstance(v.const, bool) else v.const is not None
        return bool(self.spark.range(1).select(V.truthy(v).alias("x")).first()[0])

    def _statement(self, s: ForEach | Output | Run, out: Result, command: str | None, explicit: bool) -> None:
        if isinstance(s, Run):
            c = self.commands.get(s.name)
            if c is None:
                raise RuleError(f"no command {s.name}")
            self._command(c, out, True, [self.planner.evaluate(a, Scope.empty()) for a in s.args])
            return
        if not self._allowed(s.guard):
            return
        if isinstance(s, ForEach):
            self._foreach(s, out, command, explicit)
            return
        kind, args = s.action.kind, s.action.args
        if kind in self.commands and self.commands[kind].params:  # an upper-case call runs a command
            self._command(self.commands[kind], out, True, [self.planner.evaluate(a, Scope.empty()) for a in args])
        elif kind in ("ASSERT", "ASSERT_EMPTY"):
            out.assertions.append(self._assert(kind, args, command))
        elif kind == "CHECK":
            violations = self.planner.collection(args[0])
            out.printed.append(Printed(command, self._limited(self.format_violations(self._as_violations(violations)))))
        elif kind == "SAVE":
            if explicit:
                raise RuleError("SAVE needs a foreach or a text")
        elif kind == "DEBUG":
            if self.diagnostics:
                log.info("%s", self.value_text(args[0]))
        elif kind == "VALUE":
            out.printed.append(Printed(command, self._limited(self._printable(self.planner.evaluate(args[0], Scope.empty())))))
        else:
            v = self.planner.template(args[0].value, Scope.empty()) if isinstance(args[0], Literal) and isinstance(args[0].value, str) else self.planner.value(args[0], Scope.empty())
            out.printed.append(Printed(command, self.planner.as_collection(Val_text(v))))

    def value_text(self, node: Any) -> str:
        v = self.planner.template(node.value, Scope.empty()) if isinstance(node, Literal) else self.planner.value(node, Scope.empty())
        return v.const if v.is_const else self.spark.range(1).select(V.template_text(v).alias("x")).first()[0]

    def _as_violations(self, c: Collection) -> Collection:
        cols = {f: (V.as_text(V.Val(F.col(c.ty.field(f)[0]), c.ty.field(f)[1])) if c.ty.field(f) else F.lit(None).cast("string")) for f in ("Severity", "Message", "File", "Line", "Source")}
        df = c.df.select(*(col.alias(f) for f, col in cols.items()), *(F.col(o.column) for o in c.order))
        return Collection(df, K.record([(f, K.STRING) for f in cols], "Violation"), c.order, self.planner)

    def _printable(self, value: Any) -> Collection:
        """One text per item; objects as JSON."""
        c = self.planner.as_collection(value)
        item = c.item()
        text = V.pretty_json(item) if item.ty.kind in ("record", "map") and not item.ty.field("text") else V.template_text(item)
        return c.project(V.Val(text, K.STRING))

    def _limited(self, c: Collection) -> Collection:
        return c if self.output_limit is None else c.limit(self.output_limit)

    def _traced(self, node: Any, before: int | None = None) -> Collection:
        return self.planner.collection(node)

    def _foreach(self, s: ForEach, out: Result, command: str | None, explicit: bool) -> None:
        c = self._traced(s.source)
        if c.df.isStreaming:
            raise RuleError("a stream runs with colligo.streaming.run_stream")
        if self.diagnostics:
            self.observed.append((command or "", *(self._counts(s))))
        kind, args = s.action.kind, s.action.args
        scope = Scope.of_collection(c)
        if kind == "SAVE":
            if explicit:
                out.saved.append(self._save(c, scope, args))
            return
        if kind == "DEBUG":
            if self.diagnostics:
                for line in c.project(self.planner.template(args[0].value, scope)).sorted_rows().toLocalIterator():
                    log.info("%s", line[0])
            return
        if kind == "PRINT" and isinstance(args[0], Literal):
            messages = c.project(self.planner.template(args[0].value, scope))
        elif kind == "VALUE" and not args:
            messages = self._printable(c)
        elif kind in ("PRINT", "VALUE"):
            v = self.planner.as_value(self.planner.evaluate(args[0], scope), scope)
            messages = self._printable(c.project(v))
        else:
            raise RuleError(f"no action {kind}")
        messages = self._limited(messages)
        if s.sink is not None:
            self._to_sink(s.sink, messages)
            return
        out.printed.append(Printed(command, messages))

    def _counts(self, s: ForEach) -> tuple[int, int]:
        """Items before and after the filters of a chain, for diagnostics."""
        base = s.source
        while hasattr(base, "target"):
            base = base.target
        return self.planner.collection(base).df.count(), self.planner.collection(s.source).df.count()

    def _to_sink(self, sink: Any, messages: Collection) -> None:
        name = f"{sink.namespace}.{sink.name}" if sink.namespace else sink.name
        if name in self.sinks:
            self.sinks[name](messages, *sink.args)
        elif name == "console.WriteLine":
            for row in messages.sorted_rows().toLocalIterator():
                print(row[0])
        elif name == "file.Write" and (sink.args[0].endswith("/") or Path(sink.args[0]).is_dir()):  # a folder takes a part of each task
            messages.sorted_rows().write.mode("append").text(sink.args[0])
        elif name == "file.Write":  # one file is one stream of lines: they pass the driver, a part at a time
            with open(sink.args[0], "a", encoding="utf-8") as f:
                f.writelines(row[0] + "\n" for row in messages.sorted_rows().toLocalIterator())
        else:
            raise RuleError(f"no sink {name}")

    def _save(self, c: Collection, scope: Scope, args: tuple[Any, ...]) -> Collection:
        """Lines grouped by path, each path a file's ``text``; paths stay inside the root."""
        path, line = self.planner.template(args[0].value, scope), self.planner.template(args[1].value, scope)
        pairs = c.project(V.Val(F.struct(path.col.alias("path"), line.col.alias("line")), K.record([("path", K.STRING), ("line", K.STRING)])))
        outside = pairs.df.where(F.regexp_replace("path", r"\\", "/").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")).select("path").first()
        if outside is not None:
            raise RuleError(f"SAVE writes inside the root only, not to {outside[0]}")
        texts = pairs.group_by("path").select_record(path="Items.First.path", text="Items.Text('{line}')")
        return texts.with_df(texts.df.withColumn("text", F.concat("text", F.lit("\n"))))

    @staticmethod
    def write_files(result: Result, root: str) -> None:
        """Each file written by the task that holds its text, below a folder that all executors share. Files are written
        beside their place and moved there, so a task that runs twice does no harm."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    target = Path(root, path)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                    beside.write_text(text, encoding="utf-8")
                    beside.replace(target)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["written"])

        for c in result.saved:
            c.rows("path", "text").mapInArrow(run, "written bigint").agg(F.sum("written")).collect()

    def _assert(self, kind: str, args: tuple[Any, ...], command: str | None) -> Assertion:
        value = self.planner.evaluate(args[0], Scope.empty())
        message = self.value_text(args[1]) if len(args) > 1 else ""
        if isinstance(value, V.Val) and value.ty.kind == "bool":
            holds = bool(self.spark.range(1).select(V.truthy(value).alias("x")).first()[0])
            count = int(holds)
        else:
            count = self.planner.as_collection(value).df.count()
        return Assertion(command or "assert", count > 0 if kind == "ASSERT" else count == 0, message, count)

    def _warn_empty(self, out: Result) -> None:
        roots = [k for k in self.catalog.built]
        if roots and all(self.catalog.built[k].df.isEmpty() for k in roots if not self.catalog.built[k].df.isStreaming):
            out.warnings.append("all sources are empty: is the root right?")

    # styles
    def styled(self, template: str, c: Collection) -> Collection:
        """Messages with terminal colours for ``{…@style}`` places."""
        scope = Scope.of_collection(c)
        cols = []
        for text, expression, style in parts_of(template):
            col = F.lit(text) if expression is None else V.template_text(self.planner.value(expression, scope))
            codes = ";".join(STYLES[s] for s in re.split(r"[-+ ]", style or "") if s in STYLES)
            cols.append(F.concat(F.lit(f"\x1b[{codes}m"), col, F.lit("\x1b[0m")) if codes else col)
        return c.project(V.Val(F.concat(*cols), K.STRING))


def Val_text(v: V.Val) -> V.Val:  # noqa: N802
    return V.Val(V.template_text(v), K.STRING)


def validate(engine: Engine, source: str) -> list[str]:
    """Names that a script uses and nothing provides, found by planning its commands without running them."""
    problems: list[str] = []
    script = parse_script(source)
    for s in script.statements:
        if isinstance(s, (ForEach, Output)):
            try:
                node = s.source if isinstance(s, ForEach) else (s.action.args[0] if s.action.args else None)
                if node is not None and not isinstance(node, Literal):
                    engine.planner.evaluate(node, Scope.empty())
            except (UnknownName, LookupError, V.RuleTypeError) as e:
                problems.append(str(e))
    return problems


__all__ = ["Action", "Assertion", "DataFrame", "Engine", "Printed", "Result", "RuleError", "SavedFile", "validate"]
