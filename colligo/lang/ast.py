"""Syntax tree of the rule language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: Any  # str, int, float, bool; None is nic


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Member(Node):
    """``target.name`` or, with ``args``, ``target.name(args)``."""

    target: Node
    name: str
    args: tuple[Node, ...] | None = None


@dataclass(frozen=True)
class Filter(Node):
    """``target:name(args)`` or ``target:!name``."""

    target: Node
    name: str
    args: tuple[Node, ...] | None = None
    negated: bool = False


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class Conditional(Node):
    test: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Match(Node):
    subject: Node
    arms: tuple[tuple[Node | None, Node], ...]


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Record(Node):
    """``{a = 1}`` or ``T {a = 1}``."""

    type: str | None
    fields: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Guard(Node):
    """One step of a parameter's constraint chain: ``name(args)``, maybe negated."""

    name: str
    args: tuple[Node, ...] | None
    negated: bool


@dataclass(frozen=True)
class TypeDecl:
    name: str
    base: str | None
    fields: tuple[tuple[str, str, bool, bool], ...]  # name, type, is list, optional


@dataclass(frozen=True)
class FlagsDecl:
    name: str
    members: tuple[str, ...]


@dataclass(frozen=True)
class CollectionDecl:
    name: str
    type: str


@dataclass(frozen=True)
class LetDecl:
    name: str
    value: Node
    runtime: bool = False


@dataclass(frozen=True)
class PredicateDecl:
    name: str
    param: str
    is_list: bool
    guard: tuple[Guard, ...]
    narrowed: str | None
    body: Node


@dataclass(frozen=True)
class FunctionDecl:
    name: str
    params: tuple[tuple[str, str], ...]  # parameter name, type
    guard: tuple[Guard, ...]
    record: str | None
    body: Node


@dataclass(frozen=True)
class Action:
    """What is done with each item, or with a value: PRINT, SAVE, ASSERT … or a bare expression."""

    kind: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Sink:
    namespace: str | None
    name: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class ForEach:
    source: Node
    action: Action
    sink: Sink | None = None
    guard: Node | None = None


@dataclass(frozen=True)
class Reference:
    """A named command inside another one."""

    name: str
    guard: Node | None = None


@dataclass(frozen=True)
class Output:
    """A statement that prints: a text, an action or a bare expression."""

    action: Action
    guard: Node | None = None


@dataclass(frozen=True)
class CommandDecl:
    name: str
    params: tuple[str, ...]
    parts: tuple[ForEach | Output | Reference, ...]


@dataclass(frozen=True)
class Run:
    name: str
    args: tuple[Node, ...]


@dataclass
class Script:
    feeds: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    types: list[TypeDecl] = field(default_factory=list)
    flags: list[FlagsDecl] = field(default_factory=list)
    collections: list[CollectionDecl] = field(default_factory=list)
    lets: list[LetDecl] = field(default_factory=list)
    predicates: list[PredicateDecl] = field(default_factory=list)
    functions: list[FunctionDecl] = field(default_factory=list)
    commands: list[CommandDecl] = field(default_factory=list)
    statements: list[ForEach | Output | Run] = field(default_factory=list)
    exported: set[str] = field(default_factory=set)
