"""Types of values at plan time, and their Spark forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Ty:
    kind: str  # string, int, number, bool, binary, null, other, list, record, map
    elem: Ty | None = None
    fields: tuple[tuple[str, Ty], ...] = ()
    name: str | None = None
    bases: tuple[str, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "number")

    def field(self, name: str) -> tuple[str, Ty] | None:
        """Field names are compared without regard to case; an exact match wins."""
        low = name.lower()
        found = [f for f in self.fields if f[0].lower() == low]
        return next((f for f in found if f[0] == name), found[0] if found else None)

    def is_a(self, name: str) -> bool:
        return self.name is not None and (self.name.lower() == name.lower() or any(b.lower() == name.lower() for b in self.bases))

    def named(self, name: str | None, bases: tuple[str, ...] = ()) -> Ty:
        return Ty(self.kind, self.elem, self.fields, name, bases)


STRING, INT, NUMBER, BOOL, BINARY, NULL, OTHER = (Ty(k) for k in ("string", "int", "number", "bool", "binary", "null", "other"))


def list_of(elem: Ty) -> Ty:
    return Ty("list", elem)


def record(fields: list[tuple[str, Ty]], name: str | None = None, bases: tuple[str, ...] = ()) -> Ty:
    return Ty("record", None, tuple(fields), name, bases)


def from_spark(kind: T.DataType, name: str | None = None) -> Ty:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.BinaryType):
        return BINARY
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.ArrayType):
        return list_of(from_spark(kind.elementType))
    if isinstance(kind, T.StructType):
        return record([(f.name, from_spark(f.dataType)) for f in kind.fields if not f.name.startswith("__")], name)
    if isinstance(kind, T.MapType):
        return Ty("map", from_spark(kind.valueType))
    return OTHER


def to_spark(ty: Ty) -> T.DataType:
    simple = {"string": T.StringType(), "int": T.LongType(), "number": T.DoubleType(), "bool": T.BooleanType(), "binary": T.BinaryType(), "null": T.NullType()}
    if ty.kind in simple:
        return simple[ty.kind]
    if ty.kind == "list":
        return T.ArrayType(to_spark(ty.elem))
    if ty.kind == "record":
        return T.StructType([T.StructField(n, to_spark(t), True) for n, t in ty.fields])
    if ty.kind == "map":
        return T.MapType(T.StringType(), to_spark(ty.elem))
    return T.StringType()


def common(a: Ty, b: Ty) -> Ty:
    """The type of a value that is one or the other."""
    if a.kind == "null":
        return b
    if b.kind == "null" or a.kind == b.kind:
        return a
    if a.numeric and b.numeric:
        return NUMBER
    return STRING
