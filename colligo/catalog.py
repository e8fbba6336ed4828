"""Collections by namespace and name, built only when a plan asks for them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from colligo.collection import Collection


class AmbiguousCollection(LookupError):
    """A bare name that several namespaces offer."""


class UnknownCollection(LookupError):
    pass


Factory = Callable[[], Collection]
#: A source: (session, root, what is asked for) -> collections by name. It may build any superset of what is asked for.
Source = Callable[[SparkSession, str, Sequence[str]], Mapping[str, Collection]]


class Catalog:
    """Namespaces of lazily built collections, with sources that can be asked for another root."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.factories: dict[tuple[str, str], Factory] = {}
        self.built: dict[tuple[str, str], Collection] = {}
        self.sources: dict[str, tuple[Source, tuple[str, ...]]] = {}
        self.by_path: dict[tuple[str, str, str], Collection] = {}
        self.aggregates: set[str] = set()
        self.readers: dict[str, Callable[..., Collection]] = {}

    def register(self, namespace: str, name: str, factory: Factory | Collection | DataFrame, order: Sequence[str] | None = None, item: str | None = None) -> None:
        """A collection, a frame or a function that makes one. ``order``: columns that tell the order of the items."""
        def make() -> Collection:
            out = factory() if callable(factory) and not isinstance(factory, (Collection, DataFrame)) else factory
            return out if isinstance(out, Collection) else Collection.of(out, item or name, order)

        self.factories[namespace, name] = make

    def register_source(self, namespace: str, source: Source, names: Sequence[str], root: str | None = None) -> None:
        """A source with its collection names; its collections at ``root`` are in the catalog, others by path."""
        self.sources[namespace] = (source, tuple(names))
        if root is not None:
            for name in names:
                self.factories[namespace, name] = lambda n=name: self.at_path(namespace, n, root)

    def register_aggregate(self, prefix: str) -> None:
        """A prefix such as ``Code`` that stands for all namespaces: ``Code.Types`` is the union of every ``Types``."""
        self.aggregates.add(prefix)

    def register_reader(self, extension: str, reader: Callable[..., Collection]) -> None:
        self.readers[extension.lower().lstrip(".")] = reader

    def namespaces(self) -> set[str]:
        return {ns for ns, _ in self.factories} | set(self.sources)

    def names(self, namespace: str) -> list[str]:
        return [n for ns, n in self.factories if ns == namespace]

    def get(self, namespace: str, name: str) -> Collection:
        key = next((k for k in self.factories if k[0].lower() == namespace.lower() and k[1].lower() == name.lower()), None)
        if key is None:
            raise UnknownCollection(f"no collection {namespace}.{name}")
        if key not in self.built:
            self.built[key] = self.factories[key]()
        return self.built[key]

    def find(self, name: str) -> Collection:
        """A bare name: the one namespace that has it."""
        owners = [ns for ns, n in self.factories if n.lower() == name.lower()]
        if not owners:
            raise UnknownCollection(f"no collection {name}")
        if len(owners) > 1:
            raise AmbiguousCollection(f"{name} is in {', '.join(sorted(owners))}: say which, as in {sorted(owners)[0]}.{name}")
        return self.get(owners[0], name)

    def has(self, name: str) -> bool:
        return any(n.lower() == name.lower() for _, n in self.factories)

    def at_path(self, namespace: str, name: str, path: str) -> Collection:
        """A source's collection under another root; asked for once per path."""
        key = (namespace, name, path)
        if key not in self.by_path:
            if namespace not in self.sources:
                raise UnknownCollection(f"{namespace} takes no path")
            source, names = self.sources[namespace]
            found = source(self.spark, path, [name])
            if name not in found:
                raise UnknownCollection(f"{namespace} has {', '.join(names)}, not {name}")
            self.by_path[key] = found[name]
        return self.by_path[key]

    def union_of(self, name: str, namespaces: Sequence[str] | None = None, path: str | None = None) -> Collection:
        """The collections of one name in all (or the given) namespaces, one after the other."""
        owners = sorted({ns for ns, n in self.factories if n.lower() == name.lower() and (namespaces is None or ns in namespaces)} | ({ns for ns in namespaces or () if path is not None and name in self.sources.get(ns, (None, ()))[1]}))
        if not owners:
            raise UnknownCollection(f"no namespace has {name}")
        parts = [self.at_path(ns, name, path) if path is not None else self.get(ns, name) for ns in owners]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
