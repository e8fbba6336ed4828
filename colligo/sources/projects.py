"""Projects by their manifests: .csproj, package.json, pyproject.toml, setup.py."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.collection import Collection
from colligo.sources.text import read_texts


def _csproj(text: str, path: str) -> tuple[str, list[str]]:
    name, refs = posixpath.basename(path).rsplit(".", 1)[0], []
    try:
        root = ElementTree.fromstring(text.lstrip("﻿"))
    except ElementTree.ParseError:
        return name, refs
    for e in root.iter():
        tag = e.tag.rsplit("}", 1)[-1]
        if tag == "AssemblyName" and e.text:
            name = e.text.strip()
        elif tag == "ProjectReference" and e.get("Include"):
            refs.append(posixpath.normpath(posixpath.join(posixpath.dirname(path), e.get("Include").replace("\\", "/"))))
    return name, refs


def _package(text: str, path: str) -> tuple[str, list[str]]:
    try:
        data = json.loads(text.lstrip("﻿"))
    except ValueError:
        data = {}
    data = data if isinstance(data, dict) else {}
    return data.get("name") or posixpath.basename(posixpath.dirname(path)) or "package", [*data.get("dependencies", {}), *data.get("devDependencies", {})]


def _pyproject(text: str, path: str) -> tuple[str, list[str]]:
    try:
        data = tomllib.loads(text.lstrip("﻿"))
    except tomllib.TOMLDecodeError:
        data = {}
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    refs = [re.split(r"[\s<>=!~;\[(]", d, maxsplit=1)[0] for d in project.get("dependencies", [])] + [d for d in poetry.get("dependencies", {}) if d != "python"]
    return project.get("name") or poetry.get("name") or posixpath.basename(posixpath.dirname(path)), refs


def _setup(text: str, path: str) -> tuple[str, list[str]]:
    name = re.search(r"\bname\s*=\s*['\"]([^'\"]+)", text)
    block = re.search(r"install_requires\s*=\s*\[([^\]]*)\]", text)
    refs = [re.split(r"[\s<>=!~;\[(]", d, maxsplit=1)[0] for d in re.findall(r"['\"]([^'\"]+)['\"]", block[1] if block else "")]
    return name[1] if name else posixpath.basename(posixpath.dirname(path)), refs


def manifest(path: str, text: str) -> tuple[str, str, list[str]] | None:
    """Name, language and references of a project by its manifest; C# references are paths of other manifests."""
    base = posixpath.basename(path)
    if base.endswith(".csproj"):
        name, refs = _csproj(text, path)
        return name, "csharp", refs
    if base == "package.json":
        name, refs = _package(text, path)
        return name, "javascript", refs
    if base in ("pyproject.toml", "setup.py"):
        name, refs = (_pyproject if base == "pyproject.toml" else _setup)(text, path)
        return name, "python", refs
    return None


def discover(manifests: DataFrame) -> DataFrame:
    """Projects of ``Path, Text`` manifests, parsed where they are read; references to other C# projects by their names, found
    by a join. A folder's pyproject.toml comes before its setup.py. A null text is an empty manifest; other files give no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(p, *m) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p and (m := manifest(p, t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.list_(pa.string())))], names=["Path", "Name", "Language", "Refs"])

    parsed = manifests.select("Path", "Text").mapInArrow(run, "Path string, Name string, Language string, Refs array<string>")
    folder, base = F.regexp_replace("Path", "[^/]*$", ""), F.regexp_extract("Path", "[^/]*$", 0)
    better = manifests.where(base == "pyproject.toml").select(F.concat(folder, F.lit("setup.py")).alias("Path"))
    kept = parsed.join(better, "Path", "left_anti")
    names = kept.where("Language = 'csharp'").select(F.lower("Path").alias("at"), F.col("Name").alias("named"))
    each = kept.where("Language = 'csharp'").select("Path", F.posexplode("Refs").alias("n", "ref"))
    said = F.coalesce("named", F.regexp_replace(F.regexp_extract("ref", "[^/]*$", 0), r"\.[^.]*$", ""))
    resolved = each.join(names, F.lower("ref") == F.col("at"), "left").groupBy("Path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("r")))), lambda x: x["r"]).alias("found"))
    references = F.when(F.col("Language") == "csharp", F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.col("Refs"))
    return kept.join(resolved, "Path", "left").select("Name", "Path", "Language", references.alias("References"))


def source(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, Collection]:
    """``Projects`` under a root."""
    if "Projects" not in names:
        return {}
    found = read_texts(spark, root, "{*.csproj,package.json,pyproject.toml,setup.py}").where("Path NOT LIKE '%node_modules/%'")
    return {"Projects": Collection.of(discover(found), "Project", ["Path"])}
