"""Package manifests of seven kinds to declared dependencies."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Base name patterns and the manager that each speaks for.
KINDS = (
    (re.compile(r"requirements[^/]*\.txt$"), "pip"), (re.compile(r"pyproject\.toml$"), "poetry"), (re.compile(r"Pipfile$"), "pipenv"),
    (re.compile(r"package\.json$"), "npm"), (re.compile(r"Cargo\.toml$"), "cargo"), (re.compile(r"pom\.xml$"), "maven"), (re.compile(r"go\.mod$"), "go"),
)
_PAIR = re.compile(r"""^\s*["']?([\w.\-]+)["']?\s*=\s*(?:["']([^"']*)["']|\{(.*)\})""")


def requirements(text: str) -> Iterator[tuple[str, str, bool]]:
    """name and what follows from its first comparison on, comments at the end of a line included."""
    for line in map(str.strip, text.split("\n")):
        if line[:1] not in ("", "#", "-") and (m := re.match(r"^([A-Za-z0-9_\-.]+)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?=?).*)?", line)):
            yield m[1], (m[2] or "").strip(), False


def sections(text: str, wanted: dict[str, bool]) -> Iterator[tuple[str, str, bool]]:
    """``key = "version"`` lines (or tables with a version) of the wanted sections; True stands for development."""
    dev: bool | None = None
    for line in text.split("\n"):
        head = re.match(r"^\s*\[([^\[\]]+)\]\s*(?:#.*)?$", line)
        if head:
            dev = wanted.get(head[1].strip())
        elif dev is not None and (m := _PAIR.match(line)):
            version = m[2]
            if version is None:
                found = re.search(r"""version\s*=\s*["']([^"']*)["']""", m[3])
                version = found[1] if found else ""
            yield m[1], version, dev


def package_json(text: str) -> Iterator[tuple[str, str, bool]]:
    try:
        data = json.loads(text)
    except ValueError:
        return
    for key, dev in (("dependencies", False), ("devDependencies", True)):
        part = data.get(key) if isinstance(data, dict) else None
        if isinstance(part, dict):
            yield from ((n, str(v), dev) for n, v in part.items())


def pom(text: str) -> Iterator[tuple[str, str, bool]]:
    """groupId:artifactId of every dependency, in whatever namespace."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    for d in root.iter():
        if d.tag.rpartition("}")[2] == "dependency":
            own = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in d}
            if own.get("groupId") and own.get("artifactId"):
                yield f"{own['groupId']}:{own['artifactId']}", own.get("version", ""), own.get("scope") in ("test", "provided")


def go_mod(text: str) -> Iterator[tuple[str, str, bool]]:
    inside = False
    for line in text.split("\n"):
        line = line.split("//")[0].strip()
        if re.match(r"^require\s*\($", line):
            inside = True
        elif line == ")":
            inside = False
        else:
            m = re.match(r"^(?:require\s+)?(\S+)\s+(v\S+)$", line)
            if m and (inside or line.startswith("require")):
                yield m[1], m[2], False


def dependencies(path: str, text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(manager, package, version, development) in one manifest."""
    name = path.rsplit("/", 1)[-1]
    manager = next((m for p, m in KINDS if p.match(name)), None)
    read = {
        "pip": requirements, "npm": package_json, "maven": pom, "go": go_mod,
        "poetry": lambda t: sections(t, {"project.dependencies": False, "tool.poetry.dependencies": False, "tool.poetry.dev-dependencies": True, "project.optional-dependencies": True, "tool.poetry.group.dev.dependencies": True}),
        "pipenv": lambda t: sections(t, {"packages": False, "dev-packages": True}),
        "cargo": lambda t: sections(t, {"dependencies": False, "dev-dependencies": True}),
    }
    if manager:
        yield from ((manager, *x) for x in read[manager](text))


def declared(files: DataFrame) -> DataFrame:
    """(manager, manifest_file, package_name, version_spec, is_dev) of manifests (path, text)."""
    from coderill.sources.tree import workers_see_package

    workers_see_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, p, n, v, d) for p, t in zip(b["path"], b["text"], strict=True) for m, n, v, d in dependencies(p, t or "")]
            yield pd.DataFrame(rows, columns=["manager", "manifest_file", "package_name", "version_spec", "is_dev"])

    return files.select("path", "text").mapInPandas(run, "manager string, manifest_file string, package_name string, version_spec string, is_dev boolean")
