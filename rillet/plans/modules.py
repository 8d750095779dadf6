"""User functions and modules: Spark SQL functions, which Catalyst inlines, kept in files that import one another.

A module is a JSON file {"metadata": {...}, "imports": ["other", {"path": "other", "search": "./lib"}, ...], "functions":
{"name": {"args": {"x": "double"}, "returns": "double", "body": "x * 2"}}}. `import_module` registers its functions under a
namespace, `include` without one. An import's `search`, relative to the module's own folder, comes before the search path."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession


class ModuleError(ValueError):
    pass


class Loader:
    """Finds modules by relative names in a search path, each loaded once. What it lacks is asked of `then`, another loader
    (or anything with its methods `find` and `read`); `given` are modules by name that need no file, found first."""

    def __init__(self, *search: str, given: dict[str, dict] | None = None, then: Loader | None = None):
        self.search = [Path(s).resolve() for s in search]
        self.given, self.then = given or {}, then
        self.loaded: dict[str, dict] = {}
        self.loading: list[str] = []

    def find(self, name: str, search: list[Path] | None = None) -> str | None:
        """The module's place: given:name, or its file; None if it is not here."""
        parts = Path(name).parts
        if not parts or Path(name).is_absolute() or ".." in parts:
            raise ModuleError(f"module path must be relative and stay in the search path: {name}")
        if any(a == b for a, b in zip(parts, parts[1:])):
            raise ModuleError(f"module path must not repeat a component: {name}")
        if name in self.given:
            return f"given:{name}"
        for root in [*(search or ()), *self.search]:
            for found in (root / f"{name}.json", root / name / f"{parts[-1]}.json"):
                if found.is_file():
                    return str(found)
        return self.then.find(name) if self.then else None

    def read(self, place: str) -> dict:
        name = place.removeprefix("given:")
        if name == place:
            return json.loads(Path(place).read_text())
        return self.given[name] if name in self.given else self.then.read(place)

    def _module(self, name: str, search: list[Path] | None = None) -> tuple[str, dict]:
        place = self.find(name, search)
        if place is None:
            raise ModuleError(f"module not found: {name}")
        return place, self.read(place)

    def metadata(self, name: str) -> dict:
        """What the module says about itself, with the names of its imports as `deps`."""
        _, module = self._module(name)
        deps = [i if isinstance(i, str) else i["path"] for i in module.get("imports", ())]
        return {**module.get("metadata", {}), "deps": deps}

    def load(self, name: str, search: list[Path] | None = None) -> dict:
        """All functions of a module and of those it includes, later ones replacing earlier ones."""
        place, module = self._module(name, search)
        if place in self.loading:
            raise ModuleError(f"recursive import: {' -> '.join([*self.loading, place])}")
        if place not in self.loaded:
            self.loading.append(place)
            try:
                functions: dict = {}
                for other in module.get("imports", ()):
                    path, at = (other, None) if isinstance(other, str) else (other["path"], other.get("search"))
                    own = [(Path(place).parent / at).resolve()] if at and not place.startswith("given:") else None
                    functions |= self.load(path, own)
                self.loaded[place] = functions | module.get("functions", {})
            finally:
                self.loading.pop()
        return self.loaded[place]


def define(spark: SparkSession, name: str, args: dict[str, str], returns: str, body: str) -> None:
    """A function for this session; a later definition of the name replaces it."""
    listed = ", ".join(f"{a} {t}" for a, t in args.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {returns} RETURN {body}")


def include(spark: SparkSession, loader: Loader, name: str) -> list[str]:
    functions = loader.load(name)
    for f, d in functions.items():
        define(spark, f, d["args"], d["returns"], d["body"])
    return sorted(functions)


def import_module(spark: SparkSession, loader: Loader, name: str, namespace: str) -> list[str]:
    """Functions as namespace__name."""
    functions = loader.load(name)
    for f, d in functions.items():
        define(spark, f"{namespace}__{f}", d["args"], d["returns"], d["body"])
    return sorted(f"{namespace}__{f}" for f in functions)
