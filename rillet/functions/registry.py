"""Names of the functions, with the language levels in which they exist, and functions that users add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LEVELS = ("1.5", "1.6")
_builtins: dict[str, tuple[Callable, str | None]] = {}
_defined: dict[str, Callable] = {}


def builtin(*names: str, since: str | None = None):
    """Register a function under names like "split/1"; since is the level from which on it exists."""

    def add(f: Callable) -> Callable:
        for name in names:
            _builtins[name] = (f, since)
        return f

    return add


def define(name: str, f: Callable) -> None:
    """Add a function, found before the built-in one of the same name. A later definition replaces an earlier one."""
    _defined[name] = f


def find(name: str, level: str = LEVELS[-1]) -> Callable:
    """The function of that name: name/arity first, then the bare name."""
    if level not in LEVELS:
        raise ValueError(f"no such language level: {level}")
    for key in (name, name.partition("/")[0]):
        if key in _defined:
            return _defined[key]
        if key in _builtins and (_builtins[key][1] or level) <= level:
            return _builtins[key][0]
    raise KeyError(f"no function {name} at level {level}")


def names(level: str = LEVELS[-1]) -> list[str]:
    return sorted({k for k, (_, since) in _builtins.items() if (since or level) <= level} | set(_defined))


def builtins(spark: SparkSession, level: str = LEVELS[-1]) -> DataFrame:
    """One row for each name."""
    return spark.createDataFrame([(x,) for x in names(level)], "name string")
