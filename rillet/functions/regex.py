"""Regular expressions; flags: g all, i no case, x extended, s single line, n drop empty matches.

All but `match` stay in the JVM, in its dialect. So do `capture` and `scan` of groups that take part in every match; where
a group may be left out, which Spark shows as an empty string, they are read from `match`. Patterns of the common core
(classes, groups, names, greedy and lazy repetition, lookaround) mean the same in both."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import builtin

MATCH = "array<struct<offset:int,length:int,string:string,captures:array<struct<offset:int,length:int,string:string,name:string>>>>"
NAMED = re.compile(r"\(\?<([A-Za-z][A-Za-z0-9_]*)>")


def _pattern(pattern: str, flags: str | None) -> str:
    wrong = set(flags or "") - set("gixsnlpm")
    if wrong:
        raise ValueError(f"{flags} is not a valid modifier string")
    inline = "".join(sorted({{"i": "i", "x": "x", "s": "s", "m": "s", "p": "s"}.get(f, "") for f in flags or ""}))
    return f"(?{inline}){pattern}" if inline else pattern


def _groups(pattern: str) -> list[tuple[str | None, bool]]:
    """For each capturing group its name, and whether it takes part in every match: it stands in no part that can be skipped."""
    names: list[str | None] = []
    skipped: set[int] = set()
    stack: list[tuple[list[int], list[int], list[bool]]] = [([], [], [])]  # the group itself, those within, branches
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at += 2 if pattern[at + 1 : at + 2] == "^" else 1  # the first character stands for itself, a bracket too
            at += 1
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
        elif c == "(":
            named, own = NAMED.match(pattern, at), []
            if named or pattern[at + 1 : at + 2] != "?":
                own = [len(names)]
                names.append(named[1] if named else None)
            stack.append((own, [], []))
        elif c == "|":
            stack[-1][2].append(True)
        elif c == ")":
            own, within, branches = stack.pop()
            if branches:
                skipped.update(within)
            if re.match(r"[?*]|\{0?,|\{0\}", pattern[at + 1 :]):
                skipped.update(own + within)
            stack[-1][1].extend(own + within)
        at += 1
    if stack[0][2]:
        skipped.update(stack[0][1])
    return [(name, i not in skipped) for i, name in enumerate(names)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _captured(m: Column, i: int) -> Column:
    return F.get(m["captures"], i)["string"]


@builtin("test/1", "test/2")
def test(s: Column, pattern: str, flags: str | None = None) -> Column:
    whole = F.lit(_pattern(pattern, flags))
    if "n" in (flags or ""):
        return F.exists(F.regexp_extract_all(s, whole, F.lit(0)), lambda m: m != "")
    return F.regexp_like(s, whole)


@builtin("scan/1", "scan/2")
def scan(s: Column, pattern: str, flags: str | None = None, group: int | None = None) -> Column:
    """All matches; of a pattern with groups, for each match the array of its groups (null for one left out). group: that one of each match, 0 for the whole."""
    whole, groups = F.lit(_pattern(pattern, flags)), _groups(pattern)
    if group is None and not all(always for _, always in groups):
        return F.transform(match(s, pattern, "g" + (flags or "")), lambda m: F.transform(m["captures"], lambda c: c["string"]))
    each = lambda i: F.regexp_extract_all(s, whole, F.lit(i))
    if group is not None or not groups:
        found = each(group or 0)
        return found if "n" not in (flags or "") else F.transform(F.filter(F.arrays_zip(each(0).alias("m"), found.alias("x")), lambda y: y["m"] != ""), lambda y: y["x"])
    zipped = F.arrays_zip(each(0).alias("m"), *[each(i + 1).alias(f"g{i}") for i in range(len(groups))])
    if "n" in (flags or ""):
        zipped = F.filter(zipped, lambda y: y["m"] != "")
    return F.transform(zipped, lambda y: F.array(*[y[f"g{i}"] for i in range(len(groups))]))


@builtin("capture/1", "capture/2")
def capture(s: Column, pattern: str, flags: str | None = None) -> Column:
    """The first match's named groups as a struct of their names, null for a group left out; null without a match. With flag g an array of all matches'."""
    groups = _groups(pattern)
    every = "g" in (flags or "")
    named = [(i, name) for i, (name, _) in enumerate(groups) if name]
    if every or "n" in (flags or "") or not all(groups[i][1] for i, _ in named):
        names = lambda m: F.struct(*[_captured(m, i).alias(name) for i, name in named])
        found = F.transform(match(s, pattern, flags), names)
        return found if every else F.get(found, 0)
    whole = _pattern(pattern, flags)
    return F.when(F.regexp_like(s, F.lit(whole)), F.struct(*[F.regexp_extract(s, whole, i + 1).alias(name) for i, name in named]))


def _filled(template: str, groups: list[tuple[str | None, bool]], group: Callable[[int], Column]) -> Column:
    """A template's text with ${name} and $1 replaced by groups; a backslash makes the next character plain."""
    place = {name: i + 1 for i, (name, _) in enumerate(groups) if name}
    parts, text = [], ""
    for m in re.finditer(r"\\(.)|\$\{(\w+)\}|\$(\d)|(.)", template, re.DOTALL):
        if m[2] or m[3]:
            parts += [F.lit(text), group(int(m[3]) if m[3] else place[m[2]])]
            text = ""
        else:
            text += m[1] or m[4]
    return F.concat(*parts, F.lit(text))


def _rebuilt(s: Column, pattern: str, flags: str | None, replacement: Callable[[Column], Column], every: bool) -> Column:
    """s with all matches (or the first) replaced: what is between matches and the replacements take turns. replacement(struct of m, g1, g2, ...)."""
    whole, groups = _pattern(pattern, flags), _groups(pattern)
    each = lambda i: F.regexp_extract_all(s, F.lit(whole), F.lit(i))
    found = F.arrays_zip(each(0).alias("m"), *[each(i).alias(f"g{i}") for i in range(1, len(groups) + 1)])

    def body(x: Column) -> Column:
        # an empty match at the very start is passed over by split, so there is no empty text before it
        between = F.when(F.size(x["b"]) <= F.size(x["f"]), F.concat(F.array(F.lit("")), x["b"])).otherwise(x["b"])
        counts = lambda m: m["m"] != "" if "n" in (flags or "") else F.lit(True)
        first = F.array_position(F.transform(x["f"], counts), True) - 1
        chosen = lambda m, i: counts(m) if every else i == first
        texts = F.transform(x["f"], lambda m, i: F.when(chosen(m, i), F.coalesce(replacement(m), F.lit("null"))).otherwise(m["m"]))
        return F.array_join(F.transform(F.arrays_zip(between.alias("b"), texts.alias("t")), lambda y: F.concat(y["b"], F.coalesce(y["t"], F.lit("")))), "")

    return F.when(F.regexp_like(s, F.lit(whole)), _let(F.struct(F.split(s, whole, -1).alias("b"), found.alias("f")), body)).otherwise(s)


def _by_name(pattern: str, f: Callable[[dict[str, Column]], Column]) -> Callable[[Column], Column]:
    names = [(name, i + 1) for i, (name, _) in enumerate(_groups(pattern)) if name]
    return lambda m: f({name: m[f"g{i}"] for name, i in names})


@builtin("gsub/2", "gsub/3")
def gsub(s: Column, pattern: str, replacement: str | Callable[[dict[str, Column]], Column], flags: str | None = None) -> Column:
    """All matches replaced: by a template, in which ${name} is a named group, or by what a function makes of the named groups."""
    if callable(replacement):
        return _rebuilt(s, pattern, flags, _by_name(pattern, replacement), True)
    if "n" in (flags or ""):
        return _rebuilt(s, pattern, flags, lambda m: _filled(replacement, _groups(pattern), lambda i: m[f"g{i}" if i else "m"]), True)
    return F.regexp_replace(s, _pattern(pattern, flags), replacement)


@builtin("sub/2", "sub/3")
def sub(s: Column, pattern: str, replacement: str | Callable[[dict[str, Column]], Column], flags: str | None = None) -> Column:
    """The first match replaced (all of them with flag g), as in `gsub`."""
    if "g" in (flags or ""):
        return gsub(s, pattern, replacement, flags)
    made = _by_name(pattern, replacement) if callable(replacement) else lambda m: _filled(replacement, _groups(pattern), lambda i: m[f"g{i}" if i else "m"])
    return _rebuilt(s, pattern, flags, made, False)


@builtin("split/2", "splits/1", "splits/2")
def split_re(s: Column, pattern: str, flags: str | None = None) -> Column:
    """The texts between matches; with flag n empty matches don't count."""
    whole = _pattern(pattern, flags)
    if "n" not in (flags or ""):
        return F.split(s, whole, -1)
    found = F.struct(F.split(s, whole, -1).alias("b"), F.regexp_extract_all(s, F.lit(whole), F.lit(0)).alias("m"))

    def body(x: Column) -> Column:
        between = F.when(F.size(x["b"]) <= F.size(x["m"]), F.concat(F.array(F.lit("")), x["b"])).otherwise(x["b"])
        return F.aggregate(
            F.arrays_zip(F.slice(between, 2, F.size(x["m"])).alias("b"), x["m"].alias("m")),
            F.slice(between, 1, 1),
            lambda done, y: F.when(y["m"] != "", F.concat(done, F.array(y["b"]))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), y["b"])))),
        )

    return _let(found, body)


@builtin("match/1", "match/2")
def match(s: Column, pattern: str, flags: str | None = None) -> Column:
    """Matches with offsets, lengths and captures; the first alone without flag g. Spark has no offsets of groups, so this is an Arrow UDF."""
    import regex

    every, drop_empty = "g" in (flags or ""), "n" in (flags or "")
    text = _pattern(pattern, flags)

    @F.pandas_udf(MATCH)
    def run(column: pd.Series) -> pd.Series:
        compiled = regex.compile(text)
        names = {i: n for n, i in compiled.groupindex.items()}

        def one(value):
            if value is None:
                return None
            out = []
            for m in compiled.finditer(value):
                if not (drop_empty and m.end() == m.start()):
                    groups = range(1, (compiled.groups if m.end() > m.start() else 0) + 1)
                    spans = [(g, m.start(g), m.end(g)) for g in groups]
                    out.append({"offset": m.start(), "length": m.end() - m.start(), "string": m[0], "captures": [{"offset": a, "length": max(0, b - a), "string": m[g], "name": names.get(g)} for g, a, b in spans]})
                    if not every:
                        break
            return out

        return column.map(one)

    return run(s)
