"""Two pattern languages, both turned into regular expressions when the plan is made.

Path globs: ``*`` and ``?`` match any characters, ``/`` too, ``[...]`` a class, ``{a,b}`` alternatives, case counts. Search
patterns: case does not count; with ``*`` or ``?`` the whole name must match, else a part of it is enough.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that doesn't parse."""


def to_regex(glob: str) -> str:
    """An anchored regular expression, fit for Java, RE2 and Python."""
    return f"(?s)^{body(glob)}$"


def body(glob: str, inside: bool = False) -> str:
    """The expression alone; with ``inside`` a component's, in which no wildcard reaches over ``/`` (Java and Python only)."""
    one, guard = ("[^/]", "(?!/)") if inside else (".", "")
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                raise GlobError(f"unclosed class in {glob!r}")
            inner = glob[i:end]
            negated = inner.startswith(("!", "^"))
            inner = re.sub(r"([\\\[\]&^~])", r"\\\1", inner[negated:])
            out.append(f"{guard}[{'^' * negated}{inner}]")
            i = end + 1
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        elif c == "\\":
            if i >= len(glob):
                raise GlobError(f"trailing backslash in {glob!r}")
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(re.escape(c) if not c.isalnum() and ord(c) < 128 else c)
    if braces:
        raise GlobError(f"unclosed alternatives in {glob!r}")
    return "".join(out)


def compiled(globs: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Regular expressions of the globs that parse, and (glob, error) of the others."""
    good, bad = [], []
    for glob in globs:
        try:
            good.append(to_regex(glob))
        except GlobError as e:
            bad.append((glob, str(e)))
    return good, bad


def matches_any(columns: list[Column], globs: list[str]) -> Column:
    """One of the columns (path, name) matches one of the globs; those that don't parse match nothing."""
    tests = [c.rlike(r) for r in compiled(globs)[0] for c in columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def split_globs(text: Column | str) -> Column:
    """A user's list, cut at commas and semicolons, trimmed, without empty items."""
    cut = F.transform(F.split(text, "[,;]"), lambda x: F.trim(x))
    return F.filter(cut, lambda x: x != "")


def search(name: Column, pattern: str) -> Column:
    """The search box's matcher."""
    wanted, lowered = pattern.lower(), F.lower(name)
    if "*" not in wanted and "?" not in wanted:
        return lowered.contains(wanted)
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in wanted)
    return lowered.rlike(f"(?s)^{body}$")
