"""Path expressions. Paths are absolute, cut into components at ``/``; ``/`` itself has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Levels of a path that are cut one by one.
SHORT = 8


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(path: Column | str) -> Column:
    # A plain function: one with a lambda would take every row that is cut out of generated code.
    return F.array_remove(F.split(as_column(path), "/"), "")


def plain(path: Column | str) -> Column:
    """Not ``/`` itself and without doubled, trailing or missing slashes: such a path is cut without taking it apart."""
    c = as_column(path)
    return c.startswith("/") & ~c.endswith("/") & ~c.contains("//")


def depth(path: Column | str) -> Column:
    return F.size(parts(path))


def joined(components: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(components, "/"))


def name(path: Column | str) -> Column:
    """The last component; the path itself where it has none."""
    c = as_column(path)
    return F.when(plain(c), F.substring_index(c, "/", -1)).otherwise(F.coalesce(F.try_element_at(parts(c), F.lit(-1)), c))


def parent(path: Column | str) -> Column:
    """The path without its last component; null for ``/``."""
    c, p = as_column(path), parts(path)
    above = F.left(c, F.greatest(F.length(c) - F.length(F.substring_index(c, "/", -1)) - 1, F.lit(1)))
    return F.when(plain(c), above).when(F.size(p) > 0, joined(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))))


def prefixes(path: Column | str, upto: int = 0) -> Column:
    """Proper ancestors below ``/`` (``upto`` = 0), or with the path itself (``upto`` = 1), outermost first."""
    n = depth(path) - 1 + upto
    c = as_column(path)
    levels = F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    clean = F.when(plain(c), c).otherwise(F.concat(F.lit("/"), F.trim(F.regexp_replace(c, "/{2,}", "/"), F.lit("/"))))
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("substring_index", clean, F.lit("/"), i + 1))
    # Without a lambda, which would be interpreted, as long as a path is no deeper than most.
    short = F.slice(F.array(*(F.substring_index(c, "/", i + 1) for i in range(1, SHORT + 1))), F.lit(1), F.greatest(levels - 1 + upto, F.lit(0)))
    return F.when(plain(c) & (levels - 1 + upto <= SHORT), short).when(n >= 1, made).otherwise(F.array().cast("array<string>"))


def under(path: Column | str, top: Column | str) -> Column:
    """Component-wise: the path is ``top`` or lies below it."""
    path, top = as_column(path), as_column(top)
    return (path == top) | (top == "/") | path.startswith(F.concat(top, F.lit("/")))


def under_any(path: Column | str, tops: list[str]) -> Column:
    """``under`` one of a fixed list."""
    return reduce(lambda a, b: a | b, (under(path, F.lit(t)) for t in tops), F.lit(False))


def normalized(path: Column | str) -> Column:
    """Lexically: ``.`` goes, ``..`` takes the component before it along."""
    step = lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    )
    return joined(F.aggregate(parts(path), F.array().cast("array<string>"), step))


def extension(file_name: Column | str) -> Column:
    """After the last dot of a name; empty without one."""
    return F.regexp_extract(as_column(file_name), r"\.([^.]*)$", 1)
