from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Literal or Column -> Column (strings are literals, not column names)."""
    if isinstance(x, Column):
        return x
    return F.lit(x)


def idx_seq(n: Column) -> Column:
    """0..n-1 as an array; empty when n <= 0 (``sequence(0,-1)`` counts down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def let(value, fn) -> Column:
    """Bind ``value`` once and pass it to ``fn`` as a lambda variable.

    Higher-order function bodies re-evaluate any captured sub-expression per
    element; binding an input first keeps every builder linear in its input.
    """
    return F.element_at(F.transform(F.array(as_col(value)), fn), 1)


def memo_columns(fn):
    """Reuse a built expression when a builder is called again with the same inputs.

    Inputs are the same if Spark says so of the expressions (their text is only
    the first look-up): columns of two frames print alike but differ. Building a
    large higher-order expression costs many Python-to-JVM calls; this keeps it
    to once per input.
    """
    import functools
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        columns = [a for a in args if isinstance(a, Column)]
        if any(not hasattr(c, "_jc") for c in columns):
            return fn(*args)
        key = tuple(("c", str(a)) if isinstance(a, Column) else ("v", repr(a)) for a in args)
        for held, built in cache.get(key, ()):
            if all(a._jc.equals(b._jc) for a, b in zip(columns, held, strict=True)):
                return built
        if len(cache) > 512:
            cache.clear()
        built = fn(*args)
        cache.setdefault(key, []).append((columns, built))
        return built
    return wrapper
