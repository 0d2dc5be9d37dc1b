"""Portable seeded hashing in place of a sequential RNG.

Every random draw is a pure function of (seed, keys...), so a draw is the same
whichever partition, executor or retry computes it, and DuckDB can recompute it
for the oracle. ``h`` takes the first 32 bits of md5 over ``seed:key1:key2...``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.util import as_col


def h(seed, *keys, fast: bool = False) -> Column:
    """Seeded 32-bit hash as a non-negative bigint.

    ``fast=True`` switches to xxhash64 (JVM native, no string building); it is
    not reproducible outside Spark, so the oracle-checked queries keep md5.
    """
    cols = [as_col(seed)] + [as_col(k) for k in keys]
    if fast:
        return F.pmod(F.xxhash64(*cols), F.lit(1 << 32))
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """Seeded draw in [0, 1)."""
    return h(seed, *keys) / F.lit(float(1 << 32))


def digest(seed, *keys) -> Column:
    """md5 hex of 'seed:k1:k2...' (32 lowercase hex digits)."""
    cols = [as_col(seed)] + [as_col(k) for k in keys]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


KEY_DIGITS, KEYS_PER_DIGEST = 8, 8  # a SHA-256 digest gives eight sort keys of 32 bits


def key_digits(n, seed, *keys) -> Column:
    """Hex digits of n sort keys: the SHA-256 digests of 'seed:k1:...:0', ':1', ... one after the other."""
    cols = [as_col(seed)] + [as_col(k) for k in keys]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    if isinstance(n, int):
        parts = [F.sha2(F.concat(text, F.lit(f":{j}")), 256) for j in range(-(-n // KEYS_PER_DIGEST))]
        return F.concat(*parts)
    last = F.floor((as_col(n) - 1) / KEYS_PER_DIGEST).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda j: F.sha2(F.concat_ws(":", text, j.cast("string")), 256)), "")


def random_perm(n, seed, *keys) -> Column:
    """A permutation of 0..n-1 drawn by sorting on seeded 32-bit keys (ties by index), by one rule for any n."""
    from tessera.functions.util import let
    return let(key_digits(n, seed, *keys), lambda d: perm_from_hex(d, 0, n))


def perm_from_hex(d: Column, first: int | Column, n) -> Column:
    """Permutation of 0..n-1 sorted on the keys ``first``, ``first + 1``, ... of ``key_digits`` (ties by index)."""
    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), as_col(n) - 1), lambda i: F.struct(
        F.substring(d, ((i + first) * KEY_DIGITS + 1).cast("int"), KEY_DIGITS).alias("k"), i.alias("i")))), lambda s: s["i"])


def colour_perm(seed, *keys) -> Column:
    """Colour map for grids: 0 stays 0, 1..9 are permuted."""
    return F.concat(F.array(F.lit(0)), F.transform(random_perm(9, seed, *keys), lambda x: x + 1))
