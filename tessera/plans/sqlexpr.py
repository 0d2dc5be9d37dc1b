"""DuckDB expression snippets used to write the oracle SQL of the registered queries.

These are plain text templates (one function per semantic rule) so that each
oracle states the rule independently of the Spark Column builders.
"""

from __future__ import annotations


_n = [0]


def _var(prefix: str) -> str:
    _n[0] += 1
    return f"{prefix}{_n[0]}"


def let(value: str, body) -> str:
    """Bind ``value`` once (DuckDB): body receives the bound variable name."""
    v = _var("v")
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def h(seed, *keys) -> str:
    """R0 in DuckDB: first 8 hex digits of md5('seed:k1:k2...') as bigint."""
    parts = ", ".join([str(seed)] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) AS BIGINT)"


def digest(seed, *keys) -> str:
    parts = ", ".join([str(seed)] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5(concat_ws(':', {parts}))"


def key_digits(n, seed, *keys) -> str:
    parts = ", ".join([str(seed)] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return " || ".join(f"sha256(concat_ws(':', {parts}, '{j}'))" for j in range(-(-n // 8)))


def perm_from_hex(d, first, n) -> str:
    return (f"list_transform(list_sort(list_transform(range({n}), lambda i: "
            f"{{'k': substr({d}, CAST((i + {first}) * 8 + 1 AS INTEGER), 8), 'i': i}})), lambda s: s.i)")


def random_perm(n, seed, *keys) -> str:
    return let(f"({key_digits(n, seed, *keys)})", lambda d: perm_from_hex(d, 0, n))


def colour_perm(seed, *keys) -> str:
    return f"list_concat([0], list_transform({random_perm(9, seed, *keys)}, lambda x: x + 1))"


def height(g) -> str:
    return f"len({g})"


def width(g) -> str:
    return f"(CASE WHEN len({g}) > 0 THEN len({g}[1]) ELSE 0 END)"


def transpose(g) -> str:
    return f"list_transform(range({width(g)}), lambda j: list_transform({g}, lambda rr: rr[j + 1]))"


def fliplr(g) -> str:
    return f"list_transform({g}, lambda rr: list_reverse(rr))"


def dihedral_static(g, t: int) -> str:
    return {
        0: g,
        1: f"list_reverse({transpose(g)})",
        2: f"list_reverse({fliplr(g)})",
        3: fliplr(transpose(g)),
        4: fliplr(g),
        5: f"list_reverse({g})",
        6: transpose(g),
        7: f"list_reverse({fliplr(transpose(g))})",
    }[t]


def dihedral(g, tid) -> str:
    def body(gg):
        whens = " ".join(f"WHEN {tid} = {t} THEN {dihedral_static(gg, t)}" for t in range(8))
        return f"(CASE {whens} END)"
    return let(g, body)


def inverse_tid(tid) -> str:
    return f"([0, 3, 2, 1, 4, 5, 6, 7][{tid} + 1])"


def recolour(g, perm) -> str:
    return let(perm, lambda pp: f"list_transform({g}, lambda rr: list_transform(rr, lambda x: {pp}[x + 1]))")


def inverse_perm(perm) -> str:
    return f"list_transform(range(10), lambda d: CAST(list_position({perm}, d) - 1 AS INTEGER))"


def augment(g, tid, perm) -> str:
    return dihedral(recolour(g, perm), tid)


def unaugment(g, tid, perm) -> str:
    return recolour(dihedral(g, inverse_tid(tid)), inverse_perm(perm))


def hex2(x) -> str:
    return f"lpad(hex(CAST({x} AS INTEGER)), 2, '0')"


def grid_hash(g) -> str:
    def body(gg):
        cells = f"array_to_string(list_transform(flatten({gg}), lambda x: {hex2('x')}), '')"
        return f"sha256(unhex({hex2(height(gg))} || {hex2(width(gg))} || {cells}))"
    return let(g, body)


def serialise(g, pad_r="0", pad_c="0") -> str:
    r = f"(k // 30 - ({pad_r}))"
    c = f"(k % 30 - ({pad_c}))"
    hh, ww = height(g), width(g)
    in_rows = f"({r} >= 0 AND {r} < {hh})"
    in_cols = f"({c} >= 0 AND {c} < {ww})"
    return (f"list_transform(range(900), lambda k: CASE "
            f"WHEN {in_rows} AND {in_cols} THEN {g}[{r} + 1][{c} + 1] + 2 "
            f"WHEN {r} = {hh} AND {in_cols} THEN 1 "
            f"WHEN {c} = {ww} AND {in_rows} THEN 1 ELSE 0 END)")


def crop(seq) -> str:
    """Same rule as the Spark crop, written with a prefix minimum."""
    def with_seq(sq):
        runs = (f"list_transform(range(30), lambda r: coalesce(list_position(list_transform("
                f"list_slice({sq}, r * 30 + 1, r * 30 + 30), lambda x: x < 2 OR x > 11), true) - 1, 30))")

        def with_runs(rn):
            limits = f"list_transform(range(1, 31), lambda r: list_min(list_slice({rn}, 1, r)))"

            def with_limits(lm):
                areas = f"list_transform({lm}, lambda c, i: c * i)"

                def with_areas(ar):
                    best = (f"{{'best': list_max({ar}), 'n_rows': list_position({ar}, list_max({ar})), "
                            f"'n_cols': {lm}[list_position({ar}, list_max({ar}))]}}")
                    return let(best, lambda b: (
                        f"CASE WHEN {b}.best > 0 THEN list_transform(range({b}.n_rows), lambda r: "
                        f"list_transform(list_slice({sq}, r * 30 + 1, r * 30 + {b}.n_cols), lambda x: x - 2)) "
                        f"ELSE [] END"))
                return let(areas, with_areas)
            return let(limits, with_limits)
        return let(runs, with_runs)
    return let(seq, with_seq)
