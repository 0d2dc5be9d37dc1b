"""Grid algebra as Catalyst expressions on ``array<array<int>>`` (row-major).

No Python UDF: every function returns a Column built from higher-order array
functions, so it runs inside the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.util import as_col, idx_seq, let, memo_columns

# Fixed values that must equal the source corpus format.
MAX_GRID = 30                        # grids are at most 30 x 30
SEQ_CELLS = MAX_GRID * MAX_GRID      # 900 tokens per serialised grid
PAD_ID, EOS_ID, DIGIT_OFFSET = 0, 1, 2   # PAD 0, end marker 1, colour d -> d + 2
AUG_SEPARATOR = "|||"               # name|||t{tid}|||{10 digits}
DIHEDRAL_INVERSE = [0, 3, 2, 1, 4, 5, 6, 7]


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.when(F.size(g) > 0, F.size(F.get(g, 0))).otherwise(F.lit(0))


def transpose(g: Column) -> Column:
    return let(g, lambda gg: F.transform(idx_seq(width(gg)), lambda j: F.transform(gg, lambda r: r[j])))


def _fliplr(g: Column) -> Column:
    return F.transform(g, lambda r: F.reverse(r))


def dihedral_static(g: Column, tid: int) -> Column:
    """G1 for a literal transform id."""
    if tid == 0:
        return g
    if tid == 1:  # rotate 90 counter-clockwise
        return F.reverse(transpose(g))
    if tid == 2:
        return F.reverse(_fliplr(g))
    if tid == 3:  # rotate 270
        return _fliplr(transpose(g))
    if tid == 4:
        return _fliplr(g)
    if tid == 5:
        return F.reverse(g)
    if tid == 6:
        return transpose(g)
    if tid == 7:  # fliplr after rot90 = anti-diagonal reflection
        return F.reverse(_fliplr(transpose(g)))
    raise ValueError(tid)


@memo_columns
def dihedral(g: Column, tid) -> Column:
    """G1: the 8 symmetries; ``tid`` may be a Column (only its branch runs per row)."""
    if isinstance(tid, int):
        return dihedral_static(g, tid)

    def body(gg):
        expr = F.when(tid == 0, gg)
        for t in range(1, 8):
            expr = expr.when(tid == t, dihedral_static(gg, t))
        return expr.otherwise(gg)
    return let(g, body)


def inverse_tid(tid) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DIHEDRAL_INVERSE]), as_col(tid) + 1)


def inverse_dihedral(g: Column, tid) -> Column:
    """G2."""
    if isinstance(tid, int):
        return dihedral_static(g, DIHEDRAL_INVERSE[tid])
    return dihedral(g, inverse_tid(tid))


@memo_columns
def recolour(g: Column, perm: Column) -> Column:
    """Cell -> perm[cell]."""
    return let(perm, lambda pp: F.transform(g, lambda r: F.transform(r, lambda x: F.element_at(pp, x + 1))))


@memo_columns
def inverse_perm(perm: Column) -> Column:
    """Position of each digit in the permutation."""
    return let(perm, lambda pp: F.transform(F.sequence(F.lit(0), F.lit(9)),
                                            lambda d: (F.array_position(pp, d) - 1).cast("int")))


@memo_columns
def augment(g: Column, tid, perm: Column) -> Column:
    """Forward augmentation: recolour, then the dihedral transform."""
    return dihedral(recolour(g, perm), tid)


@memo_columns
def unaugment(g: Column, tid, perm: Column) -> Column:
    """Inverse dihedral, then inverse recolour."""
    return recolour(inverse_dihedral(g, tid), inverse_perm(perm))


def aug_name(base: Column, tid: Column, perm: Column) -> Column:
    """``base|||t{tid}|||{digits}``."""
    return F.concat_ws(AUG_SEPARATOR, base, F.concat(F.lit("t"), tid.cast("string")),
                       F.array_join(perm, ""))


_SEP_RE = "\\|\\|\\|"


def parse_aug(name: Column) -> tuple[Column, Column, Column]:
    """G5 inverse -> (base, tid, perm); a name without separator is the identity."""
    has = F.instr(name, AUG_SEPARATOR) > 0
    parts = F.split(name, _SEP_RE)
    base = F.when(has, F.element_at(parts, 1)).otherwise(name)
    tid = F.when(has, F.substring(F.element_at(parts, -2), 2, 10).cast("int")).otherwise(F.lit(0))
    perm = F.when(has, let(F.element_at(parts, -1), lambda d: F.transform(
        F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, 1).cast("int")))) \
        .otherwise(F.sequence(F.lit(0), F.lit(9)))
    return base, tid, perm


def _hex2(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


@memo_columns
def grid_hash(g: Column) -> Column:
    """SHA-256 over the bytes (h, w, cells row-major), hex."""
    def body(gg):
        flat = F.flatten(gg)
        # cells 0..9 are one hex digit each: join the digits natively, then
        # prefix every digit with 0 (one regex pass instead of a per-cell lambda)
        fast = F.regexp_replace(F.array_join(flat, ""), "(.)", "0$1")
        slow = F.array_join(F.transform(flat, _hex2), "")
        mx, mn = F.array_max(flat), F.array_min(flat)
        cells = F.when(F.size(flat) == 0, F.lit("")).when((mx <= 9) & (mn >= 0), fast).otherwise(slow)
        return F.sha2(F.unhex(F.concat(_hex2(height(gg)), _hex2(width(gg)), cells)), 256)
    return let(g, body)


@memo_columns
def serialise(g: Column, pad_r=0, pad_c=0) -> Column:
    """30x30 token image of one grid, flattened to 900 tokens.

    Cell -> colour + 2; end marker 1 on the row below the grid and on the column
    right of it (the corner stays 0; nothing when that border is off-grid).
    Built row by row with native concat/array_repeat; only the grid's own cells
    pass through a lambda.
    """
    def body(b):
        gg, h_, w_, pr, pc = b["g"], b["h"], b["w"], b["pr"], b["pc"]
        right = MAX_GRID - pc - w_          # cells right of the grid (>= 0)
        zeros_left = F.array_repeat(F.lit(PAD_ID), pc)
        eos_col = F.when(right > 0, F.array(F.lit(EOS_ID))).otherwise(F.array().cast("array<int>"))
        tail = F.array_repeat(F.lit(PAD_ID), F.greatest(right - 1, F.lit(0)))

        def row(r):
            gr = r - pr
            in_grid = (gr >= 0) & (gr < h_)
            cells = F.transform(gg[F.greatest(F.least(gr, h_ - 1), F.lit(0))], lambda x: x + DIGIT_OFFSET)
            grid_row = F.concat(zeros_left, cells, eos_col, tail)
            eos_row = F.concat(zeros_left, F.array_repeat(F.lit(EOS_ID), w_), F.array_repeat(F.lit(PAD_ID), right))
            blank = F.array_repeat(F.lit(PAD_ID), MAX_GRID)
            return F.when(in_grid, grid_row).when((gr == h_) & (w_ > 0), eos_row).otherwise(blank)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MAX_GRID - 1)), row))

    def bind(gg):
        return let(F.struct(gg.alias("g"), height(gg).alias("h"), width(gg).alias("w"),
                            as_col(pad_r).cast("int").alias("pr"), as_col(pad_c).cast("int").alias("pc")), body)
    return let(g, bind)


def _row_runs(s: Column) -> Column:
    """Leading run of colour tokens in each row that can still contribute.

    Once a row starts with a non-colour token every later column limit is 0,
    so only the rows before the first such row are measured. When no token
    exceeds 11 (the serialised vocabulary, checked once per sequence) the only
    stoppers are 0 and 1, found with native array_position; other inputs take
    the general per-token test.
    """
    def bad(x):
        return (x < DIGIT_OFFSET) | (x > DIGIT_OFFSET + 9)

    first_col = F.transform(F.sequence(F.lit(0), F.lit(MAX_GRID - 1)), lambda r: F.element_at(s, r * MAX_GRID + 1))
    stop = F.array_position(F.transform(first_col, bad), True).cast("int")
    n_live = F.when(stop == 0, F.lit(MAX_GRID)).otherwise(stop - 1)

    def fast_run(r):
        row = F.slice(s, r * MAX_GRID + 1, MAX_GRID)
        p0 = F.array_position(row, PAD_ID).cast("int")
        p1 = F.array_position(F.slice(s, r * MAX_GRID + 1, MAX_GRID), EOS_ID).cast("int")
        p = F.when(p0 == 0, p1).when(p1 == 0, p0).otherwise(F.least(p0, p1))
        return F.when(p == 0, F.lit(MAX_GRID)).otherwise(p - 1)

    def slow_run(r):
        p = F.array_position(F.transform(F.slice(s, r * MAX_GRID + 1, MAX_GRID), bad), True).cast("int")
        return F.when(p == 0, F.lit(MAX_GRID)).otherwise(p - 1)

    rows = idx_seq(n_live)
    in_vocab = (F.array_max(s) <= DIGIT_OFFSET + 9) & (F.array_min(s) >= 0)
    return F.when(in_vocab, F.transform(rows, fast_run)).otherwise(F.transform(rows, slow_run))


@memo_columns
def crop(seq: Column) -> Column:
    """Largest top-left rectangle of colour tokens (2..11), minus 2.

    The column limit after row r is the minimum leading run of colour tokens
    over rows 1..r; the answer is the first row count maximising rows x limit.
    Empty when no colour token starts the first row.
    """
    def with_limits(s, limits):
        def with_areas(areas):
            def with_best(b):
                out = F.transform(F.sequence(F.lit(0), b["n_rows"] - 1), lambda r: F.transform(
                    F.slice(s, r * MAX_GRID + 1, b["n_cols"]), lambda x: x - DIGIT_OFFSET))
                return F.when(b["best"] > 0, out).otherwise(F.array().cast("array<array<int>>"))
            best = F.array_max(areas)
            n_rows = F.array_position(areas, best).cast("int")
            return let(F.struct(best.alias("best"), n_rows.alias("n_rows"),
                                F.get(limits, n_rows - 1).alias("n_cols")), with_best)
        return let(F.transform(limits, lambda c, i: c * (i + 1)), with_areas)

    def with_runs(s, runs):
        limits = F.transform(runs, lambda _, i: F.array_min(F.slice(runs, 1, i + 1)))
        return let(limits, lambda lim: with_limits(s, lim))

    return let(seq, lambda s: let(_row_runs(s), lambda runs: with_runs(s, runs)))


def translation_offsets(seed, key, h_in, h_out, w_in, w_out, exempt=None):
    """Uniform top-left offsets keeping both grids of a pair on the canvas."""
    from tessera.functions.rng import h as rng_h
    pad_r = F.pmod(rng_h(seed, "pad_r", key), MAX_GRID + 1 - F.greatest(h_in, h_out)).cast("int")
    pad_c = F.pmod(rng_h(seed, "pad_c", key), MAX_GRID + 1 - F.greatest(w_in, w_out)).cast("int")
    if exempt is not None:
        pad_r = F.when(exempt, F.lit(0)).otherwise(pad_r)
        pad_c = F.when(exempt, F.lit(0)).otherwise(pad_c)
    return pad_r, pad_c


def digits_to_ids(v: Column, offset: int = 1) -> Column:
    """Digit tokens (+1 for boards, +2 for grids)."""
    return F.transform(v, lambda x: x + offset)


def chars_to_ids(s: Column, charset: str) -> Column:
    """Character -> 1-based position in the charset (0 = foreign)."""
    return F.transform(F.split(s, ""), lambda ch: F.instr(F.lit(charset), ch))


def flatten_grid(g: Column) -> Column:
    """G15."""
    return F.flatten(g)


def reshape(v: Column, w) -> Column:
    """G15 inverse: vector -> rows of ``w``."""
    w = as_col(w)
    n_rows = (F.size(v) / w).cast("int")
    return F.transform(idx_seq(n_rows), lambda r: F.slice(v, r * w + 1, w))


def is_valid_grid(g: Column) -> Column:
    """V1: 2-D, rectangular, h and w in 1..30, cells 0..9."""
    w_ = width(g)
    return ((height(g) >= 1) & (height(g) <= MAX_GRID) & (w_ >= 1) & (w_ <= MAX_GRID)
            & F.forall(g, lambda r: (F.size(r) == w_) & F.forall(r, lambda x: (x >= 0) & (x <= 9))))
