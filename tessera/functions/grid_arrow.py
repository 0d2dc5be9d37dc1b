"""Grid codec on flat Arrow buffers: serialise, crop + un-augment, hash.

The same values as the expressions of ``functions.grid``, worked out for a whole
Arrow batch at once with NumPy instead of an interpreted lambda per cell. Use it
where whole tables of 900-token images are decoded; the expressions remain for
plans that want no Python worker. Python code runs once a row only for the
digest. A batch (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows of 900
cells) is worked on in pieces of ``PIECE_ROWS``: the work arrays take many times
a token's four bytes, and every core of an executor has a worker of its own.

Defined cases: a null argument gives null (the expression serialises a null grid as an empty image); an image of another length than 900
or a grid over 30 x 30 (with its offsets) or not rectangular is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tessera.functions.grid import DIGIT_OFFSET, EOS_ID, MAX_GRID, PAD_ID, SEQ_CELLS

# A symmetry reads cell (a, b) of the source, (a, b) = (j, i) if it swaps the axes and (i, j) if not,
# a counted from the last row or b from the last column where it flips them. Rows: transform id 0..7.
_SWAP = np.array([0, 1, 0, 1, 0, 0, 1, 1], bool)
_FLIP_ROWS = np.array([0, 0, 1, 1, 0, 1, 0, 1], bool)
_FLIP_COLUMNS = np.array([0, 1, 1, 0, 1, 0, 0, 1], bool)
_INVERSE = np.array([0, 3, 2, 1, 4, 5, 6, 7])

PIECE_ROWS = 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PIECE_ROWS`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(first, PIECE_ROWS)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``sum(sizes)`` elements: the row of each and its place inside the row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - _offsets(sizes)[row]


def _present(*arrays: pa.Array) -> np.ndarray:
    """Rows where no argument is null."""
    return np.flatnonzero(~np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in arrays]))


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _cropped(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Height and width of the largest top-left rectangle of colours in each 30 x 30 image."""
    colour = (images >= DIGIT_OFFSET) & (images <= DIGIT_OFFSET + 9)
    runs = np.logical_and.accumulate(colour, axis=2).sum(axis=2)
    limits = np.minimum.accumulate(runs, axis=1)
    areas = limits * np.arange(1, MAX_GRID + 1)
    last = areas.argmax(axis=1)  # the first of equal areas
    each = np.arange(len(images))
    found = areas[each, last] > 0
    return np.where(found, last + 1, 0), np.where(found, limits[each, last], 0)


def _inverse_perms(perms: pa.Array) -> np.ndarray:
    """Position of digits 0..9 in each permutation, the first one; -1 for a digit that is missing."""
    row, place = _spread(_lengths(perms))
    digit = perms.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(perms), 10), -1)
    out[row[::-1], digit[::-1]] = place[::-1]
    return out


def _decoded(seq: pa.Array, tid: pa.Array, perm: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights, widths and cells, row after row, of grids that are cropped and un-augmented; no argument is null."""
    if len(seq) and (_lengths(seq) != SEQ_CELLS).any():
        raise ValueError(f"a token image has {SEQ_CELLS} tokens")
    images = seq.flatten().to_numpy(zero_copy_only=False).reshape(-1, MAX_GRID, MAX_GRID)
    h, w = _cropped(images)
    t = _INVERSE[tid.to_numpy(zero_copy_only=False)]
    swap = _SWAP[t]
    high, wide = np.where(swap, w, h), np.where(swap, h, w)
    row, place = _spread(high * wide)
    i, j = place // wide[row], place % wide[row]
    a, b = np.where(swap[row], j, i), np.where(swap[row], i, j)
    a = np.where(_FLIP_ROWS[t][row], h[row] - 1 - a, a)
    b = np.where(_FLIP_COLUMNS[t][row], w[row] - 1 - b, b)
    return high, wide, _inverse_perms(perm)[row, images[row, a, b] - DIGIT_OFFSET]


def _digests(high: np.ndarray, wide: np.ndarray, cells: np.ndarray) -> list[str]:
    """SHA-256 of (height, width, cells) as bytes, lowercase hex."""
    data, at = cells.astype(np.uint8).tobytes(), _offsets(high * wide).tolist()
    return [hashlib.sha256(bytes((int(h), int(w))) + data[at[k]:at[k + 1]]).hexdigest() for k, (h, w) in enumerate(zip(high, wide, strict=True))]


def _nested(high: np.ndarray, wide: np.ndarray, cells: np.ndarray) -> pa.Array:
    """Grids as lists of rows."""
    rows = pa.ListArray.from_arrays(pa.array(_offsets(np.repeat(wide, high)), pa.int32()), pa.array(cells, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(_offsets(high), pa.int32()), rows)


def _back(found: pa.Array, present: np.ndarray, n: int) -> pa.Array:
    """``found`` at the places ``present`` of ``n`` rows, null elsewhere."""
    if len(present) == n:
        return found
    index = np.zeros(n, np.int64)
    index[present] = np.arange(len(present))
    missing = np.ones(n, bool)
    missing[present] = False
    return found.take(pa.array(index, mask=missing))


def decoded_batch(seq: pa.Array, tid: pa.Array, perm: pa.Array, with_grid: bool = True) -> tuple[pa.Array, pa.Array | None]:
    """Hashes and grids of a batch of augmented images."""
    at = _present(seq, tid, perm)
    grids = _decoded(seq.take(at), tid.take(at), perm.take(at))
    return _back(pa.array(_digests(*grids), pa.string()), at, len(seq)), _back(_nested(*grids), at, len(seq)) if with_grid else None


def serialised_batch(grid: pa.Array, pad_r: pa.Array, pad_c: pa.Array) -> pa.Array:
    """Token images of a batch of grids."""
    at = _present(grid, pad_r, pad_c)
    grids = grid.take(at)
    high = _lengths(grids)
    rows = grids.flatten()
    long = _lengths(rows)
    first = np.minimum(_offsets(high)[:-1], max(len(long) - 1, 0))
    wide = np.where(high > 0, long[first], 0) if len(long) else np.zeros(len(high), np.int64)
    down, right = pad_r.take(at).to_numpy(zero_copy_only=False), pad_c.take(at).to_numpy(zero_copy_only=False)
    if (long != np.repeat(wide, high)).any() or (high + down > MAX_GRID).any() or (wide + right > MAX_GRID).any():
        raise ValueError(f"a grid is rectangular and lies within {MAX_GRID} x {MAX_GRID}")
    out = np.full((len(at), MAX_GRID, MAX_GRID), PAD_ID, np.int32)
    row, place = _spread(high * wide)
    out[row, down[row] + place // wide[row], right[row] + place % wide[row]] = rows.flatten().to_numpy(zero_copy_only=False) + DIGIT_OFFSET
    # end marks: below the grid and right of it, where the canvas goes on
    row, place = _spread(np.where(high + down < MAX_GRID, wide, 0))
    out[row, down[row] + high[row], right[row] + place] = EOS_ID
    row, place = _spread(np.where(wide + right < MAX_GRID, high, 0))
    out[row, down[row] + place, right[row] + wide[row]] = EOS_ID
    images = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SEQ_CELLS, pa.int32()), pa.array(out.reshape(-1)))
    return _back(images, at, len(grid))


def decoded(df: DataFrame, keep: list[str], images: dict[str, str], grids: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and, for each (name, image column) of ``images``, the hash of the grid that the augmented image
    shows as ``{name}_hash``, and the grid as ``{name}_grid`` for the names in ``grids``. ``df`` has ``tid`` and ``perm``.

    A map over batches, not a Column function: Spark would copy that into the filters that it infers for
    joins on hashes, and decode every image again there.
    """
    rows = df.select(*keep, "tid", "perm", *images.values())
    schema = df.select(*keep).schema
    for name in images:
        schema = schema.add(f"{name}_hash", StringType())
        if name in grids:
            schema = schema.add(f"{name}_grid", ArrayType(ArrayType(IntegerType())))
    n, names = len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = batch.columns[:n]
            for k, name in enumerate(images):
                digest, grid = decoded_batch(batch.column(n + 2 + k), batch.column(n), batch.column(n + 1), name in grids)
                out += [digest] if grid is None else [digest, grid]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, schema)


def serialised(df: DataFrame, keep: list[str], grids: dict[str, str], pad_r: str, pad_c: str) -> DataFrame:
    """Columns ``keep`` and, for each (name, grid column) of ``grids``, its 30 x 30 token image at the offset (G8) as ``name``."""
    rows = df.select(*keep, pad_r, pad_c, *grids.values())
    schema = df.select(*keep).schema
    for name in grids:
        schema = schema.add(name, ArrayType(IntegerType()))
    n, names = len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            images = [serialised_batch(batch.column(n + 2 + k), batch.column(n), batch.column(n + 1)) for k in range(len(grids))]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + images, names=names)

    return rows.mapInArrow(run, schema)
