"""What kernels make of Arrow batches, and a way to hand batches on with what was computed from them."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa


def plain(column: pa.Array) -> list:
    """column.to_pylist(), by way of numpy where it can be: that makes a Python object for a value, not one for its wrapper too."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if pa.types.is_string(kind) and column.null_count == 0:
        codes = column.dictionary_encode()
        if 2 * len(codes.dictionary) > n:
            return column.to_pylist()
        words = codes.dictionary.to_pylist()
        return [words[i] for i in codes.indices.to_numpy().tolist()]
    if pa.types.is_list(kind) and column.null_count == 0:
        flat, ends = plain(column.flatten()), column.offsets.to_numpy().tolist()
        return [flat[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = plain(column.fill_null(pa.scalar(0, pa.int8()).cast(kind)))
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


def field(rows: pa.StructArray, name: str) -> list:
    """A field of rows as a list; of a ladder (`bids.quantity`) the lists of one field of its levels."""
    name, _, inner = name.partition(".")
    column = rows.field(name)
    if not inner:
        return plain(column)
    if column.null_count:
        return [None if levels is None else [None if x is None else x[inner] for x in levels] for levels in column.to_pylist()]
    levels = column.flatten()
    if levels.null_count:
        return [[None if x is None else x[inner] for x in levels_] for levels_ in column.to_pylist()]
    flat, ends = plain(levels.field(inner)), column.offsets.to_numpy().tolist()
    return [flat[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column as doubles, 0 where it is null, and where it isn't."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return (column if known.all() else column.fill_null(pa.scalar(0, pa.int8()).cast(column.type))).to_numpy(zero_copy_only=False).astype(float), known
