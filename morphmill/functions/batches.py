"""Arrow batches in tasks: lengths of lists, and slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, or items of lists, that are worked on at once; a longer one is a slice of its own.
SLICE = 1 << 21


def lengths(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, texts or bytes, a null's is 0, and where each starts, and the last ends, in all of them."""
    size = pc.list_value_length if pa.types.is_list(rows.type) else pc.binary_length
    own = pc.fill_null(size(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return own, np.concatenate(([0], np.cumsum(own)))


def in_slices(rows: pa.Array, then: Callable[[pa.Array], pa.Array], most: int = SLICE) -> pa.Array:
    """``then`` of a batch, slice by slice, so that what it needs in between doesn't grow with the batch.

    A slice of texts, or of lists of texts, has so many bytes, one of other lists so many items.
    """
    ends, at, out = lengths(rows)[1], 0, []
    if pa.types.is_list(rows.type) and pa.types.is_string(rows.type.value_type):
        ends = lengths(rows.flatten())[1][ends]
    while at < len(rows) or not out:
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        out.append(then(rows.slice(at, last - at)))
        at = last
    return out[0] if len(out) == 1 else pa.concat_arrays(out)
