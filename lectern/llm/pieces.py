"""Token ids of whole texts from a table of pieces between spaces: a worker encodes each frequent piece once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces that a table holds at most.
HELD_BYTES = 1 << 28


class PieceTable:
    """Pieces with their ids in a flat table; ``encode`` gives (ids of all, number of each one's) for new pieces.

    Pieces stay in Arrow, which looks up those of a whole batch at once. At ``limit`` pieces only the first half stays: pieces come roughly
    by frequency, so those are the common ones. Memory is bounded whatever the vocabulary.
    """

    def __init__(self, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.pieces = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    def _shrink(self) -> None:
        kept = self.limit // 2 if self.pieces.nbytes <= HELD_BYTES else 0
        self.pieces = self.pieces.take(pa.array(np.arange(kept)))
        self.flat = self.flat[: self.starts[kept]].copy()
        self.starts, self.sizes = self.starts[:kept].copy(), self.sizes[:kept].copy()

    def find(self, pieces: pa.StringArray) -> np.ndarray:
        """Rows of the pieces, -1 for those that are not in the table."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def lookup(self, lists: pa.ListArray, mark: str = "") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, number of ids of each text); a text is a list of its pieces.

        A batch's distinct pieces are found by Arrow, and only they are looked up. With ``mark`` the first piece of each
        text is another one than the same piece elsewhere: it has the mark before it.
        """
        if len(self) > self.limit or self.pieces.nbytes > HELD_BYTES:
            self._shrink()
        bounds, pieces = np.asarray(lists.offsets), lists.flatten()
        if mark:
            first = np.zeros(len(pieces), bool)
            first[bounds[:-1][np.diff(bounds) > 0] - bounds[0]] = True
            pieces = pc.binary_join_element_wise(pc.if_else(pa.array(first), mark, ""), pieces, "")
        coded = pieces.dictionary_encode()
        found = self.find(coded.dictionary)
        new = found < 0
        if new.any():
            fresh = coded.dictionary.filter(pa.array(new))
            flat, sizes = self.encode(fresh)
            found[new] = len(self) + np.arange(len(fresh))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        rows = found[np.asarray(coded.indices)]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[ranges(self.starts[rows], sizes)], np.diff(np.concatenate([[0], ends])[bounds - bounds[0]])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start, as many as its size, one behind the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes
