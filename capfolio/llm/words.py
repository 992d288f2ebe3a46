"""Words of many texts at once, as Arrow and numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from capfolio.llm.common import UPPER

CHUNK_BYTES = 4 << 20
LOWER = str.maketrans(UPPER, UPPER.lower())


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // most
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        yield batch.slice(start, end - start)


class Words:
    """The words (runs of characters that are no ASCII white space) of some texts.

    ``dictionary`` (Arrow) and ``unique`` (a list) are the distinct words, ``codes`` index them in text order, and text
    ``i`` has ``codes[starts[i]:starts[i + 1]]``. NULL texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.cumsum(filled)))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.starts = edges[offsets].astype(np.int64)
        encoded = (flat if filled.all() else flat.filter(pa.array(filled))).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.dictionary = encoded.dictionary
        if lower:  # of the distinct words only
            seen: dict[str, int] = {}
            again = [seen.setdefault(w.lower() if w.isascii() else w.translate(LOWER), len(seen)) for w in self.unique]
            self.codes = np.array(again, np.int64)[self.codes] if again else self.codes
            self.unique = list(seen)
            self.dictionary = pa.array(self.unique, self.dictionary.type)

    @cached_property
    def unique(self) -> list[str]:
        return self.dictionary.to_pylist()

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.unique), np.uint64, len(self.unique))
