"""Words of Arrow text columns as codes and 64-bit hashes, batch by batch, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a shingle, and odd multipliers that tell their places apart.
SHINGLE = 5
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most_bytes``; a row stays whole. After each, memory that Arrow no longer needs goes back."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
            pa.default_memory_pool().release_unused()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for every word, the distinct words that codes point to, and how many words each text has. Null counts as empty."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each of some strings, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.empty(0, np.uint64)


def shingle_hashes(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``n`` words, by the words' hashes, at every place where one begins."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += h[k : k + size] * PLACES[k]
    return mixed(out)


def text_shingles(h: np.ndarray) -> np.ndarray:
    """Shingles of one text; one with fewer words than a shingle is a shingle itself, one without words has none."""
    return shingle_hashes(h, min(SHINGLE, len(h))) if len(h) else np.empty(0, np.uint64)
