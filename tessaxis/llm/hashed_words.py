"""Words of Arrow columns as 64-bit hashes, without making a Python object of each."""

import numpy as np
import pyarrow as pa

from tessaxis.llm.shingles import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: A random-looking odd weight for each byte, after lower-casing A-Z; white space weighs nothing.
_WEIGHT = np.where(_IS_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1))[_LOWER]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words between ASCII white space of all texts, one after another, and the number of each text's words.

    A word's hash is a polynomial of its bytes' weights and its length, mixed. Null texts have no words.
    """
    values = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(values) else np.array([], np.uint8)
    bounds = bounds - bounds[0] if len(values) else np.zeros(1, np.int64)
    inside = ~_IS_SPACE[data]
    before = np.r_[False, inside[:-1]] if len(data) else inside.copy()
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.array([], np.uint64), counts
    spans = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
    powers = np.cumprod(np.full(int(spans.max()), _BASE, np.uint64), dtype=np.uint64)
    weights = _WEIGHT[data[starts[0] :]] * powers[place]
    return mix(np.add.reduceat(weights, starts - starts[0])), counts


def hash_of(word: bytes) -> int:
    """The hash of one word, as a signed number."""
    return int(hashed_words(pa.array([word.decode("utf-8", "surrogatepass")]))[0].view(np.int64)[0])
