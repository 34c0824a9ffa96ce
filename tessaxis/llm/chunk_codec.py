"""Token ids of whole batches of texts by a tokenizer file; each distinct chunk of a text is encoded once.

A text is cut before ASCII white space that follows another character. The pre-tokenizer of byte-level BPE takes white
space only at the start of a match and looks ahead only to the character after a white-space run, so no match crosses such
a cut, and the ids of the text are those of its chunks one after the other. Chunks of a batch are told apart by Arrow's
dictionary encoding; the ids of those met before come from a memory of bounded size, the others are encoded together.
The tokenizer's special tokens have their own ids, as in its encode().
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks whose ids a Python worker remembers; beyond that the memory starts anew.
MEMORY = 1 << 20
#: Chunks that are encoded as one text.
JOINED = 2000
#: Bytes of text to encode at once.
TOGETHER = 16 << 20
_codecs: dict = {}


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places where chunks of UTF-8 bytes begin: the starts of texts and the safe cuts inside them."""
    white = ((data >= 9) & (data <= 13)) | (data == 32)
    # another character before: no ASCII control or space, nor a character whose last bytes may be those of Unicode white space
    before = np.zeros((3, len(data)), np.uint8)
    for i in range(3):
        before[i, i + 1 :] = data[: len(data) - i - 1]
    one, two, three = before
    odd = (one <= 32) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81) | (two == 0xA0)))
    begins = white & ~odd
    begins[starts] = True
    return np.flatnonzero(begins)


class ChunkCodec:
    """One per Python worker and tokenizer file, see chunk_codec()."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = {i: x.content for i, x in self._tokenizer.get_added_tokens_decoder().items()}
        tokens = self._tokenizer.get_vocab().items()
        #: Bytes that each id stands for: a byte-level token has a character for each.
        self._sizes = np.zeros(max(i for _, i in tokens) + 1, np.int64)
        for token, i in tokens:
            self._sizes[i] = len(token.encode()) if i in special else len(token)
        self._forget()

    def _forget(self) -> None:
        self._chunks = pa.array([], pa.large_binary())
        self._ids, self._ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encode chunks that are new and remember them; their order in the memory.

        Those from white space to another character are encoded as one text, as no match crosses their borders.
        """
        whole = lambda x: x[0] <= 32 and (33 <= x[-1] <= 126 or x[-1] >= 128 and not x.decode()[-1].isspace())
        joined = [i for i, x in enumerate(chunks) if whole(x)]
        alone = sorted({*range(len(chunks))} - {*joined})
        ids, n = [self._ids], [np.zeros(0, np.int64)]
        for at in range(0, len(joined), JOINED):
            part = [chunks[i] for i in joined[at : at + JOINED]]
            ids.append(np.array(self._tokenizer.encode(b"".join(part).decode(), add_special_tokens=False).ids, self.dtype))
            n.append(np.diff(np.searchsorted(np.cumsum(self._sizes[ids[-1]]), np.cumsum([len(x) for x in part])) + 1, prepend=0))
        for i in alone:
            ids.append(np.array(self._tokenizer.encode(chunks[i].decode(), add_special_tokens=False).ids, self.dtype))
            n.append(np.array([len(ids[-1])]))
        order = np.array([*joined, *alone], np.int64)
        self._ids = np.concatenate(ids)
        self._ends = np.append(self._ends, self._ends[-1] + np.cumsum(np.concatenate(n)))
        return order

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (string array, nulls count as empty), and the number of ids of each."""
        binary = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(binary) else np.zeros(0, np.uint8)
        starts = (offsets - offsets[0])[:-1] if len(binary) else np.zeros(0, np.int64)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        own = starts[starts < np.append(starts[1:], len(data))]  # of texts that are not empty
        cuts = _cuts(data, own).astype(np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = chunks.dictionary
        if len(self._chunks) + len(distinct) > MEMORY:
            self._forget()
        known = pc.index_in(distinct, value_set=self._chunks)
        new, place = known.is_null(), pc.fill_null(known, 0).to_numpy().astype(np.int64)
        fresh = distinct.filter(new)
        order = self._learn(fresh.to_pylist())
        place[np.flatnonzero(new.to_numpy(zero_copy_only=False))[order]] = len(self._chunks) + np.arange(len(order))
        self._chunks = pa.concat_arrays([self._chunks, fresh.take(pa.array(order))])
        place = place[chunks.indices.to_numpy()]
        first, n = self._ends[place], self._ends[place + 1] - self._ends[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(cuts, np.append(starts, len(data)))]
        return ids, np.diff(bounds)


def chunk_codec(tokenizer_path: str) -> ChunkCodec:
    if tokenizer_path not in _codecs:
        _codecs[tokenizer_path] = ChunkCodec(tokenizer_path)
    return _codecs[tokenizer_path]
