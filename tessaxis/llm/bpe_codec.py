"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is cut before a white-space run that follows another character. No match of the split pattern crosses such
a place: its alternatives hold white space only at their start, and its one look-ahead looks at the character after a
white-space run, which lies in the same part. So the parts can be encoded one by one, however long the text is.

Null and empty texts give no ids and decode to no bytes. Rows, their order in a partition and all other columns pass
through; an output column replaces an input column of its name.
"""

import base64
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessaxis.llm.common import in_slices, put, with_field

#: The characters with the Unicode property White_Space.
WHITE_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A place where a text can be cut: between another character and white space.
SAFE = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")

PART_CHARS = 1 << 16
_codecs: dict = {}


class Codec:
    """Encoder and decoder of one rank file; one per Python worker, see codec()."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._pattern = pattern
        self.bytes_of = [b""] * (max(self._ranks.values()) + 1)
        for token, rank in self._ranks.items():
            self.bytes_of[rank] = token

    @cached_property
    def encoding(self):
        """The library's encoder; decoding does without it."""
        import tiktoken

        return tiktoken.Encoding("local", pat_str=self._pattern, mergeable_ranks=self._ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, without special tokens, as the library's encode_ordinary gives them."""
        parts = [self.encoding.encode_to_numpy(x, disallowed_special=()) for x in safe_parts(text or "", PART_CHARS)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.array([], np.uint32), *parts])

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


def safe_parts(text: str, least: int) -> list[str]:
    """The text in parts of at least that many characters, but for the last, cut only at safe places."""
    parts, start = [], 0
    while len(text) - start > least and (m := SAFE.search(text, start + least)):
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def codec(rank_path: str, pattern: str) -> Codec:
    if (rank_path, pattern) not in _codecs:
        _codecs[rank_path, pattern] = Codec(rank_path, pattern)
    return _codecs[rank_path, pattern]


def id_list(ids: pa.ListScalar) -> list[int]:
    return ids.values.to_numpy().tolist() if ids.is_valid else []


def encoded_batches(batches, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids"):
    """Arrow batches with the token ids of their texts."""
    c = codec(rank_path, pattern)
    for batch in in_slices(batches, text):
        lists = [c.encode(x.as_py()).astype(np.int32) for x in batch.column(text)]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        yield put(batch, ids, pa.ListArray.from_arrays(ends, np.concatenate([np.array([], np.int32), *lists])))


def decoded_batches(batches, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded"):
    """Arrow batches with the bytes that their token ids stand for."""
    c = codec(rank_path, pattern)
    for batch in in_slices(batches, ids):
        yield put(batch, out, pa.array([c.decode(id_list(x)) for x in batch.column(ids)], pa.binary()))


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with an array<int> column of the text's token ids, as the library's encode_ordinary gives them."""
    return df.mapInArrow(lambda batches: encoded_batches(batches, rank_path, pattern, text, ids), with_field(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; the bytes need not be valid UTF-8."""
    return df.mapInArrow(lambda batches: decoded_batches(batches, rank_path, pattern, ids, decoded), with_field(df, decoded, T.BinaryType()))
