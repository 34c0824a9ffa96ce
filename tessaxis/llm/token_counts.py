"""Edit-aware token counts: a segment tree of token counts over the pre-token parts of each document.

The leaves are parts of a text cut at places that no pre-token crosses (see bpe_codec); the inner nodes hold sums. An
edit re-encodes only the leaves that it touches and one leaf of context at each side, whose far ends stay safe cuts
because nothing near them changed; then the sums on the paths to the root are renewed.

Edits are applied in order, each to the text that the ones before it left; positions are in code points and are held
to the text's ends. Null texts count as empty, null edits as none. Repeated rows are counted one by one.
"""

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessaxis.llm.bpe_codec import Codec, codec, safe_parts

LEAF_CHARS = 400

EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())]))


class CountTree:
    """The token counts of one text under edits."""

    def __init__(self, text: str, tokens: Codec):
        self.tokens, self.parts, self.encoded_chars = tokens, safe_parts(text, LEAF_CHARS), len(text)
        self.size = 1 << (len(self.parts) - 1).bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.chars = np.zeros(2 * self.size, np.int64)
        for i, part in enumerate(self.parts):
            self.count[self.size + i], self.chars[self.size + i] = len(tokens.encode(part)), len(part)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.count[i] = self.count[2 * i] + self.count[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return int(self.count[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a position, and the position in it; the end belongs to the last leaf."""
        i = 1
        if at >= self.chars[1]:
            return len(self.parts) - 1, len(self.parts[-1]) + int(at - self.chars[1])
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, int(at)

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace length characters from start by the text."""
        start = min(max(start, 0), int(self.chars[1]))
        length = min(max(length, 0), int(self.chars[1]) - start)
        (first, offset), (last, _) = self._leaf(start), self._leaf(start + max(length - 1, 0))
        left, right = first - 1, last + 1
        while left >= 0 and not self.parts[left]:  # leaves that earlier edits emptied are no context
            left -= 1
        while right < len(self.parts) and not self.parts[right]:
            right += 1
        left, right = max(left, 0), min(right, len(self.parts) - 1)
        at = offset + sum(len(x) for x in self.parts[left:first])
        old = "".join(self.parts[left : right + 1])
        new = old[:at] + text + old[at + length :]
        self.encoded_chars += len(new)
        width = max(LEAF_CHARS, -(-len(new) // (right - left + 1)))
        fresh = safe_parts(new, width)
        for i in range(left, right + 1):
            self.parts[i] = fresh[i - left] if i - left < len(fresh) else ""
            self.count[self.size + i], self.chars[self.size + i] = len(self.tokens.encode(self.parts[i])), len(self.parts[i])
        nodes = range((self.size + left) // 2, (self.size + right) // 2 + 1)
        while nodes and nodes[0]:
            for i in nodes:
                self._sum(i)
            nodes = range(nodes[0] // 2, nodes[-1] // 2 + 1)


def count_with_edits(df: DataFrame, rank_path: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """df with n_tokens (before), n_tokens_after, encoded_chars (by all encoding), edit_chars (by the edits alone) and edited_text."""
    new = {"n_tokens": T.LongType(), "n_tokens_after": T.LongType(), "encoded_chars": T.LongType(), "edit_chars": T.LongType(), "edited_text": T.StringType()}
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(k, v) for k, v in new.items()])

    def one(value, changes, c):
        tree = CountTree(value or "", c)
        before, chars = tree.total, tree.encoded_chars
        for e in changes if changes is not None else []:
            tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
        return before, tree.total, tree.encoded_chars, tree.encoded_chars - chars, "".join(tree.parts)

    def run(batches):
        c = codec(rank_path, pattern)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500].copy()
                found = [one(x, e, c) for x, e in zip(part[text], part[edits], strict=True)]
                for k, values in zip(new, zip(*found, strict=True), strict=True):
                    part[k] = pd.Series(values, index=part.index, dtype=object if k == "edited_text" else "int64")
                yield part[schema.names]

    return df.mapInPandas(run, schema)
