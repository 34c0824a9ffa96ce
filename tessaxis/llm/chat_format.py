"""Chat formatting with an offset-aligned loss mask.

A whole conversation is rendered as one text, encoded once with character offsets, and the sorted spans of its turns are
intersected with the token spans by binary search. The marks of the template are special tokens of the encoder, so no
token straddles a mark, and each turn's text is covered by whole tokens.

Control strings inside roles and texts (the marks, and the tokenizer's own special tokens) get one more backslash after
their first character, which unescape() takes away again; so the marks found in an output are the template's.

Turns are ordered by turn (null first), then role and text. Null roles and texts count as empty; a null conv_id is a
conversation like any other; repeated rows stay repeated turns.
"""

import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """Each turn is: turn mark, role, text mark, text, end mark."""

    turn: str = "<turn>"
    text: str = "<text>"
    end: str = "</turn>"

    @property
    def marks(self) -> list[str]:
        return [self.turn, self.text, self.end]


class Renderer:
    """Renders and reads back conversations; controls are the strings that texts must not hold as they are."""

    def __init__(self, template: Template, controls: list[str]):
        self.template = template
        controls = sorted({*controls, *template.marks}, key=lambda c: (-len(c), c))
        either = lambda extra: re.compile("|".join(rf"{re.escape(c[0])}\\*{extra}{re.escape(c[1:])}" for c in controls))
        self._plain, self._escaped = either(""), either(r"\\")
        t = [re.escape(m) for m in template.marks]
        self._turns = re.compile(f"{t[0]}(.*?){t[1]}(.*?){t[2]}", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation, and the span of each turn's text in it."""
        t, out, spans, at = self.template, [], [], 0
        for role, text in turns:
            head, body = t.turn + self.escape(role) + t.text, self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, t.end]
            at = spans[-1][1] + len(t.end)
        return "".join(out), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        return [(self.unescape(a), self.unescape(b)) for a, b in self._turns.findall(formatted)]


def special_tokens(tokenizer_path: str) -> list[str]:
    """The special tokens that a tokenizer file names."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that overlaps one of the sorted spans. Tokens of one character may share its offsets."""
    mask = np.zeros(len(starts), np.int8)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = 1
    return mask


SCHEMA = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"


def format_conversations(df: DataFrame, tokenizer_path: str, template: Template = Template(), learn_role: str = "assistant") -> DataFrame:
    """One row per conv_id: the formatted text, its tokens with offsets, and the mask of the learned role's texts."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = T.StructType([chats.schema["conv_id"], *T._parse_datatype_string(SCHEMA).fields])

    def run(batches):
        from tokenizers import AddedToken, Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in template.marks])
        renderer = Renderer(template, special_tokens(tokenizer_path))
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                rows = []
                for conv, turns in zip(part["conv_id"], part["turns"], strict=True):
                    formatted, spans = renderer.render([(t["role"], t["text"]) for t in turns])
                    code = tok.encode(formatted, add_special_tokens=False)
                    offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                    learned = [s for s, t in zip(spans, turns, strict=True) if t["role"] == learn_role]
                    rows.append((conv, formatted, code.ids, offsets[:, 0], offsets[:, 1], token_mask(offsets[:, 0], offsets[:, 1], learned)))
                yield pd.DataFrame(rows, columns=schema.names)

    return chats.mapInPandas(run, schema)


def masked_spans(starts, ends, mask) -> list[tuple[int, int]]:
    """The character spans that runs of masked tokens cover."""
    spans: list[tuple[int, int]] = []
    for a, b, m, after in zip(starts, ends, mask, [0, *mask[:-1]], strict=True):
        if m and after:
            spans[-1] = (spans[-1][0], int(b))
        elif m:
            spans.append((int(a), int(b)))
    return spans
