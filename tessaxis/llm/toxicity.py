"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its lower-cased words and their beginnings of 3 to 6 characters (for inflected forms), each hashed to 32
bits. The model is fitted on a bounded sample of labelled rows: at most SAMPLE_ROWS, chosen by a hash of their ids. Only
terms that go with the label in the sample (a z-score of Z_LEAST or more) get parameters: a weight and a factor vector,
whose products learn pairs that an additive model misses. The score is the sigmoid of bias + weights + pair products.

At most TERMS_MOST terms get parameters, those of the highest z-scores; of rows with one key the greatest text and label
are learned from. Scoring sends the texts alone to Python and only scores back; texts become Python strings in slices of
Arrow batches, by bytes, so that few do at a time.

Null and empty texts have no terms and get the bias's score. Without labelled rows of both kinds every score is 0. Keys
may be of any type; rows with null keys are scored but not learned from. An output column replaces a column of its name.
Labels, lang, source and doc_id are no inputs of a score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.llm.common import in_slices

SAMPLE_ROWS, Z_LEAST, TERMS_MOST = 12_000, 5.0, 50_000
FACTORS, EPOCHS, RATE, DECAY = 8, 12, 0.1, 1e-4
MEMO_ENTRIES = 30_000
_WORD = re.compile(r"\w+")


def word_terms(word: str) -> tuple[int, ...]:
    """The hashed terms of one lower-cased word."""
    of = lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass"))
    return (of("=" + word), *(of("^" + word[:n]) for n in range(3, 7) if len(word) >= n))


def terms(text: str | None) -> set[int]:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(word_terms(word))
    return found


class FactorizationMachine:
    """index: hashed term -> row of w and v."""

    def __init__(self, index: dict[int, int], bias: float, w: np.ndarray, v: np.ndarray):
        self.index, self.bias, self.w, self.v, self._memo = index, bias, w, v, {}

    def score_rows(self, rows: np.ndarray) -> float:
        s = self.bias
        if len(rows):
            v = self.v[rows]
            s += float(self.w[rows].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))

    def score(self, text: str | None) -> float:
        rows: set[int] = set()
        memo, get = self._memo, self.index.get
        for word in set(_WORD.findall((text or "").lower())):
            found = memo.get(word)
            if found is None:
                found = tuple(r for t in word_terms(word) if (r := get(t)) is not None)
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                memo[word] = found
            rows.update(found)
        return self.score_rows(np.fromiter(sorted(rows), np.int64, len(rows)))


def select_terms(positive: Counter, negative: Counter, n_pos: int, n_neg: int) -> list[int]:
    """Terms whose share among positive rows differs from that among negative ones, strongest first."""
    found = []
    for t in positive.keys() | negative.keys():
        a, b = positive[t], negative[t]
        if a + b >= 5:
            p = (a + b) / (n_pos + n_neg)
            z = (a / n_pos - b / n_neg) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n_pos + 1 / n_neg))
            if abs(z) >= Z_LEAST:
                found.append((-abs(z), t))
    return [t for _, t in sorted(found)[:TERMS_MOST]]


def train(rows: list[np.ndarray], labels: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by stochastic gradients with per-parameter rates (AdaGrad), in a fixed order of rows."""
    rng = np.random.default_rng(0)
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS))
    gw, gv, gb = np.full(n_terms, 1e-2), np.full((n_terms, FACTORS), 1e-2), 1e-2
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            s = bias
            if len(x):
                vx = v[x]
                total = vx.sum(0)
                s += w[x].sum() + 0.5 * ((total**2).sum() - (vx**2).sum())
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - labels[i]
            gb += g * g
            bias -= RATE * g / math.sqrt(gb)
            if len(x):
                dw, dv = g + DECAY * w[x], g * (total - vx) + DECAY * vx
                gw[x] += dw * dw
                gv[x] += dv * dv
                w[x] -= RATE * dw / np.sqrt(gw[x])
                v[x] = vx - RATE * dv / np.sqrt(gv[x])
    return bias, w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> FactorizationMachine | None:
    """A model from at most `sample` labelled rows; the labels given are all that may be learned from."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "_y").agg(F.max(text).alias("_t")).select(F.col(key).cast("string").alias("k"), F.col("_y").alias("y"), F.col("_t").alias("x"))

    def hashed(batches):
        for batch in in_slices(batches, "x"):
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([sorted(terms(t.as_py())) for t in batch.column("x")], pa.list_(pa.int64()))], ["k", "y", "x"])

    def learn(batches):
        found = sorted((r for pdf in batches for r in zip(pdf["k"], pdf["y"], (x.astype(np.uint32) for x in pdf["x"]), strict=True)), key=lambda r: r[0])
        count = {0: Counter(), 1: Counter()}
        for _, y, x in found:
            count[int(y > 0)].update(x.tolist())
        labels_ = np.array([int(y > 0) for _, y, _ in found])
        if 0 < labels_.sum() < len(labels_):
            kept = select_terms(count[1], count[0], int(labels_.sum()), int((1 - labels_).sum()))
            index = {t: i for i, t in enumerate(kept)}
            del count
            bias, w, v = train([np.array(sorted(index[t] for t in x.tolist() if t in index), np.int64) for _, _, x in found], labels_, len(kept))
            yield pd.DataFrame({"t": [-1, *kept], "w": [bias, *w], "v": [np.zeros(FACTORS), *v]})

    # one task learns: its input is the bounded sample
    model = rows.mapInArrow(hashed, "k string, y int, x array<long>").repartition(1).mapInPandas(learn, "t long, w double, v array<double>").collect()
    if not model:
        return None
    terms_ = [r for r in model if r["t"] >= 0]
    return FactorizationMachine({r["t"]: i for i, r in enumerate(terms_)}, next(r["w"] for r in model if r["t"] < 0), np.array([r["w"] for r in terms_]), np.array([r["v"] for r in terms_]).reshape(-1, FACTORS))


def score(docs: DataFrame, model: FactorizationMachine | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's score."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.bias, model.w, model.v))

    @F.arrow_udf("double")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = FactorizationMachine(*sent.value)
        for texts in values:
            slices = in_slices([pa.RecordBatch.from_arrays([texts], ["x"])], "x")
            yield pa.array([machine.score(x.as_py()) for part in slices for x in part.column("x")], pa.float64())

    return docs.withColumn(out, run(F.col(text)))
