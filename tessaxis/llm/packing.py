"""Packing of documents into sequences by non-negative least squares over a histogram of lengths.

A document is its token ids and one end id. As many whole windows as it fills are sequences of their own; what is left,
shorter than a window, is packed. The histogram of these lengths, at most one count for each length below the window
however large the corpus, is all that the plan depends on:

1. Enumerate shallow combinations: all pairs and triples of lengths present that fill the window exactly.
2. Solve min |A x - histogram| over x >= 0, where a column of A counts the lengths of a combination; an active set keeps
   the solution at no more combinations than there are lengths. Round x to whole repeats, held to what is there.
3. Pack what remains greedily: the longest length that fits, again and again; a gap that no length fits is filled by
   cutting the longest. The last sequence, if not full, is laid out in sequences of a power of two, which need no padding.

The plan's runs name documents by length and rank among those of their length. Ranks are local counts that the tokenizing
tasks keep, plus the counts of the tasks before, so no length, however frequent, is gathered anywhere. The plan has some
thousand runs, bounded by the window and not by the corpus, and goes to all tasks; the table of counts is broadcast only
up to COUNTS_MOST rows, beyond that slim rows are joined by shuffles.

Null texts count as empty: the end id alone. Each row is a document of its own, null and repeated keys included. Other
columns are not passed on. Long texts are cut like others; a document must fit a task.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.llm.chunk_codec import TOGETHER, chunk_codec
from tessaxis.llm.common import in_slices, written

WINDOW = 2048
#: Rows of the table of counts, of some 24 bytes each, that are sent to all tasks.
COUNTS_MOST = 500_000
#: Rounds of the solver; it stops earlier when a round gains less than this part of the squared error.
ROUNDS, GAIN = 200, 1e-3


# the plan


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three indices into the sorted lengths: those that add up to the window; the third of a pair is len(lengths)."""
    index = np.full(window + 1, -1, np.int64)
    index[lengths] = np.arange(len(lengths))
    out = []
    rest = window - lengths
    pair = (lengths <= rest) & (index[rest] >= 0)
    out.append(np.column_stack([np.flatnonzero(pair), index[rest[pair]], np.full(pair.sum(), len(lengths))]))
    for i, a in enumerate(lengths):
        if 3 * a > window:
            break
        b = lengths[i:]
        c = window - a - b
        good = (c >= b) & (index[np.maximum(c, 0)] >= 0)
        out.append(np.column_stack([np.full(good.sum(), i), i + np.flatnonzero(good), index[c[good]]]))
    return np.concatenate(out)


def _least_squares(columns: np.ndarray, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x that brings the columns closest to the target, by conjugate gradients on the sparse columns."""
    m = len(target)
    times = lambda x: np.bincount(columns.ravel(), np.repeat(x, 3), m + 1)[:m]
    back = lambda r: np.append(r, 0.0)[columns].sum(1)
    x = start.copy()
    r = target - times(x)
    p = g = back(r)
    norm = first = g @ g
    for _ in range(300):
        if norm <= 1e-12 * max(first, 1.0):
            break
        q = times(p)
        step = norm / (q @ q)
        x += step * p
        r -= step * q
        g = back(r)
        norm, last = g @ g, norm
        p = g + norm / last * p
    return x


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Active columns and their positive weights.

    Each round activates columns with the steepest descent that have no length in common, solves over the active columns,
    and takes out those whose weight is not positive, until a round gains next to nothing.
    """
    m = len(target)
    active, x = np.zeros(0, np.int64), np.zeros(0)
    best = (float(target @ target), active, x)
    weight = 1 / np.sqrt((columns < m).sum(1))
    for _ in range(ROUNDS):
        residual = target - np.bincount(columns[active].ravel(), np.repeat(x, 3), m + 1)[:m]
        slope = np.append(residual, 0.0)[columns].sum(1) * weight
        slope[active] = 0
        steep = np.flatnonzero(slope > 1e-6 * max(target.max(), 1.0))
        if len(steep) > 20_000:
            steep = steep[np.argpartition(-slope[steep], 20_000)[:20_000]]
        free, chosen = np.ones(m + 1, bool), []
        for j in steep[np.argsort(-slope[steep], kind="stable")]:
            a, b, c = columns[j]
            if free[a] and free[b] and free[c]:
                chosen.append(j)
                free[a] = free[b] = free[c] = False
                free[m] = True
        if not chosen:
            break
        active, x = np.append(active, chosen), np.append(x, np.zeros(len(chosen)))
        while len(active):
            x = _least_squares(columns[active], target, x)
            if (x > 1e-9).all():
                break
            active, x = active[x > 1e-9], x[x > 1e-9]
        left = target - np.bincount(columns[active].ravel(), np.repeat(x, 3), m + 1)[:m]
        error = float(left @ left)
        if error >= best[0]:
            break
        done = best[0] - error < GAIN * best[0]
        best = (error, active, x)
        if done:
            break
    return best[1], best[2]


class Plan:
    """Runs of documents: (length, first rank, how many, start, piece length, first sequence, offset); the i-th of a run goes to the i-th sequence from the first."""

    def __init__(self, histogram: np.ndarray, window: int, first_sequence: int = 0):
        """histogram[n]: documents with n ids left, 0 < n < window."""
        self.window, self.next, self.runs = window, first_sequence, []
        self.by_squares = 0  # sequences from the solution
        used = np.zeros(window, np.int64)
        lengths = np.flatnonzero(histogram[:window])
        if len(lengths):
            self._repeat(histogram, lengths, used)
        self._greedy(histogram, used)

    def _repeat(self, histogram: np.ndarray, lengths: np.ndarray, used: np.ndarray) -> None:
        columns = combinations(lengths, self.window)
        active, x = non_negative_least_squares(columns, histogram[lengths].astype(float))
        for j, repeats in sorted(zip(active.tolist(), np.floor(x + 0.5).astype(int).tolist(), strict=True), key=lambda r: (-r[1], r[0])):
            parts = [int(lengths[i]) for i in columns[j] if i < len(lengths)]
            n = min(repeats, *(int(histogram[a] - used[a]) // parts.count(a) for a in parts))
            if n > 0:
                offset = 0
                for a in parts:
                    self.runs.append((a, int(used[a]), n, 0, a, self.next, offset))
                    used[a] += n
                    offset += a
                self.next += n
                self.by_squares += n

    def _greedy(self, histogram: np.ndarray, used: np.ndarray) -> None:
        """Rows of stock[n]: [length, first rank, how many, start] of pieces with n ids left."""
        stock: list[list] = [[] for _ in range(self.window)]
        there = np.zeros(self.window, bool)
        for n in np.flatnonzero(histogram[: self.window] - used):
            stock[n].append([int(n), int(used[n]), int(histogram[n] - used[n]), 0])
            there[n] = True
        while there.any():
            taken: dict[tuple[int, int], int] = {}  # (length left, place in its stock): how many a sequence takes
            parts, gap = [], self.window
            while gap and there.any():
                fits = np.flatnonzero(there[: gap + 1])
                n = int(fits[-1]) if len(fits) else int(np.flatnonzero(there)[-1])
                place = next(i for i, row in enumerate(stock[n]) if row[2] > taken.get((n, i), 0))
                parts.append((n, place, taken.get((n, place), 0), min(n, gap)))
                taken[n, place] = taken.get((n, place), 0) + 1
                there[n] = any(row[2] > taken.get((n, i), 0) for i, row in enumerate(stock[n]))
                gap -= min(n, gap)
            times = min(stock[n][i][2] // k for (n, i), k in taken.items())
            if gap:
                self._tail([(*stock[n][i][:2], k, stock[n][i][3], size) for n, i, k, size in parts])
                return
            offset, cut = 0, []
            for n, i, k, size in parts:
                length, rank, _, start = stock[n][i]
                self.runs.append((length, rank + k * times, times, start, size, self.next, offset))
                offset += size
                if size < n:
                    cut.append((n - size, [length, rank + k * times, times, start + size]))
            for (n, i), k in taken.items():
                stock[n][i][1] += k * times
                stock[n][i][2] -= k * times
            for n, row in cut:
                stock[n].append(row)
            for n in {*(n for n, _ in taken), *(n for n, _ in cut)}:
                stock[n] = [row for row in stock[n] if row[2]]
                there[n] = bool(stock[n])
            self.next += times

    def _tail(self, pieces: list[tuple[int, int, int, int, int]]) -> None:
        """The last pieces (length, rank, place among the ranks, start, size), one document each, in sequences of powers of two."""
        room, offset = 0, 0
        left = sum(p[4] for p in pieces)
        for length, rank, k, start, size in pieces:
            while size:
                if offset == room:
                    self.next += room > 0
                    room, offset = 1 << (left.bit_length() - 1), 0
                n = min(size, room - offset)
                self.runs.append((length, rank + k, 1, start, n, self.next, offset))
                offset, start, size, left = offset + n, start + n, size - n, left - n
        self.next += 1

    def lookup(self) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
        """(length, start): first ranks in order, sizes, first sequences and offsets."""
        found: dict = {}
        for length, rank, _, start, size, sequence, offset in sorted(self.runs, key=lambda r: r[1]):
            found.setdefault((length, start), []).append((rank, size, sequence, offset))
        return {k: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for k, rows in found.items()}


# the tables


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int, window: int, key: str, text: str) -> DataFrame:
    """A table: key, n (ids with the end id), ids (little-endian), _part, _rank among those of the part with as many ids left, _full: windows filled by those before."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string("n long, ids binary, _part long, _rank long, _full long").fields])

    def run(batches):
        codec, part = chunk_codec(tokenizer_path), TaskContext.get().partitionId()
        ranks, full = np.zeros(window, np.int64), 0
        end = np.array([end_id], codec.dtype).tobytes()

        def made(waiting):
            nonlocal full
            keys, texts = (pa.concat_arrays([b.column(i) for b in waiting]) for i in (0, 1))
            ids, counts = codec.encode(texts)
            data, ends = ids.tobytes(), np.cumsum(counts) * codec.dtype.itemsize
            rows, n = [data[e - c * codec.dtype.itemsize : e] + end for e, c in zip(ends, counts.tolist(), strict=True)], counts + 1
            own, fulls = np.empty(len(n), np.int64), full + np.cumsum(n // window) - n // window
            for i, r in enumerate((n % window).tolist()):
                own[i] = ranks[r]
                ranks[r] += 1
            full += int((n // window).sum())
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(rows, pa.binary()), pa.array(np.full(len(n), part)), pa.array(own), pa.array(fulls)], schema.names)

        waiting, size = [], 0
        for batch in in_slices(batches, "text", TOGETHER):
            waiting.append(batch)
            size += batch.nbytes
            if size >= TOGETHER:
                yield made(waiting)
                waiting, size = [], 0
        if waiting:
            yield made(waiting)

    return written(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema))


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids (binary of little-endian unsigned 32-bit ids)."""
    docs = tokenized(df, tokenizer_path, end_id, window, key, text)
    left = (F.col("n") % window).alias("left")
    # a full window counts as one of length `window`, what is left by its length
    each = docs.groupBy("_part", left).agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {window}")).alias("full"))
    kinds = F.explode(F.array(F.struct("left", F.col("docs").alias("c")), F.struct(F.lit(window).cast("long").alias("left"), F.col("full").alias("c")))).alias("k")
    counts = written(each.select("_part", kinds).select("_part", "k.*").groupBy("_part", "left").agg(F.sum("c").alias("c")).where("c > 0"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("left").agg(F.sum("c").alias("c")).collect():  # at most window + 1 rows
        histogram[r["left"]] = r["c"]
    plan = Plan(np.append(0, histogram[1:window]), window, int(histogram[window]))

    before = Window.partitionBy("left").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select("_part", "left", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first")))
    small = firsts.count() <= COUNTS_MOST
    sent = F.broadcast if small else lambda x: x
    rows = (docs if small else docs.drop("ids")).withColumn("left", left)
    rows = rows.join(sent(firsts), ["_part", "left"], "left").withColumnRenamed("first", "_first")
    rows = rows.join(sent(firsts.where(F.col("left") == window).select("_part", F.col("first").alias("_filled"))), "_part", "left")
    if not small:
        rows = rows.join(docs.select("_part", left, "_rank", "ids"), ["_part", "left", "_rank"])
    return _pieces(rows.select("key", "n", "ids", F.coalesce(F.col("_first") + F.col("_rank"), F.lit(0)).alias("rank"), F.coalesce(F.col("_filled") + F.col("_full"), F.lit(0)).alias("filled")), plan, key, tokenizer_path)


def _pieces(rows: DataFrame, plan: Plan, key: str, tokenizer_path: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *T._parse_datatype_string("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").fields])
    window, runs = plan.window, plan.lookup()

    def run(batches):
        kind = chunk_codec(tokenizer_path).dtype
        for batch in in_slices(batches, "ids", 4 << 20):
            owner, made = [], []
            for i, (n, rank, filled, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "rank", "filled")), batch.column("ids"), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                cuts = [(w * window, window, filled + w, 0) for w in range(n // window)]
                start = 0
                while start < n % window:
                    firsts, sizes, sequences, offsets = runs[n % window, start]
                    j = int(np.searchsorted(firsts, rank, "right")) - 1
                    cuts.append((n - n % window + start, int(sizes[j]), int(sequences[j]) + rank - int(firsts[j]), int(offsets[j])))
                    start += cuts[-1][1]
                owner += [i] * len(cuts)
                made += [(a, size, n, s, o, ids[a : a + size].tobytes()) for a, size, s, o in cuts]
            columns = list(zip(*made, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)
