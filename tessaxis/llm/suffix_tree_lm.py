"""Language-model scores by a probabilistic suffix tree over words.

Tokens are ASCII-lower-cased words between ASCII white space, and one end per text. The model's alphabet are the end, all
words that came MIN_COUNT times or more, and one class of all other words, inside which a word has its share at the root.
The root has add-one shares of all words, with one unseen word.

The tree's states are contexts of up to MAX_DEPTH words of the alphabet. A symbol has 31 bits, so the key of all tables is
two numbers: the context's last two symbols, and the third one back with the next symbol. A context is a candidate if it
came MIN_COUNT times, however many tokens there are: what is learned from a corpus is not lost where it is part of a
larger one, and the tree grows with the input. A candidate's distribution: symbols that came a fifth as often or more after it have (n - DISCOUNT) / N, N being the
number of all its next symbols (Ney's absolute discount); the rest of the mass goes to all symbols by the distribution of
the context's longest suffix that is a state. It stays if its distribution diverges from the suffix's by
DIVERGENCE nats (Kullback-Leibler), and over all its tokens by GAIN nats, which a few chance pairs don't reach. A text is scored token by token from the longest suffix before it that is a state.

How it runs. Tasks hash words by arrays, once to count them and once to write texts as symbols, from which they count keys
per batch; packed batches are dealt out by a hash of the
context and summed. A context that over 1/HOT of the tokens follow is dealt out by context and symbol, so no task gets all
of its rows; only sums of such a context meet. Divergences are groups of a Spark join with the level above. Which contexts
are candidates is told to tasks by a bitmap of three bits a key: wrong bits cost a row, and the exact count follows.

A token's log probability is its share at the root, plus for each state that ends before it the log10 of the mass that the
state leaves to its suffix, plus, for symbols that the state keeps, a gain. So scoring sums table values over (row, key).
The alphabet's words (at most one in MIN_COUNT tokens; 0.24 % of the tokens of check_l, whose part falls as the input grows) and
the HEAD_MOST most frequent keys are sent to all tasks; others are joined, those of contexts and symbols after the bitmap has shown that they may exist.

Null texts count as empty: only the end. Without training tokens every token has probability 1. Repeated rows are scored
one by one, also those with null keys, which are no training rows of the query. Words are told apart
by 64-bit hashes: of k different words, k * k / 2**65 pairs are expected to share one (0.003 for 10**8 words).
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.llm.common import dropped, in_slices, partitions, put, with_field, written
from tessaxis.llm.hashed_words import hashed_words
from tessaxis.llm.shingles import mix, range_of

MAX_DEPTH, MIN_COUNT, DISCOUNT, DIVERGENCE, GAIN = 3, 20, 0.75, 0.02, 100.0
HEAD_SHARE, HEAD_MOST, HOT, BITMAP_BITS, BITMAP_MOST = 2e-8, 3_000_000, 1000, 1 << 26, 1 << 29
BATCH_PAIRS, GROUP_PAIRS, PACKED = 1_000_000, 1_000_000, 1 << 16
OTHER, END, LEFT = 0, 1, (1 << 31) - 1  # symbols: the class of other words, the end; and in keys: what a state leaves to its suffix
END_HASH = 1
ROW, WORD = -2, -1  # in place of a key's second number: a row's own sums, a word's hash
_S, _LEFT = np.uint64(32), np.uint64(LEFT)


@dataclass
class Model:
    """n tokens of v kinds; words (e: hash, v: log10 of count + 1); alphabet: sorted hashes of symbols 2 and up; root: the
    symbols' shares; gains (e, f: key, v, n): what a state leaves to its suffix, and its symbols' gains over that."""

    n: int
    v: int
    words: DataFrame
    alphabet: np.ndarray = field(default_factory=lambda: np.array([], np.int64))
    root: np.ndarray = field(default_factory=lambda: np.array([], float))
    gains: DataFrame | None = None


def places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def with_ends(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (int64) of all tokens, each text's end after its words, and the number of each token's text."""
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.full(len(doc), END_HASH, np.int64)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = h.view(np.int64)
    return out, doc


def symbols(tokens: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    found = (places(alphabet, tokens) + 2).astype(np.uint64)
    found[found == 1] = OTHER
    found[tokens == END_HASH] = END
    return found


def contexts(ids: np.ndarray, depth: int):
    """For each length: the places of tokens with a context of so many symbols in their text, its last two symbols (the older one foremost), and the third one back above the bits of a symbol."""
    near, far, at = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64), np.arange(len(ids))
    for d in range(1, depth + 1):
        at = at[at >= d]
        at = at[ids[at - d] > END]
        if d < 3:
            near[at] |= ids[at - d] << np.uint64(32 * (d - 1))
        else:
            far[at] = ids[at - d] << _S
        yield at, near[at], far[at]


def key_hash(near: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(mix(near.view(np.uint64)) ^ last.view(np.uint64))


def summed(near: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    code, far = near, last >> _S
    for part in (far, last & _LEFT) if far.any() else (last,):
        if (code >> _S).any():  # ranks fit beside one more symbol
            order, rank = np.argsort(code), np.empty(len(code), np.uint64)
            rank[order] = np.cumsum(_changes(code[order]))
            code = rank
        code = code << _S | part
    order = np.argsort(code)
    near, last, n = near[order], last[order], n[order]
    first = np.flatnonzero(_changes(near, last))
    return near[first], last[first], np.add.reduceat(n, first, dtype=n.dtype) if len(first) else n


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def bits_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Three bits for each hash, of its lower, middle and upper part."""
    return [hashes >> np.uint64(shift) & np.uint64(size - 1) for shift in (0, 18, 35)]


def bitmap(keys: DataFrame, *columns: str | Column) -> np.ndarray:
    """A bitmap with the bits of the keys of two columns, as 64-bit words; sixteen bits a key between BITMAP_BITS and BITMAP_MOST."""
    size, many = BITMAP_BITS, keys.count()
    while size < min(16 * many, BITMAP_MOST):
        size *= 2

    def run(batches):
        words = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for bit in bits_of(key_hash(*(x.to_numpy(zero_copy_only=False) for x in batch.columns)), size):
                np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        slot = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(words[slot].view(np.int64))], ["slot", "bits"])

    found = keys.select(*columns).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow().to_pandas()
    words = np.zeros(size // 64, np.uint64)
    words[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def may_be(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for bit in bits_of(hashes, 64 * len(words)):
        bit = bit[found]
        found[found] = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """h, c: the words' hashes and counts over all texts, with the end."""

    def run(batches):
        held, size = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

        for batch in in_slices(batches, text):
            held.append(with_ends(*hashed_words(batch.column(text)))[0])
            size += len(held[-1])
            if size >= BATCH_PAIRS:
                yield out()
                size = 0
        if held:
            yield out()

    return texts.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def least_count(n: int) -> int:
    """How often contexts and symbols must come in n tokens: as often in many as in few."""
    return MIN_COUNT


def alphabet_of(table: DataFrame, least_count: int) -> pd.DataFrame:
    """h, c of the alphabet's words, sorted by h: all that came that often."""
    return table.where((F.col("c") >= least_count) & (F.col("h") != END_HASH)).select("h", "c").toArrow().to_pandas().sort_values("h")


def _planes(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, so that the codec of the shuffle finds the zero bytes."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def symbol_rows(texts: DataFrame, text: str, alphabet: Broadcast) -> DataFrame:
    """ids: the symbols of a few texts with their ends, packed."""

    def run(batches):
        for batch in in_slices(batches, text, PACKED):  # the Parquet writer holds a hundred rows at least
            ids = symbols(with_ends(*hashed_words(batch.column(text)))[0], alphabet.value)
            yield pa.RecordBatch.from_arrays([pa.array([_planes(ids.astype(np.uint32))], pa.binary())], ["ids"])

    return texts.select(text).mapInArrow(run, "ids binary")


def pair_counts(packed: DataFrame, depth: int, candidates: Broadcast | None, hot: Broadcast, groups: int, least: int) -> DataFrame:
    """ctx, far, sym, n of the symbols that came least / 5 times after contexts of a length; rows with sym = LEFT: n, and cut (what of it the others had and the discount takes) of contexts; those of a hot context in parts."""

    def deal(batches):
        held, size = [], 0

        def out():
            near, last = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            near, last, n = summed(near, last, np.ones(len(near), np.uint32))
            whole = key_hash(near, last | _LEFT)
            r = range_of(np.where(places(hot.value, whole) >= 0, key_hash(near, last), whole), groups).astype(np.int64)
            order = np.argsort(r, kind="stable")
            near, last, n, r = near[order], last[order], n[order], r[order]
            firsts = np.flatnonzero(_changes(r))
            rows = [(int(r[a]), _planes(np.diff(near[a:b], prepend=np.uint64(0))), _planes(last[a:b]), _planes(n[a:b])) for a, b in zip(firsts, np.r_[firsts[1:], len(r)][: len(firsts)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary() if i else pa.int32()) for i in range(4)], ["r", "near", "last", "counts"])

        for ids in (_from_planes(x.as_py(), np.uint32).astype(np.uint64) for batch in batches for x in batch.column("ids")):
            *_, (at, near, far) = contexts(ids, depth)
            if candidates is not None:
                ok = may_be(candidates.value, key_hash(near, far | _LEFT))
                at, near, far = at[ok], near[ok], far[ok]
            held.append((near, far | ids[at]))
            size += len(at)
            if size >= BATCH_PAIRS:
                yield out()
                size = 0
        if held:
            yield out()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        near = np.concatenate([np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in pdf["near"]])
        last = np.concatenate([_from_planes(x, np.uint64) for x in pdf["last"]])
        near, last, n = summed(near, last, np.concatenate([_from_planes(x, np.uint32) for x in pdf["counts"]]).astype(np.int64))
        first = np.flatnonzero(_changes(near, last >> _S))
        kept = 5 * n >= least
        total, cut = np.add.reduceat(n, first), np.add.reduceat(np.where(kept, DISCOUNT, n), first)
        stays = (total >= least) | (places(hot.value, key_hash(near[first], last[first] | _LEFT)) >= 0)
        kept &= np.repeat(stays, np.diff(np.r_[first, len(n)]))
        of, more = np.r_[np.flatnonzero(kept), first[stays]], int(stays.sum())
        sym = np.r_[last[kept] & _LEFT, np.full(more, _LEFT)].astype(np.int32)
        return pd.DataFrame({"ctx": near[of].view(np.int64), "far": (last[of] >> _S).astype(np.int32), "sym": sym, "n": np.r_[n[kept], total[stays]], "cut": np.r_[np.zeros(int(kept.sum())), cut[stays]]})

    dealt = packed.mapInArrow(deal, "r int, near binary, last binary, counts binary")
    return dealt.groupBy("r").applyInPandas(meet, "ctx long, far int, sym int, n long, cut double")


def with_shares(rows: DataFrame, root: Broadcast) -> DataFrame:
    """Rows with their symbols' shares at the root (above), null for LEFT."""

    def run(batches):
        for batch in batches:
            sym = batch.column("sym").to_numpy(zero_copy_only=False)
            left = sym == LEFT
            yield put(batch, "above", pa.array(root.value[np.where(left, 0, sym)], mask=left))

    return rows.mapInArrow(run, with_field(rows, "above", T.DoubleType()))


def fit(texts: DataFrame, text: str = "text", max_depth: int = MAX_DEPTH) -> Model:
    spark = texts.sparkSession
    table = written(word_counts(texts, text))
    n, v, ends = table.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("h") == END_HASH, F.col("c")))).first()
    words = table.select(F.col("h").alias("e"), F.log10(F.col("c") + 1).alias("v"))
    if not n:
        return Model(0, 0, words)
    least = least_count(n)
    found = alphabet_of(table, least)
    counts = found["c"].to_numpy(np.int64)
    share = (np.append(ends, counts) + 1) / (n + v + 1)
    root = np.append(max(1 - share.sum(), 1e-300), share)
    model = Model(int(n), int(v), words, found["h"].to_numpy(np.int64), root)
    alphabet = spark.sparkContext.broadcast(model.alphabet)
    groups = max(4, partitions(texts), -(-model.n // GROUP_PAIRS))
    often = np.flatnonzero(counts * HOT >= n).astype(np.uint64) + np.uint64(2)
    hot = np.sort(key_hash(often, np.full(len(often), _LEFT)))
    candidates, levels, packed = None, [], written(symbol_rows(texts, text, alphabet))
    whole, is_left = Window.partitionBy("ctx", "far"), F.col("sym") == LEFT  # a context has at most as many rows as the alphabet, and a few sums
    for d in range(1, max_depth + 1):
        counted = written(pair_counts(packed, d, candidates, spark.sparkContext.broadcast(hot), groups, least))
        if d == 1:
            rows = with_shares(counted, spark.sparkContext.broadcast(root))
        else:
            above = levels[-1].where(~is_left).select(F.col("ctx").alias("suffix"), "sym", F.when(F.col("stays"), F.col("p")).otherwise(F.col("above")).alias("above"))
            rows = counted.withColumn("suffix", _newest("ctx") if d == 2 else F.col("ctx")).join(above, ["suffix", "sym"], "left")
        rows = rows.withColumn("total", F.sum(F.when(is_left, F.col("n"))).over(whole)).withColumn("left", F.sum("cut").over(whole) / F.col("total"))
        rows = rows.withColumn("p", F.when(~is_left, (F.col("n") - DISCOUNT) / F.col("total") + F.col("left") * F.col("above")))
        kl = F.sum(F.col("p") * F.ln(F.col("p") / F.col("above"))).over(whole) + F.greatest(1 - F.sum("p").over(whole), F.lit(0.0)) * F.ln("left")
        stays = F.coalesce((F.col("kl") >= DIVERGENCE) & (F.col("kl") * F.col("total") >= GAIN), F.lit(False))
        levels.append(written(rows.withColumn("kl", kl).select("ctx", "far", "sym", "n", "total", "above", "p", "left", stays.alias("stays"))))
        dropped(counted)
        longer = levels[-1].where(~is_left & (F.col("n") >= least) & (F.col("sym") > END)).select(F.shiftleft(_newest("ctx"), 32).bitwiseOR(F.col("sym")).alias("ctx"), F.shiftright("ctx", 32).alias("far"), "n")
        if d == max_depth or longer.isEmpty():
            break
        candidates = spark.sparkContext.broadcast(bitmap(longer, "ctx", _last(F.lit(LEFT))))
        often = longer.where(F.col("n") * HOT >= model.n).select("ctx", _last(F.lit(LEFT))).toArrow()
        hot = np.sort(key_hash(*(x.to_numpy() for x in often.columns)))
    dropped(packed)
    for level in levels:
        kept = level.where("stays")
        symbols_ = kept.where(~is_left).select(F.col("ctx").alias("e"), _last(F.col("sym")).alias("f"), F.log10(F.col("p") / F.col("above") / F.col("left")).alias("v"), "n")
        lefts = kept.where(is_left).dropDuplicates(["ctx", "far"]).select(F.col("ctx").alias("e"), _last(F.lit(LEFT)).alias("f"), F.log10("left").alias("v"), F.col("total").alias("n"))
        model.gains = symbols_.union(lefts) if model.gains is None else model.gains.union(symbols_).union(lefts)
    model.gains = written(model.gains)
    dropped(*levels)
    return model


def _newest(ctx: str) -> Column:
    return F.col(ctx).bitwiseAND(F.lit((1 << 32) - 1))


def _last(sym: Column) -> Column:
    return F.shiftleft(F.col("far").cast("long"), 32).bitwiseOR(sym)


def _head(table: DataFrame, least: float) -> tuple[np.ndarray, ...]:
    """Hashes, in order, of the HEAD_MOST most frequent keys that came `least` times (of equally frequent ones all or none), and the keys and values."""
    of = table.where(F.col("n") >= least)
    if (many := of.count()) > HEAD_MOST:
        least = of.agg(F.percentile_approx("n", 1 - HEAD_MOST / many, 10_000)).first()[0] + 1
    found = table.where(F.col("n") >= least).select("e", "f", "v").toArrow()
    e, f, v = (x.to_numpy() for x in found.columns)
    h = key_hash(e, f)
    order = np.argsort(h)
    return h[order], e[order], f[order], v[order]


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_tokens, n_known, base_score, score (log10 probabilities of the whole text)."""
    if not model.n:
        size = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return df.select(key, size.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    spark: SparkSession = df.sparkSession
    bits, gains = np.zeros(BITMAP_BITS // 64, np.uint64), (np.array([], np.uint64), *(np.array([], x) for x in (np.int64, np.int64, float)))
    if model.gains is not None:
        bits, gains = bitmap(model.gains, "e", "f"), _head(model.gains, HEAD_SHARE * model.n)
    sent = spark.sparkContext.broadcast((np.log10(model.root), gains, bits, model.alphabet))
    unseen = -float(np.log10(model.n + model.v + 1))
    kind = df.schema[key].dataType
    names = ["row", "e", "f", "tf", "key", "n_tokens", "n_known", "base", "gain"]

    def run(batches):
        from pyspark import TaskContext

        logs, (heads, head_e, head_f, values), bits, alphabet = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in in_slices(batches, text):
            tokens, doc = with_ends(*hashed_words(batch.column(text)))
            n, asked = batch.num_rows, []

            def sums(of, weights=None, n=n, doc=doc):
                return np.bincount(doc[of], weights, n)

            def ask(of, e, f, h, asked=asked, doc=doc):
                """Rows for the keys that are not at hand, once for each text (or in parts, where others have the same upper bits of the hash)."""
                order = np.argsort(doc[of].astype(np.uint64) << np.uint64(44) | h.view(np.uint64) >> np.uint64(20))
                d, e, f = doc[of][order], e[order], f[order]
                first = np.flatnonzero(_changes(d, e, f))
                asked.append((d[first], e[first], f[first], np.diff(np.r_[first, len(e)])))

            ids = symbols(tokens, alphabet)
            seen = ids != OTHER
            base, gain = sums(~seen) * unseen + sums(seen, logs[ids[seen].astype(np.int64)]), np.zeros(n)
            ask(np.flatnonzero(~seen), tokens[~seen], np.full(int((~seen).sum()), WORD), tokens[~seen])
            for place, near, far in contexts(ids, MAX_DEPTH):
                ok = may_be(bits, key_hash(near, far | _LEFT))
                place, near, far = place[ok], near[ok], far[ok]
                for last in (far | _LEFT, far | ids[place]):
                    h = key_hash(near, last)
                    some = np.flatnonzero(may_be(bits, h))
                    of, e, f, h = place[some], near[some].view(np.int64), last[some].view(np.int64), h[some]
                    at = places(heads, h)
                    hit = at >= 0
                    hit[hit] = (head_e[at[hit]] == e[hit]) & (head_f[at[hit]] == f[hit])
                    gain += sums(of[hit], values[at[hit]])
                    ask(of[~hit], e[~hit], f[~hit], h[~hit])
            out = [np.arange(row, row + n), np.arange(row, row + n), np.full(n, ROW), np.zeros(n, np.int64)]
            parts = [np.concatenate([out[i], *((x[i] + row if i == 0 else x[i]) for x in asked)]).astype(np.int64) for i in range(4)]
            more = len(parts[0]) - n
            of_row = [np.bincount(doc, minlength=n), sums(seen).astype(np.int64), base, gain]
            columns = [pa.concat_arrays([x, pa.nulls(more, x.type)]) for x in (batch.column(key), *(pa.array(x) for x in of_row))]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in parts), *columns], names)
            row += n

    # each text's sums over the words and keys at hand, and a row for each of its other ones; rows' own keys are in no table
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names[:4]), T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in names[5:7]), *(T.StructField(c, T.DoubleType()) for c in names[7:])])
    parts = df.select(key, text).mapInArrow(run, schema)
    table = model.words.select("e", F.lit(WORD).cast("long").alias("f"), "v")
    if model.gains is not None:
        table = table.union(model.gains.select("e", "f", "v"))
    found = parts.join(table, ["e", "f"], "left")
    add = F.coalesce(F.col("tf") * F.col("v"), F.lit(0.0))
    is_word = F.col("f") == WORD
    sums = found.groupBy("row").agg(
        F.max("key").alias(key),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(is_word & F.col("v").isNotNull(), F.col("tf")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.when(is_word, add), F.lit(0.0))).alias("base_score"),
        F.sum(F.coalesce(F.col("base") + F.col("gain"), add)).alias("score"),
    )
    return sums.select(key, "n_tokens", "n_known", "base_score", "score")
