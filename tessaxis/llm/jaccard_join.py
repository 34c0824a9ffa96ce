"""N-gram Jaccard join: near duplicates by rare-first prefix filtering, linked into components.

Each text is the set of its distinct n-word shingles, held as 64-bit hashes. Two texts of |x| and |y| shingles link when
100 * |x and y| >= percent * |x or y|.

1. Equal sets are one node, by a 64-bit hash of the set. Shingles are dealt out by hash range, packed per batch of texts
   (one binary row per batch and range), and counted over distinct sets: that is the rarity order. Shingles that only one
   set has need not be kept: they take the first places of the order, and no other set shares them. The number of ranges
   follows the number of shingles. Shingles that over HEAVY_SHARE of the sets may hold (a batch names its frequent ones, so
   none is missed; at most 2/HEAVY_SHARE times a set's mean size are named) are summed map-side and sent to all tasks: no
   task gathers their occurrences. Their counts take copies of sets twice, which the order may, as all sets see the same.
2. Sets come back with their shared shingles in order, packed by node. A set whose unshared shingles fill its whole prefix
   (|x| - need + 1 places) can link with nothing and is done; so the later steps are as large as what texts share.
3. Sets meet on prefix shingles. A pair must pass the length filter, the positional filter (what remains in either set
   from the shingle where it meets) and the suffix filter (what the parities of both sets' shingles in SKETCH_BITS parts of
   the hash space say of their difference) before it is a row; it is then verified, once, by intersecting the two sets.
4. Groups of up to SMALL_GROUP sets compare all pairs, which are few. Of larger ones, rounds link each set of a prefix
   shingle's group with one leader of the group and merge what links; sets of one component need no further comparing, and shingles whose sets are in one component are
   done. Rounds go on while they merge much and more pairs than rows are open. After the rounds all pairs left (same
   shingle, different components) meet inside the join, so no link between different components is lost; only those that
   pass the filters become rows. A pair meets at its first common shingle: rows at a later one go if either of the few
   shingles before it is common too.

Shingles are 56-bit hashes: in a pair of sets of n shingles a collision has a chance of n * n / 2**56, under one in 10**8
for 20,000 words. Of k different sets, k * k / 2**65 pairs are expected to share a node: 0.03 for 10**9 sets.

Texts with no words, null or empty, have no shingles and link with nothing. Rows with the same text, and repeated rows,
are one node and so linked. Null keys take part in components but never name one, unless all keys of it are null.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.llm.common import dropped, in_slices, partitions, written
from tessaxis.llm.shingles import Shingler, mix, range_of, signature
from tessaxis.plans.graphs import components

WORDS, PERCENT = 5, 75
SMALL_GROUP, OPEN_PAIRS, MERGED_SHARE, LOOK_BACK = 8, 4, 1 / 32, 12
BATCH_SHINGLES, GROUP_SHINGLES = 400_000, 600_000
HEAVY_SHARE, SKETCH_BITS, NODE_SLICE = 1 / 250, 512, 1 << 22


def prefix_places(n: int, percent: int = PERCENT) -> int:
    """Places of the order that hold a shared shingle of any linked set: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def least_overlap(a, b, percent: int = PERCENT):
    """The least intersection of linked sets of these sizes."""
    return -(-(a + b) * percent // (100 + percent))


def node_rows(df: DataFrame, key: str, text: str, n_words: int) -> DataFrame:
    """key, text_hash, n (shingles) and node (hash of the set; null without shingles) of each row; the first row of each slice also has its frequent shingles and their counts."""
    kind = df.schema[key].dataType

    def run(batches):
        shingle = Shingler(n_words)
        for batch in in_slices(batches, text, NODE_SLICE):
            sets = [shingle(x.as_py()) for x in batch.column(text)]
            h, many = np.unique(np.concatenate([np.array([], np.uint64), *sets]), return_counts=True)
            often = many > max(1, HEAVY_SHARE / 2 * len(sets))
            lists = [[h[often].view(np.int64).tolist(), many[often].tolist()], *[[None, None]] * (len(sets) - 1)][: len(sets)]
            node = pa.array([signature(x) if len(x) else None for x in sets], pa.int64())
            columns = [batch.column(key), batch.column("text_hash"), pa.array([len(x) for x in sets], pa.int64()), node, *(pa.array([x[i] for x in lists], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, [key, "text_hash", "n", "node", "often", "many"])

    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("text_hash", "n", "node")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("often", "many"))])
    return df.select(key, text, F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)


def heavy_shingles(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles, with all that over HEAVY_SHARE of the sets have, and their counts in the slices that name them.

    Slices that don't name one hold it in under half that share of their sets, so the others count over half of it.
    """
    pairs = nodes.where("often is not null").select(F.explode(F.arrays_zip("often", "many")).alias("x"))
    total = nodes.where("node is not null").count()
    found = pairs.groupBy(F.col("x.often").alias("h")).agg(F.sum("x.many").alias("c")).where(F.col("c") > HEAVY_SHARE / 2 * total).toArrow().to_pandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that the codec of the shuffle finds the zero bytes."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def sketch(shingles: np.ndarray) -> list[int]:
    """The parities of the numbers of shingles in SKETCH_BITS parts of the hash space; two sketches differ in no more bits than the sets do in shingles."""
    odd = np.bincount((mix(shingles) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def shared_shingles(df: DataFrame, text: str, n_words: int, percent: int, ranges: int, buckets: int, heavy: tuple[np.ndarray, np.ndarray] = (np.array([], np.uint64), np.array([], np.int64))) -> DataFrame:
    """node, n, shared (uint64 bytes, in rarity order) and sketch (of the shared) of the sets that may link with another, once each."""
    sent = df.sparkSession.sparkContext.broadcast(heavy)

    def is_heavy(h):
        if not len(sent.value[0]):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(sent.value[0], h), len(sent.value[0]) - 1)
        return sent.value[0][at] == h, at

    def deal(batches):
        shingle = Shingler(n_words)
        nodes: dict[int, int] = {}
        sets: list[np.ndarray] = []

        def flush():
            h = np.concatenate(sets)
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint16)
            names = np.array(list(nodes), np.int64)
            sizes = np.array(list(nodes.values()), np.int32)
            # frequent shingles go by their sets, the others by their ranges
            r = np.where(is_heavy(h)[0], ranges + range_of(names.view(np.uint64), buckets)[at], range_of(h, ranges)).astype(np.int64)
            order = np.lexsort((h, r))
            h, at, r = h[order], at[order], r[order]
            firsts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for a, b in zip(firsts, [*firsts[1:], len(r)], strict=True):
                used, own = np.unique(at[a:b], return_inverse=True)
                yield int(r[a]), names[used].tobytes(), _planes(sizes[used]), _pack(h[a:b]), own.astype(np.uint16).tobytes()
            nodes.clear()
            sets.clear()

        def frame(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], ["r", "nodes", "sizes", "hashes", "own"])

        held = 0
        for batch in in_slices(batches, text):
            for x in batch.column(text):
                s = shingle(x.as_py())
                node = signature(s)
                if len(s) and node not in nodes:
                    nodes[node] = len(s)
                    sets.append(s)
                    held += len(s)
                if held >= BATCH_SHINGLES or len(sets) >= 60_000:
                    yield frame(flush())
                    held = 0
        if sets:
            yield frame(flush())

    def count(group: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([_unpack(x) for x in pdf["hashes"]])
        node = np.concatenate([np.frombuffer(a, np.int64)[np.frombuffer(o, np.uint16)] for a, o in zip(pdf["nodes"], pdf["own"], strict=True)])
        size = np.concatenate([_from_planes(a, np.int32)[np.frombuffer(o, np.uint16)] for a, o in zip(pdf["sizes"], pdf["own"], strict=True)])
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[fresh], node[fresh], size[fresh]
        if group[0] >= ranges:
            df_ = np.maximum(2, sent.value[1][is_heavy(h)[1]])
        else:
            _, inverse, many = np.unique(h, return_inverse=True, return_counts=True)
            df_ = many[inverse]
        keep = df_ > 1
        h, node, size, df_ = h[keep], node[keep], size[keep], df_[keep]
        order = np.lexsort((h, df_, node))
        h, node, size, df_ = h[order], node[order], size[order], df_[order].astype(np.uint32)
        bucket = range_of(node.view(np.uint64), buckets).astype(np.int32)
        rows = []
        for b in np.unique(bucket):
            at = bucket == b
            names, first, many = np.unique(node[at], return_index=True, return_counts=True)
            rows.append((int(b), names.tobytes(), size[at][first].tobytes(), many.astype(np.int32).tobytes(), h[at].tobytes(), df_[at].tobytes()))
        return pd.DataFrame(rows, columns=["b", "nodes", "sizes", "many", "hashes", "df"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
        many, names, sizes, h, df_ = read("many", np.int32), read("nodes", np.int64), read("sizes", np.int32), read("hashes", np.uint64), read("df", np.uint32)
        node, size = np.repeat(names, many), np.repeat(sizes, many)
        order = np.lexsort((h, df_, node))
        node, size, h = node[order], size[order], h[order]
        firsts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.array([], int)
        rows = []
        for a, b in zip(firsts, [*firsts[1:], len(node)], strict=True):
            n = int(size[a])
            if n - (b - a) < prefix_places(n, percent):
                rows.append((int(node[a]), n, h[a:b].tobytes(), sketch(h[a:b])))
        return pd.DataFrame(rows, columns=["node", "n", "shared", "sketch"])

    dealt = df.select(text).mapInArrow(deal, "r int, nodes binary, sizes binary, hashes binary, own binary")
    counted = dealt.groupBy("r").applyInPandas(count, "b int, nodes binary, sizes binary, many binary, hashes binary, df binary")
    return counted.groupBy("b").applyInPandas(gather, "node long, n long, shared binary, sketch array<long>")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, h and pos (the place in the whole order, from 0) of each prefix shingle that other sets share."""

    def run(batches):
        for pdf in batches:
            rows = []
            for node, n, shared in zip(pdf["node"], pdf["n"], pdf["shared"], strict=True):
                h = np.frombuffer(shared, np.int64)
                alone = n - len(h)
                k = prefix_places(n, percent) - alone
                rows.append(pd.DataFrame({"node": node, "n": n, "h": h[:k], "pos": np.arange(alone, alone + len(h[:k]))}))
            if rows:
                yield pd.concat(rows)

    return sets.mapInPandas(run, "node long, n long, h long, pos long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))

    def run(batches):
        for pdf in batches:
            keep = []
            for na, sa, nb, sb in zip(pdf["n_a"], pdf["s_a"], pdf["n_b"], pdf["s_b"], strict=True):
                a, b, need = np.sort(np.frombuffer(sa, np.uint64)), np.sort(np.frombuffer(sb, np.uint64)), least_overlap(na, nb, percent)
                keep.append(min(len(a), len(b)) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need)
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def may_link(percent: int) -> Column:
    """The positional filter on rows (n_a, pos_a, n_b, pos_b) of a common prefix shingle.

    A pair that links passes at its first common shingle, behind which all others lie; so rows that fail can go.
    """
    need = F.expr(f"((n_a + n_b) * {percent} + {100 + percent - 1}) div {100 + percent}")
    return F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need


def differ_little(percent: int) -> Column:
    """The suffix filter on rows (n_a, alone_a, sketch_a, n_b, alone_b, sketch_b): the shingles that only one set has are few enough to link.

    A linked pair has at most |a| + |b| - 2 * need of them; the unshared ones are among them, and each bit in which the
    sketches differ stands for another.
    """
    need = F.expr(f"((n_a + n_b) * {percent} + {100 + percent - 1}) div {100 + percent}")
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return F.col("alone_a") + F.col("alone_b") + bits <= F.col("n_a") + F.col("n_b") - 2 * need


def met_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components that meet in rows (h, node, n, pos, comp) and pass all filters."""
    behind = Window.partitionBy("node").orderBy("pos").rowsBetween(-LOOK_BACK, -1)
    known = sets.select("node", (F.col("n") - F.octet_length("shared") / 8).cast("long").alias("alone"), "sketch")
    ahead = rows.select("h", "node", "n", "pos", "comp", F.collect_list("h").over(behind).alias("before")).join(known, "node")
    side = lambda c: ahead.select("h", *(F.col(k).alias(f"{k}_{c}") for k in ("node", "n", "pos", "comp", "before", "alone", "sketch")))
    length = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & length & may_link(percent) & differ_little(percent) & ~F.arrays_overlap("before_a", "before_b")
    return side("a").join(side("b"), "h").where(apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def node_components(sets: DataFrame, percent: int, rounds: int | None = None) -> DataFrame | None:
    """node, comp of the linked sets; None if no shingle is shared. rounds fixes the number of leader rounds."""
    rows, labels, done = prefixes(sets, percent).withColumn("comp", F.col("node")), None, 0
    edges, mine = None, None
    while True:
        # the leader changes from round to round: the first by a hash that the round salts
        order = F.struct(F.xxhash64("node", F.lit(done)).alias("o"), F.col("node"), F.col("n"), F.col("comp"))
        groups = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.min(order).alias("lead")).where("lo <> hi")
        before, mine = mine, written(rows.join(groups.select("h", "m", "lead.node", "lead.n", "lead.comp").toDF("h", "m", "node_l", "n_l", "comp_l"), "h"))
        if before is not None:
            dropped(before)
        large = mine if done or rounds == 0 else mine.where(F.col("m") > SMALL_GROUP)
        pairs, n_rows, n_sets = large.agg(F.sum((F.col("m") - 1) / 2), F.count("*"), F.count_distinct("node")).first()
        if not n_rows and (done or mine.isEmpty()):
            return labels
        last = done == rounds if rounds is not None else done > 0 and (pairs <= OPEN_PAIRS * n_rows or merged < MERGED_SHARE * n_sets)  # noqa: F821
        if last:
            found = met_pairs(large, sets, percent)
        else:
            # a leader may be met behind the first common shingle, so its rows have the length filter alone
            led = large.where("comp <> comp_l").select(F.least("node", "node_l").alias("a"), F.greatest("node", "node_l").alias("b"), F.col("n").alias("n_a"), F.col("n_l").alias("n_b"))
            found = led.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()
            if not done:
                # groups of a few sets make few pairs and are done at once
                found = found.union(met_pairs(mine.where(F.col("m") <= SMALL_GROUP), sets, percent)).distinct()
        fresh = written(verified(found, sets, percent))
        edges = fresh if edges is None else edges.union(fresh)
        labels, merged = components(edges), fresh.count()
        if last or not n_rows:
            return labels
        rows, done = large.select("h", "node", "n", "pos").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), done + 1


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: key, text_hash (xxhash64), n_shingles and component_id (the smallest key that links reach)."""
    nodes = written(node_rows(df, key, text, n_words))
    groups = max(4, partitions(df), -(-(nodes.agg(F.sum("n")).first()[0] or 0) // GROUP_SHINGLES))
    sets = written(shared_shingles(df, text, n_words, percent, groups, groups, heavy_shingles(nodes)))
    labels = node_components(sets, percent)
    first = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    if labels is not None:
        first = first.join(labels, "node", "left")
        comp = first.groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min("first").alias("component_id"), F.sum("copies").alias("size"))
        named = first.select("node", F.coalesce("comp", "node").alias("comp")).join(comp, "comp").select("node", "component_id", "size")
    else:
        named = first.select("node", F.col("first").alias("component_id"), F.col("copies").alias("size"))
    # a row alone in its component needs no join: only components of two rows or more are looked up
    found = nodes.join(written(named.where("size > 1").drop("size")), "node", "left")
    return found.select(key, "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"))
