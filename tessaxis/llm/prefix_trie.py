"""Trie of conversation prefixes, built by truncation peeling.

A node is a distinct sequence of first turns. Peeling goes from the deepest turn up: the nodes of a depth are the stems
that earlier steps left there, merged with conversations that end there; a node is finished at that moment, since all
below it is done, and strips its last turn to become a stem of the depth above, carrying its sums along. So nodes are
found and aggregated in the same pass.

Depths are peeled inside tasks, not by one job each. A prefix that more than `most` stems share is crowded; each stem is
peeled down to just below the last crowded prefix on its path, together with all stems under that place, at most `most`.
What comes out are node rows and one stem a group, on a crowded prefix. Stems on the same prefix, however many, merge by
partial sums before they are shuffled, and the next round peels these; the crowded prefixes get fewer by about `most`
each round, so rounds are few however deep or unevenly the conversations branch. Equal conversations are one stem from
the start, with their ids' digest streamed from sorted blocks of ids.

Prefixes are told apart by 128-bit chained hashes (for 10^12 prefixes the chance of any clash is below 2e-15).

Turns are ordered by turn (null first), then role and the text's digest; null roles and texts count as empty; repeated
rows stay repeated turns. Rows without conv_id belong to no conversation. A conversation's turns, as digests, and a group
of `most` conversations must fit a task. An empty table has no conversations and so no nodes.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaxis.llm.common import partitions, written

#: Stems that are peeled together, and ids that are joined to one string, at most.
MOST, BLOCK = 2000, 4096
#: Crowded prefixes, of 16 bytes, that are sent to all tasks; more are joined under so many salts.
CROWDED_MOST, SALTS = 200_000, 64
EMPTY = hashlib.sha256(b"").hexdigest()


def _turn(role: Column, text: Column) -> Column:
    """k: a digest of role and text; b: UTF-8 bytes of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.struct(F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("k"), F.octet_length(text).cast("long").alias("b"))


def conversations(df: DataFrame) -> DataFrame:
    """conv_id, turns: array of (k, b) in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), _turn(F.col("role"), F.col("text")).alias("t"))
    chats = df.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return chats.select("conv_id", F.transform("rows", lambda r: r["t"]).alias("turns"))


def rebuilt(chats: DataFrame, of: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation whose id is the next multiple of `of` at or below; h is the id's checksum modulo `heads`."""
    chats = written(chats)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = chats.select("conv_id", "turns", (F.col("conv_id") - F.pmod("conv_id", F.lit(of))).alias("_base"), h.alias("_h"))
    base = chats.where(F.pmod("conv_id", F.lit(of)) == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    head = F.coalesce(F.expr("slice(_head, 1, _h)"), F.expr("slice(turns, 1, 0)"))
    rest = F.expr("slice(turns, _h + 1, size(turns))")
    return own.join(base, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, key (of the whole), chain (keys of all prefixes, that of no turns first), sizes."""
    for batch in batches:
        chains, sizes = [], []
        for turns in batch.column("turns"):
            chain = [b"\0" * 16]
            for t in turns.values.field("k").to_pylist():
                chain.append(hashlib.blake2b(chain[-1] + t, digest_size=16).digest())
            chains.append(chain)
            sizes.append(turns.values.field("b"))
        lists = pa.array(chains, pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([c[-1] for c in chains], pa.binary()), lists, pa.array([s.to_pylist() for s in sizes], pa.list_(pa.int64()))], ["conv_id", "key", "chain", "sizes"])


def _ends(rows: DataFrame) -> DataFrame:
    """key, ends: the digest of the ids of the conversations that end there, in order and comma-joined."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    joined = rows.groupBy("key", block).agg(F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])

    return joined.repartition(partitions(rows), "key").sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends string")


#: A stem: a prefix with what is known of its node so far.
SUMS = "n long, least long, children long, leaves long, saved long, ends string"


def _merged(stems: DataFrame) -> DataFrame:
    """One stem for each prefix."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    slim = stems.groupBy("key").agg(*sums, F.min("least").alias("least"), F.max("ends").alias("ends"))
    # all stems of a prefix have the same chain: that of one is enough
    chains = stems.groupBy("key").agg(F.first("chain").alias("chain"), F.first("sizes").alias("sizes"))
    return slim.join(chains, "key").select("key", "chain", "sizes", "n", "least", "children", "leaves", "saved", "ends")


def _placed(stems: DataFrame, most: int) -> DataFrame:
    """stems with cut: the depth just below the last prefix on their path that more than `most` stems share."""
    steps = stems.select("key", F.posexplode("chain").alias("depth", "prefix"))
    crowded = written(steps.groupBy("prefix").agg(F.count("*").alias("c")).where(F.col("c") > most).select("prefix"))
    if crowded.count() <= CROWDED_MOST:
        on = steps.join(F.broadcast(crowded), "prefix")
    else:  # a crowded prefix has many steps by its nature: they are spread over SALTS keys
        salted = steps.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        on = salted.join(crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["prefix", "salt"])
    last = on.groupBy("key").agg((F.max("depth") + 1).alias("cut"))
    return stems.join(last, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


class _Node:
    __slots__ = ("below", "chain", "ends", "sums", "sizes")

    def __init__(self, chain, sizes):
        self.chain, self.sizes, self.sums, self.ends, self.below = chain, sizes, [0, None, 0, 0, 0], None, []

    def add(self, n, least, children, leaves, saved):
        a = self.sums
        self.sums = [a[0] + n, least if a[1] is None else min(a[1], least), a[2] + children, a[3] + leaves, a[4] + saved]


def peeled(stems: list[tuple], cut: int) -> tuple[list[tuple], list[tuple]]:
    """Peels stems (chain, sizes, n, least, children, leaves, saved, ends) that share their prefix of `cut` turns down to it.

    Node rows: prefix, prefix above (null if its id is known), least, depth, least above, n, children, leaves, saved, ends; and the stem that is left.
    """
    waiting: dict[int, list[tuple]] = {}
    for s in stems:
        waiting.setdefault(len(s[0]) - 1, []).append(s)
    here: dict[bytes, _Node] = {}
    rows, depth = [], max(waiting, default=cut - 1)
    while depth >= cut:
        for chain, sizes, n, least, children, leaves, saved, ends in waiting.pop(depth, []):
            node = here.setdefault(chain[depth], _Node(chain, sizes))
            node.add(n, least, children, leaves, saved)
            node.ends = ends or node.ends
        above: dict[bytes, _Node] = {}
        for key, node in here.items():
            n, least, children, leaves, saved = node.sums
            leaves = leaves or 1
            saved += (n - 1) * node.sizes[depth - 1] if depth else 0
            row = [key, None, least, depth, None, n, children, leaves, saved, node.ends or EMPTY]
            for child in node.below:
                child[4] = least
            rows.append(row)
            if depth > cut:
                up = above.setdefault(node.chain[depth - 1], _Node(node.chain, node.sizes))
                up.add(n, least, 1, leaves, saved)
                up.below.append(row)
            elif depth:
                row[1] = node.chain[depth - 1]
                above[row[1]] = _Node(node.chain, node.sizes)
                above[row[1]].add(n, least, 1, leaves, saved)
        here, depth = above, depth - 1
    return rows, [(x.chain[:cut], x.sizes[: cut - 1], *x.sums) for x in here.values()] if cut else []


NODE = "prefix binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
_STEM_TYPES = [pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.int64()] * 5]


def _round(stems: DataFrame) -> DataFrame:
    """Node rows, and rows of stems (their columns, null in node rows), of stems with cut at or above their own depth."""
    names = [x.split()[0] for x in NODE.split(", ")] + ["chain", "sizes", "n", "least", "children", "leaves", "saved"]

    def table(rows, left):
        nodes = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 10, _NODE_TYPES, strict=True)]
        own = [pa.array(c, t) for c, t in zip(zip(*left, strict=True) if left else [()] * 7, _STEM_TYPES, strict=True)]
        nodes = [pa.concat_arrays([x, pa.nulls(len(left), x.type)]) for x in nodes]
        own = [pa.concat_arrays([pa.nulls(len(rows), x.type), x]) for x in own]
        return pa.RecordBatch.from_arrays([*nodes, *own], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stems, rows, left = None, [], [], []

        def flush():
            a, b = peeled(stems, group[0])
            rows.extend(a)
            left.extend(b)
            stems.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cut", "chain", "sizes", "n", "least", "children", "leaves", "saved", "ends")]
            for cut, chain, *rest in zip(*columns, strict=True):
                if group != (cut, chain[cut]):
                    if group:
                        flush()
                    group = (cut, chain[cut])
                stems.append((chain, *rest))
                if len(rows) >= 10_000:
                    yield table(rows, left)
                    rows, left = [], []
        if group:
            flush()
        yield table(rows, left)

    place = F.expr("chain[cut]")
    dealt = stems.withColumn("_place", place).repartition(partitions(stems), "_place").sortWithinPartitions("_place", "cut")
    return dealt.select("cut", "chain", "sizes", "n", "least", "children", "leaves", "saved", "ends").mapInArrow(run, NODE + ", chain array<binary>, sizes array<long>, n long, least long, children long, leaves long, saved long")


def trie(rows: DataFrame, most: int = MOST) -> DataFrame:
    """One row per node of the conversations (conv_id, turns): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chained = written(rows.mapInArrow(_chain, "conv_id long, key binary, chain array<binary>, sizes array<long>"))
    zero = F.lit(0).cast("long")
    stems = _merged(chained.select("key", "chain", "sizes", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("least"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.lit(None).cast("string").alias("ends")))
    stems = written(stems.drop("ends").join(_ends(chained.select("key", "conv_id")), "key"))
    found = []
    while n := stems.count():
        placed = written(_placed(stems, most)) if n > most else stems.withColumn("cut", F.lit(0))
        inside = F.col("cut") < F.size("chain")
        out = written(_round(placed.where(inside)))
        found.append(out.where("depth IS NOT NULL").select(*(x.split()[0] for x in NODE.split(", "))))
        left = out.where("depth IS NULL").select(F.element_at("chain", -1).alias("key"), "chain", "sizes", "n", "least", "children", "leaves", "saved", F.lit(None).cast("string").alias("ends"))
        stems = written(_merged(left.unionByName(placed.where(~inside).drop("cut"))))
    if not found:
        return chained.sparkSession.createDataFrame([], NODE).drop("prefix", "up")
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.unionByName(x)
    # the tops of groups stand below crowded prefixes, whose nodes later rounds found
    tops, rest = nodes.where("up IS NOT NULL").drop("parent_conv_id"), nodes.where("up IS NULL")
    crowded = nodes.select(F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id")).join(tops.select("up").distinct(), "up", "left_semi")
    return rest.unionByName(tops.join(crowded, "up")).drop("prefix", "up")
