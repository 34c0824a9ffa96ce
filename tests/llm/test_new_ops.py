"""Packing, manifest and trie against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_ops import AWKWARD, SCHEMA
from tessaxis.llm import chunk_codec, merkle, packing, prefix_trie, queries


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [(i, t, "n", 7, -1, "s") for i, t in AWKWARD]
    return spark.createDataFrame(extra, SCHEMA + ", tree string, start int, n long, ids string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries._tokenizer())


# 11


def test_chunks_encode_like_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", " the", "1", "!", " ", " ", "　", "\x85", "\x1c", "\x00", "<|endoftext|>", "’", "​", "\x7f"]
    texts = [None, "", " ", "\n\n", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000))]
    codec = chunk_codec.ChunkCodec(queries._tokenizer())
    for at in range(0, len(texts), 500):
        ids, n = codec.encode(pa.array(texts[at : at + 500], pa.string()))
        ends = np.cumsum(n)
        for t, a, b in zip(texts[at : at + 500], ends - n, ends, strict=False):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_chunk_memory_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(chunk_codec, "MEMORY", 10)
    codec = chunk_codec.ChunkCodec(queries._tokenizer())
    for text in (f"one two three {i} and {i + 1} words to fill it" for i in range(20)):
        assert codec.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text).ids


def packed_well(rows, texts, tokenizer, window=packing.WINDOW):
    """rows: (doc, start, length, crc, tokens, sequence, offset); texts: doc -> text, ids unique."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, tokens, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, crc, tokens))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids, at = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], 0
        for start, length, crc, tokens in sorted(pieces):
            assert start == at and length > 0 and tokens == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0  # no padding at all
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("most", [0, packing.COUNTS_MOST])
def test_packing_query(spark, tokenizer, monkeypatch, most):
    monkeypatch.setattr(packing, "COUNTS_MOST", most)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed_well([tuple(r) for r in got.collect()], texts, tokenizer)


def test_packing_awkward(spark, awkward, tokenizer):
    rows = awkward.withColumn("row", F.monotonically_increasing_id())
    texts = {r["row"]: r["text"] for r in rows.collect()}
    got = packing.pack(rows.repartition(3), queries._tokenizer(), key="row").withColumn("crc", F.crc32("ids"))
    packed_well([tuple(r) for r in got.select("row", "start", "length", "crc", "doc_tokens", "sequence_id", "offset").collect()], texts, tokenizer)
    assert packing.pack(awkward.limit(0), queries._tokenizer()).count() == 0
    null = packing.pack(awkward.where("doc_id IS NULL"), queries._tokenizer()).collect()
    assert {r["doc_id"] for r in null} == {None} and sum(r["length"] for r in null if r["doc_tokens"] == 1) == 1


def test_least_squares_are_least():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 3, 5, 7, 8, 11, 13])
    columns = packing.combinations(lengths, 16)
    dense = np.zeros((len(lengths) + 1, len(columns)))
    for j, c in enumerate(columns):
        assert sum(lengths[i] for i in c if i < len(lengths)) == 16
        for i in c:
            dense[i, j] += 1
    for _ in range(20):
        target = rng.integers(0, 50, len(lengths)).astype(float)
        active, x = packing.non_negative_least_squares(columns, target)
        slope = dense[:-1].T @ (target - dense[:-1, active] @ x)
        assert (x > 0).all() and np.abs(slope[active]).max(initial=0) < 1e-3 * max(target.max(), 1)
        assert slope.max() < 0.1 * max(target.max(), 1)  # no other combination would still help much


@pytest.mark.parametrize("kind", ["usual", "one length", "few lengths", "single", "none"])
def test_plan_places_each_document_once(kind):
    rng, histogram = np.random.default_rng(2), np.zeros(256, np.int64)
    if kind == "usual":
        histogram = np.bincount(rng.lognormal(4, 0.8, 50_000).astype(int) % 255 + 1, minlength=256)
    elif kind == "one length":
        histogram[200] = 10_000
    elif kind == "few lengths":
        histogram[[3, 100, 156, 250]] = 999, 50, 77, 10_000
    elif kind == "single":
        histogram[5] = 1
    plan = packing.Plan(histogram, 256, 10)
    seen = {}
    for length, rank, n, start, size, sequence, offset in plan.runs:
        for i in range(n):
            seen.setdefault((length, rank + i), []).append((start, size))
            assert 0 <= offset and offset + size <= 256 and 10 <= sequence + i < plan.next
    assert sorted(seen) == [(n, k) for n in range(256) for k in range(histogram[n])]
    for (length, _), pieces in seen.items():
        ends = [0]
        for start, size in sorted(pieces):
            assert start == ends[-1]
            ends.append(start + size)
        assert ends[-1] == length
    tokens = int(histogram @ np.arange(256))
    assert plan.next - 10 <= tokens // 256 + 9
    if kind == "usual":  # most sequences are whole documents that the solution put together
        assert plan.by_squares > 0.75 * plan.next and len(plan.runs) < 4000


# 12


def brute_manifest(rows, fan):
    """rows: (key, group, leaf, changed) -> key, leaf, subroot, root, proof, folded, verified."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def walk(levels, i):
        steps = []
        for level in levels[:-1]:
            run = i // fan * fan
            steps.append((level[run:i], level[i + 1 : run + fan]))
            i //= fan
        return steps

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2])):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[2] for r in groups[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, g in enumerate(order):
        for i, (key, _, leaf, changed) in enumerate(groups[g]):
            steps, node = walk(trees[j], i) + walk(top, j), changed or leaf
            for a, b in steps:
                node = h([*a, node, *b])
            out.append((key, leaf, trees[j][-1][0], top[-1][0], h([x for a, b in steps for x in a + b]), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("fan", "stride", "ranges"), [(8, 3, merkle.RANGES_MOST), (8, 1, 0), (2, 2, 0), (3, 4, 100)])
def test_manifest_like_brute_force(spark, monkeypatch, fan, stride, ranges):
    monkeypatch.setattr(merkle, "RANGES_MOST", ranges)
    rng = random.Random(fan)
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["en"] * 8 + ["de", None, "", "Ü"]), rng.choice(["A a", "b", None, ""])) for i in range(300)]
    rows += rows[:20] + [(5, "one", "x"), (6, ":", "-")]
    df = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], "doc_id long, lang string, text string, tree string, pos long, digest string").repartition(5)
    cols = ["doc_id", "lang", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(df, cols, {"text": merkle.lowered("text")}))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hashlib.sha256("".join(map(field, r)).encode()).hexdigest()
    tampered = lambda r: leaf((r[0], r[1], r[2] and r[2].lower())) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else None
    want = brute_manifest([(r[0], r[1], leaf(r), tampered(r)) for r in rows], fan)
    got = [tuple(r) for r in merkle.manifest(df, cols, changed=changed, fan=fan, stride=stride).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_little(spark):
    df = spark.createDataFrame([(1, "en", "x")], "doc_id long, lang string, text string")
    (r,) = merkle.manifest(df, ["doc_id", "lang", "text"]).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(df.limit(0), ["doc_id", "lang", "text"]).count() == 0


# 13


def brute_trie(chats):
    """chats: id -> list of (role, text)."""
    nodes = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for path in nodes:
        if path:
            below.setdefault(path[:-1], []).append(path)

    def sums(path):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        parts = [sums(x) for x in below.get(path, [])]
        return sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts)

    rows = []
    for path, members in nodes.items():
        leaves, saved = sums(path)
        ends = ",".join(map(str, sorted(c for c in members if len(chats[c]) == len(path))))
        rows.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(below.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def brute_rebuilt(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize(("most", "block", "sent"), [(2000, 4096, 9), (3, 2, 0), (10, 7, 10_000)])
def test_trie_like_brute_force(spark, monkeypatch, most, block, sent):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CROWDED_MOST", sent)
    rng = random.Random(most)
    turns = [("user", "a"), ("assistant", "é漢"), ("user", ""), ("", "b")]
    chats = {i: [rng.choice(turns[: 1 + d % 4]) for d in range(rng.choice([0, 1, 2, 3, 4, 8]))] for i in range(120)}
    chats |= {1000 + i: [turns[0]] * rng.choice([5, 5, 5, 9]) for i in range(40)}  # copies along one path
    chats |= {2000: [turns[1]] * 70, 2001: [turns[1]] * 69 + [turns[0]], 2002: [turns[1]] * 50}
    rows = [(c, [(hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest(), len(t.encode())) for r, t in ts]) for c, ts in chats.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<k:binary,b:bigint>>").repartition(3)
    got = [tuple(r) for r in prefix_trie.trie(df, most).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie(chats), key=repr)


def test_trie_of_awkward_conversations(spark):
    rows = [(5, 1, "user", None), (5, None, None, "x"), (5, 0, "user", "y"), (6, 0, "user", "z"), (6, 0, "user", "z"), (7, 3, "", ""), (None, 0, "user", "lost"), (11, 0, "assistant", "no base"), (16, 2, "user", "漢" * 50_000)]
    rows += [(20 + i, t, "user", f"same {t}") for i in range(9) for t in range(4 + i % 3)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(df)))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute_trie(brute_rebuilt(rows))))
    none = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(df.limit(0))))
    assert none.count() == 0 and none.columns == found.columns
