"""The corpus operators against brute force and SQL, and on awkward tables."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tessaxis.llm import bpe_codec, chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, queries, suffix_dedup, suffix_tree_lm, token_counts, toxicity
from tessaxis.llm.common import in_slices, words

RANKS, PATTERN = queries._bpe()

#: Nulls in each column, empty, blank and long texts, repeated rows and keys, characters outside ASCII, clashing columns.
BASE = "the cat sat on the mat and looked at the moon for a very long time while all of the other cats went home to sleep in the barn with the mice"
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, BASE), (4, BASE), (5, BASE.replace(" ", "\n ")), (None, BASE), (None, None), (6, "Ünïcode — 漢字 🙂 " * 40),
    (7, BASE + " " + " ".join(f"w{i}" for i in range(20000))), (8, "a" * 50000), (9, "two words"), (9, "other text of the same key"), (10, "\x00\x1f   x"), (11, " ".join(BASE.split()[:-1] + ["rats"])),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [(i, t, "n", "k", -1) for i, t in AWKWARD]
    return spark.createDataFrame(extra, SCHEMA + ", n string, key string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    of = lambda v: None if v is None or repr(v) in ("nan", "<NA>") else int(v) if isinstance(v, float) and v.is_integer() else v
    plain = lambda f: sorted(repr([of(v) for v in r]) for r in f[cols].astype(object).values.tolist())
    assert plain(got) == plain(want)


# 1


def test_chat_escaping_is_reversible():
    r = chat_format.Renderer(chat_format.Template(), ["<|endoftext|>"])
    rng = random.Random(0)
    parts = ["<turn>", "</turn>", "<text>", "<|endoftext|>", "<", "\\", "<\\/turn>", "<\\\\turn>", "x", "/turn>", "\n", ""]
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=2)), "".join(rng.choices(parts, k=5))) for _ in range(3)]
        text, spans = r.render(turns)
        assert r.read(text) == turns and [r.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_chat_mask(spark):
    rows = [(1, 1, "assistant", "<turn> naïve 漢字🙂."), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "assistant", ""), (2, None, "assistant", "a </turn>"), (2, None, "assistant", "a </turn>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df, queries._tokenizer()).collect()}
    r = chat_format.Renderer(chat_format.Template(), chat_format.special_tokens(queries._tokenizer()))
    learned = lambda x: [r.unescape(x["formatted"][a:b]) for a, b in chat_format.masked_spans(x["token_starts"], x["token_ends"], x["loss_mask"])]
    assert learned(out[1]) == ["<turn> naïve 漢字🙂."] and learned(out[None]) == [] and learned(out[2]) == ["a </turn>"] * 2
    assert r.read(out[1]["formatted"])[0] == ("user", "")
    assert chat_format.format_conversations(df.limit(0), queries._tokenizer()).count() == 0


# 2


def test_edits_count_like_encoding_again():
    c = bpe_codec.codec(RANKS, PATTERN)
    rng = random.Random(1)
    bits = [" the", "cat", "\n\n", "  ", "é漢", "'s", "12345", " ", "x" * 30, ". ", ""]
    for _ in range(60):
        text = "".join(rng.choices(bits, k=rng.randint(0, 900)))
        tree = token_counts.CountTree(text, c)
        assert tree.total == len(c.encoding.encode_ordinary(text))
        for _ in range(8):
            a, n, new = rng.randint(0, len(text) + 2), rng.randint(0, 900), "".join(rng.choices(bits, k=rng.randint(0, 60)))
            tree.edit(a, n, new)
            text = text[:a] + new + text[a + n :]
            assert "".join(tree.parts) == text and tree.total == len(c.encoding.encode_ordinary(text))


def test_edits_touch_little():
    tree = token_counts.CountTree("word " * 50000, bpe_codec.codec(RANKS, PATTERN))
    whole = tree.encoded_chars
    tree.edit(100_000, 4, "term")
    assert tree.encoded_chars - whole < 2000


def test_counts_on_awkward_rows(spark, awkward):
    edits = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(2).cast("long").alias("length"), F.lit("z y").alias("text")))
    c = bpe_codec.codec(RANKS, PATTERN)
    got = token_counts.count_with_edits(awkward.withColumn("edits", edits), RANKS, PATTERN).collect()
    want = lambda t: (len(c.encode(t)), t[:3] + "z y" + t[5:])
    assert len(got) == len(AWKWARD)
    for r in got:
        n, text = want(r["text"] or "")
        assert (r["n_tokens"], r["edited_text"], r["n_tokens_after"]) == (n, text, len(c.encode(text)))
    assert token_counts.count_with_edits(awkward.withColumn("edits", F.lit(None).cast(token_counts.EDITS)).limit(3), RANKS, PATTERN).where("n_tokens <> n_tokens_after").count() == 0


# 3


def lm_base(rows, training):
    counts = Counter()
    for t in training:
        counts.update(words(t))
        counts[b"\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in rows:
        w = [*words(t), b"\n"]
        out.append((len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out, n


class BruteTree:
    """The model by dictionaries of word tuples, one token after another."""

    def __init__(self, training, m=suffix_tree_lm):
        lists = [[*words(t), b"\n"] for t in training]
        unigram = Counter(w for x in lists for w in x)
        self.n, self.v = sum(unigram.values()), len(unigram)
        self.share = {w: (c + 1) / (self.n + self.v + 1) for w, c in unigram.items()}
        least = m.least_count(self.n)
        self.alphabet = {w for w, c in unigram.items() if c >= least or w == b"\n"}
        self.other = 1 - sum(self.share[w] for w in self.alphabet)
        after = {}
        for x in lists:
            for i in range(len(x)):
                for d in range(1, m.MAX_DEPTH + 1):
                    if i >= d and all(w in self.alphabet for w in x[i - d : i]):
                        after.setdefault(tuple(x[i - d : i]), Counter())[self.symbol(x[i])] += 1
        self.kept, self.left = {}, {}
        for ctx in sorted(after, key=len):
            total = sum(after[ctx].values())
            if total < least:
                continue
            kept = {s: c for s, c in after[ctx].items() if 5 * c >= least}
            left = 1 - sum(c - m.DISCOUNT for c in kept.values()) / total
            p = {s: (c - m.DISCOUNT) / total + left * self.p(ctx[1:], s) for s, c in kept.items()}
            kl = sum(x * math.log(x / self.p(ctx[1:], s)) for s, x in p.items()) + max(1 - sum(p.values()), 0) * math.log(left)
            if kl >= m.DIVERGENCE and kl * total >= m.GAIN:
                self.kept[ctx], self.left[ctx] = p, left

    def symbol(self, w):
        return w if w in self.alphabet else None

    def p(self, ctx, s):
        """The share of a symbol (None: the class of other words) after a context of symbols."""
        for k in range(len(ctx)):
            if ctx[k:] in self.left:
                return self.kept[ctx[k:]].get(s) or self.left[ctx[k:]] * self.p(ctx[k + 1 :], s)
        return self.other if s is None else self.share[s]

    def score(self, text, depth=suffix_tree_lm.MAX_DEPTH):
        x, total = [*words(text), b"\n"], 0.0
        for i, w in enumerate(x):
            s, ctx = self.symbol(w), tuple(self.symbol(u) for u in x[max(0, i - depth) : i])
            inside = 1.0 if s else self.share.get(w, 1 / (self.n + self.v + 1)) / self.other
            total += math.log10(self.p(ctx, s) * inside)
        return total


def test_lm_query_like_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_suffix_tree_lm(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    training = [t for i, t in docs.items() if not held[i]]
    base, n = lm_base(docs.values(), training)
    brute = BruteTree(training)
    assert len(brute.left) > 30 and any(len(x) > 1 for x in brute.left)
    for (i, t), (tokens, known, score) in zip(docs.items(), base, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], tokens, known, n) and r["base_score"] == pytest.approx(score)
        assert r["score"] == pytest.approx(brute.score(t))


@pytest.mark.parametrize("head, hot, batch", [(5e-7, 1000, 1_000_000), (2.0, 3, 500)])
def test_lm_like_brute_force(spark, monkeypatch, head, hot, batch):
    """With states of three words, all values joined, hot contexts in parts and small batches."""
    for name, value in (("HEAD_SHARE", head), ("HOT", hot), ("BATCH_PAIRS", batch), ("GROUP_PAIRS", batch), ("MIN_COUNT", 5), ("GAIN", 5.0)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(200)] + ["p q r s"] * 30
    for _ in range(100):
        # the next of u and v depends on the two before, not on one alone
        w = [rng.randrange(2), rng.randrange(2)]
        while len(w) < 40:
            w.append(w[-1] ^ w[-2] ^ (rng.random() < 0.1))
        lines.append(" ".join("uv"[x] for x in w))
    rng.shuffle(lines)
    brute = BruteTree(lines)
    assert all(x in brute.left for x in ((b"p",), (b"u", b"v"), (b"v", b"u")))
    for ctx in [(), *list(brute.left)[:: max(1, len(brute.left) // 20)]]:
        assert sum(brute.p(ctx, s) for s in [*brute.alphabet, None]) == pytest.approx(1)
    rows = [(i, x) for i, x in enumerate(lines[:60])] + [(-1, "p q r s u v v u zz P Q r"), (-2, None), (-3, "u"), (None, "zz u v u")]
    model = suffix_tree_lm.fit(spark.createDataFrame(list(enumerate(lines)), SCHEMA).repartition(3))
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got == {i: pytest.approx(brute.score(x)) for i, x in rows}


def test_lm_has_all_frequent_words(spark, monkeypatch):
    """66,000 words come often enough, more than 16 bits can number; what follows depends on the third word back."""
    for name, value in (("MIN_COUNT", 3), ("GAIN", 1.0)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    phrases = [f"s{i}{x} p{i} q{i} r{i}{x}" for i in range(11000) for x in "ab"] * 3
    random.Random(6).shuffle(phrases)
    lines = [" ".join(phrases[i : i + 20]) for i in range(0, len(phrases), 20)]
    brute = BruteTree(lines)
    assert len(brute.alphabet) == 66001 and sum(len(x) == 3 for x in brute.left) > 20000
    rows = [*enumerate(lines[:200]), (-1, "s7a p7 q7 r7b s8b p8 q8 r8b zz r9a"), (-2, None)]
    model = suffix_tree_lm.fit(spark.createDataFrame(list(enumerate(lines)), SCHEMA).repartition(3))
    assert len(model.alphabet) == 66000
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got == {i: pytest.approx(brute.score(x)) for i, x in rows}


def test_lm_bar_is_as_high_for_many_tokens(spark, monkeypatch):
    """Among a million tokens words and contexts that came three times count as they do among a thousand."""
    assert suffix_tree_lm.least_count(10**12) == suffix_tree_lm.least_count(10) == suffix_tree_lm.MIN_COUNT
    for name, value in (("MIN_COUNT", 3), ("GAIN", 1.0)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    rng = random.Random(8)
    lines = [" ".join("abcdefgh"[rng.randrange(8)] for _ in range(2000)) for _ in range(500)] + ["rare words come thrice"] * 3
    brute = BruteTree(lines)
    assert brute.n > 10**6 and {(b"rare",), (b"rare", b"words"), (b"rare", b"words", b"come")} & set(brute.left)
    model = suffix_tree_lm.fit(spark.createDataFrame(list(enumerate(lines)), SCHEMA).repartition(3))
    assert len(model.alphabet) == 12
    rows = [(1, "rare words come thrice"), (2, "a b rare words"), (3, None)]
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in suffix_tree_lm.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: pytest.approx(brute.score(x)) for i, x in rows}
    assert got[1][0] > got[1][1] + 10


def test_lm_gain_on_held_out(spark):
    """Held-out texts gain a twentieth of a log10 a token over the base at least."""
    sums = queries.op3_suffix_tree_lm(spark, SF.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] - sums[1] > 0.05 * sums[2]


def test_lm_awkward(spark, awkward):
    model = suffix_tree_lm.fit(awkward)
    got = suffix_tree_lm.score(awkward, model).collect()
    base, _ = lm_base([t for _, t in AWKWARD], [t for _, t in AWKWARD])
    assert sorted(round(r["base_score"], 6) for r in got) == sorted(round(b[2], 6) for b in base)
    none = suffix_tree_lm.score(awkward, suffix_tree_lm.fit(awkward.limit(0))).collect()
    assert len(none) == len(AWKWARD) and all(r["score"] == 0 for r in none)
    assert suffix_tree_lm.score(awkward.limit(0), model).count() == 0


# 4


def test_decontamination_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, BASE), (1, BASE), (2, None), (3, ""), (4, "TWO-words"), (5, "漢字"), (None, "the moon")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(awkward, bench).collect()}
    assert sum(1 for _ in got) <= len(AWKWARD) and decontaminate.contamination(awkward, bench).count() == len(AWKWARD)
    n = len(BASE.split())
    assert got[4, n]["n_hit"] == n and got[4, n]["items"] == ["1"] and got[9, 2]["items"] == ["4"] and got[9, 2]["contaminated"]
    assert got[7, n + 20000]["n_hit"] == n and not got[7, n + 20000]["contaminated"]
    assert got[1, 0]["n_hit"] == 0 and not got[1, 0]["contaminated"] and got[11, n]["n_hit"] == n - 1
    assert decontaminate.contamination(awkward, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(awkward.limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(1, BASE), (4, "two words")], "item_id long, text string")
    take = lambda: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(awkward, bench).collect())
    want = take()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert take() == want


# 5


def brute_components(rows, n=5, percent=75):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(s), low.get(find(i), k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_duplicates(spark, rounds, monkeypatch):
    rng = random.Random(3)
    rows = []
    for base in range(25):
        text = [f"{rng.choice('abcdefg')}{rng.randint(0, 60)}" for _ in range(rng.choice([3, 5, 12, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(jaccard_join.node_components, "__defaults__", (rounds,))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7)).drop("text_hash")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_components(rows))


def test_near_duplicates_query_like_brute_force(spark, docs):
    got = sorted(map(tuple, queries.op5_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(brute_components(sorted(docs.items())))


def test_near_but_unlinked_group_makes_few_pairs(spark, monkeypatch):
    """Of 400 sets that all share a part but hardly link, only pairs that may link become rows, and no link is lost."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(400):
        copy = list(base)
        for j in rng.sample(range(90), 4):
            copy[j] = f"z{i}-{j}"
        rows.append((i, " ".join(copy)))
    seen = []
    verified = jaccard_join.verified

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("text_hash")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_components(rows))
    assert sum(seen) < 400 * 399 / 2 / 10


def test_near_duplicates_awkward(spark, awkward):
    got = sorted(map(str, map(tuple, jaccard_join.near_duplicates(awkward).drop("text_hash").collect())))
    assert got == sorted(map(str, brute_components(AWKWARD)))
    assert jaccard_join.near_duplicates(awkward.limit(0)).count() == 0


# 6


def test_codec_like_library(spark, awkward, monkeypatch):
    c = bpe_codec.codec(RANKS, PATTERN)
    rng = random.Random(4)
    for part in (1, 3, 1 << 16):
        monkeypatch.setattr(bpe_codec, "PART_CHARS", part)
        for _ in range(1500):
            t = "".join(rng.choices(" \n\t\x1f\x85  aB9é漢🙂'.s!", k=rng.randint(0, 20)))
            assert list(c.encode(t)) == c.encoding.encode_ordinary(t)
    both = bpe_codec.decode(bpe_codec.encode(awkward, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(both) == len(AWKWARD)
    for r in both:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["token_ids"] == c.encoding.encode_ordinary(r["text"] or "")
    assert bpe_codec.encode(awkward.limit(0), RANKS, PATTERN).count() == 0


def test_codec_query(spark, docs):
    c = bpe_codec.codec(RANKS, PATTERN)
    for r in queries.op6_bpe_codec(spark, SF).collect():
        ids = c.encoding.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# 7


def test_exact_dedup_awkward(spark, awkward):
    got = exact_dedup.label_copies(awkward).collect()
    assert len(got) == len(AWKWARD)
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    for g in groups.values():
        assert all(r["group_size"] == len(g) for r in g) and sum(r["kept"] for r in g) == 1
        keys = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {r["keep_id"] for r in g} == {min(keys) if keys else None}
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)
    assert exact_dedup.label_copies(awkward.limit(0)).count() == exact_dedup.drop_copies(awkward.limit(0)).count() == 0


def test_exact_dedup_heavy(spark):
    rows = [(i, "same  text" if i % 2 else f"text {i // 6}") for i in range(3000, 0, -1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    want = {}
    for i, t in rows:
        want.setdefault(" ".join(t.split()), []).append(i)
    for tracked in (8, 1024):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.label_copies(df, tracked=tracked).collect()}
        assert got == {i: (min(g), len(g), i == min(g)) for g in want.values() for i in g}
        assert {r["doc_id"] for r in exact_dedup.drop_copies(df, tracked=tracked).collect()} == {min(g) for g in want.values()}


# 8

PAGE = """<!DOCTYPE html><html><head><title>Head title</title><style>p{{x}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site <a href=/>name</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h1>A &amp; B&nbsp;&lt;tag&gt;</h1><p>First <b>bold</b>face   para<br>graph with some words in it.<p>Second one, unclosed<!-- hidden --><div class="ad">Buy now</div>
<table><tr><td>cell one<td>cell two</table><aside>Side</aside><form><input value=1>Form text</form>{close}
<section id="comments"><p>First! nice post</p></section><footer>&copy; 2020</footer></body></html>"""
WANT = "A & B <tag> First boldface para graph with some words in it. Second one, unclosed cell one cell two"


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>")])
def test_extraction(open_, close):
    assert html_extract.main_text(PAGE.format(open=open_, close=close), {}) == WANT


def test_extraction_awkward(spark):
    pages = [(1, "u", None, "t"), (2, "u", "", "t"), (None, None, PAGE.format(open="<article>", close="</article>"), "t"), (4, "u", "<p>unclosed <b", "t"), (5, "u", "plain < text & more", "t"), (5, "u", "plain < text & more", "t"), (6, "u", "<article>" + "<p>word</p>" * 20000 + "</article>", "t"), (7, "u", "<script>never ends", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert got[:3] == [(1, ""), (2, ""), (None, WANT)] and got[4] == got[5] == (5, "plain < text & more") and got[6] == (6, " ".join(["word"] * 20000)) and got[7] == (7, "")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_extraction_query_like_the_articles(spark):
    """Each page's text is that of its article, read by another parser; the scan, not the reader, leaves out the rest."""
    got = {r["page_id"]: r for r in queries.op8_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert len(got) == len(pages) >= 50

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.parts.append("" if tag in html_extract.INLINE else " ")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag not in ("article", "footer")
            self.parts.append("" if tag in html_extract.INLINE else " ")

        def handle_data(self, data):
            self.parts.append(data if self.inside else "")

    for page in pages:
        gold = Article()
        gold.feed((page["html"] or "").replace("<footer", "</article><footer"))
        want = " ".join("".join(gold.parts).split())
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (want, len(want))
        found = html_extract.tokens(page["html"] or "")
        a, b = html_extract.best_region([html_extract.score(t, weights) for t in found])
        assert any(place and text.split() for text, place, *_ in found[:a] + found[b:])


def test_extraction_keeps_names_that_only_resemble():
    page = '<nav><a href=1>x</a></nav><article><h1>Markets</h1><p class="share-price">Price 5</p><div class="search-engines">Engines are good</div><div class="cookie-notice">No</div><p>End.</p></article>'
    assert html_extract.main_text(page, {}) == "Markets Price 5 Engines are good End."


def test_extraction_takes_linear_time():
    start = time.process_time()
    for page in ("<a " * 100_000, "<div>" * 30_000 + "</b>" * 30_000, "<a '>" * 50_000, '<a "' * 50_000 + ">", "<!--" * 50_000, "<script " * 50_000, "<" * 50_000, "word " * 200_000):
        html_extract.main_text(page, {})
    assert time.process_time() - start < 8


LINE = " ".join(f"word{i}." for i in range(30))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>L</p><blockquote class=comment>A quoted passage</blockquote></main>", "L A quoted passage"),
        ("<article><p>L</p><section class=related><h3>Related work</h3><p>L</p></section></article>", "L Related work L"),
        ("<article><p>L</p><section class=related><h3>Related</h3><ul><li><a href=1>L</a></ul></section></article>", "L"),
        ("<article><p>A L</p></article><div>L L L L</div><article>B L</article><footer>x</footer>", "A L B L"),
        ("<article><p>L</p><search>find it</search><div class=ad>L L</div>end</article>", "L end"),
        ("<div><p>L</p><div class=comments><p>L</p></div></div>", "L"),
        ("<article>L</article><div>" + "<div class=related>" * 3000 + "L", "L"),
    ],
)
def test_extraction_by_what_elements_hold(page, want):
    """Quotations, prose under names of link lists and second articles stay; link lists, adverts and comments go."""
    for weights in ({}, {"in": 1.0, "out": -3.0, "free": 1.0}):
        assert html_extract.main_text(page.replace("L", LINE), weights).replace(LINE, "L") == want


def test_extraction_is_decided_by_the_scan(spark, monkeypatch):
    """With the whole page in place of the runs that the scan finds, nearly every page changes."""
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    before = [html_extract.main_text(x, weights) for x in pages]
    monkeypatch.setattr(html_extract, "best_runs", lambda scores, price: [(0, len(scores))] if price != html_extract.CUT else [])
    assert sum(html_extract.main_text(x, weights) != y for x, y in zip(pages, before, strict=True)) > 0.9 * len(pages)


def test_best_runs_are_best():
    rng = random.Random(6)
    for _ in range(300):
        s, price = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 8))], rng.choice([0.25, 1, 2])
        runs = html_extract.best_runs(s, price)
        assert all(a < b for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:], strict=False))
        masks = range(1 << len(s))
        worth = (sum(x for i, x in enumerate(s) if m >> i & 1) - price * (m & ~(m << 1)).bit_count() for m in masks)
        assert sum(sum(s[a:b]) - price for a, b in runs) == pytest.approx(max(worth))


def test_best_region_is_best():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == pytest.approx(max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))]))


# 9


def test_toxicity_learns_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        w = [f"w{rng.randint(0, 300)}" for _ in range(12)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["insult"] * a + ["group"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a and b)))
    df = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 1000").select("doc_id", "toxic"))
    held = [r for r in toxicity.score(df, model).collect() if r["doc_id"] >= 1000]
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in held]) > 0.97


def test_toxicity_query_on_held_out_labels(spark):
    """Labelled documents that the query may not learn from are told apart."""
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.95 * len(rows) and len(rows) > 500
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc >= 0.95


def test_toxicity_slices_and_string_keys(spark, monkeypatch):
    """A hundred texts of a megabyte are scored a few at a time; keys may be strings."""
    batch = pa.RecordBatch.from_pydict({"text": ["fool " * 200_000] * 100})
    assert max(x.num_rows for x in in_slices(iter([batch]), "text")) <= 2
    rows = [(f"d{i}", "you fool" if i % 2 else "you friend") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = df.select("doc_id", F.col("text").contains("fool").cast("int").alias("toxic"))
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert all((r["score"] >= 0.5) == ("fool" in r["text"]) for r in got)


def test_toxicity_awkward(spark, awkward, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = toxicity.score(awkward.drop("score"), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(awkward, labels.limit(0)) is None and toxicity.score(awkward, None).where("score <> 0").count() == 0
    marked = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (7, 0)], "doc_id long, toxic int")
    assert toxicity.score(awkward.limit(0), toxicity.fit(awkward, marked)).count() == 0


# 10


def brute_repeats(rows, length=100):
    out, seen = {}, set()
    for key, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        out[key] = bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


def test_repeats_like_brute_force(spark):
    rng = random.Random(7)
    passages = ["".join(rng.choices("abcd ", k=rng.randint(80, 400))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choices("abcdé\x00 ", k=rng.randint(0, 300))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 300), (201, "x" * 900), (202, "ab" * 90), (203, rows[5][1]), (204, rows[5][1])]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("segment", [101, 230, 1 << 19])
def test_repeats_across_segments_of_long_texts(spark, segment):
    """Passages that start, end or lie at a segment's border, many copies in a batch, repeated rows, keys that are strings."""
    rng = random.Random(segment)
    passages = ["".join(rng.choices("abcdefgh ", k=rng.randint(100, 260))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=rng.randint(1, 150))) for _ in range(rng.randint(1, 9))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, passages[0] + passages[1]) for i in range(80)]
    want = brute_repeats(rows)
    df = spark.createDataFrame([*rows, rows[7]], SCHEMA).repartition(3)
    got = [(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df.select(F.col("doc_id").cast("string"), "text"), segment=segment).collect()]
    assert {int(k): v for k, v in got} == want and len(got) == len(rows) + 1


def test_repeats_query_like_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.op10_suffix_dedup(spark, SF).collect()}
    for i, kept in brute_repeats(sorted(docs.items())).items():
        r, n = got[i], len((docs[i] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (n, n - len(kept), hashlib.sha256(kept).hexdigest())


def test_maximal_repeats_have_all_occurrences():
    texts = [b"..LEFTanchorRIGHT..", b"##LEFTanchorRIGHT##", b"!!!!!!anchorRIGHT!!", b"@@LEFTanchor@@@@@@@"]
    at = [t.index(b"anchor") for t in texts]
    right, left = np.zeros((4, 16), np.uint8), np.zeros((4, 8), np.uint8)
    n_right, n_left = np.zeros(4, int), np.zeros(4, int)
    for i, (t, p) in enumerate(zip(texts, at, strict=True)):
        r, b = t[p:][:16], t[:p][::-1][:8]
        right[i, : len(r)], left[i, : len(b)] = list(r), list(b)
        n_right[i], n_left[i] = len(r), len(b)
    found = {(a, b): sorted(m.tolist()) for a, b, m in suffix_dedup.maximal_repeats(np.zeros(4, np.uint64), right, n_right, left, n_left, 10)}
    assert found == {(4, 11): [0, 1], (0, 11): [0, 1, 2], (4, 6): [0, 1, 3]}


def test_repeats_awkward(spark, awkward):
    got = suffix_dedup.remove_repeats(awkward)
    assert got.count() == len(AWKWARD) and suffix_dedup.remove_repeats(awkward.limit(0)).count() == 0
    by = {(r["doc_id"], r["n_bytes"]): r for r in got.collect()}
    assert bytes(by[4, len(BASE)]["kept"]) == BASE.encode() and bytes(by[None, len(BASE)]["kept"]) == b""
    assert bytes(by[8, 50000]["kept"]) == b"a" and by[1, 0]["starts"] == []


# the pipeline


def test_pipeline(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [frame]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SF).cache()
        if name != "bpe_codec":
            assert out.columns == frame.columns
        steps.append(out)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1] == ids[-2]
    norm = {}
    for i in sorted(ids[1]):
        norm.setdefault(exact_key(docs[i]), i)
    assert ids[2] == set(norm.values())
    comp = {k: c for k, _, c in brute_components([(i, docs[i]) for i in sorted(ids[2])])}
    assert ids[3] == {i for i in ids[2] if comp[i] == i}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(ids[0] - ids[1]) <= 2 * len(toxic) + 10
    assert corpus_pipeline.run(spark, SF).count() == len(ids[-1])


def test_pipeline_awkward(spark, awkward):
    rows = awkward.withColumnsRenamed({"n": "_id", "key": "_digest", "score": "text_hash"})
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
    assert {r["doc_id"] for r in rows.collect()} >= {1, 4, 6, 7, 8, 9}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), SF).count() == 0


def exact_key(text):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_lm_keys_at_hand_are_bounded(spark, monkeypatch):
    """However many keys a tree has; others, and those that a small bitmap takes for keys, are joined, with the same scores."""
    for name, value in (("MIN_COUNT", 3), ("GAIN", 1.0)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    rng = random.Random(9)
    phrases = [f"s{i} p{i} q{i}" for i in range(300) for _ in range(3 + i % 5)]
    rng.shuffle(phrases)
    lines = [" ".join(phrases[i : i + 20]) for i in range(0, len(phrases), 20)]
    brute, texts = BruteTree(lines), spark.createDataFrame(list(enumerate(lines)), SCHEMA).repartition(3)
    for most, bits in ((40, 1 << 26), (10**6, 1 << 10)):
        monkeypatch.setattr(suffix_tree_lm, "HEAD_MOST", most)
        monkeypatch.setattr(suffix_tree_lm, "BITMAP_BITS", bits)
        model = suffix_tree_lm.fit(texts)
        at_hand = len(suffix_tree_lm._head(model.gains, 0)[0])
        assert at_hand <= most and model.gains.count() > 600
        assert len(suffix_tree_lm.bitmap(model.gains, "e", "f")) * 64 >= min(bits, 16 * 600)
        got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(texts, model).collect()}
        assert got == {i: pytest.approx(brute.score(x)) for i, x in enumerate(lines)}
