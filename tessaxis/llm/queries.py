"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

import hashlib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaxis.llm import bpe_codec, chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, merkle, packing, prefix_trie, suffix_dedup, suffix_tree_lm, token_counts, toxicity
from tessaxis.llm.common import crc_mod, in_slices, table


def _bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chat_digests(df: DataFrame, controls: list[str]) -> DataFrame:
    """Digests of formatted conversations, read back from the texts and masks."""

    def run(batches):
        r = chat_format.Renderer(chat_format.Template(), controls)
        for pdf in batches:
            rows = []
            for conv, text, starts, ends, mask in zip(pdf["conv_id"], pdf["formatted"], pdf["token_starts"], pdf["token_ends"], pdf["loss_mask"], strict=True):
                turns = r.read(text)
                learned = "".join(r.unescape(text[a:b]) for a, b in chat_format.masked_spans(starts, ends, mask))
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = df.schema["conv_id"].dataType.simpleString()
    return df.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(chat_format.format_conversations(rows, _tokenizer()), chat_format.special_tokens(_tokenizer()))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document, placed by checksums of its id: a cut, an insertion and a replacement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))) + 1
    at = lambda salt: F.crc32(F.concat_ws("/", F.lit(salt), F.col("doc_id").cast("string")).cast("binary")) % n
    edit = lambda salt, length, text: F.struct(at(salt).alias("start"), F.lit(length).cast("long").alias("length"), F.lit(text).alias("text"))
    edits = F.array(edit("cut", 40, ""), edit("insert", 0, " an added remark, with 12 new words\n"), edit("replace", 7, "it's"))
    counted = token_counts.count_with_edits(docs.withColumn("edits", edits), *_bpe())
    return counted.select("doc_id", "n_tokens", "n_tokens_after", "encoded_chars", "edit_chars", F.sha2("edited_text", 256).alias("edited_sha256"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = suffix_tree_lm.fit(docs.where(crc_mod("doc_id", 7).isin(0, 1, 3, 4, 5, 6)))
    scored = suffix_tree_lm.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def bpe_digests(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Digests of the rows' ids and of the bytes decoded from them; one Python worker a task encodes, decodes and digests."""

    def run(batches):
        for batch in bpe_codec.decoded_batches(bpe_codec.encoded_batches(batches, rank_path, pattern), rank_path, pattern):
            ids = batch.column("token_ids")
            told = [hashlib.sha256(" ".join(map(str, bpe_codec.id_list(x))).encode()).hexdigest() for x in ids]
            digests = [hashlib.sha256(x.as_py() or b"").hexdigest() for x in batch.column("decoded")]
            n = pc.list_value_length(ids).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(told, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, *_bpe())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, held against rows of which a third have their text in lower case."""
    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(crc_mod("doc_id", 3) == 0, merkle.leaf(docs, columns, {"text": merkle.lowered("text")}))
    return merkle.manifest(docs, columns, changed=changed)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_suffix_tree_lm, op4_decontamination, op5_jaccard_join, op6_bpe_codec, op7_exact_dedup, op8_html_extract, op9_toxicity, op10_suffix_dedup, op11_packing, op12_merkle, op13_prefix_trie)}

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a text of ASCII characters, as a number.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"

ORACLES = {
    "op1_chat_format": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
  sum(19 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*(/?turn>|text>|\|endoftext\|>)')) + len(regexp_extract_all(text, '<\\*(/?turn>|text>|\|endoftext\|>)')))::BIGINT AS formatted_chars FROM rows GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g""",
    "op4_decontamination": rf"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array({_ASCII}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, w[i:i + 12] AS win FROM starts),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
cand AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM cand) c JOIN wins USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_merkle": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
  sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
  CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered FROM documents),
tree AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM docs
  UNION ALL SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 8),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
walk AS (SELECT doc_id, lang, 0 AS lvl, pos, n, coalesce(tampered, leaf) AS cur, '' AS proof FROM docs
  UNION ALL SELECT w.doc_id, w.lang, w.lvl + 1, w.pos // 8, (any_value(w.n) + 7) // 8, sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.cur ELSE t.h END, '' ORDER BY t.pos)),
    any_value(w.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
  FROM walk w JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.pos // 8 = w.pos // 8 WHERE w.n > 1 GROUP BY w.doc_id, w.lang, w.lvl, w.pos),
up AS (SELECT w.doc_id, w.lang, 0 AS lvl, s.pos, s.n, w.cur, w.proof, s.subroot FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT w.doc_id, w.lang, w.lvl + 1, w.pos // 8, (any_value(w.n) + 7) // 8, sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.cur ELSE t.h END, '' ORDER BY t.pos)),
    any_value(w.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), ''), any_value(w.subroot)
  FROM up w JOIN top t ON t.lvl = w.lvl AND t.pos // 8 = w.pos // 8 WHERE w.n > 1 GROUP BY w.doc_id, w.lang, w.lvl, w.pos)
SELECT d.doc_id, d.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = r.h AS verified
FROM docs d JOIN up u ON u.doc_id = d.doc_id AND u.n = 1, (SELECT h FROM top WHERE n = 1) r""",
    "op13_prefix_trie": rf"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
built AS (SELECT o.conv_id, list_concat(coalesce(b.turns, [])[:h], o.turns[h + 1:]) AS turns FROM (SELECT *, ({_CRC.format("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
steps AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built),
nodes AS (SELECT depth, turns[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * octet_length(encode(n.path[n.depth]['t'])) ELSE 0 END AS own FROM nodes n LEFT JOIN kids k USING (depth, path)),
sums AS (SELECT depth, path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT n_children, own, unnest(range(0, depth + 1)) AS depth, path AS whole FROM full_) x, LATERAL (SELECT x.whole[:x.depth] AS path) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (depth, path) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.path[:f.depth - 1]""",
}
