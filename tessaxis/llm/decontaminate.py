"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Each item of the benchmark gives windows of n consecutive words (an item of fewer words, but not none, gives one window
of all of them). A window must be contained whole, so its necessary prefix is one word: the rarest, by how many words
of the documents it makes up. Documents' words are joined with the windows' prefix words; the position of the prefix
word in the window and the two lengths bound where a window can lie; then the words from there are compared with the
window's, all of them.

Words are the runs of ASCII digits, letters and all non-ASCII characters after lower-casing A-Z. Null and empty texts
have no words and are never contaminated; repeated benchmark rows count as one item by item_id; an empty benchmark hits
nothing; rows of the benchmark without item_id mark words and name no item. The windows are broadcast while they are under
BROADCAST_BYTES, and one pass over the documents gives all. Beyond that the documents' words are written once with a number
for each row, dealt out by prefix word, and rows without hits come from a left join on the numbers, so no key is common to
all documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaxis.llm.common import LOWER, UPPER, written

WINDOW, BROADCAST_BYTES = 13, 32 << 20


def word_list(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, documents: DataFrame, text: str = "text", item: str = "item_id", n: int = WINDOW) -> DataFrame:
    """item, words, anchor (the prefix word) and at (its place in the window, from 0), once each."""
    items = benchmark.select(F.col(item).alias("item"), word_list(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    found = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("words")).distinct()
    vocabulary = found.select(F.explode("words").alias("anchor")).distinct()
    small = vocabulary.agg(F.sum(F.octet_length("anchor") + 24)).first()[0] or 0
    text_words = documents.select(F.explode(word_list(text)).alias("anchor"))
    counts = text_words.join(F.broadcast(vocabulary) if small <= BROADCAST_BYTES else vocabulary, "anchor").groupBy("anchor").agg(F.count("*").alias("c"))
    placed = found.select("item", "words", F.posexplode("words").alias("at", "anchor")).join(counts, "anchor", "left")
    # words that no document has make a window impossible: its rarest word has no occurrence to join
    rarest = F.min_by(F.struct("anchor", "at"), F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("anchor"), F.col("at")))
    return placed.groupBy("item", "words").agg(rarest.alias("r")).select("item", "words", "r.anchor", "r.at")


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = WINDOW) -> DataFrame:
    """One row per row of documents: key, text_hash (xxhash64), n_words, n_hit, items (sorted as strings) and contaminated (a twentieth of the words or more)."""
    found = written(windows(benchmark, documents, text, item, n))
    bytes_ = found.agg(F.sum(F.aggregate("words", F.lit(64), lambda a, w: a + F.octet_length(w) + 8))).first()[0] or 0
    small = bytes_ <= BROADCAST_BYTES
    docs = documents.select(F.col(key).alias(key), F.monotonically_increasing_id().alias("_row"), F.xxhash64(text).alias("text_hash"), word_list(text).alias("_w"))
    docs = docs if small else written(docs)
    start = F.col("pos") - F.col("at")
    span = F.struct(start.alias("a"), (start + F.size("words")).alias("b"))
    same = F.slice("_w", F.greatest(start + 1, F.lit(1)), F.size("words")) == F.col("words")
    if small:
        # a row with the empty word marks the end of each document, so that one pass gives documents without hits too
        marker = found.sparkSession.range(1).select(*(F.lit("" if c == "anchor" else None).cast(t).alias(c) for c, t in found.dtypes))
        exploded = docs.select(key, "_row", "text_hash", "_w", F.posexplode(F.concat("_w", F.array(F.lit("")))).alias("pos", "anchor"))
        lies = (start >= 0) & (start + F.size("words") <= F.size("_w"))
        hits = exploded.join(F.broadcast(found.unionByName(marker)), "anchor").where(F.col("words").isNull() | (lies & same))
        hits = hits.select(key, "_row", "text_hash", F.when(F.col("words").isNull(), F.size("_w")).alias("n_words"), F.col("item").alias("_item"), F.when(F.col("words").isNotNull(), span).alias("span"))
    else:
        ahead = docs.select("_row", F.size("_w").alias("_n"), F.posexplode("_w").alias("pos", "anchor"))
        placed = ahead.join(found, "anchor").where((start >= 0) & (start + F.size("words") <= F.col("_n")))
        met = placed.join(docs.select("_row", "_w"), "_row").where(same).select("_row", F.col("item").alias("_item"), span.alias("span"))
        hits = docs.select(key, "_row", "text_hash", F.size("_w").alias("n_words")).join(met, "_row", "left")
    per = hits.groupBy("_row").agg(F.first(key, ignorenulls=True).alias(key), F.first("text_hash").alias("text_hash"), F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.col("_item").cast("string")).alias("items"), F.collect_set("span").alias("spans"))
    # the union of the spans: sorted by start, each adds what lies beyond the furthest end so far
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(F.array_sort("spans"), zero, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n")))
    n_hit = union["n"]
    return per.select(key, "text_hash", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
