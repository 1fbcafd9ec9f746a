"""Benchmark decontamination over a distributed positional inverted index; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import if_few, released, shared_dir, stored

WINDOW = 8
#: At most so many rows are broadcast (terms: about 20 MB; windows: about 40 MB); beyond it terms go in blocks, windows by a shuffled join.
BLOCK_TERMS, BROADCAST_WINDOWS = 200_000, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; null has none."""
    cut = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    return F.transform(cut, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (item_id, window): ``width`` consecutive words each; a shorter item is one window, one without words none."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window")).distinct()


@dataclass
class Index:
    """Stored postings (doc, th, term, pos, around), documents (doc, th, n_words) and windows with their two rarest terms.

    ``doc`` is the row's id (null: the smallest long) and ``th`` its text's hash, which tell rows apart; ``around`` the
    words from ``width - 1`` before a posting to ``width - 1`` behind it, ``before`` how many of them precede it.
    """

    postings: DataFrame
    documents: DataFrame
    windows: DataFrame
    width: int
    few_windows: bool


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("th"),
        words_of(F.col(f"`{text}`")).alias("w"),
    )


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The terms in parts that are small enough to broadcast; their number follows from their count."""
    n = terms.count()
    parts = max(1, -(-n // (BLOCK_TERMS // 2)))
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)) for k in range(parts)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def build_index(docs: DataFrame, items: DataFrame, folder: str, width: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Store the postings that the benchmark's windows need.

    First scan: how often each benchmark term occurs in the whole corpus (map-side counts, so no hot term). Each
    window then takes its two rarest terms. Second scan: postings of those terms alone, and for each row its word
    count as the posting of the empty term that ends it. Both filter where words are cut, by a broadcast of at most
    BLOCK_TERMS terms at a time. Other columns of ``docs`` are ignored.
    """
    windows = stored(windows_of(items, width), folder, "windows")
    keyed = _keyed(docs, doc_id, text)
    vocabulary = stored(windows.select(F.explode("window").alias("term")).distinct(), folder, "vocabulary")
    counts = _union([keyed.select(F.explode("w").alias("term")).join(block, "term").groupBy("term").count() for block in _blocks(vocabulary)])
    counts = stored(counts, folder, "counts")
    # the two rarest positions of each distinct window; a window with a term that occurs nowhere has no match
    each = windows.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    placed = each.select("window", F.posexplode("window").alias("at", "term")).join(counts, "term")
    ranked = placed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("count", "term", "at"))).alias("ranked")).where(F.size("ranked") == F.size("window"))
    ready = each.join(ranked, "window").select(
        "window", "items", F.xxhash64("window").alias("wid"), F.col("ranked")[0]["term"].alias("a"), F.col("ranked")[0]["at"].alias("a_at"), F.get("ranked", F.lit(1))["term"].alias("b"), F.get("ranked", F.lit(1))["at"].alias("b_at")
    )
    ready = stored(ready, folder, "ready")
    few = ready.count() <= BROADCAST_WINDOWS
    terms = ready.select(F.explode(F.array("a", "b")).alias("term")).where("term IS NOT NULL").unionAll(ready.sparkSession.createDataFrame([("",)], "term string")).distinct()
    terms = stored(terms, folder, "terms")
    ended = keyed.select("doc", "th", F.concat("w", F.array(F.lit(""))).alias("w"))
    found = _union([ended.select("doc", "th", "w", F.posexplode("w").alias("pos", "term")).join(block, "term") for block in _blocks(terms)])
    around = F.when(F.col("term") != "", F.slice("w", F.greatest(F.col("pos") - width + 2, F.lit(1)), 2 * width - 1))
    postings = stored(found.select("doc", "th", "term", "pos", around.alias("around"), F.least(F.col("pos"), F.lit(width - 1)).alias("before")), folder, "postings")
    documents = postings.where("term = ''").select("doc", "th", F.col("pos").alias("n_words"))
    return Index(postings.where("term != ''"), documents, ready, width, few)


def exact_matches(index: Index) -> DataFrame:
    """Occurrences of windows: (doc, th, start, length, items), each once.

    The rarest term's postings, moved back by its offset, meet the second rarest's; what both agree on is compared
    word by word with the words around the posting.
    """
    windows = F.broadcast(index.windows) if index.few_windows else index.windows
    from_a = index.postings.join(windows, F.col("term") == F.col("a")).where(F.col("pos") >= F.col("a_at"))
    from_a = from_a.where(F.slice("around", F.col("before") - F.col("a_at") + 1, F.size("window")) == F.col("window")) if index.few_windows else from_a
    from_a = from_a.select("doc", "th", "wid", (F.col("pos") - F.col("a_at")).alias("start"), F.size("window").alias("length"), "items", "b", "before", "a_at", "around", "window")
    second = windows.where("b IS NOT NULL").select("wid", "b", "b_at")
    from_b = index.postings.select("doc", "th", "term", "pos").join(second, F.col("term") == F.col("b")).select("doc", "th", "wid", (F.col("pos") - F.col("b_at")).alias("start"))
    alone = from_a.where("b IS NULL")
    both = from_a.where("b IS NOT NULL").join(from_b, ["doc", "th", "wid", "start"], "left_semi")
    met = alone.unionByName(both)
    met = met.where(F.slice("around", F.col("before") - F.col("a_at") + 1, F.size("window")) == F.col("window"))
    return met.select("doc", "th", "start", "length", "items").distinct()


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """Where a window's two rarest terms stand within ``slop`` words of each other, in any order: (doc, th, start, end, items).

    Positions meet by buckets of ``slop`` words, so a document's postings aren't paired with each other throughout.
    """
    windows = F.broadcast(index.windows) if index.few_windows else index.windows
    bucket = F.floor(F.col("pos") / slop)
    a = index.postings.join(windows, F.col("term") == F.col("a")).where("b IS NOT NULL").select("doc", "th", "wid", "items", F.col("pos").alias("a_pos"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = index.postings.join(windows, F.col("term") == F.col("b")).select("doc", "th", "wid", F.col("pos").alias("b_pos"), bucket.alias("bucket"))
    near = a.join(b, ["doc", "th", "wid", "bucket"]).where((F.abs(F.col("a_pos") - F.col("b_pos")) <= slop) & (F.col("a_pos") != F.col("b_pos")))
    return near.select("doc", "th", F.least("a_pos", "b_pos").alias("start"), F.greatest("a_pos", "b_pos").alias("end"), "items").distinct()


def contamination(index: Index) -> DataFrame:
    """Per row: doc, th, n_words, n_hit (words inside any occurrence), item_ids (those with occurrences, sorted as strings)."""
    matches = exact_matches(index)
    spans = matches.groupBy("doc", "th").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    hit = spans.select("doc", "th", covered.alias("n_hit"), "item_ids")
    return index.documents.join(hit, ["doc", "th"], "left").select(
        "doc", "th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(build_index(docs, items, shared_dir(spark)))
    return found.select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= 2).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of any benchmark item go; a run of WINDOW words in order is no chance."""
    released(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    folder = shared_dir(spark)
    found = contamination(build_index(docs, items, folder))
    leaked = if_few(stored(found.where(F.size("item_ids") >= 1).select("doc", "th").distinct(), folder, "leaked"))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == leaked["doc"]) & (F.xxhash64(docs["text"]) == leaked["th"])
    return docs.join(leaked, same, "left_anti")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::varchar AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS g, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM grams JOIN windows USING (g, n)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
