"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import BATCH_BYTES, BROADCAST_IDS, bounded_batches, if_few, memory_of, only_kept, shared_dir, stored, trimmed

#: Signature length.
COORDINATES = 48
#: Hubs a posting list has at most; a list of m members uses about log2 m of them.
HUBS = 8

_MULTIPLIERS = [np.uint64(x | 1) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_XORS = [int(x) for x in np.random.default_rng(12).integers(0, 1 << 62, HUBS)]


@dataclass(frozen=True)
class Shingling:
    """How many words make a shingle, the similarity to reach in percent, and how many coordinates must collide for it.

    At a similarity of 0.8 exactly, fewer than 24 of 48 collide with a probability of about 1e-6; with ``agree`` 1 of 1e-33,
    at the cost of longer prefixes.
    """

    words: int = 5
    percent: int = 80
    agree: int = 24


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle; without words, none.

    Words are runs of anything but ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> list[int]:
    """The coordinate-value pairs as one long each: the coordinate above 32 bits of its smallest hash."""
    return [(k << 32) | int((shingles * a).min() >> np.uint64(32)) for k, a in enumerate(_MULTIPLIERS)]


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signed(docs: DataFrame, width: int, with_sets: bool) -> DataFrame:
    """Per row of (doc_id, th, text): n, class hash (c1, c2), and its pairs or its whole set."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("neardup")
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            n, c1, c2, extra, size, at = [], [], [], [], 0, 0
            for i, text in enumerate(texts):
                s = shingle_set(text, width)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                c1.append(_as_long(digest & (1 << 64) - 1))
                c2.append(_as_long(digest >> 64))
                extra.append(s.view(np.int64) if with_sets else signature(s) if len(s) else [])
                size += 8 * len(extra[-1])
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    span = slice(at, i + 1)
                    made = [pa.array(v, pa.int64()) for v in (n, c1, c2)] + [pa.array(extra, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids[span], hashes[span], *made], names=["doc_id", "th", "n", "c1", "c2", "held"])
                    n, c1, c2, extra, size, at = [], [], [], [], 0, i + 1
        trimmed()

    return docs.select("doc_id", "th", "text").mapInArrow(sign, "doc_id long, th long, n long, c1 long, c2 long, held array<long>")


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Components of (u, v) pairs: (node, label), label the smallest node, by alternating large and small stars.

    Every round is an aggregation by node with map-side minima and a join, written to the shared folder; the number
    of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), folder, f"{name}-0")
    said = None
    for k in range(1, 64):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.where("u != v").distinct(), folder, f"{name}-{k}")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == said:
            break
        said = new
    else:
        raise RuntimeError(f"components of {name} didn't settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _agree(shingling: Shingling) -> Column:
    """Whether sizes nu, nv allow the similarity and signatures hu, hv share enough coordinates."""
    return _sizes_allow(F.col("nu"), F.col("nv"), shingling.percent) & (F.size(F.array_intersect("hu", "hv")) >= shingling.agree)


def _ends_known(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of the classes, once as (u, nu, hu), once as (v, nv, hv)."""
    u, v = (classes.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("held").alias(f"h{k}")) for k in "uv")
    return u, v


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets(reps: DataFrame, docs: DataFrame, classes: DataFrame, shingling: Shingling, folder: str, name: str) -> DataFrame:
    """The whole sets of classes, (rep, s), made again from one text each."""
    wanted = stored(classes.select("rep", "doc", "c1", "c2").join(reps, "rep"), folder, f"{name}-wanted")
    ids = wanted.select(F.col("doc").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    made = _signed(texts, shingling.words, True).select("c1", "c2", F.col("held").alias("s"))
    classed = wanted.select("rep", "c1", "c2")
    return stored(made.join(F.broadcast(classed) if few else classed, ["c1", "c2"]).select("rep", "s").dropDuplicates(["rep"]), folder, f"{name}-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, shingling: Shingling, folder: str, name: str) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    a, b = (sets.select(F.col("rep").alias(k), F.col("s").alias(f"s{k}")) for k in "uv")
    both = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("su", "sv")).cast("long"))
    return stored(both.where(F.col("both") * 100 >= (F.size("su") + F.size("sv") - F.col("both")) * shingling.percent).select("u", "v"), folder, f"{name}-edges")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct()


def _areas(open_: DataFrame, folder: str) -> DataFrame:
    """(rep, label, area) of the open (rep, label, least): components that share a list, or are linked by such, lie in one area."""
    shared = connected(open_.select(F.col("label").alias("u"), F.col("least").alias("v")), folder, "areas")
    return stored(open_.select("rep", "label").distinct().join(shared.select(F.col("node").alias("label"), F.col("label").alias("area")), "label"), folder, "placed")


def _differing(placed: DataFrame, sets: DataFrame, shingling: Shingling, folder: str) -> DataFrame:
    """(rep, area, label, n, d, w): what a member's set and its area's middle don't share, and what that costs.

    The middle of an area M holds the shingles that more than half of its members hold. With A' = A ^ M, what A and B don't
    share numbers |A'| + |B'| - 2 |A' & B'|, and they link if that is at most (100 - p) / (100 + p) of |A| + |B| (p percent).
    With w(A) = (100 + p) |A'| - (100 - p) |A|, they link just if w(A) + w(B) <= 2 (100 + p) |A' & B'|.
    """
    p = shingling.percent
    held = sets.join(if_few(placed), "rep")
    sizes = placed.groupBy("area").agg(F.count("*").alias("members")).where("members > 2")
    counts = held.select("area", F.explode("s").alias("shingle")).groupBy("area", "shingle").agg(F.count("*").alias("holders"))
    middle = counts.join(sizes, "area").where("2 * holders > members").groupBy("area").agg(F.collect_list("shingle").alias("middle"))
    d = F.when(F.col("middle").isNull(), F.col("s")).otherwise(F.concat(F.array_except("s", "middle"), F.array_except("middle", "s")))
    each = held.join(stored(middle, folder, "middles"), "area", "left").select("rep", "area", "label", F.size("s").cast("long").alias("n"), d.alias("d"))
    return stored(each.withColumn("w", (100 + p) * F.size("d").cast("long") - (100 - p) * F.col("n")), folder, "differing")


def _merged(differing: DataFrame, folder: str) -> DataFrame:
    """(area, label, main, low): components with a member that links with its area's most central one, which is in ``main``.

    Members with w(A) + w(B) <= 0 link whatever they share; then both link with the member of the least w, ``low``, too.
    """
    central = differing.groupBy("area").agg(F.min(F.struct("w", "label")).alias("c")).select("area", F.col("c.w").alias("low"), F.col("c.label").alias("main"))
    central = stored(central, folder, "central")
    near = differing.groupBy("area", "label").agg(F.min("w").alias("w")).join(central, "area")
    return stored(near.select("area", "label", "low", F.when(F.col("w") + F.col("low") <= 0, F.col("main")).otherwise(F.col("label")).alias("into"), "main"), folder, "merged")


def _across(differing: DataFrame, merged: DataFrame, shingling: Shingling, folder: str) -> DataFrame:
    """Pairs (u, v) of members in different components, as merged, whose whole sets may reach the similarity.

    Such members have w(A) + w(B) > 0 (else both were merged), so they share differences from the middle. With these in
    one order, rarest first, what either holds from the first they share on is no less than what they must share: a
    member posts its differences as long as enough is left for the least w it can meet. Differences of one member
    alone lead the order and are posted by none. A list's largest component isn't paired with itself.
    """
    p, twice = shingling.percent, 2 * (100 + shingling.percent)
    tokens = differing.select("rep", "area", F.explode("d").alias("shingle"))
    counts = tokens.groupBy("area", "shingle").count().where("count > 1")
    met = tokens.join(counts.hint("shuffle_hash"), ["area", "shingle"])
    ranked = met.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("t"))
    known = ranked.join(differing.select("rep", "area", "label", "n", "w"), "rep").join(merged, ["area", "label"])
    met_least = F.when(F.col("into") == F.col("main"), F.greatest(F.col("low"), 1 - F.col("low"))).otherwise(F.col("low"))
    enough = F.filter(F.transform("t", lambda t, i: F.struct((F.size("t") - i).cast("long").alias("rest"), t["shingle"].alias("shingle"))), lambda t: t["rest"] * twice >= F.col("w") + met_least)
    posted = known.select("rep", "area", F.col("into").alias("label"), "n", "w", F.explode(enough).alias("t"))
    posted = stored(posted.select("rep", "area", "label", "n", "w", "t.rest", "t.shingle"), folder, "posted")
    parts = posted.groupBy("area", "shingle", "label").count().groupBy("area", "shingle").agg(F.count("*").alias("parts"), F.max(F.struct("count", "label"))["label"].alias("main")).where("parts > 1")
    still = stored(posted.join(parts.select("area", "shingle", "main"), ["area", "shingle"]), folder, "still")
    a, b = (still.select("area", "shingle", *[F.col(c).alias(f"{c}{k}") for c in ("rep", "label", "n", "w", "rest", "main")]) for k in (1, 2))
    fits = (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("main2")) | (F.col("rep1") < F.col("rep2"))) & _sizes_allow(F.col("n1"), F.col("n2"), p)
    fits &= F.least("rest1", "rest2") * twice >= F.col("w1") + F.col("w2")
    met = a.where("label1 != main1").join(b, (a["area"] == b["area"]) & (a["shingle"] == b["shingle"]) & fits)
    return met.select(F.least("rep1", "rep2").alias("u"), F.greatest("rep1", "rep2").alias("v")).distinct()


def _named(classes: DataFrame) -> DataFrame:
    """Classes with ``rep``, a long that no other class has."""
    for seed in range(64):
        out = classes.withColumn("rep", F.xxhash64("c1", "c2", F.lit(seed)))
        if out.groupBy("rep").count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("no distinct names for the classes")


def grouped_rows(docs: DataFrame, shingling: Shingling = Shingling(), folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, th (its text's xxhash64), n_shingles, label (its group; null without words), component_id. See ``near_duplicates``."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    rows = stored(_signed(docs, shingling.words, False), folder, "rows")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("held").alias("held"))
    classes = _named(stored(classes, folder, "classes"))

    posted = classes.select("rep", "n", F.explode("held").alias("token"))
    shared = posted.groupBy("token").count().where("count > 1")
    met = posted.join(shared.hint("shuffle_hash"), "token")
    ranked = met.groupBy("rep").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "token"))).alias("tokens"))
    prefix = ranked.where(F.size("tokens") >= shingling.agree).select("rep", "n", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - shingling.agree + 1)).alias("t"))
    postings = stored(prefix.select("rep", "n", F.col("t.token").alias("token")), folder, "postings")

    hubs = [F.min(F.col("rep").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"h{k}") for k, x in enumerate(_XORS)]
    lists = postings.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"), *hubs).where("m > 1")
    lists = lists.groupBy("m", "x1", "x2", *[f"h{k}" for k in range(HUBS)]).agg(F.min("token").alias("token"))
    used = F.least(F.ceil(F.log2("m")), F.lit(HUBS)).cast("int")
    lists = stored(lists.select("token", F.array_distinct(F.slice(F.array(*[f"h{k}" for k in range(HUBS)]), F.lit(1), used)).alias("hubs")), folder, "lists")
    # most lists of a member share their hubs
    met = postings.join(lists, "token").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    known_u, known_v = _ends_known(classes)
    first = met.withColumnRenamed("rep", "u").join(known_u, "u").select("u", "nu", "hu", F.explode("hubs").alias("v")).where("u != v").join(known_v, "v").where(_agree(shingling))
    agreeing = stored(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), folder, "first-agree")
    links = _confirmed(agreeing, _sets(_ends(agreeing), docs, classes, shingling, folder, "first"), shingling, folder, "first")
    labels = stored(connected(links, folder, "one"), folder, "labels")

    named = postings.join(lists.select("token"), "token").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("label", "rep").alias("label"))
    named = stored(named, folder, "named")
    several = named.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least != greatest").select("token", "least")
    open_ = stored(named.join(several, "token").select("rep", "label", "least").distinct(), folder, "open")
    open_sets = _sets(open_.select("rep").distinct(), docs, classes, shingling, folder, "open")
    differing = _differing(_areas(open_, folder), open_sets, shingling, folder)
    merged = _merged(differing, folder)
    second = stored(_across(differing, merged, shingling, folder), folder, "second")
    ends = stored(_ends(second), folder, "second-ends")
    more = _confirmed(second, open_sets.join(if_few(ends), "rep", "left_semi"), shingling, folder, "second")
    lu, lv = (labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in "uv")
    joined = more.join(lu, "u", "left").join(lv, "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    joined = stored(joined.unionAll(merged.where("into != label").select(F.col("label").alias("u"), F.col("into").alias("v"))), folder, "joined")
    if joined.isEmpty():
        final = labels
    else:
        top = connected(joined, folder, "two").select(F.col("node").alias("old"), F.col("label").alias("top"))
        every = labels.unionAll(top.select(F.col("old").alias("node")).join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        final = every.join(top, every["label"] == top["old"], "left").select("node", F.coalesce("top", "label").alias("label"))
    joined = classes.select("c1", "c2", "doc", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    grouped = stored(joined.select("c1", "c2", "doc", "label"), folder, "grouped")
    smallest = grouped.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_class = stored(grouped.join(smallest, "label").select("c1", "c2", "label", "component_id"), folder, "of-class")
    only_kept(spark, folder, "rows", "of-class")
    out = rows.where("n > 0").join(of_class, ["c1", "c2"], "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "label", "component_id")
    bare = rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return out.unionAll(bare)


def near_duplicates(docs: DataFrame, shingling: Shingling = Shingling(), folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (whether it is its own).

    Two texts are linked if 100 * |A and B| >= percent * |A or B| over their distinct shingle sets; texts without
    words link with nothing.

    1. Rows of equal sets collapse into classes, with map-side aggregation, so copies cost one row.
    2. Each class posts under every coordinate-value pair of its signature. Pairs that one class alone posts are
       skipped, and of the rest, rarest first, only the prefix in which two signatures that agree often enough must
       meet; the most frequent lists are never merged. Lists with the same members count once.
    3. First join: members meet the list's hubs (about log2 of its members, HUBS at most). Collisions are counted over both
       signatures; enough of them, and sizes that allow it, go to whole sets. What is confirmed makes components.
    4. Second join: components that share lists make areas. Whole sets are compared by their differences from the
       area's middle (``_differing``): members near it are one component at once (``_merged``), and members of different
       components meet where the differences they share allow a link (``_across``), and whole sets are compared
       as before. So no pair is left that is neither ruled out nor already connected, and none is
       capped.
    5. Components of all links, with the copies put back.

    Classes go by a name of their own, so rows that repeat an id are judged by their own texts; groups that hold one id
    have equal component ids then. Null and empty texts have no shingles and are kept. Null ids stay null, and are not
    taken as smallest. Other columns are ignored; an empty table gives no rows.
    """
    out = grouped_rows(docs, shingling, folder, doc_id, text).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` over four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Shingling(words=4))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the smallest id (five-word shingles).

    Of rows of one group that share the smallest id, the one with the smallest text hash stays; null ids come last. Rows of
    different groups stay even if they share an id; rows without words all stay.
    """
    folder = shared_dir(spark)
    found = stored(grouped_rows(docs.select("doc_id", "text")).where("label IS NOT NULL").select("label", F.col("doc_id").isNull().alias("none"), "doc_id", "th"), folder, "found")
    best = found.groupBy("label").agg(F.min(F.struct("none", "doc_id", "th")).alias("best"))
    gone = found.join(best, "label").where(F.struct("none", "doc_id", "th") != F.col("best"))
    gone = stored(gone.select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")).distinct(), folder, "gone")
    gone = if_few(gone)
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_th"]), "left_anti")
    if found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return out
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = out.where(worded).withColumn("_id", F.col("doc_id").cast("long")).withColumn("_th", F.xxhash64("text")).dropDuplicates(["_id", "_th"]).drop("_id", "_th")
    return once.unionAll(out.where(~worded))
