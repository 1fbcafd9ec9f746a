"""Language identification by compression: one zstandard raw-content dictionary a language; the smallest encoding wins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, memory_of, remainder_of_id

UNDETERMINED = "und"
#: A language's dictionary, at most how many training rows fill it, and how many characters of each, from its first letter.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 32_768, 400, 8_000
#: Texts are encoded in pieces of so many bytes, so that the dictionary, not the text itself, decides.
PIECE_BYTES = 1024
#: A text is rejected if its margin, by which share the second-best encoding is larger, is below a part of what all but a
#: share of the rightly judged training texts reach when cut to its length: the lower of the two of these lengths, in bytes, that it lies between.
MARGIN_PART, MARGIN_SHARE, MARGIN_LENGTHS = 0.5, 0.01, (4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
#: How many training rows of all languages together show these margins, and how many at least for a length.
MARGIN_ROWS, LEAST_MARGINS = 800, 20

# A-Z to a-z; other ASCII but letters to spaces; bytes of other characters stay.
_FOLD = bytes(c if 97 <= c <= 122 or c > 127 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def folded(text: str) -> bytes:
    """Lower-case letters and spaces only, a word that repeats the one before left out."""
    words = text.encode().translate(_FOLD).split()
    return b" ".join([w for w, before in zip(words, [b"", *words]) if w != before])


class Dictionaries(dict):
    """Dictionaries by language, with ``least``: pairs of a length and the least margin of a kept text of that length."""

    least: tuple[tuple[int, float], ...] = ()


def learned_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Dictionaries:
    """A dictionary for each language from rows with text and language: sampled texts, cut to DICTIONARY_BYTES in all.

    The sample is bounded: per language about SAMPLE_ROWS rows of any length, those with the smallest hashes of id and
    text, and of each row SAMPLE_CHARS characters from its first letter. Counting is one aggregation by language; the
    sample one more scan, filtered where it is read, so no group is gathered in a task.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Dictionaries()
    under = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, math.ceil((1 << 20) * min(1.0, SAMPLE_ROWS / n)))])
    taken: dict[str, list[tuple[int, int, str]]] = {}
    begun = F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, SAMPLE_CHARS).alias("t")
    for r in rows.where(F.col("h") < F.element_at(under, F.col("l"))).select("h", "i", begun, "l").collect():
        taken.setdefault(r["l"], []).append((r["h"], r["i"] or 0, r["t"]))
    texts = {language: [folded(t) for _, _, t in sorted(found)] for language, found in sorted(taken.items())}
    out = Dictionaries({language: d for language, found in texts.items() if (d := dictionary(found))})
    out.least = least_margins(texts)
    return out


def dictionary(texts: list[bytes]) -> bytes:
    return b" ".join(texts)[:DICTIONARY_BYTES]


def least_margins(texts: dict[str, list[bytes]]) -> tuple[tuple[int, float], ...]:
    """By length, the margin that all but MARGIN_SHARE of the training texts cut to it reach.

    Each text is judged by dictionaries of the other half of the rows, which don't hold it.
    """
    seen: dict[int, list[float]] = {n: [] for n in MARGIN_LENGTHS}
    each = max(1, MARGIN_ROWS // (2 * max(1, len(texts))))
    for half in (0, 1):
        measure = CompressionClassifier({k: dictionary(t[1 - half :: 2]) for k, t in texts.items()}).measure
        for language, found in texts.items():
            for text in found[half::2][:each]:
                for n in MARGIN_LENGTHS:
                    if len(text) >= n:
                        best, _, margin = measure(text[:n])
                        if best == language:
                            seen[n].append(margin)
    return tuple((n, sorted(m)[int(len(m) * MARGIN_SHARE)]) for n, m in seen.items() if len(m) >= LEAST_MARGINS)


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.least = getattr(dictionaries, "least", ())
        params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.encoders = []
        for content in dictionaries.values():
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=params)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress)

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether it is rejected. Texts without letters are undetermined and rejected."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        body = folded(text)
        language, score, margin = self.measure(body)
        return language, score, margin, margin < MARGIN_PART * self.least_of(len(body))

    def least_of(self, length: int) -> float:
        at = sum(n <= length for n, _ in self.least)
        return min((m for _, m in self.least[max(0, at - 1) : at + 1]), default=0.0) if at else 0.0

    def measure(self, body: bytes) -> tuple[str, float, float]:
        """Language, score and margin of a folded text."""
        pieces = [body[i : i + PIECE_BYTES] for i in range(0, len(body), PIECE_BYTES)] or [b""]
        sizes = [sum(len(encode(p)) for p in pieces) for encode in self.encoders]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], self.languages[k]))
        best = sizes[order[0]]
        share = sum(math.exp(max(-700.0, (best - s) / len(pieces))) for s in sizes)
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return self.languages[order[0]], 1.0 / share, margin


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[Column] | None = None, only_kept: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` to the columns ``keep`` (default: all).

    The whole text is encoded, piece by piece, with every language's dictionary; ties go to the first language by
    name. Null, empty and letter-free texts give ``und``, score 0, rejected. Narrow: no shuffle; repeated rows repeat.
    With ``only_kept`` rejected rows go and no columns are added.
    ``dictionaries`` goes to the workers with the function: languages times DICTIONARY_BYTES.
    """
    bounded_batches(docs.sparkSession)
    keep = [F.col(f"`{c}`") for c in docs.columns] if keep is None else keep
    named = docs.select(*keep)
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    kept = rows.schema.fields[: len(keep)]
    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), "lang_pred string, score double, margin double, rejected boolean"])

    n_keep = len(keep)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("language")
        judge = CompressionClassifier(dictionaries).judge
        for batch in batches:
            got = [judge(t) for t in batch.column(n_keep).to_pylist()]
            made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keep], *made], names=[*(f"k{i}" for i in range(n_keep)), "lang_pred", "score", "margin", "rejected"])

    out = rows.mapInArrow(classify, schema)
    if only_kept:
        return out.where(~F.col("rejected")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(named.columns)])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(named.columns)], "lang_pred", "score", "margin", "rejected")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from two of three folds of it. Rows without an id aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder_of_id("doc_id", 3) == 1, F.lit(False))
    model = learned_dictionaries(docs.where(~held_out))
    return identified(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go; where no language is learned, all stay."""
    held_out = F.coalesce(remainder_of_id("doc_id", 3) == 1, F.lit(False))
    model = learned_dictionaries(docs.where(~held_out))
    if not model:
        return docs
    return identified(docs, model, only_kept=True)
