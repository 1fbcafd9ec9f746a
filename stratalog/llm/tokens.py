"""Exact token counts at every prefix of every text, from a prefix dynamic programme (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe import word_bpe
from stratalog.llm.common import bounded_batches

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"


def prefix_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store the exact token count of every prefix of every text.

    Returns the columns ``keep`` (default: ``doc_id``) plus ``n_tokens`` (the whole text's count), ``prefix_steps``
    (for each code point, how many tokens it adds, as signed integers of ``step_bytes`` bytes each). The running sum
    of the steps up to position k is the token count of the first k code points; ``tokens_at`` and ``longest_prefix``
    answer truncation and budget questions from it without encoding again.

    ``vocabulary`` is the path of a ``tokenizers`` BPE file that executors can open. Narrow: no shuffle, so a hot key
    or repeated rows change nothing. A null text counts as empty: 0 tokens and no steps. Rows keep their multiplicity;
    extra columns of any name pass through only if named in ``keep``.
    """
    keep = ["doc_id"] if keep is None else keep
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "n_tokens long, prefix_steps binary, step_bytes int"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            steps = bpe.prefix_steps_all(batch.column(len(keep)).to_pylist())
            totals = [int(np.frombuffer(s, np.int8 if w == 1 else "<i4").sum(dtype=np.int64)) for s, w in steps]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(totals, pa.int64()), pa.array([s for s, _ in steps], pa.binary()), pa.array([w for _, w in steps], pa.int32())],
                names=[*(f"k{i}" for i in range(len(keep))), "n_tokens", "prefix_steps", "step_bytes"],
            )

    out = rows.mapInArrow(count, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "prefix_steps", "step_bytes")


def tokens_at(prefix_steps: bytes, step_bytes: int, position: int) -> int:
    """The token count of the first ``position`` code points of a text."""
    steps = np.frombuffer(prefix_steps, np.int8 if step_bytes == 1 else "<i4")
    return int(steps[: max(0, position)].sum(dtype=np.int64))


def longest_prefix(prefix_steps: bytes, step_bytes: int, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    counts = np.frombuffer(prefix_steps, np.int8 if step_bytes == 1 else "<i4").cumsum(dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents`` under the public word BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = prefix_token_counts(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
