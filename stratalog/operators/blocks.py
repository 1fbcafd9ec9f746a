"""Pairs in blocks: joins of many rows with many, whose pairs are made one by one where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.body import fresh

#: Values a block holds, about.
BLOCK = 512


def blocked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of each key in lists of about BLOCK structs of the other columns: a key of many rows has many lists, so none outgrows a task."""
    rest = [c for c in df.columns if c not in keys]
    many, part = fresh("n"), fresh("n")
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(many))
    dealt = df.join(sizes, keys).withColumn(part, F.pmod(F.xxhash64(*rest), F.col(many)))
    return dealt.groupBy(*keys, part).agg(F.collect_list(F.struct(*rest)).alias(name)).drop(part)


def spread(df: DataFrame, lists: list[str], parts: int) -> DataFrame:
    """Every combination of the lists' structs, a column for each field. Blocks are dealt out first and combinations never shuffled."""
    df = df.repartition(parts)
    for name in lists:
        one = fresh("e")
        fields = df.schema[name].dataType.elementType.fieldNames()
        df = df.withColumn(one, F.explode(name)).drop(name)
        df = df.select(*[c for c in df.columns if c != one], *[F.col(one)[f].alias(f) for f in fields])
    return df


def tasks(df: DataFrame, blocks: int = 0) -> int:
    """Into how many tasks pairs go: some for each core, and of known blocks at most 16 of pairs (4 million) in one."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, min(blocks // 16, 20_000))
