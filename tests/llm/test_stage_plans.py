"""Stages that drop rows deal out the ids that go, not the texts; where those ids are too many, the rows left are the same."""

import pytest

from stratalog.llm import common
from stratalog.llm.decontaminate import decontamination_stage
from stratalog.llm.neardup import neardup_stage

ITEM = "one two three four five six seven eight nine ten"


@pytest.fixture
def unhelped(spark):
    """Spark broadcasts nothing of its own accord."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("most", [common.BROADCAST_IDS, 0])
def test_dropping_stages(unhelped, monkeypatch, tmp_path, most):
    spark = unhelped
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(k, f"{own(k)} {ITEM}" if k % 5 == 0 else own(k)) for k in range(20)] + [(20 + k, own(k)) for k in (1, 2, 3)] + [(None, ITEM), (None, own(4)), (30, None), (31, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(repr(r) for r in rows if ITEM not in (r[1] or ""))
    once = neardup_stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, map(tuple, once.collect()))) == sorted(repr(r) for r in rows if r not in [(21, own(1)), (22, own(2)), (23, own(3)), (None, own(4))])
    if most:
        for left in (clean, once):
            assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
