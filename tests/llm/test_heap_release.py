"""Stages that follow heavy ones begin with heap handed back; what earlier stages left isn't held beside Python workers."""

import pytest

from stratalog.llm.decontaminate import decontamination_stage
from stratalog.llm.packing import packing_stage


@pytest.mark.parametrize("stage", [decontamination_stage, packing_stage])
def test_stage_hands_heap_back(spark, tmp_path, stage):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    spark.createDataFrame([("i", "four five")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    management = spark._jvm.java.lang.management.ManagementFactory
    whole = lambda: sum(b.getCollectionCount() for b in management.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = whole()
    left = stage(spark, docs, str(tmp_path))
    assert whole() > before
    assert sorted({row.doc_id for row in left.collect()}) == [1, 2]
