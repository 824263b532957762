from pathlib import Path

import pytest

from surestat.plans.views import in_spark

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
def test_every_pair_is_a_start(spark):
    pairs = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_suppkey note", "l_partkey index").distinct()
    starts = in_spark(spark, DATA, "starts")
    assert starts.count() == pairs.count() > 0 and pairs.exceptAll(starts).isEmpty()
