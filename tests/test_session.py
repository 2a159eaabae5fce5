"""What a cut leaves on disk."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from tracefold.session import DROP_SHUFFLES, cut, cut_bucketed


@pytest.mark.parametrize("write", [cut, lambda df: cut_bucketed(df, ["k"])])
def test_a_cut_leaves_no_shuffle_files(spark, write):
    here = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for d in here.localDirs() for p in glob.glob(f"{d.getPath()}/*/shuffle_*.data") if os.path.getsize(p)}
    before, kept = files(), spark.conf.get(DROP_SHUFFLES)
    out = write(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(DROP_SHUFFLES) == kept
    assert sorted(r["count"] for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143]
