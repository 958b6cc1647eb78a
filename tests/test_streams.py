"""Streams whose result is as large as their input."""

import pytest

from tessera import plans

@pytest.mark.parametrize("n", [0, 1, 1000])
def test_logged_stream_stays_off_the_driver(spark, tmp_path, n):
    spark.range(n).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "if(id % 7 = 0, null, id % 5) as user_id", "concat('k', id % 3) as event_type", "1D as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    df = plans.QUERIES["logged_stream"](spark, str(tmp_path))
    assert df.columns == ["event_id", "user_id", "event_type"]
    assert sorted(map(tuple, df.collect())) == [(i, i % 5 if i % 7 else None, f"k{i % 3}") for i in range(n)]
    # a table of files, not rows of the driver's memory
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString() and "MemoryPlan" not in df._jdf.queryExecution().analyzed().toString()
