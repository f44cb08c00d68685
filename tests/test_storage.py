"""The stored history on disk."""

import pytest
from pyspark.sql import functions as F

from tickloom.sources import storage as S

KIND = "id long, closed_at string, pnl double"


def trades(spark, *rows):
    return spark.createDataFrame(list(rows), KIND).withColumn("closed_at", F.to_timestamp("closed_at"))


def test_upsert_touches_only_its_months(spark, tmp_path):
    path = str(tmp_path / "trades")
    assert S.upsert(spark, path, trades(spark, (1, "2024-01-05", 1.0), (2, "2024-02-05", 2.0), (None, "2024-02-05", 9.0), (3, None, 9.0))) == ["2024-01", "2024-02"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "trades" / "month=2024-01").glob("*.parquet")}
    assert S.upsert(spark, path, trades(spark, (2, "2024-03-01", 5.0), (4, "2024-03-02", 4.0))) == ["2024-02", "2024-03"]
    got = {r.id: (r.pnl, r.month) for r in spark.read.parquet(path).collect()}
    assert got == {1: (1.0, "2024-01"), 2: (5.0, "2024-03"), 4: (4.0, "2024-03")}
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "trades" / "month=2024-01").glob("*.parquet")}
    assert S.upsert(spark, path, trades(spark)) == []
    assert S.delete(spark, path, [2, 77]) == 1 and {r.id for r in spark.read.parquet(path).collect()} == {1, 4}
    with pytest.raises(ValueError):
        S.delete(spark, path, list(range(1001)))
    assert {r.month for r in S.file_manifest(spark, path).collect()} == {"2024-01", "2024-03"}


def test_retention_passes_over_large_archives(spark):
    rows = [("a", f"f{k}", k, size) for k, size in enumerate([10, 10, 90, 20, 30])]
    df = spark.createDataFrame(rows, "log string, path string, at int, size long")
    assert {r.path for r in S.retained(df, 3, 70).collect() if r.kept} == {"f4", "f3", "f1"}
    assert not any(r.kept for r in S.retained(df, 0, 70).collect())
