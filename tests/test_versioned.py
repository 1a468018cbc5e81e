"""Versioned datasets, and the targets upload on top of them."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.sources import io as IO
from tillroll.sources.versioned import Conflict, Versioned


def table(spark, rows):
    return spark.createDataFrame(rows, "month int, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.write_parquet(table(spark, [(1, "old")]), path)
    broken = spark.range(100).select(F.col("id").cast("int").alias("month"),
                                     F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        IO.write_parquet(broken.repartition(4), path)
    assert rows(IO.scan_parquet(spark, path)) == [(1, "old")]
    IO.write_parquet(table(spark, [(2, "new")]), path)
    assert rows(IO.scan_parquet(spark, path)) == [(2, "new")]
    assert rows(Versioned(spark, path).read(1)) == [(1, "old")]


def test_partitions_are_replaced_alone(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"))
    t.overwrite(table(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "n")]), "month")
    before = set(t.manifest()["folders"])
    t.replace(table(spark, [(2, "B"), (2, "BB")]), [2, 3])
    assert rows(t.read().filter("month IS NOT NULL")) == [(1, "a"), (2, "B"), (2, "BB")]
    assert t.read().filter("month IS NULL").count() == 1
    assert len(before & set(t.manifest()["folders"])) == 2          # the folders of the others are the same ones
    with pytest.raises(ValueError, match="outside"):
        t.replace(table(spark, [(9, "x")]), [2])
    t.replace(table(spark, []), [1, 2])
    assert t.read().count() == 1
    assert t.vacuum(keep=1) >= 1 and t.read().count() == 1 and len(t.versions()) == 1


def test_of_two_writers_the_second_is_refused(spark, tmp_path, monkeypatch):
    a, b = Versioned(spark, str(tmp_path / "t")), Versioned(spark, str(tmp_path / "t"))
    a.overwrite(table(spark, [(1, "a")]))
    base = b.manifest()
    a.overwrite(table(spark, [(2, "a")]))
    monkeypatch.setattr(b, "manifest", lambda *x: base)
    with pytest.raises(Conflict):
        b.overwrite(table(spark, [(3, "b")]))
    assert rows(a.read()) == [(2, "a")]


def test_an_empty_dataset_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.write_parquet(table(spark, []), path, "month")
    assert IO.scan_parquet(spark, path).schema.names == ["month", "v"] and IO.scan_parquet(spark, path).count() == 0


TARGETS = "date string, target_revenue string, target_orders string, note string"


def test_bad_target_rows_are_kept_aside_with_the_reason(spark, tmp_path):
    path = str(tmp_path / "targets")
    raw = spark.createDataFrame([("1998-01-01", "10.5", "3", "x"), ("1998-13-01", "1", "1", "x"), ("1998-01-02", "ten", "", None),
                                 (None, "1", "1", "x"), ("1998-01-03 10:00:00", " 7 ", None, "x"), ("1998-01-04", "1e30", "x1", "y")], TARGETS)
    good = IO.replace_targets(raw, path)
    assert rows(good.select("date", F.col("target_revenue").cast("double"), F.col("target_orders").cast("double")).fillna(-1)) == [
        (dt.date(1998, 1, 1), 10.5, 3.0), (dt.date(1998, 1, 3), 7.0, -1.0)]
    bad = {r.reason: r.row for r in IO.read_rejects(spark, path).collect()}
    assert set(bad) == {"date: 1998-13-01", "target_revenue: ten", "date: missing", "target_revenue: 1e30; target_orders: x1"}
    assert bad["target_revenue: ten"] == '{"date":"1998-01-02","target_revenue":"ten","target_orders":"","note":null}'
    IO.replace_targets(raw.limit(1), path)
    assert IO.read_rejects(spark, path).count() == 0
    assert good.count() == 2                                        # a reader that has begun keeps its version


def test_targets_survive_a_failed_upload(spark, tmp_path):
    path = str(tmp_path / "targets")
    IO.replace_targets(spark.createDataFrame([("1998-01-01", "1", "1", "")], TARGETS), path)
    broken = spark.createDataFrame([("1998-01-02", "2", "2", "")], TARGETS).withColumn(
        "target_orders", F.when(F.col("date").isNotNull(), F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        IO.replace_targets(broken.withColumn("target_orders", F.col("target_orders").cast("string")), path)
    assert [str(r.date) for r in IO.scan_parquet(spark, path).collect()] == ["1998-01-01"]
