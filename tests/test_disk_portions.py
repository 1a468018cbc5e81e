"""Disk of the model build: shuffles go with their job, and many lines are joined, rolled up and dealt in portions."""
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tillroll.operators import facts as FX
from tillroll.plans import refresh as R
from tillroll.sources.versioned import COMMIT, Versioned
from tillroll.workspace import Workspace


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 lines of 12 orders in four months (one order without a day, one month hot, one line twice, one line without returns' day)."""
    at = tmp_path_factory.mktemp("tables")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    day = {0: None, 1: dt.datetime(1998, 1, 5), 2: dt.datetime(1998, 2, 7), 3: dt.datetime(1998, 4, 9)}
    put("orders", [(i, i % 3, day.get(i, dt.datetime(1998, 3, 1 + i % 4)), "FOP"[i % 3], 10.0 * i) for i in range(12)],
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderstatus string, o_totalprice double")
    lines = [(n % 12, n % 7, n % 4, n // 12, float(1 + n % 5), 10.0 + n, 0.05, "ANR"[n % 3], "FO"[n % 2],
              None if n == 8 else dt.datetime(1998, 1 + n % 5, 2)) for n in range(59)]
    put("lineitem", [*lines, lines[5]], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    put("customer", [(i, i) for i in range(3)], "c_custkey bigint, c_nationkey int")
    put("part", [(i, f"p{i}", "PROMO", "b", i, 9.5) for i in range(7)], "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    put("events", [(i, dt.datetime(2024, 1, 1 + i % 30), i, "click", 1.0, f'{{"k": {i % 100}}}') for i in range(40)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    return str(at)


def counted(df):
    columns = [c for c in df.columns if c != "stored_month"]
    return sorted(tuple(map(str, r)) for r in df.groupBy(*sorted(columns)).count().collect())


def test_every_month_is_in_one_portion_and_a_hot_one_is_cut(monkeypatch):
    monkeypatch.setattr(FX, "PORTION_ROWS", 10)
    assert FX.month_portions({}) == [FX.Portion([])] and FX.month_portions({199801: 9}) == [FX.Portion([199801])]
    found = FX.month_portions({199803: 25, 199801: 4, FX.NO_MONTH: 3, 199802: 6})
    assert sorted(found) == [FX.Portion([FX.NO_MONTH, 199801]), FX.Portion([199802]), *[FX.Portion([199803], 3, i) for i in range(3)]]
    assert len(FX.month_portions({199800 + i: 1000 for i in range(1, 13)})) <= 2 * FX.PORTIONS


def test_tables_built_in_portions_hold_the_same_rows(spark, folder, monkeypatch):
    plain = Workspace(spark, folder, materialize=False)
    monkeypatch.setattr(FX, "PORTION_ROWS", 7)
    cut = Workspace(spark, folder)
    written = {}
    import tillroll.workspace as WS
    real = WS.write_by_month
    monkeypatch.setattr(WS, "write_by_month", lambda df, path, *a: (written.setdefault(path.rsplit("/", 1)[1].split("-")[0], []).append(path), real(df, path, *a)))
    for name in ("line_items", "orders", "inventory", "traffic_items", "returns"):
        assert counted(cut.feed(name)) == counted(plain.feed(name)), name
    assert counted(cut.product_fact) == counted(plain.product_fact) and cut.product_fact.count() > 0
    assert len(written["lines_base"]) == FX.PORTIONS and len(written["orders"]) == 3 and len(written["fact_product"]) > 1
    names = ["line_items", "inventory", "fact_product"]
    assert {n: r[0] for n, r in cut.from_footers(names).items()} == {n: r[0] for n, r in plain.from_footers(names).items()}


def test_a_fact_refreshed_in_portions_is_one_version_with_the_same_rows(spark, folder, tmp_path, monkeypatch):
    ws = Workspace(spark, folder)
    feeds = {n: ws.feed(n) for names, _, _ in R.FACTS.values() for n in names}
    R.refresh(spark, feeds, str(tmp_path / "whole"))
    monkeypatch.setattr(FX, "PORTION_ROWS", 7)
    without = {n: f.filter(R.feed_day(f) != F.lit(dt.date(1998, 3, 3))) for n, f in feeds.items()}
    for root, steps in (("cut", [feeds]), ("twice", [without, feeds])):
        for given in steps:
            R.refresh(spark, given, str(tmp_path / root))
        stored = Versioned(spark, str(tmp_path / root / "fact_product"))
        assert len(stored.versions()) == len(steps)
        assert len({f.split("/")[0] for f in stored.manifest()["folders"] if f.startswith(COMMIT)}) > 1
        for fact in R.FACTS:
            assert counted(R.read_fact(spark, str(tmp_path / root), fact)) == counted(R.read_fact(spark, str(tmp_path / "whole"), fact)), fact


def shuffles(spark) -> set:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_stored_tables_go_with_their_job(spark, tmp_path):
    before = shuffles(spark)
    t = Versioned(spark, str(tmp_path / "t"))
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("m"), "id").groupBy("m", "id").count()
    t.overwrite(rows, "m")
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and t.read().count() == 1000
