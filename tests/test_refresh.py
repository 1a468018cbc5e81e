"""Incremental build: a change rewrites its month alone, and the facts equal a full build."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.operators.compare import month_number
from tillroll.plans import refresh as R
from tillroll.sources.versioned import Versioned
from tillroll.workspace import Workspace

DAY = dt.date(1998, 3, 3)


@pytest.fixture(scope="module")
def feeds(spark):
    ws = Workspace(spark, SF_SMALL)
    names = {n for names, _, _ in R.FACTS.values() for n in names}
    recent = {n: ws.feed(n).filter(R.feed_day(ws.feed(n)) >= "1997-12-01").cache() for n in names}
    yield recent
    for df in recent.values():
        df.unpersist()


def counted(df):
    columns = [c for c in df.columns if c != "stored_month"]
    return sorted((tuple(map(str, r)) for r in df.groupBy(*columns).count().collect()))


def test_a_changed_day_rewrites_one_month(spark, feeds, tmp_path):
    root, full = str(tmp_path / "facts"), str(tmp_path / "full")
    without = {n: f.filter(R.feed_day(f) != F.lit(DAY)) for n, f in feeds.items()}
    R.refresh(spark, without, root)
    before = {fact: set(Versioned(spark, f"{root}/{fact}").manifest()["folders"]) for fact in R.FACTS}
    done = R.refresh(spark, feeds, root)
    assert done["fact"] == done["fact_product"] == ["199803"]
    R.refresh(spark, feeds, full)
    for fact, months in done.items():
        now = Versioned(spark, f"{root}/{fact}").manifest()["folders"]
        assert len(set(now) - before[fact]) == len(months) <= 1
        assert counted(R.read_fact(spark, root, fact)) == counted(R.read_fact(spark, full, fact))
    assert all(not months for months in R.refresh(spark, feeds, root).values())
    assert len(Versioned(spark, f"{root}/fact").versions()) == 2
    # a month that is gone from the feeds goes from the facts
    less = {n: f.filter(month_number(R.feed_day(f)) != 199801) for n, f in feeds.items()}
    assert R.refresh(spark, less, root)["fact"] == ["199801"]
    assert R.read_fact(spark, root, "fact").filter(month_number(F.col("date")) == 199801).count() == 0


def test_an_altered_value_is_found(spark, feeds):
    feed = feeds["email"]
    assert R.month_digests(feed) == R.month_digests(feed.repartition(7))
    other = feed.withColumn("opens", F.when(F.col("date") == F.lit(DAY), F.col("opens") + 1).otherwise(F.col("opens")))
    a, b = R.month_digests(feed), R.month_digests(other)
    assert [m for m in a if a[m] != b[m]] == (["199803"] if feed.filter(F.col("date") == F.lit(DAY)).count() else [])
