"""The streamed orders equal a batch over the same files, whatever the order of deliveries."""
import json
import random

from pyspark.sql import functions as F

from tillroll.sources import io as IO
from tillroll.sources.versioned import Versioned
from tillroll.streaming import order_landing as S

PAYLOAD = {"customer": {"id": 4}, "shipping_address": {"country_code": "GB"}}


def page(order, day, price, updated, number=0, country="GB"):
    return {**PAYLOAD, "id": order, "page": number, "created_at": f"1998-{day}T10:00:00", "updated_at": updated and f"1998-{updated}T00:00:00",
            "shipping_address": {"country_code": country}, "line_items": [{"price": price, "quantity": 1}]}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, folder, path, lane):
    S.start_orders_upsert(S.pages_stream(spark, str(folder)), path, lane).awaitTermination(180)


def orders(df):
    return sorted((r.order_id, str(r.created_at), r.country, float(r.net_sales)) for r in df.collect())


def batch(spark, folder):
    return IO.merge_payload_pages(IO.flatten_payload(IO.read_payload(spark, str(folder))))


def lane_of(df):
    return sorted((str(r.date), r.country, r.orders, float(r.revenue)) for r in df.collect())


def test_a_late_correction_replaces_the_first_delivery(spark, tmp_path):
    folder, path, lane = tmp_path / "land", str(tmp_path / "pages"), str(tmp_path / "lane")
    land(folder, "a.json", [page(1, "01-05", "10.00", "01-05"), page(2, "02-01", "3.00", "02-01"), page(3, "03-01", "8.00", "03-09")])
    run(spark, folder, path, lane)
    kept = [f for f in Versioned(spark, path).manifest()["folders"]]
    land(folder, "b.json", [page(1, "01-05", "12.00", "06-30"), page(1, "01-05", "5.00", "06-30", number=1), page(3, "03-01", "1.00", "03-02")])
    run(spark, folder, path, lane)
    assert [r[-1] for r in orders(S.current_orders(spark, path))] == [17.0, 3.0, 8.0]
    assert orders(S.current_orders(spark, path)) == orders(batch(spark, folder))
    assert lane_of(Versioned(spark, lane).read()) == lane_of(S.sales_lane(batch(spark, folder)))
    now = Versioned(spark, path).manifest()
    assert len(set(kept) & set(now["folders"])) == 1                   # February alone was not touched
    versions = Versioned(spark, path).versions()
    run(spark, folder, path, lane)                                     # nothing new: nothing written
    assert Versioned(spark, path).versions() == versions


def test_a_page_may_move_to_another_month(spark, tmp_path):
    folder, path, lane = tmp_path / "land", str(tmp_path / "pages"), str(tmp_path / "lane")
    for name, rows in (("a.json", [page(1, "01-31", "1.00", "01-31"), page(2, "01-31", "2.00", None)]), ("b.json", [page(1, "02-01", "4.00", "02-02")])):
        land(folder, name, rows)
        run(spark, folder, path, lane)
    assert orders(S.current_orders(spark, path)) == orders(batch(spark, folder))
    assert lane_of(Versioned(spark, lane).read()) == lane_of(S.sales_lane(batch(spark, folder))) and len(lane_of(Versioned(spark, lane).read())) == 2


def test_random_deliveries_and_a_batch_run_twice(spark, tmp_path):
    r, folder, path = random.Random(4), tmp_path / "land", str(tmp_path / "pages")
    days = ["01-02", "01-20", "02-03", "04-09"]
    stored = Versioned(spark, path)
    for step in range(4):
        rows = [page(o, days[o % 4], f"{r.randrange(100)}.50", r.choice(["05-01", "05-02", "05-03", None]), r.randrange(3), r.choice(["GB", "DE"])) for o in r.choices(range(12), k=15)]
        land(folder, f"{step}.json", rows)
        flat = IO.flatten_payload(spark.read.schema(IO.PAYLOAD_SCHEMA).json(str(folder / f"{step}.json")))
        S.upsert_pages(stored, flat, batch=step)
        assert S.upsert_pages(stored, flat.withColumn("gross_sales", F.lit(0).cast("decimal(18,2)")), batch=step) == []
        assert orders(S.current_orders(spark, path)) == orders(batch(spark, folder))
