"""The stored customer state answers any range as the orders do, and grows without them."""
import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from tillroll.plans import customer_state as S

ORDERS = "order_id long, customer_id long, created_at timestamp, net_sales decimal(18,2)"


def some(n, seed):
    r = random.Random(seed)
    start = dt.datetime(1998, 1, 1)
    return [(i, r.choice([None, 1, 1, 1, 2, 3, 4, 5]), start + dt.timedelta(hours=r.randrange(24 * 200)),
             r.choice([None, Decimal(r.randrange(-500, 9999)) / 100])) for i in range(n)] + [(n, 6, None, Decimal("5.00"))]


def brute(rows, cur, cmp):
    out = {}
    by = defaultdict(list)
    for _, customer, at, value in rows:
        if at is not None:
            by[customer].append((at.date(), value or Decimal(0)))
    for customer, own in by.items():
        side = [[v for d, v in own if a <= d <= b] for a, b in (cur, cmp)]
        out[customer] = (min(d for d, _ in own), len(side[0]), len(side[1]), sum(side[0], Decimal(0)), sum(side[1], Decimal(0)), sum((v for _, v in own), Decimal(0)))
    return out


RANGES = [((dt.date(1998, 2, 10), dt.date(1998, 2, 20)), (dt.date(1997, 2, 10), dt.date(1997, 2, 20))),
          ((dt.date(1998, 1, 31), dt.date(1998, 4, 1)), (dt.date(1998, 1, 1), dt.date(1998, 1, 31))),
          ((dt.date(1998, 3, 1), dt.date(1998, 3, 31)), (dt.date(1998, 2, 15), dt.date(1998, 3, 10)))]


@pytest.mark.parametrize("cur,cmp", RANGES)
def test_any_range_from_the_state(spark, cur, cmp):
    rows = some(300, 1)
    state = S.customer_state(spark.createDataFrame(rows, ORDERS))
    got = {r.customer_id: tuple(r)[1:] for r in S.per_customer(state, cur, cmp).collect()}
    assert got == brute(rows, cur, cmp)


def test_new_orders_merge_into_the_state(spark):
    old, new = some(200, 2), [(1000 + i, *r[1:]) for i, r in enumerate(some(50, 3))]
    frames = [spark.createDataFrame(x, ORDERS) for x in (old, new, old + new)]
    a, b, both = (S.customer_state(f) for f in frames)
    days = lambda s: sorted(map(str, S.exploded(s).collect()))
    assert days(S.merged(a, b)) == days(both)
    assert S.merged(a, b).count() == both.count()
