"""A lattice of stored roll-ups and the choice of the smallest one that answers a question.

A roll-up is the fact summed by day and some dimensions.  Each is built from the smallest stored roll-up
that has its dimensions, so the fact is read for the finest alone.  A question (dimensions asked for,
dimensions filtered by) is answered by the roll-up with the fewest rows that has them all, and by the
fact where none has.  Base metrics are sums, so a roll-up of a roll-up is exact; ratios are evaluated over
the sums.

``ROLLUPS`` follows the reports: dimensions that one rule derives from another (channel group from
channel, region from market) go together at no cost in rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.operators import compare as C

CHANNEL = ("marketing_channel_group", "marketing_channel")
PAID = ("paid_ad_platform", "paid_campaign_type")
MARKET = ("geo_region", "geo_market")

#: roll-ups by name, finer ones first
ROLLUPS = {
    "explorer": ("source", *CHANNEL, *PAID, *MARKET, "device"),
    "channel_market": (*CHANNEL, *PAID, *MARKET),
    "channel_device": (*CHANNEL, *PAID, "device"),
    "source_market": ("source", *MARKET),
    "channel": (*CHANNEL, *PAID),
    "market": MARKET,
    "device": ("device",),
    "day": (),
}


def rolled_up(df: DataFrame, dims) -> DataFrame:
    """``df`` summed by day and ``dims``; a group's sum is null where all its values are."""
    return df.groupBy("date", *dims).agg(*[F.sum(b).alias(b) for b in M.BASE_METRICS])


class Lattice:
    """``fact`` gives the fact; ``store(name, build)`` writes a roll-up once and returns it with its number of rows."""

    def __init__(self, fact: Callable[[], DataFrame], store: Callable[[str, Callable[[], DataFrame]], tuple[DataFrame, int]]) -> None:
        self._fact, self._store = fact, store
        self._built: dict[str, tuple[DataFrame, int]] = {}

    def rollup(self, name: str) -> DataFrame:
        """The stored roll-up, built from the smallest one before it in ``ROLLUPS`` that has its dimensions."""
        if name not in self._built:
            finer = list(ROLLUPS)[:list(ROLLUPS).index(name)]
            dims = ROLLUPS[name]
            self._built[name] = self._store(name, lambda: rolled_up(self._smallest(dims, finer)[1], dims))
        return self._built[name][0]

    def _smallest(self, dims, names) -> tuple[str, DataFrame]:
        able = [n for n in names if set(dims) <= set(ROLLUPS[n])]
        if not able:
            return "fact", self._fact()
        for n in able:
            self.rollup(n)
        best = min(able, key=lambda n: (self._built[n][1], n))
        return best, self._built[best][0]

    def choose(self, dims: list[str], filters: dict | None = None) -> tuple[str, DataFrame]:
        """(name, table) of the roll-up with the fewest rows that can answer; ("fact", fact) where none can."""
        known = [d for d, values in (filters or {}).items() if values and d in M.DIMENSIONS]
        return self._smallest([d for d in [*dims, *known] if d != "date"], list(ROLLUPS))

    def aggregate(self, dims: list[str], metrics: list[str], rng, filters: dict | None = None) -> DataFrame:
        """``metrics`` by ``dims`` over a range, as ``compare.aggregate`` gives them from the fact."""
        table = self.choose(dims, filters)[1]
        return C.aggregate(C.apply_filters(table, *rng, filters), dims, metrics)
