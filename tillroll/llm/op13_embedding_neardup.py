"""Near duplicates among embeddings by NN-descent.

Two vectors link when their labels are equal and their cosine, in double precision, is at least the threshold.

1. Equal vectors of a label become one class with a count.
2. ``cover``: classes are put into balls: a leader and classes so near to it that any two of them surely link (their
   angles to the leader add up to less than the threshold's angle).  A dense group of near copies is then
   a few balls, whose inner links are proven and counted without being listed.
3. ``seeded`` gives each leader the K nearest others in blocks of neighbours along random hyperplane orders;
   ``refined`` improves these lists by joins of the neighbours of each node with each other (neighbours of
   neighbours).  A pair is near if members of the two balls may link.  Near pairs stay in a list beyond K, so a list
   whose K places are all taken by near pairs grows as long as more are found.
4. ``missed`` audits a sample of nodes, of fixed size, against all nodes.  While rounds find more near pairs or
   the audit's recall is below RECALL, the search goes on, after a failed audit with the pairs missed and with new
   orders in blocks of double size, which in the end are whole labels.
5. ``decided`` verifies near pairs in double precision.  Where two balls link in part, their members are compared,
   chunk against chunk, and counted.  Balls that link are joined to components.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and those with a null label,
link with nothing; vectors of different lengths do not link; rows that repeat an id are vectors
of their own; a null id is never the smallest of a component with another; an empty table gives an empty result; other
columns are not read.  Middle nodes of many lists are split by chance into runs of at most JOIN_ROWS, anew in each round.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.llm.components import components
from tillroll.llm.scratch import store

THRESHOLD = 0.93
K, ORDERS, BLOCK, COVER_BLOCK, COVER_ROUNDS, JOIN_ROWS, CHUNK = 8, 4, 256, 512, 2, 128, 1024
AUDIT, RECALL, BITS = 512, 0.99, 30
TINY = 1e-14      # more than the rounding of a dot product of unit vectors


def angle_at_most(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine - TINY, -1, 1))


def angle_at_least(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine + TINY, -1, 1))


def unit_vectors(column: pa.ListArray) -> list[bytes | None]:
    """Each vector at length one, as doubles; None for those that cannot link."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    out: list[bytes | None] = [None] * len(column)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        peak = np.abs(values).max(axis=1)
        good = np.isfinite(peak) & (peak > 0)
        values = values[good] / peak[good, None]
        values /= np.linalg.norm(values, axis=1)[:, None]
        for row, value in zip(rows[good].tolist(), values, strict=True):
            out[row] = value.tobytes()
    return out


def _matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Binary vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows with equal ``keys``, of rows sorted by them."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        edge = np.zeros(batch.num_rows + 1, bool)
        edge[[0, -1]] = True
        for key in keys:
            column = batch.column(key)
            edge[1:-1] |= ~pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(edge).tolist()
        held = None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            while hi - lo > rows or (hi < batch.num_rows and hi > lo):
                take = min(rows, hi - lo)
                yield batch.slice(lo, take)
                lo += take
            if lo < hi:
                held = batch.slice(lo, hi - lo)
    if held is not None and held.num_rows:
        yield held


def _ordered(nodes: DataFrame, seeds: list[int], rows: int, body, schema: str) -> DataFrame:
    """``body`` over blocks of ``rows`` neighbours of (id, label, dim, unit, radius) along random orders, one for each seed."""
    kind = nodes.schema["label"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for seed in seeds:
                marks = np.zeros(len(dims), np.int64)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    planes = np.random.default_rng([seed, dim]).standard_normal((dim, BITS))
                    side = _matrix(batch.column("unit").take(pa.array(at))) @ planes > 0
                    marks[at] = side @ (1 << np.arange(BITS)[::-1])
                yield pa.record_batch([pa.array([seed] * len(dims), pa.int32()), pa.array(marks), *batch.columns],
                                      names=["seed", "mark", *batch.schema.names])

    marked = nodes.select("id", "label", "dim", "unit", "radius").mapInArrow(
        signed, f"seed int, mark bigint, id bigint, label {kind}, dim int, unit binary, radius double")
    order = ["seed", "label", "dim", "mark", "salt"]
    marked = marked.withColumn("salt", F.xxhash64("id", "seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ["seed", "label", "dim"], rows):
            yield from body(block)

    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def cover(classes: DataFrame, half: float, rounds: int = COVER_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Balls (id, label, dim, unit, radius) and members (member, id) of classes (id, label, dim, unit, radius)."""
    def absorb(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit, radius, ids = _matrix(block.column("unit")), block.column("radius").to_numpy(), block.column("id").to_numpy()
        near = angle_at_most(unit @ unit.T) + radius[None, :] <= half
        leader = np.full(len(ids), -1)
        for i in np.argsort(-near.sum(axis=1), kind="stable").tolist():
            if leader[i] < 0:
                taken = near[i] & (leader < 0)
                taken[i] = True
                leader[taken] = i
        reach = angle_at_most((unit * unit[leader]).sum(axis=1)) + radius
        reach[leader == np.arange(len(ids))] = radius[leader == np.arange(len(ids))]
        yield pa.record_batch([pa.array(ids), pa.array(ids[leader]), pa.array(reach)], names=["member", "id", "reach"])

    balls, members = classes, classes.select(F.col("id").alias("member"), "id")
    for seed in range(rounds):
        found = store(_ordered(balls, [1000 + seed], COVER_BLOCK, absorb, "member bigint, id bigint, reach double"), "absorbed")
        radius = found.groupBy("id").agg(F.max("reach").alias("radius"))
        balls = store(balls.drop("radius").join(radius, "id"), "balls")
        members = store(members.withColumnRenamed("id", "was").join(found.select(F.col("member").alias("was"), "id"), "was").select("member", "id"), "members")
    return balls, members


def _listed(ids: np.ndarray, sims: np.ndarray, near: np.ndarray, low: np.ndarray, joined: np.ndarray, k: int) -> pa.RecordBatch:
    """(v, u, sim, near) of pairs of a block in ``joined`` that are near, or above ``low`` and among the k best of their row."""
    sims = np.where(joined, sims, -np.inf)
    if len(ids) > k + 1:
        low = np.maximum(low, np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k])
    v, u = np.nonzero(joined & (near | (sims >= low[:, None])))
    return pa.record_batch([pa.array(ids[v]), pa.array(ids[u]), pa.array(sims[v, u].astype(np.float64)), pa.array(near[v, u])], names=["v", "u", "sim", "near"])


def _near(sims: np.ndarray, radius: np.ndarray, other: np.ndarray, theta: float) -> np.ndarray:
    """Whether members of balls with centres of these (single precision) cosines may link."""
    return np.arccos(np.clip(sims, -1, 1)) <= theta + 1e-3 + radius[:, None] + other[None, :]


EDGE = "v bigint, u bigint, sim double, near boolean"


def seeded(balls: DataFrame, theta: float, seeds: list[int], block: int, k: int = K) -> DataFrame:
    """(v, u, sim, near) of the nearest in each block of each order."""
    def nearest(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit, radius, ids = _matrix(part.column("unit")).astype(np.float32), part.column("radius").to_numpy(), part.column("id").to_numpy()
        for lo in range(0, len(ids), BLOCK):         # a large block row by row of small ones
            sims = unit[lo:lo + BLOCK] @ unit.T
            near = _near(sims, radius[lo:lo + BLOCK], radius, theta)
            joined = ids[lo:lo + BLOCK, None] != ids[None, :]
            sims = np.where(joined, sims, -np.inf)
            least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k + 1 else np.full(len(sims), -2.0)
            v, u = np.nonzero(joined & (near | (sims >= least[:, None])))
            yield pa.record_batch([pa.array(ids[lo + v]), pa.array(ids[u]), pa.array(sims[v, u].astype(np.float64)), pa.array(near[v, u])], names=["v", "u", "sim", "near"])

    return _ordered(balls, seeds, block, nearest, EDGE)


def merged(old: DataFrame | None, found: DataFrame, k: int = K) -> DataFrame:
    """The lists (v, u, sim, near, new): the k best of each node and all near ones; written."""
    found = found.withColumn("new", F.lit(True))
    every = found if old is None else old.unionByName(found)
    every = every.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.bool_or("near").alias("near"), F.bool_and("new").alias("new"))
    best = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return store(every.withColumn("place", F.row_number().over(best)).filter((F.col("place") <= k) | F.col("near")).drop("place"), "lists")


def refined(lists: DataFrame, balls: DataFrame, theta: float, turn: int, k: int = K) -> DataFrame:
    """The lists after every node's neighbours, forward and backward, were compared with each other where one is new."""
    both = lists.select(F.col("v").alias("w"), F.col("u").alias("x"), "new").unionByName(lists.select(F.col("u").alias("w"), F.col("v").alias("x"), "new"))
    both = both.groupBy("w", "x").agg(F.bool_or("new").alias("new"))
    runs = both.groupBy("w").agg(F.ceil(F.count("*") / JOIN_ROWS).alias("runs"), F.bool_or("new").alias("any"))
    info = balls.select("id", "unit", "radius").join(
        lists.groupBy("v").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("low")), F.col("id") == F.col("v"), "left")
    info = info.select(F.col("id").alias("x"), "unit", "radius", F.coalesce("low", F.lit(-2.0)).alias("low"))
    rows = both.join(runs.filter("any"), "w").withColumn("run", F.pmod(F.xxhash64("x", F.lit(turn)), F.col("runs"))).drop("runs", "any")

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(x, "<f8").astype("<f4").tobytes() for x in batch.column("unit").to_pylist()]
            yield pa.record_batch([batch.column("x"), pa.array(units, pa.binary()), batch.column("radius"), batch.column("low")], names=["x", "unit", "radius", "low"])

    info = info.mapInArrow(lean, "x bigint, unit binary, radius double, low double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, ["w", "run"], 1 << 30):
            new = part.column("new").to_numpy(zero_copy_only=False)
            if part.num_rows > 1 and new.any():
                unit, radius, ids = _matrix(part.column("unit"), "<f4"), part.column("radius").to_numpy(), part.column("x").to_numpy()
                sims = unit @ unit.T
                joined = (new[:, None] | new[None, :]) & ~np.eye(len(ids), dtype=bool)
                yield _listed(ids, sims, _near(sims, radius, radius, theta), part.column("low").to_numpy(), joined, k)

    order = ["w", "run"]
    found = rows.join(info, "x").repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, EDGE)
    wide = runs.filter("runs > 1").select(F.col("w").alias("v"), F.lit(True).alias("again"))
    old = lists.join(wide, "v", "left").select("v", "u", "sim", "near", F.coalesce("again", F.lit(False)).alias("new"))
    return merged(old, found, k)


def missed(lists: DataFrame, balls: DataFrame, theta: float, sample: int = AUDIT) -> tuple[float, DataFrame]:
    """The share of near pairs of a sample of nodes that the lists hold, and those that they lack."""
    asked = balls.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("id", "label", "dim", "unit", "radius").collect()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for place in set(where) & {(a.label, a.dim) for a in asked}:
                own = [a for a in asked if (a.label, a.dim) == place]
                part = batch.filter(pa.array([w == place for w in where]))
                ids = part.column("id").to_numpy()
                sims = np.stack([np.frombuffer(a.unit, "<f8") for a in own]) @ _matrix(part.column("unit")).T
                mine = np.array([a.id for a in own])
                near = _near(sims, np.array([a.radius for a in own]), part.column("radius").to_numpy(), theta) & (mine[:, None] != ids[None, :])
                v, u = np.nonzero(near)
                yield pa.record_batch([pa.array(mine[v]), pa.array(ids[u]), pa.array(sims[v, u]), pa.array(np.ones(len(v), bool))], names=["v", "u", "sim", "near"])

    true = store(balls.mapInArrow(compare, EDGE), "audit")
    known = lists.filter("near")
    lacking = true.join(known.select("v", "u"), ["v", "u"], "left_anti").join(known.select(F.col("v").alias("u"), F.col("u").alias("v")), ["v", "u"], "left_anti")
    lacking = store(lacking, "lacking")
    total = true.count()
    return 1.0 if not total else 1 - lacking.count() / total, lacking


def near_pairs(balls: DataFrame, theta: float, recall: float = RECALL, k: int = K, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(v, u), v < u, of balls that may link, by NN-descent until nothing new is found and the audit is passed."""
    lists = merged(None, seeded(balls, theta, list(range(orders)), block, k), k)
    found, turn = lists.filter("near").count(), 0
    while True:
        turn += 1
        lists = refined(lists, balls, theta, turn, k)
        before, found = found, lists.filter("near").count()
        if found > before:
            continue
        share, lacking = missed(lists, balls, theta)
        if share >= recall:
            return store(lists.filter("near").select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct(), "near")
        block *= 2
        lists = merged(lists, lacking.unionByName(seeded(balls, theta, [100 * turn + i for i in range(orders)], block, k)), k)


def decided(pairs: DataFrame, balls: DataFrame, members: DataFrame, theta: float, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (v, u) of balls that link wholly, pairs that link in part, and (member, n): the links that members have in the latter.

    ``members``: (member, id, unit, weight)."""
    side = balls.select("id", "unit", "radius")
    rows = pairs.join(side.select(F.col("id").alias("v"), F.col("unit").alias("a"), F.col("radius").alias("ra")), "v")
    rows = rows.join(side.select(F.col("id").alias("u"), F.col("unit").alias("b"), F.col("radius").alias("rb")), "u")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = [float(np.frombuffer(a, "<f8") @ np.frombuffer(b, "<f8")) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            cosine, reach = np.array(dots), batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
            alone = reach == 0
            whole = np.where(alone, cosine >= threshold, angle_at_most(cosine) + reach < theta)
            part = ~whole & ~alone & (angle_at_least(cosine) - reach <= theta)
            yield pa.record_batch([batch.column("v"), batch.column("u"), pa.array(whole), pa.array(part)], names=["v", "u", "whole", "part"])

    judged = store(rows.select("v", "u", "a", "b", "ra", "rb").mapInArrow(judge, "v bigint, u bigint, whole boolean, part boolean"), "judged")
    partly = judged.filter("part").select("v", "u")
    runs = members.groupBy("id").agg(F.ceil(F.count("*") / CHUNK).alias("runs"))
    partly = partly.join(runs.select(F.col("id").alias("v"), F.col("runs").alias("nv")), "v").join(runs.select(F.col("id").alias("u"), F.col("runs").alias("nu")), "u")

    def dealt(own: str, n: str, other: str, mine: bool) -> DataFrame:
        """Each member in one run of its own side, against every run of the other side."""
        run = F.pmod(F.xxhash64("member"), F.col(n))
        out = partly.join(members.withColumnRenamed("id", own), own).withColumn("run", run).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        i, j = ("run", "other") if mine else ("other", "run")
        return out.select("v", "u", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(mine).alias("first"), "member", "unit", "weight")

    order = ["v", "u", "i", "j"]
    both = dealt("v", "nv", "nu", True).unionByName(dealt("u", "nu", "nv", False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, order, 1 << 30):
            first = part.column("first").to_numpy(zero_copy_only=False)
            a, b = part.filter(pa.array(first)), part.filter(pa.array(~first))
            if a.num_rows and b.num_rows:
                link = _matrix(a.column("unit")) @ _matrix(b.column("unit")).T >= threshold
                n = np.concatenate([link @ b.column("weight").to_numpy(), link.T @ a.column("weight").to_numpy()])
                ids = np.concatenate([a.column("member").to_numpy(), b.column("member").to_numpy()])
                keep = n > 0
                yield pa.record_batch([pa.array(np.full(keep.sum(), part.column("v")[0].as_py())), pa.array(np.full(keep.sum(), part.column("u")[0].as_py())),
                                       pa.array(ids[keep]), pa.array(n[keep])], names=["v", "u", "member", "n"])

    counts = store(both.repartition(*order).sortWithinPartitions(*order).mapInArrow(count, "v bigint, u bigint, member bigint, n bigint"), "counts")
    return judged.filter("whole").select("v", "u"), counts.select("v", "u").distinct(), counts.groupBy("member").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    theta = math.acos(threshold)
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_vectors(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["vec", "label", "unit"])

    rows = vectors.select(F.col(id_col).alias("vec"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(read, f"vec {id_kind}, label {label_kind}, unit binary")
    rows = store(rows.withColumn("digest", F.when(F.col("label").isNotNull(), F.sha2("unit", 256))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.filter("digest IS NOT NULL").groupBy("label", "digest").agg(
        F.min(F.struct("row", "unit")).alias("first"), F.count("*").alias("weight"), F.min("vec").alias("least"))
    classes = store(classes.select(F.col("first.row").alias("id"), "label", "digest", (F.octet_length("first.unit") / 8).cast("int").alias("dim"),
                                   F.col("first.unit").alias("unit"), F.lit(0.0).alias("radius"), "weight", "least"), "classes")
    balls, members = cover(classes.select("id", "label", "dim", "unit", "radius"), theta / 2 - 1e-9)
    members = members.join(classes.select(F.col("id").alias("member"), "unit", "weight", "least"), "member")
    whole, partly, counts = decided(near_pairs(balls, theta, recall), balls, members.drop("least"), theta, threshold)

    weights = store(members.groupBy("id").agg(F.sum("weight").alias("weight"), F.min("least").alias("least")), "weights")
    either = whole.unionByName(whole.select(F.col("u").alias("v"), F.col("v").alias("u")))
    beyond = either.join(weights.select(F.col("id").alias("u"), "weight"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("weight").alias("beyond"))
    joined = components(whole.unionByName(partly).select(F.col("v").alias("a"), F.col("u").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("root"))
    of = weights.join(joined, "id", "left").join(beyond, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select("id", "component_id", (F.col("weight") - 1 + F.coalesce("beyond", F.lit(0))).alias("inner"))
    known = members.select("member", "id").join(of, "id").join(counts, "member", "left")
    known = classes.select(F.col("id").alias("member"), "label", "digest").join(known, "member").select(
        "label", "digest", "component_id", (F.col("inner") + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"))
    out = rows.select("vec", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec"))
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of a label, so for small tables; what a search missed would show here.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
     g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                  AND len(list_filter(v, lambda x: x <> 0)) > 0),
     p AS (SELECT a.r AS a, b.r AS b, b.vec_id FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
           WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
     c AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM p) UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
     m AS (SELECT a, min(e.vec_id) AS component_id FROM c JOIN e ON e.r = c.b GROUP BY a),
     n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, CASE WHEN n.a IS NULL THEN e.vec_id ELSE component_id END AS component_id,
       e.vec_id IS NOT DISTINCT FROM CASE WHEN n.a IS NULL THEN e.vec_id ELSE component_id END AS kept
FROM e LEFT JOIN n ON n.a = e.r LEFT JOIN m ON m.a = e.r
"""
