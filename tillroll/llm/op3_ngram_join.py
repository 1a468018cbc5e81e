"""N-gram Jaccard self-join with count vectors and R-trees.

1. Every text becomes its set of k-word shingle hashes; equal sets are one node from here on.
2. Blocks.  Sets whose sizes allow the similarity fall in a common size class; a class hashes the
   shingles into more groups than two similar sets can differ in shingles, so one group at least
   holds the same shingles in both.  A block is a class, a group and its content.  Empty groups
   are no blocks; a class has spare groups for them.  Sets of up to ``SMALL`` shingles, which have few
   groups, get a block for each of their first shingles in order of the hash instead, so many that
   similar sets always share one: no link of theirs depends on odds.  For larger sets the odds that a
   similar pair has no common block are below 1e-9.
3. A block of up to three members yields its pairs.  Members of larger blocks are kept as rows
   (block, set), and an R-tree over their count vectors finds the pairs whose overlap may suffice;
   parities of finer counts turn down nearly all of those that are no links, in the same task.  A
   search gives the edges of a least spanning forest of what is left.
4. These pairs are verified against the full sets; components follow.  Blocks inside one component
   need no more work; those with several are searched again for all pairs across components, and the
   survivors are verified.

No group is expanded into all its pairs, and none is gathered in one task: a block that is frequent
within a task leaves one representative in the shuffle and its members as rows; blocks of more than
``CHUNK`` members are searched chunk against chunk.

Defined cases: a text without words (null, empty) has an empty set and is linked with nothing; a
text of fewer than k words is one shingle; repeated rows are equal sets; an empty table gives an
empty result; other columns are not read.  Identifiers must be integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import blobs as B, rtree, texthash as H
from tillroll.llm.components import components
from tillroll.llm.scratch import store, tasks

K, PERCENT = 4, 85
#: Postings that a task holds before it deals them out; members that make a block frequent in a task.
FLUSH, FREQUENT, CHUNK = 1 << 19, 256, 2048
SEEN = 1 << 20
#: Sets up to this size meet by their first shingles.
SMALL = 32
DOCS, POSTINGS, LEADERS, PAIRS, MEMBERS = range(5)
OUT = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "kind tinyint, bucket int, blob binary"


class Classes:
    """Size classes: sizes up to ``tops[c]``; ``groups[c]`` groups."""

    def __init__(self, percent: int, largest: int) -> None:
        tops = [1]
        while tops[-1] < largest * 100 // percent + 1:
            tops.append(max(tops[-1] + 1, tops[-1] * 3 // 2))
        self.tops = np.array(tops)
        differ = 2 * self.tops * (100 - percent) // (100 + percent)
        self.groups = differ + 9 + differ * 3 // 100
        self.percent = percent

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n)

    def both(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each size, and that of the largest size it can be similar to."""
        return self.of(n), self.of(n * 100 // self.percent)


def keys(row: np.ndarray, hashed: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block key) of every block of each row's set; ``row`` ascends, and ``hashed`` within a row."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, H.U)
    classes = Classes(percent, int(n.max()))
    own, upper = classes.both(n)
    content = H.mix(hashed ^ H.U(0x2545F4914F6CDD1D))
    rows, out = [], []
    for c, use in ((own, np.ones(len(n), bool)), (upper, upper != own)):
        use = use & (n > SMALL)
        pick = use[row]
        r, h = row[pick], hashed[pick]
        groups = np.where(use, classes.groups[c], 0)
        base = np.cumsum(groups) - groups
        seed = H.mix((c + 1).astype(H.U))
        group = ((H.mix(h ^ seed[r]) >> H.U(32)) * groups[r].astype(H.U) >> H.U(32)).astype(np.int64)
        at = base[r] + group
        total = int(groups.sum())
        sums = np.zeros(total, H.U)
        np.add.at(sums, at, content[pick])
        held = np.bincount(at, minlength=total) > 0
        owner = np.repeat(np.arange(len(n)), groups)[held]
        number = (np.arange(total) - np.repeat(base, groups))[held]
        rows.append(owner)
        out.append(H.mix(sums[held] ^ H.mix(seed[owner] + number.astype(H.U))))
    # two similar sets, one of up to SMALL members, share one of the first n - ceil(n * percent / 100) + 1
    small = n * percent <= SMALL * 100
    first = np.where(small & (n > 0), n + (-percent * n // 100) + 1, 0)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    pick = place < first[row]
    rows.append(row[pick])
    out.append(H.mix(hashed[pick] ^ H.U(0x8CB92BA72F3D8DD7)))
    return np.concatenate(rows), np.concatenate(out)


def sets(chunk: H.Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a chunk, and the size and identity of each set."""
    rows = chunk.hi - chunk.lo
    row, hashed = H.distinct(*H.shingles(H.words(chunk.data, chunk.offsets[:-1]), rows, k), rows)
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, H.U)
    np.add.at(total, row, H.mix(hashed ^ H.U(0x9FB21C651E98DF25)))
    return row, hashed, n, H.mix(total + n.astype(H.U) * H.U(0x9E3779B97F4A7C15))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(key)))


def _pairs(key: np.ndarray, sid: np.ndarray) -> list[np.ndarray]:
    """The distinct pairs (smaller, larger) of keys with two or three members; key, sid sorted."""
    starts, sizes = _runs(key)
    two, three = starts[sizes == 2], starts[sizes == 3]
    left = np.concatenate([sid[two], sid[three], sid[three], sid[three + 1]])
    right = np.concatenate([sid[two + 1], sid[three + 1], sid[three + 2], sid[three + 2]])
    left, right = _sorted_unique(left, right)
    return [left, right]


def _sorted_unique(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    return key[keep], sid[keep]


def _emit(kind: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind], pa.int8()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], schema=OUT)


def _map(k: int, percent: int, buckets: int, frequent: int):
    def flush(key: list[np.ndarray], sid: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, sid = _sorted_unique(np.concatenate(key) & H.U((1 << 48) - 1), np.concatenate(sid))
        starts, sizes = _runs(key)
        often = np.repeat(sizes > frequent, sizes)
        if often.any():
            members = [B.to48(key[often]), sid[often]]
            yield from (_emit(MEMBERS, b, x) for b, x in B.deal(members, (sid[often] % H.U(buckets)).astype(np.int32)))
            lead = starts[sizes > frequent]
            leaders = [B.to48(key[lead]), sid[lead]]
            yield from (_emit(LEADERS, b, x) for b, x in B.deal(leaders, (key[lead] % H.U(buckets)).astype(np.int32)))
        key, sid = key[~often], sid[~often]
        yield from (_emit(POSTINGS, b, x) for b, x in B.deal([B.to48(key), sid], (key % H.U(buckets)).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sid, held, seen, turn = [], [], 0, set(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(False)
            number = ids.fill_null(0).to_numpy(False).astype("<i8")
            for chunk in H.chunks(batch.column("text")):
                row, hashed, n, own = sets(chunk, k)
                turn += 1
                here = slice(chunk.lo, chunk.hi)
                docs = [number[here], known[here].astype(np.uint8), n.astype("<u4"), own]
                yield _emit(DOCS, int(own[0] % H.U(buckets)), B.pack(docs))
                if len(seen) > SEEN:
                    seen.clear()
                _, first = np.unique(own, return_index=True)
                new = np.zeros(len(own), bool)
                for i in first.tolist():
                    if n[i] and (s := int(own[i])) not in seen:
                        seen.add(s)
                        new[i] = True
                pick = new[row]
                r, found = keys(row[pick], hashed[pick], np.where(new, n, 0), percent)
                key.append(found)
                sid.append(own[r])
                held += len(found)
                if held > FLUSH:
                    yield from flush(key, sid)
                    key, sid, held = [], [], 0
        if held:
            yield from flush(key, sid)
    return run


def _reduce(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if kind in (POSTINGS, LEADERS):
                    held.setdefault(bucket, []).append((kind, blob.as_py()))
                else:
                    yield _emit(kind, bucket, blob.as_py())
        for bucket in list(held):
            parts = held.pop(bucket)
            read = [(kind, *B.unpack(blob, ["u6", "<u8"])) for kind, blob in parts]
            key, sid = _sorted_unique(np.concatenate([x[1] for x in read]), np.concatenate([x[2] for x in read]))
            led = [x[1] for x in read if x[0] == LEADERS]
            starts, sizes = _runs(key)
            wide = sizes > 3
            if led:
                wide |= np.isin(key[starts], np.concatenate(led))
            few = np.repeat((sizes > 1) & ~wide, sizes)
            if few.any():
                yield _emit(PAIRS, bucket, B.pack(_pairs(key[few], sid[few])))
            if wide.any():
                wide = np.repeat(wide, sizes)
                yield _emit(MEMBERS, bucket, B.pack([B.to48(key[wide]), sid[wide]]))
    return run


def _decode(table: DataFrame, kind: int, kinds: list[str], ddl: str, convert) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                columns = convert(B.unpack(blob.as_py(), kinds))
                for lo in range(0, len(columns[0][1]), 100_000):
                    yield pa.record_batch({name: values[lo:lo + 100_000] for name, values in columns})
    return table.filter(F.col("kind") == kind).select("blob").mapInArrow(run, ddl)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("<u8").view("<i8"), pa.int64())


def _full_sets(source: DataFrame, bits: np.ndarray, k: int) -> DataFrame:
    """(sid, n, vec, odd, members) of the sets that the filter lets through."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("odd", pa.binary()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in H.chunks(batch.column("text")):
                row, hashed, n, own = sets(chunk, k)
                ends = np.searchsorted(row, np.arange(len(n) + 1))
                if len(seen) > SEEN:
                    seen.clear()
                pick = [i for i in np.flatnonzero(B.may_contain(bits, own) & (n > 0)).tolist() if not (int(own[i]) in seen or seen.add(int(own[i])))]
                if not pick:
                    continue
                vec = rtree.vectors(row, hashed, len(n))
                low = np.sort  # sets of 48-bit numbers ascend
                yield pa.record_batch([_long(own[pick]), pa.array(n[pick], pa.int64()), pa.array([vec[i].tobytes() for i in pick], pa.binary()),
                                       pa.array([rtree.odd_bits(hashed[ends[i]:ends[i + 1]]) for i in pick], pa.binary()),
                                       pa.array([B.to48(low(hashed[ends[i]:ends[i + 1]] & H.U((1 << 48) - 1))).tobytes() for i in pick], pa.binary())], schema=schema)

    rows = source.select("text").mapInArrow(run, "sid bigint, n bigint, vec binary, odd binary, members binary")
    return rows.dropDuplicates(["sid"])


def _filtered(rows: DataFrame, test) -> DataFrame:
    """The (a, b) of the rows that ``test`` accepts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(test(batch), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return rows.mapInArrow(run, "a bigint, b bigint")


def _with_both(pairs: DataFrame, full: DataFrame, column: str, percent: int) -> DataFrame:
    """(a, b, x, y) with a column of both sets, of pairs whose sizes allow the similarity."""
    side = full.select("sid", "n", column)
    out = pairs.join(side.withColumnsRenamed({"sid": "a", "n": "na", column: "x"}), "a").join(side.withColumnsRenamed({"sid": "b", "n": "nb", column: "y"}), "b")
    return out.filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b", "x", "y")


def _asked(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that the pairs may need, told by a filter of fixed size before anything is shuffled."""
    bits = B.membership(pairs.select(F.explode(F.array("a", "b")).alias("sid")), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(B.may_contain(bits, batch.column("sid").to_numpy().view("<u8")), pa.bool_()))

    return full.select("sid", "n", "members").mapInArrow(run, "sid bigint, n bigint, members binary")


def bounded(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose count vectors allow the similarity."""
    def test(batch: pa.RecordBatch) -> list[bool]:
        if not batch.num_rows:
            return []
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, rtree.GROUPS).astype(np.int64) for c in ("x", "y"))
        return (np.minimum(x, y).sum(1) >= rtree.least_overlap(x.sum(1), y.sum(1), percent)).tolist()
    return _filtered(_with_both(pairs, full, "vec", percent), test)


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets reach the similarity."""
    def test(batch: pa.RecordBatch) -> list[bool]:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = B.from48(x.as_buffer()), B.from48(y.as_buffer())
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(both) - common))
        return out
    pairs = store(pairs, "candidates")
    return _filtered(_with_both(pairs, _asked(full, pairs), "members", percent), test)


def _searched(told: DataFrame, full: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of differently labelled sets of a block that may be links, by R-trees over its members' count vectors.

    ``told`` has (block, sid, label); with ``forest``, only a least spanning forest of the pairs of a search.
    """
    mixed = told.groupBy("block").agg(F.count("*").alias("m"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    parts = F.ceil(F.col("m") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("parts"))
    # a member meets every chunk of its block: a chunk pair is one search
    rows = (told.join(mixed.select("block", parts.alias("parts")), "block").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("block", F.least("own", "other").cast("int").alias("p"), F.greatest("own", "other").cast("int").alias("q"), F.col("own").cast("int").alias("own"), "sid", "label"))
    rows = rows.join(full.select("sid", "vec", "odd"), "sid").repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")

    def search(held: list[dict], seen: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        points = np.frombuffer(b"".join(h["vec"] for h in held), "<u4").reshape(-1, rtree.GROUPS).astype(np.int64)
        members = rtree.Members(points, rtree.folded([h["odd"] for h in held]), percent)
        own, p, q = (np.array([h[c] for h in held]) for c in ("own", "p", "q"))
        sid, label = (np.array([h[c] for h in held]) for c in ("sid", "label"))
        left, right = np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0])
        i, j, far = members.candidates(left, right, label)
        if forest:
            pick = rtree.forest(i, j, far, len(held))
            i, j = i[pick], j[pick]
        least, most = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
        new = {pair for pair in zip(least.tolist(), most.tolist(), strict=True) if pair not in seen}
        if len(seen) > SEEN:
            seen.clear()
        seen |= new  # a pair of several blocks goes out once from a task, while it is remembered
        if new:
            a, b = zip(*sorted(new), strict=True)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, seen = [], None, set()
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["block"], row["p"], row["q"])
                if here != at and held:
                    yield from search(held, seen)
                    held = []
                at = here
                held.append(row)
        if held:
            yield from search(held, seen)

    return rows.select("block", "p", "q", "own", "sid", "label", "vec", "odd").mapInArrow(run, "a bigint, b bigint").distinct()


def _blocked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes (doc_id, n, sid), pairs (a, b) of small blocks, members (block, sid) of larger ones, and the sets in either."""
    spark = docs.sparkSession
    buckets = 4 * tasks(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    met = source.mapInArrow(_map(k, percent, buckets, FREQUENT), DDL).repartition("bucket").mapInArrow(_reduce(buckets), DDL)
    table = store(met, "blocks")

    nodes = _decode(table, DOCS, ["<i8", "u1", "<u4", "<u8"], "doc_id bigint, n bigint, sid bigint", lambda c: [
        ("doc_id", pa.array(c[0], pa.int64(), mask=c[1] == 0)), ("n", pa.array(c[2].astype(np.int64))),
        ("sid", pa.array(c[3].view("<i8"), pa.int64(), mask=c[2] == 0))])
    pairs = _decode(table, PAIRS, ["<u8", "<u8"], "a bigint, b bigint", lambda c: [("a", _long(c[0])), ("b", _long(c[1]))])
    pairs = store(pairs.distinct(), "pairs")
    members = _decode(table, MEMBERS, ["u6", "<u8"], "block bigint, sid bigint", lambda c: [("block", _long(c[0])), ("sid", _long(c[1]))])
    members = store(members.distinct(), "members")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionAll(members.select("sid"))
    full = store(_full_sets(source, B.membership(asked, "sid"), k), "sets")
    return nodes, pairs, members, full


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(sid, component): the smallest identifier of every set, then of every component, then back to the sets."""
    least = nodes.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    told = least.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    told = store(told, "labels")
    return told.join(told.groupBy("label").agg(F.min("least").alias("component")), "label").select("sid", "component")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the smallest id reachable by links."""
    nodes, pairs, members, full = _blocked(docs, id_col, text_col, k, percent)
    alone = members.select("block", "sid", F.col("sid").alias("label"))
    near = bounded(pairs, full, percent).unionByName(_searched(alone, full, percent, forest=True)).distinct()
    first = store(verified(near, full, percent), "links")
    labels = components(first)
    told = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("block", "sid", F.coalesce("label", "sid").alias("label"))
    more = verified(_searched(store(told, "told"), full, percent, forest=False), full, percent)
    labels = components(first.unionByName(more))

    found = _named(nodes, labels)
    return nodes.join(found, "sid", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join: every link (a, b) between different sets, a < b, and (id, n_shingles, component_id, set_id, n_links) of every row.

    ``set_id`` is null for an empty set; ``n_links`` counts the other rows linked directly, copies among
    them.  All blocks are searched for all their pairs, so the work grows with the number of links,
    in a group of near copies with its square; ``linked`` finds the same components from fewer pairs."""
    nodes, pairs, members, full = _blocked(docs, id_col, text_col, k, percent)
    alone = members.select("block", "sid", F.col("sid").alias("label"))
    near = bounded(pairs, full, percent).unionByName(_searched(alone, full, percent, forest=False))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # the two order sets apart
    found = store(verified(near, full, percent), "all-links")
    copies = nodes.filter("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("rows"))
    both = found.select(F.col("a").alias("sid"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("sid"), F.col("a").alias("other")))
    far = both.join(copies.withColumnsRenamed({"sid": "other", "rows": "others"}), "other").groupBy("sid").agg(F.sum("others").alias("others"))
    counts = copies.join(far, "sid", "left").select("sid", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = nodes.join(_named(nodes, components(found)).join(counts, "sid"), "sid", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.col("sid").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found, rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
