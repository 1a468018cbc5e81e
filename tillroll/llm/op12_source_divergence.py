"""Source divergence audit by a recount over minimal perfect hashes.

Which terms does a source use more than its language does, and how far are sources apart?  Terms are runs of letters
(any character beyond ASCII counts as one), A-Z lower-cased.

1. ``kept_terms``: exact document frequencies of all (language, term), filtered.
2. ``hash_shards``: the kept terms of a language are dealt to shards of about SHARD_TERMS by their hash;
   each shard becomes a minimal perfect hash with its terms stored in slot order.
3. ``recount``: shards of at most BROADCAST_BYTES together are broadcast.  A second pass over the texts
   turns each term into the slot of its shard, verified against the stored term, and sends (group, slot, count).
   Terms of shards beyond that bound are sent as strings and find their slot in the shard's own task.  There each
   (language, source) group has a dense array of slots, which the counts increment.
4. ``pair_sums`` and ``top_terms`` read those arrays shard by shard, with the groups' totals.

All arithmetic is in integers: p = 1 + floor(10^9 (count + 1) / (N + V)) by long division, f = floor((p - q)^2 / q).

Defined cases: null text, language and source count as ''; groups without terms, and languages without kept
terms, have pairs (value 0 if no term is kept); rows that repeat count each; an empty table gives an empty
result; other columns are not read.  A task holds the counts of one shard for all sources of one language, as
rows of the result for one language are pairs of its sources; one number for each language goes to every task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.llm.perfect_hash import LEVELS, Shards, build, hashes
from tillroll.llm.scratch import store
from tillroll.llm.texthash import chunks, text_buffers

MIN_DOCS, SHARD_TERMS, TOP, SCALE_STEPS = 3, 4096, 200, 3
#: Bytes of perfect hashes that are sent to every task; the rest is looked up in the shards' own tasks.
BROADCAST_BYTES = 64 << 20
CHUNK_BYTES, CELLS = 8 << 20, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(text, term) of every run of letters in texts at ``offsets`` of ``data``."""
    inside = np.append(_LETTER[data], False)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:]
    end = inside[:-1] & (~inside[1:] | edge[1:])
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    at = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    letters = _LOWER[data[inside[:-1]]]
    return text, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)])


def _runs_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(language, text number, index of its term, distinct terms, sources of the texts) of each chunk's texts of one language."""
    for batch in batches:
        lang, source = batch.column("lang"), batch.column("source")
        for part in chunks(batch.column("text"), CHUNK_BYTES):
            text, terms = term_runs(part.data, part.offsets)
            codes = lang.slice(part.lo, part.hi - part.lo).dictionary_encode()
            of_text = codes.indices.to_numpy()[text] if len(text) else np.zeros(0, int)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                here = np.flatnonzero(of_text == code)
                if len(here):
                    own = terms.take(pa.array(here)).dictionary_encode()
                    yield name, text[here], own.indices.to_numpy(), own.dictionary, source.slice(part.lo, part.hi - part.lo)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of terms in at least ``min_docs`` texts of the language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, index, terms, _ in _runs_by_lang(batches):
            pairs = np.unique(text.astype(np.int64) * len(terms) + index)
            docs_ = np.bincount(pairs % len(terms), minlength=len(terms))
            yield pa.record_batch([pa.array([lang] * len(terms)), terms.cast(pa.large_string()), pa.array(docs_)], names=["lang", "term", "docs"])

    counted = _texts(docs).mapInArrow(count, "lang string, term string, docs bigint")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")


def hash_shards(kept: DataFrame, shards_of: dict[str, int]) -> DataFrame:
    """(lang, shard, n, words, sizes, terms, bytes): the minimal perfect hash of each shard."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = hashes(batch.column("term"))
            of = np.array([shards_of[x] for x in batch.column("lang").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("lang"), pa.array((hashed % of).astype(np.int32)), batch.column("term")], names=["lang", "shard", "term"])

    def made(key: tuple, table: pa.Table) -> pa.Table:
        terms = pa.chunked_array(table.column("term")).combine_chunks().cast(pa.large_binary())
        words, sizes, order = build(hashes(terms))
        packed = _packed(terms.take(pa.array(order)))
        size = words.nbytes + sizes.nbytes + len(packed)
        return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "n": [len(terms)], "words": [words.tobytes()],
                         "sizes": [sizes.tobytes()], "terms": [packed], "bytes": [size]})

    dealt = kept.mapInArrow(deal, "lang string, shard int, term string")
    return dealt.groupBy("lang", "shard").applyInArrow(
        made, "lang string, shard int, n bigint, words binary, sizes binary, terms binary, bytes bigint")


def _packed(terms: pa.LargeBinaryArray) -> bytes:
    """Offsets, then letters, of the terms."""
    data, offsets = text_buffers(terms)
    return offsets.astype("<i8").tobytes() + data.tobytes()


def _unpacked(n: int, packed: bytes) -> pa.LargeBinaryArray:
    offsets, letters = pa.py_buffer(packed[:8 * (n + 1)]), pa.py_buffer(packed[8 * (n + 1):])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets, letters])


def _part(n: int, words: bytes, sizes: bytes, terms: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return np.frombuffer(words, "<u8"), np.frombuffer(sizes, np.int64), _unpacked(n, terms)


def _sent_to_all(shards: DataFrame, limit: int) -> list:
    """As many of the smallest shards as surely fit the limit together."""
    largest = shards.agg(F.max("bytes")).first()[0] or 1
    return shards.orderBy("bytes", "lang", "shard").limit(limit // largest).select("lang", "shard", "n", "words", "sizes", "terms").collect()


def recount(docs: DataFrame, shards: DataFrame, shards_of: dict[str, int], limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, shard, n, terms, sources, counts, totals): dense counts of each shard's slots, source after source."""
    spark = docs.sparkSession
    everywhere = spark.sparkContext.broadcast([tuple(r) for r in _sent_to_all(shards, limit)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple[Shards, np.ndarray]] = {}
        for lang in {row[0] for row in everywhere.value}:
            rows = [row for row in everywhere.value if row[0] == lang]
            number = np.full(shards_of[lang], -1)
            number[[row[1] for row in rows]] = np.arange(len(rows))
            own[lang] = Shards([_part(*row[2:]) for row in rows]), number
        for lang, text, index, terms, source in _runs_by_lang(batches):
            if lang not in shards_of:
                continue
            hashed = hashes(terms)
            shard = (hashed % np.uint64(shards_of[lang])).astype(np.int64)
            slot = np.full(len(terms), -2)                       # -2: look it up in the shard's task
            if lang in own:
                table, number = own[lang]
                here = np.flatnonzero(number[shard] >= 0)
                slot[here] = table.slots(number[shard[here]], hashed[here], terms.take(pa.array(here)))
            codes = source.dictionary_encode()
            group = codes.indices.to_numpy()[text].astype(np.int64)
            pairs, times = np.unique(group * len(terms) + index, return_counts=True)
            group, index = np.divmod(pairs, len(terms))
            known = slot[index] != -1
            group, index, times = group[known], index[known], times[known]
            order = np.lexsort((slot[index], shard[index]))
            group, index, times = group[order], index[order], times[order]
            of_shard = shard[index]
            if not len(of_shard):
                continue
            cuts = np.flatnonzero(np.diff(of_shard, prepend=-1)).tolist()
            names = codes.dictionary.to_pylist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(of_shard)], strict=True):
                used, local = np.unique(group[a:b], return_inverse=True)
                far = terms.take(pa.array(index[a:b])).to_pylist() if slot[index[a]] == -2 else None
                hits = np.stack([local, slot[index[a:b]], times[a:b]]).astype("<i8" if times[a:b].max() >> 31 else "<i4")
                out.append((lang, int(of_shard[a]), [names[i] for i in used.tolist()], hits.tobytes(), hits.itemsize, far))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT.types, strict=True)], schema=SENT)

    SENT = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())), ("hits", pa.binary()),
                      ("width", pa.int32()), ("far", pa.list_(pa.binary()))])
    sent = _texts(docs).mapInArrow(send, "lang string, shard int, sources array<string>, hits binary, width int, far array<binary>")
    lookup = shards.select("lang", "shard", "n", "words", "sizes", "terms")
    both = lookup.unionByName(sent, allowMissingColumns=True).withColumn("hit", F.col("hits").isNotNull())
    both = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "hit")
    COUNTED = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("terms", pa.binary()), ("sources", pa.list_(pa.string())),
                         ("counts", pa.list_(pa.binary())), ("totals", pa.list_(pa.int64()))])

    def increment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, dense, key = None, {}, None

        def finished() -> pa.RecordBatch:
            values = ([key[0]], [key[1]], [len(part[2])], [_packed(part[2])], [list(dense)],
                      [[row.tobytes() for row in dense.values()]], [[int(row.sum()) for row in dense.values()]])
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, COUNTED.types, strict=True)], schema=COUNTED)

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                if not columns["hit"][i].as_py():
                    if part is not None:
                        yield finished()
                    part, dense = _part(*(columns[c][i].as_py() for c in ("n", "words", "sizes", "terms"))), {}
                    key, table = (columns["lang"][i].as_py(), columns["shard"][i].as_py()), Shards([part])
                    continue
                local, slot, times = np.frombuffer(columns["hits"][i].as_py(), f"<i{columns['width'][i].as_py()}").reshape(3, -1)
                if columns["far"][i].is_valid:
                    far = columns["far"][i].values.cast(pa.large_binary())
                    slot = table.slots(np.zeros(len(far), np.int64), hashes(far), far)
                    local, slot, times = local[slot >= 0], slot[slot >= 0], times[slot >= 0]
                for number, source in enumerate(columns["sources"][i].as_py()):
                    here = local == number
                    if here.any():
                        counts = dense.setdefault(source, np.zeros(len(part[2]), np.int64))
                        np.add.at(counts, slot[here], times[here])
        if part is not None:
            yield finished()

    return both.mapInArrow(increment, "lang string, shard int, n bigint, terms binary, sources array<string>, counts array<binary>, totals array<bigint>")


def parts_per_billion(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / total), by long division, three digits a step."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _shares(row: dict, cells: int = CELLS) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first slot, sources, numbers of those with counts, their counts, shares of all sources, shares of the language)
    of runs of a shard's slots, so short that a table of all sources stays small."""
    names = [x["source"] for x in row["groups"]]
    number = {s: i for i, s in enumerate(names)}
    used = np.array([number[s] for s in row["sources"]], int)
    counts = np.stack([np.frombuffer(c, np.int64) for c in row["counts"]]) if len(used) else np.zeros((0, row["n"]), np.int64)
    totals = np.array([x["n"] for x in row["groups"]], np.int64)
    step = max(1, cells // max(1, len(names)))
    for lo in range(0, row["n"], step):
        some = counts[:, lo:lo + step]
        dense = np.zeros((len(names), some.shape[1]), np.int64)
        dense[used] = some
        yield (lo, names, used, some, parts_per_billion(dense, totals[:, None] + row["v"]),
               parts_per_billion(some.sum(axis=0), np.int64(totals.sum() + row["v"])))


def pair_sums(counted: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language."""
    KIND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums, names = None, []
                for _, names, _, _, p, _ in _shares(row):
                    sums = np.zeros((len(names), len(names)), np.int64) if sums is None else sums
                    for a in range(len(names)):
                        gap = p[a] - p
                        sums[a] += (gap * gap // p).sum(axis=1)
                for a, name in enumerate(names):
                    yield pa.record_batch([pa.array([row["lang"]] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(sums[a])], schema=KIND)

    found = counted.mapInArrow(pairs, "lang string, source string, item string, value bigint").filter("source <> item")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(counted: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value) of terms that a source uses more than its language; the ``top`` of each group and shard at least."""
    KIND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms = _unpacked(row["n"], row["terms"])
                for lo, names, used, counts, shares, q in _shares(row):
                    for a, own in zip(used.tolist(), counts, strict=True):
                        p = shares[a]
                        at = np.flatnonzero((own > 0) & (p > q))
                        value = (p[at] - q[at]) * (p[at] - q[at]) // q[at]
                        if len(at) > top:
                            least = np.partition(value, len(value) - top)[len(value) - top]
                            at, value = at[value >= least], value[value >= least]   # with all ties of the last one
                        if len(at):
                            yield pa.record_batch([pa.array([row["lang"]] * len(at)), pa.array([names[a]] * len(at)),
                                                   terms.take(pa.array(lo + at)).cast(pa.large_string()).cast(pa.string()), pa.array(value)], schema=KIND)

    return counted.mapInArrow(largest, "lang string, source string, item string, value bigint")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    groups = _texts(docs).select("lang", "source").distinct()
    kept = store(kept_terms(docs, min_docs), "kept")
    terms_of = {r.lang: r.v for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    shards_of = {lang: -(-v // SHARD_TERMS) for lang, v in terms_of.items()}
    shards = store(hash_shards(kept, shards_of), "shards")
    counted = store(recount(docs, shards, shards_of, limit), "counted")
    totals = counted.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy(
        "lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("n"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    groups = store(groups, "groups")
    roster = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    counted = counted.join(roster.join(sizes, "lang"), "lang")
    other = groups.select("lang", F.col("source").alias("item"))
    bare = groups.select("lang", "source").join(sizes, "lang", "left_anti").join(other, "lang").filter("source <> item")
    pairs = pair_sums(counted).unionByName(bare.withColumn("value", F.lit(0).cast("long")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = top_terms(counted, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
     l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
     p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                  (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total::HUGEINT + v))::HUGEINT AS p
           FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total)::HUGEINT + any_value(v)))::HUGEINT AS q
           FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(x.f), 0)::BIGINT AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN (SELECT a.lang, a.source, b.source AS item, (a.p - b.p) * (a.p - b.p) // b.p AS f
                          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) x
                 ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY ALL),
     terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms)
WHERE rank <= 200
"""
