"""Benchmark decontamination: size-partitioned MinHash containment search.

The sketch of an item of n distinct shingles is its ``n - ceil(threshold * n) + 1`` smallest shingle
hashes (bottom-m MinHash).  A document that holds at least ``threshold`` of the item's shingles
misses fewer than that many, so it holds one sketch hash at least: the search misses nothing, however
long the document.  Items are partitioned by size (powers of two).  A document asks only the
partitions whose smallest item could lie among the shingles that it shares with the benchmark, and
a pair of document and item survives only if that number reaches what this item needs.  Surviving
pairs are verified by exact shingle containment.

Everything is made in tasks and joined on hashes; the driver gets one membership filter of the
benchmark's hashes (sized by their count, ``FILTER_BYTES`` at most).  Where a benchmark outgrows that
bound the filter lets more document shingles through to the joins and the result stays the same.
Texts are told apart by SHA-256, so copies are searched once.

Defined cases: null and empty texts, and items without words, match nothing; an item of fewer
than k words is one shingle, found in a document as that run of words; repeated documents each
get their rows, repeated items are reported under each item id, null ids too; empty tables give empty
results; other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import texthash as H
from tillroll.llm.scratch import store

SHINGLE, THRESHOLD = 5, 0.8

#: The membership filter takes about 64 bits a hash, between 128 KB and this.
FILTER_BYTES = 1 << 25


def needed(n: int, threshold: float) -> int:
    """Shingles of an item of n that a document must hold."""
    return math.ceil(threshold * n - 1e-9)


def sketch_size(n: int, threshold: float) -> int:
    return n - needed(n, threshold) + 1


def _lists(row: np.ndarray, values: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """The values of each of ``rows`` as lists; ``row`` ascends."""
    offsets = np.append(np.searchsorted(row, rows), np.searchsorted(row, rows[-1], "right")) if len(rows) else np.zeros(1, int)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _runs(found: H.Words, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of exactly w words, in order of rows."""
    if len(found.row) < w:
        return np.zeros(0, np.int64), np.zeros(0, H.U)
    at = np.flatnonzero(found.row[w - 1:] == found.row[:len(found.row) - w + 1])
    return found.row[at], H._combine(found.hash, at, w)


def _digests(chunk: H.Chunk, rows: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(chunk.data[chunk.offsets[r]:chunk.offsets[r + 1]]).hexdigest() for r in rows.tolist()], pa.string())


def _sketched(items: DataFrame, item_col: str, item_text: str, k: int, threshold: float) -> DataFrame:
    """(item_id, key, n, width, part, hashes, sketch) of every item that has words, written; key tells sets apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for chunk in H.chunks(batch.column("text")):
                found, rows = H.words(chunk.data, chunk.offsets[:-1]), chunk.hi - chunk.lo
                width = np.minimum(np.bincount(found.row, minlength=rows), k)
                row, hashed = H.distinct(*H.shingles(found, rows, k), rows)
                own, n = np.unique(row, return_counts=True)
                if not len(own):
                    continue
                rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                short = rank < np.repeat([sketch_size(x, threshold) for x in n.tolist()], n)
                ends = np.cumsum(n)
                key = [hashlib.sha256(hashed[b - x:b].tobytes()).hexdigest() for b, x in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch({
                    "item_id": ids.take(pa.array(chunk.lo + own)), "key": pa.array(key, pa.string()), "n": pa.array(n, pa.int64()),
                    "width": pa.array(width[own], pa.int32()), "part": pa.array([int(x).bit_length() for x in n.tolist()], pa.int32()),
                    "hashes": _lists(row, hashed.view(np.int64), own), "sketch": _lists(row[short], hashed[short].view(np.int64), own)})

    kind = items.schema[item_col].dataType.simpleString()
    source = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    return store(source.mapInArrow(run, f"item_id {kind}, key string, n bigint, width int, part int, hashes array<bigint>, sketch array<bigint>"), "op6-items")


class Filter(NamedTuple):
    """Membership of hashes in the benchmark (part 0) and in the sketches of each size partition."""
    bits: np.ndarray
    widths: list[int]
    least: dict[int, int]   # per partition, the shingles that its smallest item needs

    def may_hold(self, part: int, hashed: np.ndarray) -> np.ndarray:
        return np.logical_and(*[(self.bits[word] >> bit) & H.U(1) == 1 for word, bit in _places(part, hashed, len(self.bits))])


def _places(part: int, hashed: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places (word, bit) of each hash in a filter of that many 64-bit words."""
    x = H.mix(hashed + H.U(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return [((half & H.U(words * 64 - 1)) // H.U(64), half & H.U(63)) for half in (x, x >> H.U(32))]


def _filter(items: DataFrame, threshold: float) -> Filter:
    size = items.agg(F.sum(F.size("hashes") + F.size("sketch"))).first()[0] or 0
    words = min(1 << max(14, size.bit_length()), FILTER_BYTES // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = np.zeros(words, H.U)
        for batch in batches:
            places = _places(0, batch.column("hashes").flatten().to_numpy().view(H.U), words)
            sketch = batch.column("sketch")
            part = np.repeat(batch.column("part").to_numpy(), sketch.value_lengths().to_numpy())
            hashed = sketch.flatten().to_numpy().view(H.U)
            for p in np.unique(part).tolist():
                places += _places(p, hashed[part == p], words)
            for word, bit in places:
                np.bitwise_or.at(bits, word.astype(np.int64), H.U(1) << bit)
        used = np.flatnonzero(bits)
        yield pa.record_batch({"w": pa.array(used, pa.int64()), "b": pa.array(bits[used].view(np.int64))})

    filled = items.select("part", "hashes", "sketch").mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(words, H.U)
    bits[filled["w"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64).view(H.U)
    parts = items.groupBy("part").agg(F.min("n").alias("n")).collect()
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    return Filter(bits, widths, {r.part: needed(r.n, threshold) for r in parts})


def _candidates(source: DataFrame, known: Filter) -> DataFrame:
    """(doc_id, digest, hashes, parts, asked) of the rows of (doc_id, text) that hold a sketch hash, written.

    ``hashes`` are all distinct shingles shared with the benchmark (a few more may pass the filter),
    ``asked`` those to look up in the size partition at the same place of ``parts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in H.chunks(batch.column("text")):
                found = H.words(chunk.data, chunk.offsets[:-1])
                kept = []
                for w in known.widths:
                    row, hashed = _runs(found, w)
                    may = known.may_hold(0, hashed)
                    kept.append((row[may], hashed[may]))
                row, hashed = (np.concatenate(c) for c in zip(*kept, strict=True))
                if not len(row):
                    continue
                order = np.lexsort((hashed, row))
                row, hashed = row[order], hashed[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
                row, hashed = row[new], hashed[new]
                shared = np.bincount(row)[row]
                asked = []
                for part, least in known.least.items():
                    at = np.flatnonzero(shared >= least)
                    at = at[known.may_hold(part, hashed[at])]
                    asked.append((at, np.full(len(at), part)))
                at, part = (np.concatenate(c) for c in zip(*asked, strict=True))
                order = np.argsort(at, kind="stable")
                at, part = at[order], part[order]
                if own := np.unique(row[at]).tolist():
                    rows = np.array(own)
                    here = np.isin(row, rows)
                    yield pa.record_batch({
                        "doc_id": ids.take(pa.array(chunk.lo + rows)), "digest": _digests(chunk, rows),
                        "hashes": _lists(row[here], hashed[here].view(np.int64), rows),
                        "parts": _lists(row[at], part.astype(np.int32), rows), "asked": _lists(row[at], hashed[at].view(np.int64), rows)})

    kind = source.schema["doc_id"].dataType.simpleString()
    if not known.widths:
        source = source.limit(0)
    return store(source.mapInArrow(run, f"doc_id {kind}, digest string, hashes array<bigint>, parts array<int>, asked array<bigint>"), "op6-candidates")


def _verified(candidates: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(digest, key, common, n) of every text and item that it contains."""
    texts, sets = candidates.dropDuplicates(["digest"]), items.dropDuplicates(["key"])
    lookups = (texts.select("digest", F.size("hashes").alias("shared"), F.explode(F.arrays_zip("parts", "asked")).alias("a"))
               .select("digest", "shared", F.col("a.parts").alias("part"), F.col("a.asked").alias("hash")))
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    sketches = sets.select("part", F.explode("sketch").alias("hash"), "key", need.alias("need"))
    pairs = lookups.join(sketches, ["part", "hash"]).filter(F.col("shared") >= F.col("need")).select("digest", "key").distinct()
    return (pairs.join(sets.select("key", "n", F.explode("hashes").alias("hash")), "key")
            .join(texts.select("digest", F.explode("hashes").alias("hash")), ["digest", "hash"])
            .groupBy("digest", "key", "n").agg(F.count("*").alias("common")).filter(F.col("common") >= need))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, common, item_shingles, containment) for every item that a document contains."""
    sketched = _sketched(items, item_col, item_text, k, threshold)
    found = _candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _filter(sketched, threshold))
    return (_verified(found, sketched, threshold).join(found.select("doc_id", "digest"), "digest").join(sketched.select("item_id", "key"), "key")
            .select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "common", F.col("n").alias("item_shingles"),
                    (F.col("common") / F.col("n")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item."""
    sketched = _sketched(items, item_col, item_text, k, threshold)
    found = _candidates(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), _filter(sketched, threshold))
    leaks = store(_verified(found, sketched, threshold).select("digest").distinct(), "op6-leaks")
    return docs.join(leaks, F.sha2(docs[text_col].cast("binary"), 256) == leaks["digest"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, row_number() OVER () AS r, id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM texts
), items AS (
  SELECT r, id, least(len(w), 5) AS width, unnest(list_distinct([array_to_string(w[j:j + least(len(w), 5) - 1], ' ')
           for j in range(1, len(w) - least(len(w), 5) + 2)])) AS s
  FROM words WHERE kind = 'i' AND len(w) > 0
), sizes AS (
  SELECT r, count(*) AS n FROM items GROUP BY r
), docs AS (
  SELECT DISTINCT words.r, words.id, width, unnest([array_to_string(w[j:j + width - 1], ' ') for j in range(1, len(w) - width + 2)]) AS s
  FROM words, (SELECT DISTINCT width FROM items) WHERE kind = 'd' AND len(w) >= width
)
SELECT docs.id AS doc_id, items.id AS item_id, count(*) AS common, n AS item_shingles, count(*) / n AS containment
FROM docs JOIN items USING (width, s) JOIN sizes ON sizes.r = items.r
GROUP BY docs.r, docs.id, items.r, items.id, n HAVING 5 * count(*) >= 4 * n
"""
