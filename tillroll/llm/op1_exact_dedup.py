"""Exact deduplication with Patricia-trie owners.

Texts are normalised (A-Z to a-z; null counts as empty) and dealt by length and content hash.  Tries
compare full byte strings: one in each task that reads documents joins the equal texts it meets, so
a text that a third of all rows share is one row per task before anything is shuffled; one in each
partition after the shuffle joins those.  A terminal holds the identifier that owns its text and the
number of rows.  ``keep="largest"`` ranks identifiers downwards, ``"smallest"`` upwards.

Every document then finds its owner by length and hash, in an equi-join whose hot keys adaptive
execution splits.

Defined cases: null and empty texts are equal to each other; a null identifier ranks after all
others; rows that repeat an identifier with its text all count in the group and are all kept if
theirs is; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.tries import OwnerTrie

#: Bytes that a trie holds before it passes rows on (before the shuffle) or spills (after it).
LOCAL_BYTES, FINAL_BYTES, BATCH_BYTES = 32 << 20, 64 << 20, 8 << 20


def _rank(owner: int | str | None, keep: str) -> tuple:
    """Orders identifiers so that the one to keep is smallest; null is last."""
    if owner is None:
        return (1,)
    if keep == "smallest":
        return (0, owner)
    return (0, -owner) if isinstance(owner, int) else (0, tuple(-ord(c) for c in owner), 0)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[4]) if len(row) > 4 else 0)
        if size > BATCH_BYTES:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def owners(docs: DataFrame, keep: str) -> DataFrame:
    """(size, digest, keep_id, group_size) of every distinct text of (doc_id, size, digest, body)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = OwnerTrie(1 << 62), None

        def flush() -> Iterator[pa.RecordBatch]:
            return _batches(((len(key), own[3], own[1], own[2], key) for key, own in trie.terminals()), schema)

        for batch in batches:
            schema = pa.schema([("size", pa.int64()), ("digest", pa.string()), ("doc_id", batch.schema.field("doc_id").type), ("n", pa.int64()), ("body", pa.binary())])
            for owner, digest, body in zip(batch.column("doc_id").to_pylist(), batch.column("digest"), batch.column("body"), strict=True):
                trie.insert(body.as_py(), _rank(owner, keep), owner, 1, digest.as_py())
                if trie.held > LOCAL_BYTES:
                    yield from flush()
        if schema:
            yield from flush()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = OwnerTrie(FINAL_BYTES), None
        for batch in batches:
            schema = pa.schema([("size", pa.int64()), ("digest", pa.string()), ("keep_id", batch.schema.field("doc_id").type), ("group_size", pa.int64())])
            for owner, digest, n, body in zip(batch.column("doc_id").to_pylist(), batch.column("digest"), batch.column("n").to_pylist(), batch.column("body"), strict=True):
                trie.insert(body.as_py(), _rank(owner, keep), owner, n, digest.as_py())
        if schema:
            yield from _batches(((len(key), own[3], own[1], own[2]) for key, own in trie.terminals()), schema)

    met = docs.select("size", "digest", "doc_id", "body").mapInArrow(local, f"size bigint, digest string, doc_id {kind}, n bigint, body binary")
    return met.repartition("size", "digest").mapInArrow(final, f"size bigint, digest string, keep_id {kind}, group_size bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    body = F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower()).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    rows = rows.select("doc_id", "body", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("digest"))
    out = rows.select("doc_id", "size", "digest").join(owners(rows, keep), ["size", "digest"])
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
