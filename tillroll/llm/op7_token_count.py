"""Token counts with a whole-token shortcut.

A vocabulary string that encodes, alone, as exactly one token needs no merging when it turns up as
a whole pre-token.  ``whole_tokens`` proves this once per worker for every vocabulary string; texts
are split into pre-tokens, those strings count one each, and only the rest is merged.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count
as the library's default reads them (one special token); repeated rows give repeated results; an
empty table gives an empty result; columns besides the id and the text are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import tokens

LIMIT = 512
#: Merged pre-tokens remembered per worker; a bound on memory only, counts do not depend on it.
REMEMBERED = 200_000


@lru_cache(maxsize=None)
def whole_tokens() -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    split = regex.compile(public_tokenizers.PATTERN)
    encode = tokens.encoder().encode_ordinary
    proven = set()
    for raw in tokens.ranks():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if split.fullmatch(text) and len(encode(text)) == 1:
            proven.add(text)
    return frozenset(proven)


class Counts:
    """Counts the tokens of texts, remembering how many tokens each merged pre-token makes."""

    def __init__(self) -> None:
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = tokens.encoder().encode_ordinary
        self.whole = whole_tokens()
        self.merged: dict[str, int] = {}

    def of(self, text: str) -> int:
        parts = text.split(tokens.SPECIAL)
        total = len(parts) - 1
        for part in parts:
            pieces = self.split(part)
            rest = [p for p in pieces if p not in self.whole]
            total += len(pieces) - len(rest)
            for piece, times in Counter(rest).items():
                made = self.merged.get(piece)
                if made is None:
                    made = len(self.encode(piece))
                    if len(self.merged) >= REMEMBERED:
                        self.merged.clear()
                    if len(piece) <= 64:
                        self.merged[piece] = made
                total += made * times
        return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            texts = batch.column("text")
            n = [counts.of(t.as_py()) for t in texts]
            size = [0 if t is None else t.as_buffer().size for t in texts]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()),
                                   "n_tokens": pa.array(n, pa.int64())})

    out = source.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit)).withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
