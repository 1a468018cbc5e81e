"""Repair of conversation structure with a suffix-shared DAWG.

The rows of a conversation, in order of turn, have faults: blank (no visible character), duplicate
(role and text seen earlier in the conversation) or truncated (no ``.!?`` at the end); the first that
holds counts.  ``signatures`` writes each conversation as one symbol per row: the initial of the role
and the fault, or ``x`` for a row that must go.

A repair keeps (0), re-roles to user or assistant (1) or deletes (2) each row and may insert a user or
assistant row without text anywhere (5), so that the role initials read ``(s?(ua)+)?``; a truncated row that
stays costs 5 more.  ``plans`` finds the cheapest, ties by the smallest string of edit initials, for all
distinct signatures at once: they are sorted from their ends, so that signatures with a common rest meet
the same automaton node, and a node's cost-to-go and best edit for each grammar state are computed once.
From one grammar state each edit initial leads to one state only; of equally cheap edits the smallest
initial therefore starts the smallest audit, and a node need not hold the audit itself.

``repaired`` applies the plans and returns the rows with their texts; the query digests them.

Defined cases: null ids, turns, roles and texts count as one space where a value is needed (a null turn
sorts first, and a null id is one conversation); rows that share a turn are in order of role, then of the
digest of role and text; a conversation without rows, or with rows that all must go, has an empty
repair; an empty table gives an empty result; other columns are not read.  The rows of a
conversation pass one task as a stream (its SHA-256 is sequential), one symbol of each being held;
duplicates are ranked by a window, which spills.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.llm.scratch import store

WHITE = "\t\n\x0b\x0c\r "
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # what is inserted or re-roled to
ENDS = (0, 3)
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with seeded faults; ``gone`` marks those to drop."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", blank), F.coalesce("text", blank)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    return out.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"),
                      F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of role and text that ties of one turn are ordered by."""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(said, 256)))


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH_ROWS or size > BATCH_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every conversation of
    (conv_id, turn, role, text, gone)."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    lean = _keyed(rows).select("conv_id", "turn", "digest", "gone", F.substring("role", 1, 1).alias("initial"), "role",
                               (last == "").alias("blank"), last.isin(".", "!", "?").alias("whole"))
    order = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    lean = lean.repartition("conv_id").withColumn("seen", F.row_number().over(order) - 1)
    lean = lean.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "seen")
    id_kind = rows.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def conversations(first: pa.RecordBatch) -> Iterator[tuple]:
            def all_rows() -> Iterator[tuple]:
                yield from _tuples(iter([first]))
                yield from _tuples(batches)
            for conv, group in groupby(all_rows(), key=lambda r: r[0]):
                symbols, counts, illegal, before = [], [0, 0, 0], 0, None
                low = high = turn_before = None
                turns = 0
                for _, turn, gone, initial, blank, whole, seen in group:
                    if gone:
                        continue
                    if turn is not None and turn != turn_before:
                        low, high, turns, turn_before = turn if low is None else low, turn, turns + 1, turn
                    if before is not None and before + initial not in LEGAL:
                        illegal += 1
                    before = initial
                    fault = 0 if blank else 1 if seen else 2 if not whole else 3
                    if fault < 3:
                        counts[fault] += 1
                    known = initial if initial in ("s", "u", "a") else "o"
                    symbols.append("x" if fault < 2 else known.upper() if fault == 2 else known)
                yield (conv, "".join(symbols), high - low + 1 - turns if turns else 0, *counts, illegal)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("signature", pa.string()),
                                *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
            yield from _batches(conversations(batch), schema)

    return lean.select("conv_id", "turn", "gone", "initial", "blank", "whole", "seen").mapInArrow(
        scan, f"conv_id {id_kind}, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


#: A node's table: for each grammar state the cost-to-go, the first edit's initial and the state after it.
Table = list[tuple[int, str, int] | None]


def _inserted(table: Table) -> Table:
    """``table`` where an insertion before the next row may come first (two suffice: after them a state recurs)."""
    for _ in range(2):
        old = list(table)
        for state, then in ((0, 2), (1, 2), (2, 3), (3, 2)):
            if old[then] is not None:
                way = (old[then][0] + INSERT, "I", then)
                table[state] = way if table[state] is None else min(table[state], way)
    return table


def end_node() -> Table:
    return _inserted([(0, "", s) if s in ENDS else None for s in range(4)])


def node(symbol: str, rest: Table) -> Table:
    """The table of the node that reads ``symbol`` and goes on at the node of ``rest``."""
    known, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out: Table = []
    for state in range(4):
        ways = [(rest[state][0] + DELETE, "D", state)] if rest[state] else []
        if symbol != "x":
            then = NEXT[state].get(known)
            if then and rest[then]:
                ways.append((rest[then][0] + KEEP + late, "K", then))
            then = NEXT[state][ROLE[state][0]]
            if rest[then]:
                ways.append((rest[then][0] + REROLE + late, "R", then))
        out.append(min(ways) if ways else None)
    return _inserted(out)


def walk(tables: list[Table]) -> tuple[int, str]:
    """(cost, audit) of the path from the node of a whole signature, last in ``tables``, to the end node."""
    state, at, audit = 0, len(tables) - 1, []
    while True:
        cost, edit, then = tables[at][state]
        if not edit:
            return tables[-1][0][0], "".join(audit)
        audit.append(edit)
        state, at = then, at - (edit != "I")


def plans(found: DataFrame) -> DataFrame:
    """(signature, cost, audit, new_nodes) of every distinct signature.

    Sorted from the end, signatures that share a rest follow each other; the path of nodes from the end node
    is kept as a stack, and only nodes behind the common rest are new."""
    words = found.select("signature").distinct().withColumn("from_end", F.reverse("signature"))

    def dawg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("new_nodes", pa.int64())])

        def made() -> Iterator[tuple]:
            path, before = [end_node()], ""
            for (word,) in _tuples(batches):
                shared = 0
                for a, b in zip(word, before, strict=False):
                    if a != b:
                        break
                    shared += 1
                del path[shared + 1:]
                for symbol in word[shared:]:
                    path.append(node(symbol, path[-1]))
                before = word
                yield (word[::-1], *walk(path), len(word) - shared)

        yield from _batches(made(), schema)

    sorted_words = words.select("from_end").repartitionByRange("from_end").sortWithinPartitions("from_end")
    return sorted_words.mapInArrow(dawg, "signature string, cost bigint, audit string, new_nodes bigint")


def planned(rows: DataFrame) -> DataFrame:
    """``signatures`` of (conv_id, turn, role, text, gone) with cost and audit; written, to cut lineage."""
    found = store(signatures(rows), "signatures")
    return store(found.join(plans(found), "signature"), "plans")


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, next to each other in one partition."""
    kept = _keyed(rows.filter(~F.col("gone"))).drop("gone")
    heads = plan.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                        F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), F.col("audit"))
    both = heads.unionByName(kept.withColumn("audit", F.lit(None).cast("string"))).withColumn("body", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "body", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "turn", "role", "text", "audit")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, (edit, turn, role, text) of each repaired row in order) of a stream of ``_streamed``."""
    for conv, group in groupby(_tuples(batches), key=lambda r: r[0]):
        audit = next(group)[4]

        def rows(audit: str = audit, group: Iterator[tuple] = group) -> Iterator[tuple]:
            state = 0
            for edit in audit:
                if edit == "I":
                    yield edit, None, ROLE[state], ""
                    state = NEXT[state][ROLE[state][0]]
                    continue
                _, turn, role, text, _ = next(group)
                if edit == "D":
                    continue
                role = ROLE[state] if edit == "R" else role
                yield edit, turn, role, text
                state = NEXT[state][role[0]]
        yield conv, rows()


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of every repaired conversation."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("place", pa.int64()), ("edit", pa.string()),
                            ("turn", first.schema.field("turn").type), ("role", pa.string()), ("text", pa.string())])
        flat = ((conv, place, *row) for conv, out in edited(_again(first, batches)) for place, row in enumerate(out))
        yield from _batches(flat, schema)

    return _streamed(rows, plan).mapInArrow(apply, f"conv_id {kinds['conv_id']}, place bigint, edit string, turn {kinds['turn']}, role string, text string")


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of ``role:text`` of the repaired rows, joined by newlines."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("repaired_sha256", pa.string())])

        def made() -> Iterator[tuple]:
            for conv, out in edited(_again(first, batches)):
                digest, between = hashlib.sha256(), b""
                for _, _, role, text in out:
                    digest.update(between + role.encode() + b":" + text.encode())
                    between = b"\n"
                yield conv, digest.hexdigest()
        yield from _batches(made(), schema)

    return _streamed(rows, plan).mapInArrow(apply, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): fault counts, cost, audit and digest of the repair."""
    plan = planned(rows)
    done = digests(rows, plan)
    same = plan["conv_id"].eqNullSafe(done["conv_id"])
    return plan.join(done, same).select(plan["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _way(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _plus(cost: str, edit: str, way: str) -> str:
    return f"{{c: {way}.c + {cost}, e: '{edit}' || {way}.e}}"


def _sql() -> str:
    """Dynamic programming from the end of each distinct signature, the four states side by side."""
    never, done = "{c: 1000000000::BIGINT, e: '~'}", "{c: 0::BIGINT, e: ''}"
    def relaxed(b: list[str]) -> list[str]:
        two, three = _way(b[2], _plus("5", "I", b[3])), _way(b[3], _plus("5", "I", b[2]))
        return [_way(b[0], _plus("5", "I", two)), _way(b[1], _plus("5", "I", two)), two, three]
    ends = relaxed([done, never, never, done])
    late = "(CASE WHEN y <> lower(y) THEN 5 ELSE 0 END)"
    steps = []
    for state in range(4):
        keeps = " ".join(f"WHEN lower(y) = '{i}' THEN {_plus(late, 'K', f'v{t}')}" for i, t in NEXT[state].items())
        target = NEXT[state][ROLE[state][0]]
        steps.append(_way(_plus("2", "D", f"v{state}"), f"(CASE WHEN y = 'x' THEN {never} {keeps} ELSE {never} END)",
                          f"(CASE WHEN y = 'x' THEN {never} ELSE {_plus(f'1 + {late}', 'R', f'v{target}')} END)"))
    bases = ", ".join(f"{s} AS b{i}" for i, s in enumerate(steps))
    after = ", ".join(f"{s} AS v{i}" for i, s in enumerate(relaxed([f"b{i}" for i in range(4)])))
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
     d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
                      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
           FROM conversations, crc),
     r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again, kind
           FROM d),
     k AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest,
                  right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS fin FROM r WHERE kind <> 0),
     f AS (SELECT *, left(role, 1) AS initial,
                  CASE WHEN fin = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 THEN 'duplicate'
                       WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  row_number() OVER o AS place, lag(left(role, 1)) OVER o AS before
           FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, again)),
     g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                  count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                  string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x'
                                  WHEN fault = 'truncated' THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END)
                                  WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END, '' ORDER BY place) AS sig
           FROM f GROUP BY conv_id),
     b AS (SELECT sig, length(sig) AS n, {', '.join(f'{s} AS v{i}' for i, s in enumerate(ends))} FROM (SELECT DISTINCT sig FROM g)
           UNION ALL
           SELECT sig, n, {after} FROM (SELECT sig, n - 1 AS n, {bases}
                                        FROM (SELECT sig, n, v0, v1, v2, v3, substr(sig, n, 1) AS y FROM b WHERE n > 0))),
     p AS (SELECT sig, v0.c AS cost, v0.e AS audit FROM b WHERE n = 0),
     e AS (SELECT sig, audit, unnest(range(1, length(audit) + 1)) AS j FROM p),
     a AS (SELECT sig, j, substr(audit, j, 1) AS edit,
                  length(replace(substr(audit, 1, j), 'I', '')) AS place,
                  length(replace(substr(audit, 1, j), 'D', '')) AS out FROM e),
     w AS (SELECT g.conv_id, a.out, a.edit, f.role, f.text,
                  max(CASE WHEN a.out = 1 AND a.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS system
           FROM g JOIN a ON g.sig = a.sig LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.place = a.place
           WHERE a.edit <> 'D'),
     h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                  || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY out)) AS digest FROM w GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.cost, 0) AS cost,
       coalesce(p.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN p ON g.sig = p.sig
LEFT JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""


ORACLE_SQL = _sql()
