"""Operators 11 to 13 against brute force on small tables, and their defined cases."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import op11_conversation_repair as repair
from tillroll.llm import op12_source_divergence as divergence
from tillroll.llm import op13_embedding_neardup as neardup
from tillroll.llm.perfect_hash import Shards, build, hashes

ROWS = "conv_id long, turn long, role string, text string"


# ── 11: conversation repair ──────────────────────────────────────────────
def damaged(rows):
    """The contract's damage, row by row."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found, inserts=3):
    """(cost, audit, repaired) over every sequence of edits with at most ``inserts`` insertions."""
    best = None

    def go(i, roles, cost, audit, said, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best or (10**9, "~", []), (cost, audit, said))
        if left:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 5, audit + "I", said + [(role, "")], left - 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, roles, cost + 2, audit + "D", said, left)
        if found[i] not in ("blank", "duplicate"):
            late = 5 if found[i] == "truncated" else 0
            go(i + 1, roles + (role[:1] or "?"), cost + late, audit + "K", said + [(role, text)], left)
            for to in ("user", "assistant"):
                go(i + 1, roles + to[0], cost + 1 + late, audit + "R", said + [(to, text)], left)

    go(0, "", 0, "", [], inserts)
    return best


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        found, count = faults(own), Counter(faults(own))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, said = cheapest(own, found)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def by_conv(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_equals_search_over_all_edits(spark, tmp_path):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "why", " \n", "", None, "é?", "Ja.\n"]
    rows = [(conv, turn if rng.random() < 0.9 else None, rng.choice(roles[:3] if conv % 2 else roles), rng.choice(texts))
            for conv in range(60) for turn in range(rng.randrange(1, 7))] + [(None, 0, "user", "a."), (None, None, None, None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("signature", F.lit("clash")).withColumn("audit", F.lit(1))
    assert by_conv(repair.audit(repair.damage(df))) == expected(rows)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert {c: tuple(r) for c, *r in con.execute(repair.ORACLE_SQL).fetchall()} == by_conv(repair.query(spark, str(tmp_path)))


def test_repaired_rows_and_shared_nodes(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (2, 0, "system", "S."), (2, 1, "assistant", "A."), (3, 0, "system", "S."), (3, 1, "assistant", "A.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("gone", F.lit(False))
    plan = repair.planned(df)
    got = {(r.conv_id, r.place): (r.edit, r.turn, r.role, r.text) for r in repair.repaired(df, plan).collect()}
    assert {r.conv_id: (r.cost, r.audit) for r in plan.collect()} == {1: (4, "DD"), 2: (1, "RK"), 3: (1, "RK")}
    assert got == {(c, p): r for c in (2, 3) for p, r in enumerate((("R", 0, "user", "S."), ("K", 1, "assistant", "A.")))}
    long = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(4001)], ROWS).withColumn("gone", F.lit(False))
    plan = repair.planned(long)
    assert plan.first().cost == 2 and repair.repaired(long, plan).count() == 4000
    words = spark.createDataFrame([("uaua",), ("ua",), ("sua",), ("xua",)], "signature string")
    assert sum(r.new_nodes for r in repair.plans(words.coalesce(1)).collect()) >= 6      # of 12 symbols; ua's nodes are shared


def test_no_conversations(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair.audit(repair.damage(empty)).collect() == []


# ── 12: source divergence ────────────────────────────────────────────────
def divergences(rows, least=3, top=200):
    cut = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, langs = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", cut.findall((text or "").translate(lower))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


DOCS = "text string, lang string, source string"


@pytest.mark.parametrize("limit", [divergence.BROADCAST_BYTES, 0])
def test_divergence_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 16)
    rng = random.Random(5)
    words = ["Haus", "haus", "ÄÖ", "äö", "x" * 300, "日本語", "a_b", "tail9end"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 3, 30]))), rng.choice(["en", "de", "", None]), rng.choice(["s0"] * 5 + ["s1", "s2", None])) for _ in range(200)]
    rows += [(None, "en", "quiet"), ("solitary words here", "fr", "a"), ("", "fr", "b"), ("one", "xx", "only")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("shard", F.lit(2))
    got = sorted(map(tuple, divergence.divergence(df, limit=limit).collect()))
    assert got == divergences(rows)


def test_divergence_of_nothing_and_ranks(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []
    rows = [("b a c", "en", "s")] * 3 + [("zz", "en", "t")]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), top=2)
    assert sorted(map(tuple, got.collect())) == divergences(rows, top=2)


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 10**12, 9 * 10**14]), np.array([9 * 10**14 + 7] * 3)
    assert divergence.parts_per_billion(counts, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), total.tolist())]


def test_perfect_hashes_are_minimal_and_verified():
    import pyarrow as pa
    parts, words = [], []
    for s, n in enumerate((1, 5000, 0, 77)):
        keys = pa.array([f"k{s}-{i}".encode() for i in range(n)], pa.large_binary())
        bits, sizes, order = build(hashes(keys))
        assert sorted(order.tolist()) == list(range(n))
        parts.append((bits, sizes, keys.take(pa.array(order))))
        words.append(keys)
    table = Shards(parts)
    for s, keys in enumerate(words):
        if len(keys):
            slots = table.slots(np.full(len(keys), s), hashes(keys), keys)
            assert sorted(slots.tolist()) == list(range(len(keys)))
            assert parts[s][2].take(pa.array(slots)).equals(keys)
            assert (table.slots(np.full(len(keys), (s + 1) % 4), hashes(keys), keys) == -1).all()
    same = pa.array([b"x", b"X"], pa.large_binary())            # equal hashes: the slots behind
    bits, sizes, order = build(hashes(same))
    both = Shards([(bits, sizes, same.take(pa.array(order)))])
    assert sorted(both.slots(np.zeros(2, int), hashes(same), same).tolist()) == [0, 1]


# ── 13: near duplicates among embeddings ─────────────────────────────────
def linked_by_brute_force(rows, threshold=0.93):
    good = []
    for i, (_, vector, label) in enumerate(rows):
        if label is None or not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        good.append((i, label, np.array(vector, float) / np.abs(np.array(vector, float)).max()))
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (vec, _, _) in enumerate(rows):
        least[find(i)].append(vec)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids) if ids else None
        out.append((vec, links[i], component, vec == component))
    return sorted(out, key=str)


def test_vectors_link_as_by_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for size, spread, label in ((150, 0.03, 1), (60, 0.15, 1), (40, 0.25, 2), (30, 0.3, 2), (200, 2.0, 1), (25, 0.22, 3)):
        centre = rng.standard_normal(24)
        rows += [(None, (centre + spread * rng.standard_normal(24)).tolist(), label) for _ in range(size)]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    rows += [(900 + i, rows[3][1], 1) for i in range(40)] + [(5, rows[5][1], 1), (None, rows[7][1], 1), (None, None, 1)]
    rows += [(950, [1.0, 2.0], 1), (951, [1.0, 2.0], 1), (952, [1.0, 2.0], 2), (953, [0.0, 0.0], 1), (954, [], 1), (955, [1.0, None], 1),
             (956, [float("nan"), 1.0], 1), (957, [float("inf"), 1.0], 1), (958, [1e300, 2e300], 1), (959, [1.0, 2.0], None), (960, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("member", F.lit("clash")).withColumn("row", F.lit(0))
    got = neardup.near_duplicates(df, recall=1.0)
    assert sorted(map(tuple, got.collect()), key=str) == linked_by_brute_force(rows)


def test_lists_grow_where_they_are_saturated(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "JOIN_ROWS", 24)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + 0.21 * rng.standard_normal(32)).tolist(), 0) for i in range(120)]      # every pair links, few fit a ball
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, neardup.near_duplicates(df, recall=1.0).collect()), key=str) == linked_by_brute_force(rows)


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
