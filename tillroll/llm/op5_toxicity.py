"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training (bounded: at most ``TRAIN_ROWS`` labelled documents of class 0 and 1, of
at most ``TRAIN_CHARS`` characters, the first by a hash of the id):
1. Near repeats aside, words and word beginnings that occur in toxic documents far more often than in the others form
   the lexicon, in steps of their log-odds.  A token is labelled toxic if it is of the lexicon and
   its document is labelled toxic.
2. A two-state chain is fitted to the labelled tokens: a weight for each step of the lexicon and
   for each transition, by gradient ascent on the conditional likelihood, with gradients from
   forward-backward marginals.
3. A logistic curve maps a document's summed and largest marginals to its score; classes weigh as
   they do among all labelled training rows.

Scoring reads every whole text.  Tokens outside the lexicon all have one potential, so a run of g
of them is the g-th power of one 2x2 matrix: forward-backward is exact over the whole text while its
steps are those of the lexicon's tokens.

Defined cases: a null or empty text has the score of a text without toxic tokens; repeated rows get
equal scores; an empty table gives an empty result; without labelled rows of both classes every
score is the prior of class 1 (0 without rows); labels of unknown documents are not used; other
columns are not read.
"""
from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.llm import texthash as H

TRAIN_ROWS, TRAIN_CHARS = (6000, 3000), 10_000
THRESHOLD = 0.3
#: Log-odds at which the lexicon's steps begin; below the first a token is neutral.
STEPS = (2.5, 3.5, 4.5, 5.5)
#: A lexicon entry occurs in this many toxic training documents at least, none a near repeat of
#: another, and this share of its documents is toxic, were both classes of one size,
#: which would come by chance with at most this probability (Chernoff's bound).
LEAST, PURE, CHANCE = 4, 0.98, 3e-5
#: Lengths of the word beginnings that are features; hashes by which near repeats are told.
BEGINNINGS, REPEAT_HASHES = (8, 7, 6, 5, 4), 4
SEGMENT, SEGMENTS, ROUNDS = 64, 1500, 100
WORD = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start:int,end:int,score:double>>"


class Model(NamedTuple):
    lexicon: dict[str, int]      # word, or beginning of a word with a star, to step
    emit: np.ndarray             # weight of state 1 by step; step 0 is neutral
    move: np.ndarray             # 2x2 transition weights
    curve: tuple[float, float, float]


def features(word: str) -> list[str]:
    """A word and its beginnings, the longest first."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def _varied(texts: list[str]) -> list[bool]:
    """False for a text that nearly repeats an earlier one: they share one of several least shingle hashes."""
    seen, out = set(), []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        hashed = H.shingles(H.words(data, np.zeros(1, np.int64)), 1, 5)[1]
        least = {(i, int(H.mix(hashed ^ H.U(i + 1)).min())) for i in range(REPEAT_HASHES)} if len(hashed) else set()
        out.append(not least & seen)
        seen |= least
    return out


def _telling(t: int, c: int, n: tuple[int, int]) -> bool:
    """Whether t toxic and c other documents of n are too many toxic ones for chance."""
    if t * n[0] < PURE * (t * n[0] + c * n[1]):
        return False
    p, q = n[1] / (n[0] + n[1]), t / (t + c)
    apart = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if c else 0)
    return (t + c) * apart >= -math.log(CHANCE)


def _lexicon(texts: list[str], toxic: list[int]) -> dict[str, int]:
    known: dict[str, str] = {}
    docs = [(label, {known.setdefault(w, w) for w in WORD.findall(text.lower())})
            for text, label, varied in zip(texts, toxic, _varied(texts), strict=True) if varied]
    n = (sum(not label for label, _ in docs), sum(label for label, _ in docs))
    out: dict[str, int] = {}
    kept: set[str] = set()  # features of enough toxic documents; only words that begin so go on
    last = 0
    for k in [*sorted(BEGINNINGS), 0]:
        counts = (Counter(), Counter())
        for label, words in docs:
            counts[label].update({f"{w[:k]}*" if k else w for w in words
                                  if len(w) >= k and (not last or len(w) < last or f"{w[:last]}*" in kept)})
        kept = {f for f, t in counts[1].items() if t >= LEAST} | {f for f, c in counts[0].items() if c >= LEAST and k}
        for feature in kept | set(counts[0]):
            t, c = counts[1][feature], counts[0][feature]
            odds = math.log((t + 0.5) / (n[1] - t + 0.5)) - math.log((c + 0.5) / (n[0] - c + 0.5)) if n[0] and n[1] else 0
            step = sum(odds >= s for s in STEPS) if t >= LEAST and _telling(t, c, n) else 0
            # a longer beginning that is known to be harmless overrules a shorter one that is not
            if step or (t + c >= LEAST and any(out.get(f) for f in features(feature.rstrip("*")))):
                out[feature] = step
        last = k
    return out


def step_of(lexicon: dict[str, int], word: str) -> int:
    """The step of the longest known feature of ``word``."""
    return next((lexicon[f] for f in features(word) if f in lexicon), 0)


def _marginals(steps: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state) at each place, and expected transitions, for sequences (rows) of equal length."""
    n, t = steps.shape
    pot = np.ones((n, t, 2))
    pot[:, :, 1] = np.exp(emit[steps])
    m = np.exp(move)
    ahead, back = np.empty((n, t, 2)), np.ones((n, t, 2))
    ahead[:, 0] = pot[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (ahead[:, i - 1] @ m) * pot[:, i]
        ahead[:, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (back[:, i + 1] * pot[:, i + 1]) @ m.T
        back[:, i] = b / b.sum(1, keepdims=True)
    state = ahead * back
    state /= state.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * m * (back[:, 1:] * pot[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return state[:, :, 1], pair.sum((0, 1))


def _fit_chain(steps: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    emit, move = np.zeros(len(STEPS) + 1), np.zeros((2, 2))
    seen_emit = np.array([(labels * (steps == s)).sum() for s in range(len(emit))], float)
    a, b = labels[:, :-1], labels[:, 1:]
    seen_move = np.array([[((a == i) & (b == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    speed = [np.zeros(len(emit)), np.zeros((2, 2))]
    size = max(1, steps.size)
    for _ in range(ROUNDS):
        p, pairs = _marginals(steps, emit, move)
        grad_emit = (seen_emit - np.array([p[steps == s].sum() for s in range(len(emit))])) / size - 1e-4 * emit
        grad_move = (seen_move - pairs) / size - 1e-4 * move
        for g, v, w in ((grad_emit, speed[0], emit), (grad_move, speed[1], move)):
            v *= 0.9
            v += 0.1 * g * g
            w += 0.1 * g / (np.sqrt(v) + 1e-8)
    return emit, move


@lru_cache(maxsize=65536)
def _power(move: bytes, neutral: float, gap: int) -> np.ndarray:
    m = np.exp(np.frombuffer(move).reshape(2, 2)) * np.array([1.0, math.exp(neutral)])
    out = np.eye(2)
    while gap:
        if gap & 1:
            out = out @ m
            out /= out.sum()
        m = m @ m
        m /= m.sum()
        gap >>= 1
    return out


def marginals(model: Model, places: list[int], steps: list[int], length: int) -> list[float]:
    """P(toxic) of the lexicon's tokens at ``places`` of a text of ``length`` tokens."""
    key, m = model.move.tobytes(), np.exp(model.move)
    neutral = float(model.emit[0])
    pots = [np.array([1.0, math.exp(model.emit[s])]) for s in steps]
    ahead = []
    for i, place in enumerate(places):
        if i == 0:
            # a run that opens the text starts in either state with the potentials of its own tokens
            a = pots[0] if place == 0 else (np.array([1.0, math.exp(neutral)]) @ _power(key, neutral, place - 1) @ m) * pots[0]
        else:
            a = (ahead[-1] @ _power(key, neutral, place - places[i - 1] - 1) @ m) * pots[i]
        ahead.append(a / a.sum())
    back = _power(key, neutral, length - 1 - places[-1]) @ np.ones(2)
    out = [0.0] * len(places)
    for i in range(len(places) - 1, -1, -1):
        p = ahead[i] * back
        out[i] = float(p[1] / p.sum())
        if i:
            back = _power(key, neutral, places[i] - places[i - 1] - 1) @ (m @ (pots[i] * back))
            back /= back.sum()
    return out


class Tagger:
    """Scores texts; remembers the step of each word seen (a bound on memory only)."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def tag(self, text: str) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Summed and largest marginals, and (start, end, marginal) of the lexicon's tokens."""
        known, lexicon = self.known, self.model.lexicon
        found = WORD.findall(text.lower())
        for w in found:
            if w not in known:
                if len(known) > 300_000:
                    known.clear()
                known[w] = 0
                known[w] = step_of(lexicon, w)
        get = known.get
        steps = [get(w, -1) for w in found]
        if -1 in steps:  # forgotten meanwhile
            steps = [step_of(lexicon, w) for w in found]
        places = [i for i, s in enumerate(steps) if s]
        if not places:
            return 0.0, 0.0, []
        p = marginals(self.model, places, [steps[i] for i in places], len(steps))
        at = {i: k for k, i in enumerate(places)}
        spans = []
        if len(text.lower()) == len(text):  # offsets agree unless a letter's lower case is longer
            spans = [(*m.span(), p[at[i]]) for i, m in enumerate(WORD.finditer(text.lower())) if i in at]
        else:
            ends, low = [], 0
            for c in text:
                low += len(c.lower())
                ends.append(low)
            back = np.searchsorted(np.array(ends), np.arange(low), "right")
            spans = [(int(back[m.start()]), int(back[m.end() - 1]) + 1, p[at[i]]) for i, m in enumerate(WORD.finditer(text.lower())) if i in at]
        return sum(p), max(p), spans

    def score(self, total: float, top: float) -> float:
        a, b, c = self.model.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * top))))


def _fit_curve(total: np.ndarray, top: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones(len(total)), np.log1p(total), top], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (toxic - p)) - 0.01 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        w += np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1]), float(w[2])


def fit(texts: list[str], toxic: list[int], share: float) -> Model:
    """A model from labelled texts; ``share`` is that of class 1 among all labelled rows."""
    lexicon = _lexicon(texts, toxic) if 0 < sum(toxic) < len(toxic) else {}
    segments: list[tuple[int, np.ndarray, int]] = []
    for text, label in zip(texts, toxic, strict=True):
        steps = np.array([step_of(lexicon, w) for w in WORD.findall(text.lower())], int)
        for i in range(0, len(steps) - SEGMENT + 1, SEGMENT):
            segments.append((int(steps[i:i + SEGMENT].any()), steps[i:i + SEGMENT], label))
    picked = [s for s in segments if s[0]][:SEGMENTS] + [s for s in segments if not s[0]][:SEGMENTS]
    move, emit = np.zeros((2, 2)), np.zeros(len(STEPS) + 1)
    if picked:
        steps = np.stack([s for _, s, _ in picked])
        emit, move = _fit_chain(steps, (steps > 0) * np.array([label for _, _, label in picked])[:, None])
    tagger = Tagger(Model(lexicon, emit, move, (0.0, 0.0, 0.0)))
    got = [tagger.tag(t)[:2] for t in texts]
    if not lexicon:
        odds = math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0
        return tagger.model._replace(curve=(odds, 0.0, 0.0))
    label = np.array(toxic)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    total, top = np.array(got).T
    return tagger.model._replace(curve=_fit_curve(total, top, label, weight))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit a model on a bounded sample of the labelled rows that are not held out."""
    usable = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
              .filter(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i"))))
    n = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    samples = [usable.filter(F.col("y") == y).groupBy("i", "y").count().orderBy(F.xxhash64("i"), "i").limit(TRAIN_ROWS[y]) for y in (0, 1)]
    sample = samples[0].unionByName(samples[1])
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).filter(F.length("t") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(sample), F.col("d") == F.col("i")).groupBy("d", "y").agg(F.min("t").alias("t"))  # one row of an id

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample has a fixed bound; one task fits the model, and the driver gets that alone."""
        rows_ = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.record_batch([pa.array([pickle.dumps(fit([t for _, t, _ in rows_], [y for _, _, y in rows_], share))])], names=["model"])

    found = rows.select("d", "t", "y").repartition(1).mapInArrow(fit_sample, "model binary").first()
    return pickle.loads(found.model) if found else fit([], [], share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, spans) of every row; spans are offending character offsets."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                total, top, found = tagger.tag(text.as_py())
                scores.append(tagger.score(total, top))
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= 0.5])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, span)})

    out = source.mapInArrow(run, f"doc_id {kind}, score double, spans {SPANS}")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("doc_id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that the model does not find toxic."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            scores = [tagger.score(*tagger.tag(t.as_py() or "")[:2]) for t in batch.column(text_col)]
            yield batch.filter(pa.array([x < THRESHOLD for x in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
