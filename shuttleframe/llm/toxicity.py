"""Toxic spans by a linear-chain conditional random field (operator 6).

Labels mark whole documents, so tokens get their training tags in rounds. First, in documents labelled 1, the tokens whose
form or prefix is far more frequent in labelled-1 documents than in others are tagged toxic. A two-state CRF over token
features (form, prefixes, suffix), of which many say little on their own, with transition weights is fitted to these tags by
gradient descent on the exact log-likelihood (forward-backward). Then its own marginals give the tags of the next round:
in documents labelled 1, tokens that it holds toxic rather than not, whatever their form's frequency, and at least the one
that it holds most so; in others none. A document's score aggregates the marginals: the expected number of toxic tokens
against the document's length goes through a logistic curve that is fitted on the same training rows.

Tokens without a weighted feature share one potential, and a run of them is a power of one 2x2 matrix. The chain is
therefore summed over weighted tokens and run lengths, which gives the marginals of the whole chain exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, chunks, documents, texts, whole

#: Labelled rows that the model is fitted on, at most, and the characters of their texts: a bounded sample by hash.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 20_000_000
#: A feature is kept if at least so many training documents have it, and its log odds reach the bound.
LEAST_DOCS = 4
LEAST_ODDS = 1.0
#: Log odds from which a token's best feature makes it toxic in the first round of tags; rounds.
FIRST_ODDS = 2.0
ROUNDS = 2
#: ... and if its log-likelihood ratio against independence does, so that chance features of small samples stay out.
LEAST_RATIO = 20.0
TOKEN = regex.compile(r"[^\W\d_]+")
EPOCHS = 60


def lowered(text: str) -> list[str]:
    """Tokens of a text, each lower-cased on its own: their places are those of TOKEN in the text, whatever lower-casing does."""
    return [t.lower() for t in TOKEN.findall(text)]


def features(token: str) -> tuple[str, ...]:
    """Form, prefixes of 4 and 5 characters, suffix of 4, of a lower-cased token."""
    out = [f"w={token}"]
    if len(token) > 4:
        out.append(f"p4={token[:4]}")
        out.append(f"s4={token[-4:]}")
    if len(token) > 5:
        out.append(f"p5={token[:5]}")
    return tuple(out)


@dataclass
class Model:
    """Weights by feature (for the toxic state), transitions (2x2), bias of the toxic state, and the score's curve."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -4.0
    curve: tuple[float, float, float] = (0.0, 0.0, -2.0)
    prefixes: frozenset[str] = frozenset()

    def unary(self, token: str) -> float | None:
        """Potential of the toxic state against the other one; None if no feature has a weight."""
        found = [w for f in features(token) if (w := self.weights.get(f)) is not None]
        return self.bias + sum(found) if found else None


def _power(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Eigenvalues and vectors of the step over a token without a weight, scaled by the largest eigenvalue."""
    step = np.exp(model.transitions) * np.array([1.0, math.exp(model.bias)])[None, :]
    values, vectors = np.linalg.eig(step)
    values, vectors = values.real, vectors.real
    top = float(values.max())
    return values / top, vectors, np.linalg.inv(vectors), math.log(top)


def marginals(model: Model, n: int, places: np.ndarray, potentials: np.ndarray) -> tuple[np.ndarray, float]:
    """(marginal of the toxic state at each place, log partition) of a chain of n tokens with weights at ``places``."""
    values, vectors, inverse, log_top = _power(model)
    gap = np.diff(places, prepend=-1) - 1
    tail = n - 1 - (int(places[-1]) if len(places) else -1)

    def over(k: int) -> np.ndarray:
        return (vectors * values**k) @ inverse

    start = np.array([1.0, math.exp(model.bias)])
    hop = np.exp(model.transitions)
    forward, scale = [], 0.0
    state = None
    for i, p in enumerate(potentials):
        at = np.array([1.0, math.exp(min(p, 30.0))])
        if state is None:
            if gap[i] == 0:
                state = at
            else:
                state = start @ over(int(gap[i]) - 1) @ hop * at
                scale += log_top * (int(gap[i]) - 1)
        else:
            state = state @ over(int(gap[i])) @ hop * at
            scale += log_top * int(gap[i])
        total = state.sum()
        state, scale = state / total, scale + math.log(total)
        forward.append(state)
    if state is None:
        last = start @ over(n - 1)
        return np.zeros(0), scale + log_top * (n - 1) + math.log(last.sum())
    back = over(tail) @ np.ones(2)
    log_z = scale + log_top * tail + math.log((state @ back).item())
    out = np.empty(len(potentials))
    for i in range(len(potentials) - 1, -1, -1):
        both = forward[i] * back
        out[i] = both[1] / both.sum()
        at = np.array([1.0, math.exp(min(potentials[i], 30.0))])
        if i:
            back = over(int(gap[i])) @ hop @ (at * back)
            back = back / back.sum()
    return out, log_z


def _tag(tokens: list[list[str]], labels: list[int]) -> dict[str, float]:
    """Features with their log odds of standing in a document labelled 1."""
    toxic, other = Counter(), Counter()
    for words, y in zip(tokens, labels, strict=True):
        (toxic if y else other).update({f for t in set(words) for f in features(t)})
    n1, n0 = sum(labels), len(labels) - sum(labels)
    out, rate = {}, n1 / (n1 + n0)
    for f, c in toxic.items():
        o = other[f]
        odds = math.log((c + 0.5) / (n1 + 1)) - math.log((o + 0.5) / (n0 + 1))
        ratio = 2 * (c * math.log(c / ((c + o) * rate)) + (o * math.log(o / ((c + o) * (1 - rate))) if o else 0.0))
        if c >= LEAST_DOCS and odds >= LEAST_ODDS and ratio >= LEAST_RATIO:
            out[f] = odds
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fits tags, CRF and curve to (text, label) rows; without rows of both labels, a model that rejects nothing."""
    labels = [y for _, y in rows]
    if not any(labels) or all(labels):
        return Model()
    same: dict[str, str] = {}
    tokens = [[same.setdefault(w, w) for w in lowered(t)] for t, _ in rows]
    odds = _tag(tokens, labels)
    if not odds:
        return Model()
    names = sorted(odds)
    index = {f: i for i, f in enumerate(names)}
    # A tag needs a feature: tokens without one are plain in every chain.
    own = {t: [index[f] for f in features(t) if f in index] for t in same}
    found = [[(i, own[t]) for i, t in enumerate(words) if own[t]] for words in tokens]
    tags = [[int(bool(y) and max(odds[names[j]] for j in ids) >= FIRST_ODDS) for _, ids in marked] for marked, y in zip(found, labels, strict=True)]
    for k in range(ROUNDS):
        chains = [(len(words), marked, t) for words, marked, t in zip(tokens, found, tags, strict=True) if words]
        model = _train(chains, names)
        if k + 1 < ROUNDS:
            tags = [_again(model, names, len(words), marked) if y and marked else [0] * len(marked) for words, marked, y in zip(tokens, found, labels, strict=True)]
    model.prefixes = frozenset(model.weights)
    return _calibrate(model, tokens, labels)


def _again(model: Model, names: list[str], n: int, marked: list[tuple[int, list[int]]]) -> list[int]:
    """Tags of a labelled-1 document's weighted tokens by the model's marginals: those from a half on, or the largest one."""
    potentials = np.array([model.bias + sum(model.weights[names[j]] for j in ids) for _, ids in marked])
    p = marginals(model, n, np.array([i for i, _ in marked], np.int64), potentials)[0]
    return (p >= min(0.5, p.max())).astype(int).tolist()


@dataclass
class Joined:
    """Whole chains one after another: their tokens with features, the first and the last one, and the runs of plain tokens between.

    ``kind`` numbers the way to each of these tokens from the one before: 0 from another chain, else ``gaps[kind - 1]`` plain
    tokens. Features are pairs (``at``, ``feature``); ``seen`` counts the transitions of the tags, where plain tokens are 0.
    """

    kind: np.ndarray
    gaps: np.ndarray
    at: np.ndarray
    feature: np.ndarray
    tags: np.ndarray
    seen: np.ndarray


def joined(chains: list[tuple[int, list[tuple[int, list[int]]], list[int]]]) -> Joined:
    """``chains``: tokens, (place, features) of those with features, and their tags."""
    gap, at, feature, tags, seen = [], [], [], [], np.zeros((2, 2))
    for n, marked, tag in chains:
        by = {i: (ids, y) for (i, ids), y in zip(marked, tag, strict=True)}
        before = None
        for i in sorted({0, n - 1} | by.keys()):
            ids, y = by.get(i, ((), 0))
            at.extend([len(tags)] * len(ids))
            feature.extend(ids)
            if before is None:
                gap.append(-1)
            else:
                plain = i - before - 1
                gap.append(plain)
                if plain:
                    seen[tags[-1], 0] += 1
                    seen[0, 0] += plain - 1
                    seen[0, y] += 1
                else:
                    seen[tags[-1], y] += 1
            tags.append(y)
            before = i
    every, kind = np.unique(np.array([-1, *gap], np.int64), return_inverse=True)
    return Joined(kind[1:], every[1:], np.array(at, np.int64), np.array(feature, np.int64), np.array(tags, float), seen)


def _links(trans: np.ndarray, bias: float, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of plain tokens the matrix of their steps and the last one, up to a factor, and its logarithm's derivatives
    by the four transitions and the bias."""
    hop, plain = np.exp(trans), np.diag([1.0, math.exp(bias)])
    d_hop = np.zeros((5, 2, 2))
    for k in range(4):
        d_hop[k, k // 2, k % 2] = hop[k // 2, k % 2]
    base, d_base = hop @ plain, d_hop @ plain
    d_base[4] = hop @ np.diag([0.0, math.exp(bias)])
    top = np.abs(np.linalg.eigvals(base)).max()
    base, d_base = base / top, d_base / top
    power, d_power = np.tile(np.eye(2), (len(gaps), 1, 1)), np.zeros((len(gaps), 5, 2, 2))
    rest = gaps.copy()
    while rest.any():
        odd = rest % 2 == 1
        d_power[odd] = d_power[odd] @ base + power[odd][:, None] @ d_base
        power[odd] = power[odd] @ base
        base, d_base = base @ base, d_base @ base + base @ d_base
        rest //= 2
    link = power @ hop
    return link, (d_power @ hop + power[:, None] @ d_hop) / link[:, None]


def _through(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``start`` times the first 1, 2, ... of the 2x2 matrices (4 rows, one column each), each product scaled to the sum 1.

    Blocks are multiplied side by side, and the same is done with their products, so a chain of any length takes few steps.
    """
    n, size = steps.shape[1], 64
    if n <= size:
        out, (p, q) = np.empty((2, n)), start
        for i, (a, b, c, d) in enumerate(steps.T.tolist()):
            p, q = p * a + q * c, p * b + q * d
            p, q = p / (p + q), q / (p + q)
            out[0, i], out[1, i] = p, q
        return out
    blocks = -(-n // size)
    x = np.zeros((4, blocks * size))
    x[0], x[3] = 1.0, 1.0
    x[:, :n] = steps
    x = np.ascontiguousarray(x.reshape(4, blocks, size).transpose(2, 0, 1))
    product = x[0]
    for a, b, c, d in x[1:]:
        e, f, g, h = product
        product = np.stack([e * a + f * c, e * b + f * d, g * a + h * c, g * b + h * d])
        product /= product.sum(0)
    state = np.empty((2, blocks))
    state[:, 0] = start
    state[:, 1:] = _through(product[:, :-1], start)
    out = np.empty((size, 2, blocks))
    for k, (a, b, c, d) in enumerate(x):
        state = np.stack([state[0] * a + state[1] * c, state[0] * b + state[1] * d])
        state /= state.sum(0)
        out[k] = state
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def gradient(x: Joined, w: np.ndarray, trans: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the tags' log-likelihood, over whole chains, by weights, transitions and bias."""
    n = len(x.tags)
    potential = np.exp(np.clip(bias + np.bincount(x.at, w[x.feature], n), -30, 30))
    link, d_link = _links(trans, bias, x.gaps)
    ways = np.concatenate([np.ones((1, 4)), link.reshape(-1, 4)])[x.kind].T
    steps = ways.copy()
    steps[1] *= potential
    steps[3] *= potential
    forward = _through(steps, np.array([0.5, 0.5]))
    backward = np.full((2, n), 0.5)
    backward[:, :-1] = _through(steps[[0, 2, 1, 3]][:, :0:-1], np.array([0.5, 0.5]))[:, ::-1]
    both = forward * backward
    toxic = both[1] / both.sum(0)
    pairs = forward[[0, 0, 1, 1], :-1] * steps[:, 1:] * backward[[0, 1, 0, 1], 1:]
    pairs /= pairs.sum(0)
    sums = np.stack([np.bincount(x.kind[1:], p, len(x.gaps) + 1)[1:] for p in pairs], 1).reshape(-1, 1, 2, 2)
    inside = (sums * d_link).sum((0, 2, 3))
    miss = x.tags - toxic
    return np.bincount(x.feature, miss[x.at], len(w)), x.seen - inside[:4].reshape(2, 2), float(miss.sum() - inside[4])


def _train(chains: list, names: list[str]) -> Model:
    """Gradient ascent on the log-likelihood of the tags, over all tokens of all chains at once."""
    x = joined(chains)
    values: list = [np.zeros(len(names)), np.zeros((2, 2)), -3.0]
    moment, square = [0.0 * v for v in values], [0.0 * v for v in values]
    n = len(x.tags)
    for epoch in range(1, EPOCHS + 1):
        by_weight, by_hop, by_bias = gradient(x, *values)
        grads = [by_weight / n - 1e-5 * values[0], by_hop / n - 1e-4 * values[1], by_bias / n]
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            values[i] = values[i] + 0.15 * moment[i] / (1 - 0.9**epoch) / (np.sqrt(square[i] / (1 - 0.99**epoch)) + 1e-8)
    w, trans, bias = values
    return Model({f: float(v) for f, v in zip(names, w, strict=True)}, trans, float(bias))


def tag(model: Model, tokens: list[str], memory: dict[str, float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(places, marginals) of the tokens with a weight."""
    places, potentials = [], []
    for i, t in enumerate(tokens):
        if t in memory:
            u = memory[t]
        else:
            if len(memory) > 300_000:
                memory.clear()
            u = memory[t] = model.unary(t)
        if u is not None:
            places.append(i)
            potentials.append(u)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.array(places, np.int64)
    return at, marginals(model, len(tokens), at, np.array(potentials))[0]


def summary(n: int, p: np.ndarray) -> tuple[float, float]:
    """What the curve takes: log of the expected number of toxic tokens, and that of their share."""
    expected = float(p.sum())
    return math.log1p(expected), math.log1p(1000.0 * expected / (n + 20.0))


def _calibrate(model: Model, tokens: list[list[str]], labels: list[int]) -> Model:
    """Logistic curve over ``summary`` by Newton steps."""
    memory: dict[str, float | None] = {}
    x = np.array([[*summary(len(t), tag(model, t, memory)[1]), 1.0] for t in tokens])
    y, c = np.array(labels, float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(3)
        c = c + np.clip(np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * c), -5, 5)
    model.curve = tuple(float(v) for v in c)
    return model


def score(model: Model, n: int, p: np.ndarray) -> float:
    a, b = summary(n, p)
    z = model.curve[0] * a + model.curve[1] * b + model.curve[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out():
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows that aren't held out: a sample by hash of SAMPLE_ROWS rows and SAMPLE_CHARS characters at most.

    Rows whose label is null don't count. A row that doesn't fit the rest of the characters is skipped, and others go on.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train_rows = marked.where(~held_out())
    # Toxic rows are rarer: half of the sample is theirs, as far as there are so many.
    sizes = {r["toxic"]: r["count"] for r in train_rows.groupBy("toxic").count().collect()}
    share = {k: min(1.0, SAMPLE_ROWS / 2 / n) for k, n in sizes.items()}
    spread = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for k, s in share.items():
        wanted = wanted | ((F.col("toxic") == k) & (spread < s))
    chosen = train_rows.where(wanted)
    # ``chosen`` has SAMPLE_ROWS rows, give or take the hash's chance: small enough to broadcast whatever the corpus holds.
    # Where a doc_id repeats, its least text counts, so that reruns agree.
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    picked = rows.select("toxic", "text").withColumn("n", F.length("text")).orderBy(F.xxhash64("text"), "toxic")
    out, size = [], 0
    for r in picked.where(F.col("n") <= SAMPLE_CHARS).select("text", "toxic").toLocalIterator():
        if size + len(r["text"]) > SAMPLE_CHARS:
            continue
        size += len(r["text"])
        out.append((r["text"], int(r["toxic"])))
    return fit(out)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, score, spans (start, end, p of toxic tokens) of every row. Null and empty texts have no tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = sent.value, {}
        for b in chunks(batches):
            scores, spans = [], []
            for text in texts(b):
                tokens = lowered(text)
                places, p = tag(model, tokens, memory)
                scores.append(score(model, len(tokens), p))
                hit = {int(i): float(v) for i, v in zip(places, p, strict=True) if v >= 0.5}
                found = []
                if hit:
                    found = [{"start": m.start(), "end": m.end(), "p": hit[i]} for i, m in enumerate(TOKEN.finditer(text)) if i in hit]
                spans.append(found)
            arrays = [*[b.column(i) for i in range(len(keep))], pa.array(scores, pa.float64())]
            arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "score", "spans"])

    kept = docs.select(*keep, whole().alias("text"))
    types = dict(kept.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return kept.mapInArrow(run, fields + ", score double, spans array<struct<start:int,end:int,p:double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("span_starts"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: float = 0.5) -> DataFrame:
    """The rows whose score is below the bound, unchanged. Null texts and repeated rows stay as they are, columns may have any
    names, an empty table gives an empty one."""
    model = train(docs, labels)
    plain, back = by_place(docs, "text")
    others = [c for c in plain.columns if c != "text"]
    kept = scored(plain.withColumn("whole", F.col("text")), model, [*others, "whole"]).where(F.col("score") < bound)
    return back(kept.withColumnRenamed("whole", "text"))
