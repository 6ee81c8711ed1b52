"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier.

Voters are mined from a bounded sample of labelled rows: whole words (lexicon) and word beginnings
(patterns) that stand in toxic texts far more often than chance, and a few fixed shape patterns.  A voter
that fires says toxic, else it abstains; the classifier has one more input, that none of the mined ones fires.

The label model takes a text's label as hidden: labels mine the voters, give the share of toxic texts and the start
of the estimates, and no more.  Given the label, every voter fires with a chance that depends on whether its partner
fires; the partners form a forest (the strongest pairs by their likelihood-ratio statistic given the label), so the
model has a term for each strong correlation and its posterior is exact.  Expectation maximisation over the votes
estimates the chances, the forest is drawn again from the posterior every few rounds, and a voter's accuracy is the
posterior share of toxic texts among those it fires in.  The posterior labels train a logistic regression on the
votes, whose probability is the score.

Scoring reads a text once: words and their beginnings are hashed for a whole batch at a time and
looked up among the voters, so it costs the same for a text of any length.

Defined results: a null or empty text is scored like one in which no voter fires; without any labelled
row, or with rows of one label only, every score is the share of toxic rows (0 without rows); rows with a
null label are not learned from; repeated rows stay; extra columns may have any name (one called like the
result gives way to it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_frames, pieces, quoted, ready_python, unused, written_table
from .langid import code_points, is_letter

TRAIN_DOCS = 10_000          # labelled rows learned from, about
VOTERS = 512                 # mined voters at most
CANDIDATES = 4000            # words and beginnings weighed up for them
PREFIXES = (3, 4, 5, 6, 7)
MIN_TOXIC = 3                # toxic texts a voter stands in at least
MIN_RATE = 0.75              # share of toxic texts among those it stands in, at least
ANCHOR = 2.0                 # texts that a voter's rates in the labelled rows weigh against those in the posterior
SHRINK = 0.5                 # texts that a voter's rate weighs against its rates where its partner fires or not
TELLS = 0.2                  # share of what the less telling voter of a pair tells that the pair must share to be linked
ROUNDS, REDRAW = 60, 10      # of the label model at most; rounds from one forest to the next
THRESHOLD = 0.3
CHUNK_CHARS = 1_000_000
#: Shape voters: texts with at least so many runs of a sign.
SHAPES = (("!!", 3), ("##", 3), ("$$", 3), ("**", 3), ("??", 3))
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _RADIX, np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of all words (runs of letters, lower-cased) and their beginnings."""
    parts = [code_points(t) for t in texts]
    gap = np.zeros(1, np.uint32)
    chars = np.concatenate([gap] + [x for p in parts for x in (p, gap)])
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
    letter = is_letter()[chars]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(~letter[at - 1])
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    value = (chars[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place % 64] + (place // 64).astype(np.uint64)
    text = np.searchsorted(ends, at[first], side="right")
    whole = np.add.reduceat(value, first) * np.uint64(31)
    where, hashes = [text], [whole]
    for k in PREFIXES:
        longer = length > k
        begin = first[longer]
        h = np.zeros(len(begin), np.uint64)
        for i in range(k):
            h += value[begin + i]
        where.append(text[longer])
        hashes.append(h * np.uint64(31) + np.uint64(k))
    return np.concatenate(where), np.concatenate(hashes)


def feature_hash(feature: str) -> np.uint64:
    """Hash of a mined feature: ``=word`` or ``^beginning``."""
    kind, word = feature[0], feature[1:]
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for i, c in enumerate(word):
            h += np.uint64(ord(c) + 1) * _POWERS[i % 64] + np.uint64(i // 64)
        return h * np.uint64(31) + np.uint64(len(word) if kind == "^" else 0)


@dataclass
class Votes:
    """Voters in order of hash; a text's votes are their numbers, the shapes' numbers follow."""

    hashes: np.ndarray

    def cast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, voter) pairs."""
        n = len(self.hashes)
        text, h = word_hashes(texts)
        if n and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
            hit = self.hashes[at] == h
            text, voter = text[hit], at[hit]
        else:
            text = voter = np.zeros(0, np.int64)
        shaped = [(i, n + k) for k, (sign, least) in enumerate(SHAPES) for i, t in enumerate(texts) if t.count(sign) >= least]
        pairs = np.concatenate([np.stack([text, voter], 1), np.array(shaped, np.int64).reshape(-1, 2)])
        pairs = np.unique(pairs, axis=0)
        return pairs[:, 0], pairs[:, 1]


@dataclass
class Model:
    votes: Votes
    weight: np.ndarray       # of each mined voter and each shape
    none: float              # weight of "no mined voter fires"
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        text, voter = self.votes.cast(texts)
        s = np.full(len(texts), self.bias)
        np.add.at(s, text, self.weight[voter])
        fired = np.zeros(len(texts), bool)
        fired[text[voter < len(self.votes.hashes)]] = True
        s[~fired] += self.none
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def logit(p):
    return np.log(p) - np.log1p(-p)


@dataclass
class LabelModel:
    """``partner``: the voter each voter depends on (-1: none); ``chance[label, partner fires, voter]``: how
    often it fires; ``accuracy``: how often the hidden label is toxic where it fires."""

    prior: float
    partner: np.ndarray
    chance: np.ndarray
    accuracy: np.ndarray

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        """Chance of the label toxic for each row of ``fires`` (rows x voters, 0 or 1)."""
        with_partner = partner_fires(fires, self.partner) > 0
        clean, toxic = (np.where(with_partner, c[1], c[0]) for c in self.chance)
        evidence = np.where(fires > 0, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit(self.prior) + evidence, -30, 30)))


def partner_fires(fires: np.ndarray, partner: np.ndarray) -> np.ndarray:
    return np.where(partner >= 0, fires[:, partner], 0).astype(np.float32)


def chances(fires: np.ndarray, partner: np.ndarray, posterior: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How often each voter fires by label and by whether its partner does, from soft labels."""
    out = np.empty((2, 2, fires.shape[1]))
    held = partner_fires(fires, partner)
    for label, weight in enumerate((1 - posterior, posterior)):
        w = weight.astype(np.float32)
        rows, own, on, both = float(w.sum()), w @ fires, w @ held, w @ (held * fires)
        rate = (own + ANCHOR * start[label]) / (rows + ANCHOR)
        out[label, 1] = (both + SHRINK * rate) / (on + SHRINK)
        out[label, 0] = np.where(partner >= 0, (own - both + SHRINK * rate) / (rows - on + SHRINK), rate)
    return np.clip(out, 1e-5, 1 - 1e-5)


def correlated(fires: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Partner of each voter: the maximum spanning forest of the pairs whose likelihood-ratio statistic given the
    label is more than chance makes among that many pairs, and at least TELLS of the most it could be."""
    k = fires.shape[1]
    strength, most = np.zeros((k, k)), np.zeros(k)
    for weight in (1 - posterior, posterior):
        w = weight.astype(np.float32)
        rows, one, both = float(w.sum()), (w @ fires).astype(np.float64), ((fires * w[:, None]).T @ fires).astype(np.float64)
        a, b = one[:, None], one[None, :]
        for seen, x, y in ((both, a, b), (a - both, a, rows - b), (b - both, rows - a, b), (rows - a - b + both, rows - a, rows - b)):
            due = np.maximum(x * y / max(rows, 1e-9), 1e-12)
            strength += np.where(seen > 1e-9, 2 * seen * np.log(np.maximum(seen, 1e-9) / due), 0)
        for seen in (one, rows - one):
            most += np.where(seen > 1e-9, 2 * seen * np.log(max(rows, 1e-9) / np.maximum(seen, 1e-9)), 0)
    strength[strength < TELLS * np.minimum(most[:, None], most[None, :])] = 0
    np.fill_diagonal(strength, 0)
    least = 2 * math.log(max(2, k * k)) + 4
    partner, done = np.full(k, -1), np.zeros(k, bool)
    pull, nearest, best = np.full(k, -1.0), np.full(k, -1), strength.max(1, initial=0)
    for _ in range(k):
        i = int(np.where(done, -2.0, pull).argmax())
        if pull[i] < least:                      # the next tree begins with the voter of the strongest pair left
            i = int(np.where(done, -2.0, best).argmax())
        else:
            partner[i] = nearest[i]
        done[i] = True
        closer = ~done & (strength[i] > pull)
        pull[closer], nearest[closer] = strength[i, closer], i
    return partner


def label_model(fires: np.ndarray, prior: float, start: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """Fit to votes without labels.  ``fires``: rows x voters, 0 or 1; ``start[label, voter]``: first guess of how
    often each fires.  Returns the model and the posterior of each row."""
    fires = fires.astype(np.float32)
    partner = np.full(fires.shape[1], -1)
    chance = np.clip(np.repeat(start[:, None, :], 2, axis=1), 1e-5, 1 - 1e-5)
    posterior = None
    for turn in range(ROUNDS):
        before, posterior = posterior, LabelModel(prior, partner, chance, start[1]).posterior(fires)
        if turn % REDRAW == REDRAW - 1 and turn + REDRAW < ROUNDS:
            partner = correlated(fires, posterior)
        elif turn + REDRAW >= ROUNDS and np.abs(posterior - before).max() < 1e-4:
            break
        chance = chances(fires, partner, posterior, start)
    accuracy = (posterior @ fires) / np.maximum(fires.sum(0), 1e-9)
    return LabelModel(prior, partner, chance, accuracy), posterior


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft targets (Newton steps)."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w = np.zeros(z.shape[1])
    w[-1] = logit(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - target) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def mine(sample: DataFrame) -> list[tuple[str, int, int]]:
    """``(feature, toxic texts, clean texts)`` of the best candidates of a sample (text, toxic)."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    word = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\p{L}+"), F.lit(0)))
    features = F.flatten(F.transform(word, lambda w: F.concat(
        F.array(F.concat(F.lit("="), w)),
        *[F.when(F.length(w) > k, F.array(F.concat(F.lit("^"), F.substring(w, 1, k)))).otherwise(F.array().cast("array<string>"))
          for k in PREFIXES])))
    counted = sample.select("toxic", F.explode(F.array_distinct(features)).alias("feature")) \
        .groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")) \
        .where(F.col("t") >= MIN_TOXIC)
    sizes = sample.agg(F.avg("toxic").alias("rate"), F.count(F.lit(1)).alias("n")).first()
    counted = written_table(counted, "candidates")
    # a feature must be surer than chance makes any of those tried: n * KL(its rate || base rate) over ln(tried)
    base, n = F.lit(float(sizes["rate"])), F.col("t") + F.col("c")
    rate = (F.col("t") / n)
    surprise = F.col("t") * F.log(rate / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    least = math.log(max(1, counted.count()))
    best = counted.where((rate > base) & (rate >= MIN_RATE)).withColumn("s", surprise).where(F.col("s") >= least) \
        .orderBy(F.col("s").desc(), "feature").limit(CANDIDATES)
    return [(r["feature"], r["t"], r["c"]) for r in best.collect()]


def choose(candidates: list[tuple[str, int, int]], most: int = VOTERS) -> list[str]:
    """The first ``most`` candidates without beginnings that longer ones make needless: those found in as
    many texts, or, where clean texts have it too, purer ones that together stand in as many toxic texts."""
    kept: list[tuple[str, int, int]] = []
    for f, t, c in sorted(candidates, key=lambda x: (-len(x[0]) - (x[0][0] == "="), x[0])):
        inside = [g for g in kept if g[0][1:].startswith(f[1:])] if f[0] == "^" else []
        same = any(g[1:] == (t, c) for g in inside)
        purer = sum(g[1] for g in inside if g[2] * t < c * g[1]) >= t if c else False
        if not same and not purer:
            kept.append((f, t, c))
    names = {f for f, _, _ in kept}
    return [f for f, _, _ in candidates if f in names][:most]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_DOCS) -> Model:
    """Fit on about ``rows`` labelled rows at most, drawn by a hash of doc_id."""
    ready_python(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()) \
        .select(F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("toxic"))
    total = known.count()
    share = int(1_000_000 * min(1.0, rows / max(1, total)))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1_000_000)) < share)
    # about ``rows`` small rows: the texts are not shuffled to find theirs
    sample = written_table(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
                           .join(F.broadcast(drawn), F.col("doc") == F.col("_id")).select("text", "toxic"), "labelled")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = sizes["n"], sizes["t"] or 0
    nothing = Votes(np.zeros(0, np.uint64))
    if toxic == 0 or toxic == n:
        rate = toxic / n if n else 0.0
        return Model(nothing, np.zeros(len(SHAPES)), 0.0, float(logit(np.clip(rate, 1e-6, 1 - 1e-6))))
    hashes = np.unique(np.array([feature_hash(f) for f in choose(mine(sample))], np.uint64))
    votes = Votes(hashes)
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def poll(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            ballots: list[list[int]] = [[] for _ in texts]
            for i, v in zip(*(x.tolist() for x in shared.value.cast(texts))):
                ballots[i].append(v)
            yield pd.DataFrame({"toxic": frame["toxic"], "ballot": ballots})

    ballots = sample.mapInPandas(poll, "toxic int, ballot array<int>").toPandas()   # as many rows as drawn
    ballots = ballots.iloc[np.lexsort([ballots["ballot"].map(str).to_numpy(), ballots["toxic"].to_numpy()])]
    fires = np.zeros((len(ballots), len(hashes) + len(SHAPES)), np.float32)
    for i, b in enumerate(ballots["ballot"]):
        fires[i, np.asarray(b, np.int64)] = 1
    truth = ballots["toxic"].to_numpy(np.float64)
    prior = float(np.clip(truth.mean(), 0.001, 0.999))
    start = np.stack([(fires[truth == y].sum(0) + 0.1) / ((truth == y).sum() + 1.0) for y in (0, 1)])
    _, posterior = label_model(fires, prior, start)
    none = ~fires[:, :len(hashes)].any(1, keepdims=True)
    weight, bias = logistic(np.concatenate([fires, none], 1), posterior)
    return Model(votes, weight[:-1], float(weight[-1]), bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the score of each text, in place of a column of that name."""
    ready_python(docs.sparkSession)
    (inner,) = unused(docs, "_text")
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    source = docs.select(*[F.col(quoted(f.name)) for f in kept], F.col(quoted(text)).alias(inner))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame.pop(inner)]
            for a, b in pieces(map(len, texts), CHUNK_CHARS):
                yield frame.iloc[a:b].assign(**{name: shared.value.score(texts[a:b])})

    return map_frames(source, run, StructType([*kept, StructField(name, DoubleType())]))
