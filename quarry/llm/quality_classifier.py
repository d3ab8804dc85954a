"""Positive-unlabelled quality classifier: non-negative unbiased risk.

Trusted positives are texts labelled 1; the unlabelled set is a hash sample of all documents outside the
held-out fold, good and bad mixed as they come, labelled or not. Labels 0 are never read. The class prior
is estimated from scores on the unlabelled set: among cross-fitted scores, the least ratio of the shares of
unlabelled and of positive rows above a cut (every ratio bounds the prior from above; cuts that keep at
least half of the positives). An additive model (piecewise constant in every text statistic, cut at the
training quantiles) is trained by full-batch gradient steps on

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the logistic loss; when the term for negatives falls below zero its gradient is turned round, as
in the non-negative estimator. Its bias is then set so that the mean score of the unlabelled set is the
prior. The score is the model's probability of label 1.

The model sees the text only: labels, lang, source and doc_id are never inputs of a score. It is fitted
on at most ``MAX_ROWS`` positive labels (smallest hash of doc_id first) and the documents whose hash of doc_id
is below that share of its range which makes ``MAX_ROWS`` rows expected (all documents while there are no
more); features are a few dozen numbers a row. A doc_id that repeats is sampled with all its rows; beyond three
times ``MAX_ROWS`` rows, which only repeated doc_ids can bring, the rows of smallest hash stay. Scoring is one pass over
all texts without a shuffle.

Nulls: a null or empty text has the statistics of an empty text and gets its score; a null doc_id is
carried through and is never a training row. Repeated doc_ids are scored row by row; repeated labels of a
doc_id train as often as they occur. With no positive or no unlabelled rows there is nothing to learn from: every
score is 0.5 and no row is rejected. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import text_batches

MAX_ROWS = 40_000
BINS = 20
STEPS = 1200
PRIOR_STEPS, PRIOR_GUESSES = 400, (0.7, 0.8, 0.9)
HASHES = 1 << 40
UNDECIDED = 0.5
THRESHOLD = 0.3
SPECIAL, DIGITS, MARKS, LOUD = (np.frombuffer(x, np.uint8) for x in (b"#*$%&|<>", b"0123456789", b".,;:", b"!?"))

FEATURES = (
    "log words", "mean word length", "share of symbols", "share of distinct words", "share of repeated lines", "share of upper case",
    "share of digits", "share of marks", "share of ! and ?", "share of equal neighbours", "longest word", "words a line", "words a full stop",
    "share of the commonest word", "share of one-letter words", "share of capitalised words",
)


def statistics(text: str | None) -> list[float]:
    """``FEATURES`` of a text.

    ASCII characters are counted as bytes of its UTF-8 form, all in one pass.
    """
    text = text or ""
    found = text.split()
    n, chars = max(1, len(found)), max(1, len(text))
    signs = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x]
    lengths = list(map(len, found))
    upper = sum(map(str.isupper, found))
    return [
        np.log1p(len(found)),
        sum(lengths) / n,
        signs[SPECIAL].sum() / chars,
        len(counts) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        upper / n,
        signs[DIGITS].sum() / chars,
        signs[MARKS].sum() / n,
        signs[LOUD].sum() / n,
        sum(map(str.__eq__, found, found[1:])) / n,
        max(lengths, default=0),
        np.log1p(n / max(1, len(lines))),
        np.log1p(n / (1 + signs[ord(".")])),
        max(counts.values(), default=0) / n,
        lengths.count(1) / n,
        sum(map(str.istitle, found)) / n,
    ]


@dataclass
class Model:
    """Cut points (features x BINS - 1), weights per bin, bias and prior."""

    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        return self.weights[np.arange(at.shape[1]), at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.sums(x), -30, 30)))


def risk_terms(theta: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Values of ``prior * E_P[loss(g)]`` and ``E_U[loss(-g)] - prior * E_P[loss(-g)]`` and their gradients.

    Rows are lists of places in ``theta``, whose last entry is the bias.
    """

    def spread(at: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.bincount(at.ravel(), np.repeat(by, at.shape[1]), minlength=len(theta) - 1)
        return np.append(out, by.sum())

    gp, gu = (theta[:-1][at].sum(axis=1) + theta[-1] for at in (positive, unlabelled))
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    # d loss(g) = s - 1, d loss(-g) = s, with s the sigmoid of g.
    grad_p = spread(positive, prior * (sp - 1) / len(sp))
    grad_n = spread(unlabelled, su / len(su)) - spread(positive, prior * sp / len(sp))
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean(), grad_p, grad_n


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Non-negative PU fit of the additive model by Adam steps on all rows."""
    cuts = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(cuts, np.zeros((positive.shape[1], BINS)), 0.0, prior)
    width = positive.shape[1]
    sides = [model.bins(x) + BINS * np.arange(width) for x in (positive, unlabelled)]
    theta = np.zeros(width * BINS + 1)
    theta[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    for t in range(1, steps + 1):
        _, negative, grad_p, grad_n = risk_terms(theta, *sides, prior)
        grad = grad_p + grad_n if negative >= 0 else -grad_n
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, theta[:-1].reshape(width, BINS), float(theta[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good rows among the unlabelled, from the scores of models that did not train on the scored row.

    No cut can keep a smaller share of the unlabelled rows than the prior times its share of the positive
    rows, so the ratio that is least with its standard error added, over cuts and rankings, is the estimate.
    """
    # A text that is on both sides, or has copies, is in one fold.
    parts = [np.array([zlib.crc32(row.tobytes()) % 2 for row in x]) for x in (positive, unlabelled)]
    folds = 2 if all(0 < part.sum() < len(part) for part in parts) else 1
    parts = [part % folds for part in parts]
    ratios = []
    for guess in PRIOR_GUESSES:
        own, other = np.zeros(len(positive)), np.zeros(len(unlabelled))
        for k in range(folds):
            p, u = (part == k for part in parts)
            model = train(positive[~p if folds > 1 else p], unlabelled[~u if folds > 1 else u], guess, PRIOR_STEPS)
            own[p], other[u] = model.score(positive[p]), model.score(unlabelled[u])
        u, p = (1 - np.searchsorted(np.sort(x), np.quantile(own, np.linspace(0, 0.5, 51))) / len(x) for x in (other, own))
        error = np.sqrt((1 - p) / (p * len(own)) + (1 - u) / (np.maximum(u, 1 / len(other)) * len(other)))
        ratios += zip(u / p * (1 + error), u / p, strict=True)
    return float(np.clip(min(ratios)[1], 0.01, 0.99))


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Prior, model and bias from the statistics of positive and unlabelled rows."""
    prior = estimate_prior(positive, unlabelled)
    model = train(positive, unlabelled, prior)
    sums, low, high = model.sums(unlabelled), -60.0, 60.0
    for _ in range(60):
        model.bias = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(model.bias + sums, -30, 30)))).mean() > prior:
            high = model.bias
        else:
            low = model.bias
    return model


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.drop(columns="text").assign(x=[statistics(t) for t in b["text"]])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """place (a hash), n_positive (labels 1 of the row), unlabelled (row is in the sample) and text of the rows to train on.

    The positive doc_ids (ids only) are chosen first; one pass over the texts, without a shuffle, follows.
    """
    text_batches(docs.sparkSession)
    own = labels.filter("doc_id is not null and quality = 1").filter(~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_positive"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(~held_out("doc_id"))
    share = min(1.0, max_rows / max(1, texts.count()))
    sampled = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(HASHES)) < int(share * HASHES)
    place = F.xxhash64("doc_id", "text").alias("place")
    rows = texts.join(F.broadcast(chosen), "doc_id", "left").select(place, F.coalesce("n_positive", F.lit(0)).alias("n_positive"), sampled.alias("unlabelled"), "text")
    return rows.filter("n_positive > 0 or unlabelled")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Train on rows outside the held-out fold; None where there is nothing to learn from."""
    found = training_rows(docs, labels, max_rows).mapInPandas(_features, "place long, n_positive long, unlabelled boolean, x array<double>")
    rows = found.orderBy("place").limit(3 * max_rows).collect()  # a few numbers each
    positive, unlabelled = [r.x for r in rows for _ in range(r.n_positive)], [r.x for r in rows if r.unlabelled]
    if not positive or not unlabelled:
        return None
    # Sorted: the result does not depend on the order of rows.
    return fit_rows(*(x[np.lexsort(x.T)] for x in (np.array(positive), np.array(unlabelled))))


def _scores(model: Model) -> Column:
    """Score of the ``text`` column: Arrow batches of texts alone, other columns stay as they are."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return F.pandas_udf(run, "double")(F.col("text").cast("string"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(UNDECIDED) if model is None else _scores(model)).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, unchanged, in one pass without a shuffle."""
    return docs if model is None else docs.filter(_scores(model) >= THRESHOLD)
