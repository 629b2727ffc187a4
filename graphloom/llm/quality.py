"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1, unlabelled ones are documents at large. The
model minimises the non-negative unbiased risk

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

with the logistic loss: as long as the second term is positive it is descended as it stands, and
when a step makes it negative its sign is turned, so that positives hidden among the unlabelled
cannot drive the risk below zero. The class prior p is estimated from positives and unlabelled rows
alone: a first model, fitted with FIRST_PRIOR, ranks all rows; above a threshold there are at least p
times as many of the unlabelled, by share, as of the positives, so p is the least ratio of the two
shares over thresholds that nearly all positives pass (TAILS). Both shares count every row.

A text's features are shares of character classes, word, line and repetition statistics of the whole
text, expanded by hinges at the sample's quantiles, so that a linear score can follow a
threshold. Labels, lang, source and doc_id are no inputs. The weights are fitted on samples of at most
SAMPLE positives and SAMPLE unlabelled rows, those with the smallest hash of id and features; every
row of the input is scored.

Scores are the logistic function of f. The cut in use is CUT; the offset is calibrated on the training
sample so that all but KEEP_LOSS of the trusted positives score above it.

Defined results: a null text counts as empty; a null doc_id is held out like any other by the CRC of
its absent text (0, so it is); labels of rows that repeat a doc_id are taken as their greatest; rows
that repeat a doc_id with different texts are rows of their own, and rows alike in id and text count
once in the samples; with no positive to learn from every score is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import materialize, release_memory, table

CUT = 0.3
SAMPLE = 6000
KEEP_LOSS = 0.002
FIRST_PRIOR = 0.5
TAILS = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05)  # shares of positives below a threshold
HINGES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
STEPS, RATE, RIDGE = 400, 0.05, 3.0  # the ridge counts as RIDGE / positives
FEATURES = 26


def features_of(text: str | None):
    """The statistics of one text as a list of FEATURES floats."""
    import math

    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    at = lambda chars: int(sum(counts[ord(c)] for c in chars)) / n
    span = lambda a, b: int(counts[ord(a) : ord(b) + 1].sum()) / n
    words = data.split()
    w = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lower = data.lower().split()
    share = counts[counts > 0] / n
    return [
        math.log1p(n),
        math.log1p(len(words)),
        n / w,
        w / max(1, len(lines)),
        len(set(lower)) / w,
        len(set(zip(lower, lower[1:], strict=False))) / w,
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / w,
        len(set(lines)) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()),
        span("A", "Z"),
        span("a", "z"),
        span("0", "9"),
        int(counts[128:].sum()) / n,
        at("!"),
        at("?"),
        at(".,"),
        at(";:"),
        at("#%&$*@"),
        at("|"),
        at("<>{}[]()"),
        at("=+/\\_-~^"),
        at("\"'`"),
        at(" "),
        at("\n\t\r"),
        int(counts[:32].sum()) / n,
        sum(1 for x in words if len(x) > 24) / w,
    ]


class Model:
    """Hinge knots, scaling and weights of a fitted classifier."""

    def __init__(self, knots, mean, scale, weights, offset: float):
        self.knots, self.mean, self.scale, self.weights, self.offset = knots, mean, scale, weights, offset

    @staticmethod
    def expand(x, knots):
        import numpy as np

        return np.concatenate([x, *[np.maximum(0, x - k) for k in knots], *[(x > k).astype(float) for k in knots]], axis=1)

    def score(self, x):
        return sigmoid(((self.expand(x, self.knots) - self.mean) / self.scale) @ self.weights + self.offset)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_parts(w, p, u, prior: float):
    """The two terms of the risk: p * E_pos[l(f)], and E_unl[l(-f)] - p * E_pos[l(-f)] before it is cut at 0."""
    import numpy as np

    fp, fu = p @ w, u @ w
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def direction(w, p, u, prior: float):
    """The gradient to descend: of both terms, or, where the second is negative, of its negative alone."""
    gp, gu = sigmoid(p @ w), sigmoid(u @ w)
    rest = gu @ u / len(u) - prior * (gp @ p) / len(p)
    return rest - prior * ((1 - gp) @ p) / len(p) if risk_parts(w, p, u, prior)[1] >= 0 else -rest


def fit(positive, unlabelled, prior: float) -> Model:
    """Minimises the non-negative risk by Adam on full batches."""
    import math

    import numpy as np

    both = np.concatenate([positive, unlabelled])
    knots = np.quantile(both, HINGES, axis=0)
    wide = Model.expand(both, knots)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
    del wide
    p, u = ((Model.expand(x, knots) - mean) / scale for x in (positive, unlabelled))
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        grad = direction(w, p, u, prior) + RIDGE / len(p) * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    lowest = float(np.quantile(p @ w, KEEP_LOSS))
    shift = math.log(CUT / (1 - CUT)) - lowest + 0.05
    return Model(knots, mean, scale, w[:-1], float(w[-1] + max(0.0, shift)))


def prior_of(positive_above, unlabelled_above, positives: int, unlabelled: int) -> float:
    """The class prior, from how many rows of either kind lie above each threshold."""
    ratios = [(u / unlabelled) / (p / positives) for p, u in zip(positive_above, unlabelled_above, strict=True) if p]
    return float(min(0.99, max(0.01, min(ratios, default=FIRST_PRIOR))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _rows(texts):
    import numpy as np

    return np.array([features_of(t) for t in texts], float).reshape(-1, FEATURES)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the features x of every row, as a written table."""
    return materialize(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _features(F.col("text")).alias("x")), "quality-features")


def train(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The classifier learnt from the rows of featured() that are not held out; None without trusted positives."""
    import numpy as np

    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality")).where("quality > 0").select("id")
    at_large = rows.where(~F.col("held_out")).select(F.col("doc_id").alias("id"), "x")
    trusted = materialize(at_large.join(good, "id"), "quality-trusted")

    def sample(df: DataFrame, seed: int):
        # Keys are distinct before they are limited, whatever ids repeat. Of many rows only the smallest
        # keys are looked at, which hold the sample unless very many rows are alike.
        keyed = df.select(F.xxhash64("id", "x", F.lit(seed)).alias("key"), "x")
        share = 8 * SAMPLE / max(1, df.count())
        for bound in [int(2**64 * share) - 2**63] * (share < 1) + [None]:
            some = keyed if bound is None else keyed.where(F.col("key") < F.lit(bound))
            found = some.groupBy("key").agg(F.first("x").alias("x")).orderBy("key").limit(SAMPLE).select("x").toArrow()
            if found.num_rows == SAMPLE:
                break
        return np.array(found.column("x").to_pylist(), float).reshape(-1, FEATURES)

    p, u = sample(trusted, 11), sample(at_large, 12)
    if not len(p) or not len(u):
        return None
    first = fit(p, u, FIRST_PRIOR)
    cuts = np.quantile(first.score(p), TAILS).tolist()

    def above(df: DataFrame):
        score = score_features(F.col("x"), first)
        return df.select(score.alias("s")).agg(F.count("s"), *[F.sum((F.col("s") >= F.lit(c)).cast("long")) for c in cuts]).first()

    positives, unlabelled = above(trusted), above(at_large)
    return fit(p, u, prior_of(positives[1:], unlabelled[1:], positives[0], unlabelled[0]))


def _features(text: Column) -> Column:
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([features_of(t) for t in texts])
        finally:
            release_memory()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text.cast("string"))


def _scored(column: Column, model: Model | None, matrix) -> Column:
    import pandas as pd

    if model is None:
        return F.lit(1.0)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for rows in batches:
                yield pd.Series(model.score(matrix(rows)))
        finally:
            release_memory()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(column)


def score_features(x: Column, model: Model | None) -> Column:
    """The quality score of a row of features, from 0 to 1."""

    def matrix(rows):
        import numpy as np

        return np.array(rows.tolist(), float).reshape(-1, FEATURES)

    return _scored(x, model, matrix)


def score_column(text: Column, model: Model | None) -> Column:
    """The quality score of a text, from 0 to 1."""
    return _scored(text.cast("string"), model, _rows)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    rows = featured(docs)
    scored = rows.select("doc_id", "held_out", score_features(F.col("x"), train(rows, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    return docs.where(score_column(F.col("text"), train(featured(docs), labels)) >= CUT)


def op5_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
