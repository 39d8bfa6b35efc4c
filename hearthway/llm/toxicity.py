"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0..K-1 are modelled by P(grade > k) = sigmoid(w.x - t_k): one weight vector shared by ordered
thresholds t_0 < t_1 < ...  Features are the distinct words of a text and their prefixes, hashed, and once more what two
different words of the text have in common. The model is fitted on a bounded sample of labelled documents, and the
probability from which a document counts as toxic is chosen on held-out parts of it; every document is scored over its
whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, settle, ship, tidy, with_row

#: Labelled documents that a model is fitted on, at most; taken by hash of their id.
MAX_ROWS = 12_000
#: Hash space of the features, and the features that a model keeps at most.
SPACE, MAX_FEATURES = 1 << 22, 20_000
#: Least likelihood-ratio statistic of a feature that takes part.
LEAST_G2 = 18.0
#: Words whose features a task keeps.
MOST_WORDS = 100_000
#: Letters of the prefixes that are features.
PREFIXES = (3, 4, 5, 6, 7, 8)
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its shorter prefixes."""
    parts = ["=" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(p.encode()) % SPACE for p in parts)


def text_features(text: str) -> list[int]:
    """Features of a text; SPACE is added to those of two or more of its distinct words."""
    seen = Counter(f for w in set(LETTERS.findall(text.lower())) for f in word_features(w))
    return sorted([*seen, *(f + SPACE for f, n in seen.items() if n > 1)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights by feature, ordered thresholds, and the probability above which a document is toxic."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0,)
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each threshold k."""
        return _sigmoid(score[:, None] - np.array(self.thresholds)[None, :])

    def scores(self, texts: pd.Series, known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
        """w.x of each text: the weights of its distinct features. ``known`` keeps words between the batches of a task."""
        known, weights = {} if known is None else known, self.weights

        def hits(word: str) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                if len(known) > MOST_WORDS:
                    known.clear()
                found = known[word] = tuple(f for f in word_features(word) if f in weights or f + SPACE in weights)
            return found

        def total(text: str) -> float:
            seen = Counter(f for w in set(LETTERS.findall(text.lower())) for f in hits(w))
            return sum(weights.get(f, 0.0) + (weights.get(f + SPACE, 0.0) if n > 1 else 0.0) for f, n in seen.items())

        return np.array([total(t) for t in texts], dtype=float)

    @classmethod
    def fit(cls, features: list[np.ndarray], grades: np.ndarray, steps: int = 300, l2: float = 1e-5) -> OrdinalModel:
        """Maximum likelihood with an L2 penalty, by full-batch gradient steps (Adam).

        Without rows nothing is graded above 0; with rows of one grade the thresholds alone are fitted.
        """
        levels = int(grades.max()) if len(grades) else 0
        if not levels:
            return cls()
        rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
        names, cols = np.unique(np.concatenate([np.asarray(f, dtype=np.int64) for f in features]), return_inverse=True)
        # thresholds t_0, t_0 + exp(d_1), ... stay ordered; they start where the grades' shares say
        share = np.clip([np.mean(grades > k) for k in range(levels)], 1e-4, 1 - 1e-4)
        t = np.log((1 - share) / share)
        p = np.concatenate([np.zeros(len(names)), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
        m, v, k = np.zeros_like(p), np.zeros_like(p), len(names)
        for step in range(1, steps + 1):
            t = np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))
            s = np.bincount(rows, weights=p[cols], minlength=len(grades))
            low = np.where(grades > 0, _sigmoid(t[np.maximum(grades, 1) - 1] - s), 0.0)
            high = np.where(grades < levels, _sigmoid(t[np.minimum(grades, levels - 1)] - s), 1.0)
            width = np.maximum(high - low, 1e-12)
            ds = -(high + low - 1)  # of the loss
            dt = np.zeros(levels)
            np.add.at(dt, np.minimum(grades, levels - 1), np.where(grades < levels, -high * (1 - high) / width, 0.0))
            np.add.at(dt, np.maximum(grades, 1) - 1, np.where(grades > 0, low * (1 - low) / width, 0.0))
            back = np.cumsum(dt[::-1])[::-1]  # a step d_k moves all later thresholds
            g = np.concatenate([np.bincount(cols, weights=ds[rows], minlength=k) / len(grades) + l2 * p[:k], back[:1] / len(grades), back[1:] * np.exp(p[k + 1 :]) / len(grades)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        t = np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))
        return cls({int(f): float(w) for f, w in zip(names, p[:k], strict=True)}, tuple(float(x) for x in t))


def held_out_cut(features: list[np.ndarray], grades: np.ndarray, folds: int = 4) -> float:
    """The probability of a grade above 0 that parts toxic rows from others best (F1) where each was left out of the fit."""
    bad = grades > 0
    if min(bad.sum(), (~bad).sum()) < folds:
        return 0.5
    p, fold = np.zeros(len(grades)), np.arange(len(grades)) % folds
    for k in range(folds):
        model = OrdinalModel.fit([f for f, o in zip(features, fold, strict=True) if o != k], grades[fold != k])
        out = np.flatnonzero(fold == k)
        p[out] = model.above(np.array([sum(model.weights.get(int(f), 0.0) for f in features[i]) for i in out], dtype=float))[:, 0]
    cuts = np.linspace(0.05, 0.95, 37)
    f1 = [2 * (bad & (p > c)).sum() / max(1, bad.sum() + (p > c).sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])


def screened(sample: DataFrame, least: float = LEAST_G2) -> DataFrame:
    """Features of sample(_grade, f) by likelihood-ratio statistic against grade > 0: the best MAX_FEATURES over ``least``."""
    n, b = (float(x or 0) for x in sample.agg(F.count(F.lit(1)), F.sum((F.col("_grade") > 0).cast("int"))).first())
    counts = sample.select((F.col("_grade") > 0).cast("int").alias("bad"), F.explode("f").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("seen"), F.sum("bad").alias("with")).filter("seen >= 3")
    seen, hit = F.col("seen"), F.col("with")
    cells = [(hit, seen * b / n if n else hit), (seen - hit, seen * (n - b) / n if n else hit), (b - hit, (n - seen) * b / n if n else hit), (n - b - seen + hit, (n - seen) * (n - b) / n if n else hit)]
    g2 = sum((F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(F.lit(0.0)) for o, e in cells), F.lit(0.0))
    return counts.withColumn("g2", g2).filter(F.col("g2") >= least).orderBy(F.desc("g2"), "feature").limit(MAX_FEATURES).select("feature")


def fit_on(docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hash of their id.

    ``grade`` is an expression over ``labels``. Labels with a null grade or id are ignored; of several labels of a
    document the highest grade counts; of several rows of a document the smallest text. Features are screened by Spark;
    the driver gets the screened features of the sample, MAX_FEATURES names at most.
    """
    ship(docs.sparkSession)
    graded = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("_grade")).filter("_id is not null and _grade is not null").groupBy("_id").agg(F.max("_grade").alias("_grade"))
    chosen = graded.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_grade").agg(F.min("_text").alias("_text"))

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        let_go()
        return texts.map(lambda t: np.array(text_features(t), dtype=np.int32))

    held = settle(sample.select("_grade", features("_text").alias("f")), "labelled")
    names = np.sort(np.array([r["feature"] for r in screened(held).collect()], dtype=np.int32))

    @F.pandas_udf("array<int>")
    def kept(f: pd.Series) -> pd.Series:
        return f.map(lambda x: np.asarray(x)[np.isin(x, names)])

    rows = held.select("_grade", kept("f").alias("f")).orderBy("_grade", "f").toPandas()
    known, grades = rows["f"].tolist(), rows["_grade"].to_numpy(dtype=np.int64)
    model = OrdinalModel.fit(known, grades)
    model.cut = held_out_cut(known, grades)
    return model


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: row_no, doc_id, p_toxic, expected_severity, grade (0, or the likeliest
    above 0 of a toxic one), toxic.

    A document is toxic when P(grade > 0) is over the model's cut. A null text counts as empty; an empty text has no features
    and gets the prior. Repeated rows are scored each for itself; other columns are not read.
    """
    ship(docs.sparkSession)
    numbered, row = with_row(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        model, known = shared.value, {}
        for batch in batches:
            scores = model.scores(batch["text"], known)
            above = model.above(scores)
            each = -np.diff(np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))]))
            toxic = above[:, 0] > model.cut
            grade = np.where(toxic, 1 + each[:, 1:].argmax(axis=1), 0).astype(np.int32)
            yield pd.DataFrame({"row_no": batch["row_no"], "doc_id": batch["doc_id"].astype("Int64"), "p_toxic": above[:, 0], "expected_severity": above.sum(axis=1), "grade": grade, "toxic": toxic})
        known.clear()
        tidy()

    source = numbered.select(F.col(row).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, "row_no long, doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")


def severity() -> Column:
    """Grades from the labels at hand: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 1, F.lit(1) + F.when(F.col("quality") == 0, F.lit(1)).otherwise(F.lit(0))).when(F.col("toxic") == 0, F.lit(0))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with their columns; rows stay where they are read."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        model, known = shared.value, {}
        for texts in batches:
            yield pd.Series(model.above(model.scores(texts, known))[:, 0] > model.cut)
        known.clear()
        tidy()

    return docs.filter(~toxic(F.coalesce(F.col(text_col), F.lit(""))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_on(docs, labels, severity())
    return score(docs, model).select("doc_id", "p_toxic", "expected_severity", "grade", "toxic")
