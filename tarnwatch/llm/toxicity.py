"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives; every other document of the
training side is *unlabelled* text, toxic or not.  A linear classifier over the
distinct words and word beginnings of a text is fitted with the class-prior-corrected risk

    R = pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

in numpy: while the second term is below -beta its gradient is reversed, so the
model can't drive the estimated negative risk below zero.  The prior ``pi`` is
the share of toxic rows among the labelled training rows.

Training rows are bounded samples (``max_positive``, ``max_unlabelled``; taken in
order of a hash of doc_id), so what reaches the driver doesn't grow with the corpus.  Scoring
covers every row and whole texts in Arrow batches.

Defined results: a null or empty text has no words and gets the score of the
bias; very long texts are scored whole; rows with null doc_id are scored and never trained on; repeated rows get
equal scores and are trained on once; a score of exactly the threshold counts as toxic; empty tables give an empty result; without a toxic label every text scores 0.0067 (a bias of -5),
and where no text of a toxic label or no other text is at hand, the prior; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_table, table, unit, write_table

HELD_OUT_FOLDS = 5
WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)


def features(text: str | None) -> set[str]:
    """Binary features: the distinct lower-cased words, and their beginnings of 4 and 5 letters (``~``) with
    how often words begin so: twice (``~2``), three times (``~3``), in over 1 % (``~d``) or 2.5 % (``~D``) of all words."""
    words = WORDS.findall((text or "").lower())
    out = set(words)
    for n in STEMS:
        for stem, k in Counter(w[:n] for w in words if len(w) > n).items():
            out.add(stem + "~")
            if k > 1:
                out.add(stem + "~2")
                if k > 2:
                    out.add(stem + "~3")
            if k * 100 > len(words):
                out.add(stem + "~d")
                if k * 40 > len(words):
                    out.add(stem + "~D")
    return out


@dataclass
class PuModel:
    prior: float
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def decide(self, text: str | None) -> float:
        get = self.weights.get
        return self.bias + sum(get(w, 0.0) for w in features(text))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.decide(text), -50, 50))))


def nn_pu_fit(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, l2: float = 1e-5, beta: float = 0.02) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk with logistic loss; returns weights and bias."""
    d = xp.shape[1]
    theta = np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

    def grad(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(g.astype(np.float32) @ x, g.sum()) / max(len(x), 1)

    for t in range(1, steps + 1):
        w, b = theta[:d].astype(np.float32), theta[d]
        fp, fu = xp @ w + b, xu @ w + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = grad(xu, sig(fu)) - prior * grad(xp, sig(fp))
        g = -g_negative if negative < -beta else prior * grad(xp, sig(fp) - 1) + g_negative
        g[:d] += l2 * theta[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], float(theta[d])


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features(t)))

    return words(text)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, max_features: int = 1024, min_rows: int = 5, min_z: float = 5.0, seed: int = 17) -> PuModel:
    """Fits on the given rows: docs (doc_id, text) and labels (doc_id, toxic) of the training side only.

    Features are kept if at least ``min_rows`` sampled positives hold them and their share among the
    positives differs from that among the unlabelled by ``min_z`` standard errors; the ``max_features``
    strongest remain.
    """
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not n or not toxic:
        return PuModel(prior=0.0, bias=-5.0)
    prior = min(max(toxic / n, 1e-4), 0.9)
    order = unit(F.col("doc_id"), F.lit(seed))
    ids_p = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    ids_u = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled)
    wanted = ids_p.select("doc_id", F.lit(1).alias("p")).unionByName(ids_u.select("doc_id", F.lit(0).alias("p")))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("p", feature_column(F.col("text")).alias("words"))  # wanted has max_positive + max_unlabelled rows at most
    rows = write_table(rows.distinct(), "op1-features")  # copies count once
    size = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_unl:
        return PuModel(prior=prior, bias=float(np.log(prior / (1 - prior))))
    held = rows.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).where(F.col("a") >= min_rows)
    share = (F.col("a") + F.col("b")) / float(n_pos + n_unl)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n_pos + 1 / n_unl))
    strongest = held.withColumn("z", F.abs(F.col("a") / float(n_pos) - F.col("b") / float(n_unl)) / error).where(F.col("z") >= min_z)
    names = [r["word"] for r in strongest.orderBy(F.desc("z"), "word").limit(max_features).select("word").collect()]
    at = {w: i for i, w in enumerate(names)}

    @F.pandas_udf("array<int>")
    def places(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: [at[w] for w in words if w in at])

    got = rows.select("p", places("words").alias("places")).toPandas().sort_values("p", kind="stable")
    drop_table(rows)

    def matrix(lists: list) -> np.ndarray:
        x = np.zeros((len(lists), len(at)), dtype=np.float32)
        for i, found in enumerate(lists):
            x[i, np.asarray(found, dtype=int)] = 1
        return x

    pos, unl = (sorted(map(tuple, got.loc[got["p"] == k, "places"])) for k in (1, 0))
    weights, bias = nn_pu_fit(matrix(pos), matrix(unl), prior)
    return PuModel(prior, bias, {w: float(weights[i]) for w, i in at.items() if abs(weights[i]) > 1e-6})


def score_column(model: PuModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return score(text)


def score_toxicity(docs: DataFrame, model: PuModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold)."""
    return docs.withColumn("score", score_column(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: PuModel, threshold: float = 0.5) -> DataFrame:
    """docs without those that the model calls toxic; columns stay as they are."""
    return docs.where(score_column(model, F.col("text")) < threshold)


def train_side(frame: DataFrame) -> DataFrame:
    return frame.where(crc_mod(F.col("doc_id"), HELD_OUT_FOLDS) != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(train_side(docs), train_side(table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_FOLDS) == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
