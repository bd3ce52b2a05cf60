"""Language identification by error-correcting output codes.

Each learned language gets a codeword of ``bits`` signs; one binary classifier per bit, a
logistic model over hashed byte n-grams, predicts that bit.  Decoding adds, over the bits, the logistic
loss between the predicted margin and each codeword, weighted by how reliable the bit was in training,
and takes the nearest codeword; a small lead over the second marks the text ambiguous.

The models are fitted on at most ``per_lang`` rows of each language and ``max_rows`` in all (at least one a language), taken in order of a hash of doc_id
by a filter in the scan: no text is shuffled, and what reaches the driver is a compressed n-gram count of bounded size per sampled row.  Prediction covers every row and the whole text.

Defined results: null, empty or letterless text gives ``und`` with score 0 (not ambiguous); rows with null
lang or doc_id are predicted and never learned from; rows equal in doc_id, lang and n-grams are learned from once; equal texts get equal results; a text of
any length is read whole; ties between codewords go to the language that sorts first; if nothing could be learned all rows are ``und``; an empty table gives
an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, unit

FOLDS, HELD_OUT = 4, 2
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
DIMS = 4096


def ngram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed byte 1-, 2- and 3-grams of the lower-cased letters and the gaps between them."""
    b = np.frombuffer(b" " + NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace") + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    counts = np.bincount(b % dims, minlength=dims)
    for g, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
        counts = counts + np.bincount(((g * np.uint32(salt)) >> np.uint32(11)) % np.uint32(dims), minlength=dims)
    return counts


def profile(counts: np.ndarray) -> np.ndarray:
    """L2-normalised square roots of the counts."""
    return np.sqrt(counts).astype(np.float32) / max(float(np.sqrt(counts.sum())), 1.0)


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """n rows of +-1: of many random code books, the one whose closest rows and columns are farthest apart."""
    rng, best, score = np.random.default_rng(seed), None, -1.0
    if n == 1:
        return np.ones((1, bits), dtype=np.int8)
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        fixed = np.abs(c.sum(axis=0)) == n
        c[rng.integers(n), fixed] *= -1  # no bit may be the same for all
        apart = (bits - c.astype(int) @ c.T.astype(int)) // 2
        near = apart[~np.eye(n, dtype=bool)].min()
        if near + apart.mean() / (bits * 4) > score:
            best, score = c, near + apart.mean() / (bits * 4)
    return best


@dataclass
class EcocModel:
    langs: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    reliability: np.ndarray | None = None
    lead: float = 0.1

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        z = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -z) * self.reliability).sum(axis=2) / self.reliability.sum()

    def predict(self, texts: list) -> tuple[list, list, list]:
        lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        for i, t in enumerate(texts):
            if not self.langs or not t or not LETTER.search(t):
                continue
            loss = self.losses(profile(ngram_counts(t))[None, :])[0]
            p = np.exp(-len(self.reliability) * (loss - loss.min()))
            p /= p.sum()
            best = int(loss.argmin())
            rest = np.delete(loss, best)
            lang[i], score[i] = self.langs[best], float(p[best])
            unsure[i] = bool(len(rest) and rest.min() - loss[best] < self.lead)
        return lang, score, unsure


def fit_ecoc(counts: list[np.ndarray], langs: list[str], bits: int = 15, steps: int = 250, l2: float = 1e-4) -> EcocModel:
    names = sorted(set(langs))
    if not names:
        return EcocModel()
    x = np.stack([profile(c) for c in counts])
    code = codewords(len(names), bits)
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    share = pd.Series(langs).value_counts()
    row = np.array([1.0 / (len(names) * share[v]) for v in langs], dtype=np.float32)[:, None]  # languages weigh the same
    w, b = np.zeros((x.shape[1], bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    mw, mb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -50, 50))) * row
        mw, mb = 0.9 * mw + x.T @ g + l2 * w, 0.9 * mb + g.sum(axis=0)
        w, b = w - rate * mw, b - rate * mb
    right = (((x @ w + b) * y > 0) * row).sum(axis=0)
    reliability = np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))) + 1e-3
    return EcocModel(names, code, w, b, reliability.astype(np.float32))


def train_langid(docs: DataFrame, per_lang: int = 1000, max_rows: int = 8000, bits: int = 15, seed: int = 23) -> EcocModel:
    """Fits on docs (doc_id, text, lang), the training side only; null lang, text or doc_id is left out."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    share = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language, as in the model itself
    if not share:
        return EcocModel()
    per_lang = max(1, min(per_lang, max_rows // len(share)))
    # the sample expected is a fifth and 50 rows more than wanted; the exact cut follows on the driver
    most = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.2 * per_lang + 50) / r["n"])) for r in share], "lang string, __tw_most double")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(ngram_counts(t).astype("<u4").tobytes(), 1) if LETTER.search(t) else None)

    u = unit(F.col("doc_id"), F.lit(seed))
    sample = known.join(F.broadcast(most), "lang").where(u < F.col("__tw_most")).select("lang", "doc_id", u.alias("u"), packed("text").alias("counts"))
    got = sample.where("counts IS NOT NULL").distinct().toPandas().sort_values(["lang", "u", "doc_id", "counts"]).groupby("lang").head(per_lang)
    return fit_ecoc([np.frombuffer(zlib.decompress(c), dtype="<u4") for c in got["counts"]], got["lang"].tolist(), bits)


def identify_language(docs: DataFrame, model: EcocModel, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, unsure = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": np.array(score, dtype=float), "ambiguous": np.array(unsure, dtype=bool)})

    return docs.withColumn("__tw_lang", predict(F.col(text_col))).withColumns({c: F.col(f"__tw_lang.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop("__tw_lang")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), FOLDS)
    model = train_langid(docs.where(fold != HELD_OUT).select("doc_id", "text", "lang"))
    held = F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "ambiguous")
