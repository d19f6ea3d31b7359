"""Operator 3: language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams, weighted by TF-IDF. Document
frequencies come from every training text; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of
them, and a temperature fitted on rows left out of that fit calibrates the
probabilities. Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common as C

BUCKETS = 1 << 15
SAMPLE = 3000
UNKNOWN = "und"


class Grams:
    """Distinct hashed n-grams of a text and their counts."""

    def __init__(self):
        self.odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = c * self.odd[0]
        parts = [h]
        for n in (1, 2):
            if len(c) > n:
                h = h[:-1] * self.odd[1] + c[n:] * self.odd[2]
                parts.append(h)
        at = C.mix(np.concatenate(parts)) >> np.uint64(49)
        count = np.bincount(at.astype(np.int64), minlength=BUCKETS)
        idx = np.flatnonzero(count)
        return idx, count[idx]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (languages, buckets), mostly zero
    bias: np.ndarray
    temperature: float

    def features(self, idx: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[idx]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, idx: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, idx] @ self.features(idx, count) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; and the number of rows."""

    def run(batches):
        grams, df, n = Grams(), np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                df[grams(t)[0]] += 1
                n += 1
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "docs"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.mapInArrow(run, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        out[r.bucket] = r.docs
    return out[:BUCKETS], int(out[BUCKETS])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, buckets) and bias from rows (class, indices, values), one example at a time.

    The bias sits in one more column, which carries no penalty.
    """
    z = np.zeros((classes, BUCKETS + 1))
    n = np.zeros_like(z)
    penalty = np.full(BUCKETS + 1, l1)
    penalty[BUCKETS] = 0.0

    def weights(zz, nn, lam):
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - lam, 0)
        return -shrunk / ((beta + np.sqrt(nn)) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, idx, x = rows[k]
            idx, x = np.append(idx, BUCKETS), np.append(x, 1.0)
            zz, nn = z[:, idx], n[:, idx]
            w = weights(zz, nn, penalty[idx])
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[:, idx] = zz + g - sigma * w
            n[:, idx] = nn + g * g
    w = weights(z, n, penalty)
    return w[:, :BUCKETS], w[:, BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from (id, text, lang) rows, None without any labelled text.

    Frequencies count all rows. About ``sample`` rows, shared evenly by the
    languages and chosen by a hash of id and text, fit weights and temperature.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    df, n = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(sample / len(langs) / sizes[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000.0
    chosen = labelled.where(draw < share)

    def run(batches):
        grams = Grams()
        for b in batches:
            got = [grams(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                 pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["lang", "idx", "cnt"])

    model = Model(langs, idf, np.zeros((len(langs), BUCKETS)), np.zeros(len(langs)), 1.0)
    table = chosen.select("lang", "text").mapInArrow(run, "lang string, idx array<int>, cnt array<int>").toArrow()
    rows = [(langs.index(y), i, model.features(i, c)) for y, i, c in
            zip(table["lang"].to_pylist(), (np.asarray(v.values) for v in table["idx"]), (np.asarray(v.values) for v in table["cnt"]))]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[2].sum()))
    held = [r for k, r in enumerate(rows) if k % 5 == 4]
    model.weights, model.bias = ftrl([r for k, r in enumerate(rows) if k % 5 != 4] or rows, len(langs))
    if held:
        logits = np.stack([model.weights[:, i] @ x + model.bias for _, i, x in held])
        model.temperature = temperature(logits, np.array([y for y, _, _ in held]))
    return model


def predict(df: DataFrame, model: Model | None, keep: list[Column | str]) -> DataFrame:
    """``keep`` (columns of ``df``) with lang_pred and score from the whole ``text``.

    A null text, one without a letter (``str.isalpha``: digits in circles and fractions are none), and any text
    without a model give ``und`` with score 0. Of languages of equal probability the first in order is taken. Every
    row is judged on its own: repeated rows give repeated results, an empty table none. Columns of ``df`` called
    lang_pred or score clash only if they are kept.
    """
    rows = df.select(*keep, "text")
    names = rows.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        grams, m = Grams(), shared.value
        for b in batches:
            lang, score = [], []
            for t in b.column("text").to_pylist():
                if m is None or t is None or not any(map(str.isalpha, t)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = m.probabilities(m.logits(*grams(t)))
                k = int(p.argmax())
                lang.append(m.langs[k])
                score.append(min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang), pa.array(score, pa.float64())],
                                             names=[*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(rows.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(run, schema)
