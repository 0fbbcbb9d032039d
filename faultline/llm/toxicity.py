"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, steps

#: Training: distinct texts taken on each side (those with the smallest hash), and the longest text.
POSITIVES = 2_000
UNLABELLED = 6_000
TRAIN_CHARS = 50_000
#: Bytes of a word's beginning that are features besides the word.
STEMS = (4, 5, 6)
#: A feature counts if it is in this many and this share of the distinct positives, and this many times as frequent there as in
#: clean texts, whose rate is what the prior's share of toxic ones leaves of the unlabelled texts' rate.
LEAST_DOCS = 6
LEAST_SHARE = 0.02
LEAST_RATIO = 3.0
FEATURES = 20_000
ROUNDS = 300
NORM = 1e-5
#: Words whose weights a task remembers.
CACHE_WORDS = 400_000
#: Upper case to lower case, punctuation and control characters to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(PLAIN).split())


def of_word(word: bytes) -> list[bytes]:
    return [b"=" + word, *[word[:n] for n in STEMS if len(word) >= n]]


def features_of(text: bytes, known: dict[bytes, float]) -> set[bytes]:
    return {f for word in words_of(text) for f in of_word(word) if f in known}


def above_clean(p: float, n_p: int, u: float, n_u: int, prior: float) -> float:
    """How many times as frequent a feature is in positives (p of n_p) as in clean texts; u of n_u unlabelled ones have it.

    The clean rate is estimated from both and taken one standard error higher, as a high prior magnifies what chance does.
    """
    error = np.sqrt(u * (1 - u) / n_u + prior**2 * p * (1 - p) / n_p)
    return p / ((max(0.0, u - prior * p) + error) / (1 - prior) + 1 / n_u)


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float) -> tuple[dict[bytes, float], float]:
    """Weights by feature and a bias, with the least class-prior-corrected risk.

    Risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)), with the logistic
    loss. Where the second term falls below zero the step goes up its gradient instead, which keeps it from overfitting.
    A text's features are the distinct words and word beginnings in it.
    """
    positive = list(dict.fromkeys(positive))  # copies would make all their words look toxic
    n = len(positive)
    if not n or not unlabelled:
        return {}, -10.0
    with_p: Counter[bytes] = Counter()
    for text in positive:
        with_p.update(set().union(*map(of_word, words_of(text))))
    frequent = {f: c for f, c in with_p.items() if c >= max(LEAST_DOCS, LEAST_SHARE * n)}
    del with_p  # nearly all features are rare: only frequent ones are counted in the other texts
    held = [features_of(t, frequent) for t in (*positive, *unlabelled)]
    with_u = Counter(f for s in held[n:] for f in s)
    ratio = {f: above_clean(c / n, n, with_u[f] / len(unlabelled), len(unlabelled), prior) for f, c in frequent.items()}
    chosen = sorted((f for f, r in ratio.items() if r >= LEAST_RATIO), key=lambda f: (-frequent[f] * np.log(ratio[f]), f))[:FEATURES]
    at = {f: i for i, f in enumerate(chosen)}
    own = [sorted(at[f] for f in s if f in at) for s in held]
    row = np.repeat(np.arange(len(own)), list(map(len, own)))
    col = np.array([i for x in own for i in x], np.int64)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    speed, speed_b = np.full(len(w), 1e-8), 1e-8
    share_p, share_u = np.full(n, 1 / n), np.full(len(unlabelled), 1 / len(unlabelled))
    for _ in range(ROUNDS):
        f = np.bincount(row, w[col], len(own)) + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = (share_u * np.logaddexp(0, f[n:])).sum() - prior * (share_p * np.logaddexp(0, f[:n])).sum()
        up_negative = np.concatenate([-prior * share_p * p[:n], share_u * p[n:]])
        if negative >= 0:
            slope = up_negative
            slope[:n] += prior * share_p * (p[:n] - 1)
        else:
            slope = -up_negative
        g = np.bincount(col, slope[row], len(w)) + NORM * w
        gb = slope.sum()
        speed, speed_b = speed + g * g, speed_b + gb * gb
        w, bias = w - 0.3 * g / np.sqrt(speed), bias - 0.3 * gb / np.sqrt(speed_b)
    return {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(bias)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[dict[bytes, float], float]:
    """Fits on at most POSITIVES texts confirmed toxic and UNLABELLED others of ``allowed`` rows, whose labels are not used.

    Copies of a text are one, toxic if any of them is called so, however many rows they are: both sides are drawn from
    distinct texts, and the class prior is the share of toxic ones among those with a label. Texts over TRAIN_CHARS are
    not drawn.
    """
    known = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(allowed & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= TRAIN_CHARS))
    usable = usable.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("copy", F.xxhash64("text"))
    each = usable.select("doc_id", "copy").join(known, "doc_id", "left").groupBy("copy")
    distinct = Scratch(docs.sparkSession).table("distinct", each.agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    prior = distinct.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(0.9, max(0.001, prior or 0.0))

    def drawn(texts: DataFrame, most: int) -> list[bytes]:
        top = texts.select("doc_id", "copy").orderBy("copy").limit(most)
        rows = usable.join(F.broadcast(top), ["doc_id", "copy"]).dropDuplicates(["copy"])  # at most ``most`` rows
        return [bytes(r.text) for r in sorted(rows.collect(), key=lambda r: r.copy)]

    return fit(drawn(distinct.where("toxic = 1"), POSITIVES), drawn(distinct, UNLABELLED), prior)


def score(docs: DataFrame, weights: dict[bytes, float], bias: float) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of at least 0.5) of every row's whole text.

    A null text counts as empty and scores what a text without any learned word does. Repeated rows and null doc_ids are
    scored each. Other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, ...]] = {}
        for batch, texts in steps(batches):
            values = []
            for text in texts:
                words = words_of(text)
                for word in words.difference(known):
                    known[word] = tuple(f for f in of_word(word) if f in weights)
                features = set().union(*filter(None, map(known.__getitem__, words)))
                values.append(bias + sum(map(weights.__getitem__, sorted(features))))
                if len(known) > CACHE_WORDS:
                    known.clear()
            scores = 1 / (1 + np.exp(-np.clip(np.array(values), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, f"doc_id {key}, score double, predicted int")
