"""Language identification in two steps: the family first, then linear support vector machines between its languages."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import steps

#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "am", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
#: Training: labelled rows taken per language and in all (those with the smallest hash of doc_id), and the longest text.
ROWS_A_LANGUAGE = 300
ROWS_IN_ALL = 4_000
TRAIN_CHARS = 50_000
#: Hashed byte trigrams, documents whose histograms are held at once, weight of the squared norm, gradient steps.
SLOTS = 4_096
DOCS_AT_ONCE = 128
NORM = 1e-4
STEPS = 150


def held_out(doc_id: Column, of: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of hashed trigram counts of whole texts, each row of length one; letters A-Z in lower case."""
    low = np.frombuffer(b" ".join(t.lower() for t in texts) + b"  ", np.uint8).astype(np.uint32)
    code = (low[:-2] * 0x9E3779B1 + low[1:-1] * 0x85EBCA6B + low[2:] * 0xC2B2AE35) >> 20
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(code)]
    counts = np.bincount(owner * SLOTS + code[: len(owner)] % SLOTS, minlength=len(texts) * SLOTS)
    out = np.sqrt(counts.reshape(len(texts), SLOTS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def separator(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss; both sides count alike, however many rows they have."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    c = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(STEPS):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - 0.25 * (NORM * ahead - 2 * x.T @ (c * y * gap))
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


class Model:
    """Weights by task: one separator per family against the rest, one per pair of languages of a family."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        known = {code: family for family, codes in FAMILIES.items() for code in codes}
        family = {code: known.get(code, code) for code in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, c in enumerate(self.langs) if family[c] == f] for f in self.families]
        x = np.vstack([features(texts[i : i + DOCS_AT_ONCE]) for i in range(0, len(texts), DOCS_AT_ONCE)] or [np.zeros((0, SLOTS), np.float32)])
        own, kin = np.array([self.langs.index(c) for c in langs], int), np.array([self.families.index(family[c]) for c in langs], int)
        self.pairs = [p for group in self.members for p in combinations(group, 2)]
        weights = [separator(x, kin == f) for f in range(len(self.families))] if len(self.families) > 1 else []
        for a, b in self.pairs:
            rows = (own == a) | (own == b)
            weights.append(separator(x[rows], own[rows] == a))
        self.weights = np.array(weights, np.float32).reshape(len(weights), SLOTS + 1).T

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """A language per text, and 0.5 to 1 from the closest of the decisions that led there (1 without any)."""
        x = features(texts)
        margins = x @ self.weights[:-1] + self.weights[-1]
        n = len(self.families) if len(self.families) > 1 else 0
        kin = margins[:, :n].argmax(axis=1) if n else np.zeros(len(texts), int)
        sure = np.full(len(texts), np.inf)
        if n:
            best = np.sort(margins[:, :n], axis=1)
            sure = (best[:, -1] - best[:, -2]) / 2
        votes = np.full((len(texts), len(self.langs)), -np.inf)
        for f, group in enumerate(self.members):
            votes[np.ix_(kin == f, group)] = 0
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, n + k]
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
        win = votes.argmax(axis=1)
        for k, (a, b) in enumerate(self.pairs):
            mine = (win == a) | (win == b)
            sure[mine] = np.minimum(sure[mine], np.abs(margins[mine, n + k]))
        return [self.langs[i] for i in win], 1 / (1 + np.exp(-4 * np.maximum(sure, 0)))


def train(docs: DataFrame, allowed: Column) -> Model:
    """Fits the separators on at most ROWS_A_LANGUAGE labelled rows per language and ROWS_IN_ALL in all, of ``allowed`` rows."""
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= TRAIN_CHARS))
    kinds = max(1, labelled.select("lang").distinct().limit(ROWS_IN_ALL).count())
    most = min(ROWS_A_LANGUAGE, max(2, ROWS_IN_ALL // kinds))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("doc_id", "lang")
    chosen = labelled.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])  # at most ROWS_IN_ALL rows
    rows = chosen.select(F.col("text").cast("binary").alias("text"), "lang", "doc_id").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    return Model([bytes(r.text) for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. Whole texts
    count, of any length. Other columns pass through unchanged; lang_pred and score replace columns of those names.
    """
    packed = base64.b64encode(model.weights.astype("<f4").tobytes()).decode()
    shape, langs, families, members, pairs = model.weights.shape, model.langs, model.families, model.members, model.pairs

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.weights = np.frombuffer(base64.b64decode(packed), "<f4").reshape(shape)
        own.langs, own.families, own.members, own.pairs = langs, families, members, pairs
        for batch, texts in steps(batches):
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if langs and any(map(str.isalpha, t.decode(errors="replace")))]
            for at in range(0, len(real), DOCS_AT_ONCE):
                some = real[at : at + DOCS_AT_ONCE]
                names, sure = own.predict([texts[i] for i in some])
                scores[some] = sure
                for i, name in zip(some, names, strict=True):
                    found[i] = name
            columns = [batch.column(k) for k, c in enumerate(batch.schema.names) if c not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array(scores)], names=out)

    kept = docs.drop("lang_pred", "score")
    out = [*kept.columns, "lang_pred", "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(predicted, f"{schema}, lang_pred string, score double")
