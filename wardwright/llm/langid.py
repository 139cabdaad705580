"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import WordIds, in_held_out, matches, prepare, subword_buckets, table
from wardwright.session import settle

_WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 13
SIZES = (2, 3, 4)


def letter_words(text: str) -> Iterator[list[str]]:
    return matches(_WORD, text.lower())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of words and the word each belongs to; words without a letter have none."""
    kept = [n for n, w in enumerate(words) if any(map(str.isalpha, w))]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, owner = subword_buckets([words[n].encode("utf-8") for n in kept], SIZES, BUCKETS)
    return found, np.array(kept)[owner]


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # buckets x dimensions
    weights: np.ndarray  # dimensions x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dimensions: int = 16, epochs: int = 6,
        rate: float = 8.0, batch: int = 32, accuracy: float = 0.99, seed: int = 7) -> Model | None:
    """Train by stochastic gradient descent on (buckets, counts) per document; every fifth document calibrates.

    On those the temperature with the best likelihood is chosen, and the lowest score from which on the predictions
    reach `accuracy`. None if there is nothing to learn from.
    """
    rows = [n for n, (b, _) in enumerate(features) if len(b)]
    languages = sorted({labels[n] for n in rows})
    if not languages:
        return None
    answer = {lang: k for k, lang in enumerate(languages)}
    held, train = rows[::5] if len(rows) >= 50 else rows, [n for i, n in enumerate(rows) if i % 5 or len(rows) < 50]
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / dimensions, (BUCKETS, dimensions))
    weights, bias = np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    weights += rng.normal(0, 0.5, weights.shape)

    def dense(numbers: list[int]) -> np.ndarray:
        x = np.zeros((len(numbers), BUCKETS), np.float32)
        for i, n in enumerate(numbers):
            buckets, counts = features[n]
            x[i, buckets] = counts / counts.sum()
        return x

    steps = epochs * -(-len(train) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for at in range(0, len(order), batch):
            numbers = [train[i] for i in order[at : at + batch]]
            x, y = dense(numbers), np.array([answer[labels[n]] for n in numbers])
            mean = x @ embedding
            slope = _softmax(mean @ weights + bias)
            slope[np.arange(len(y)), y] -= 1
            slope *= rate * (1 - step / steps) / len(y)
            embedding -= x.T @ (slope @ weights.T)
            weights -= mean.T @ slope
            bias -= slope.sum(axis=0)
            step += 1
    logits = np.concatenate([dense(held[k : k + 64]) @ embedding @ weights + bias for k in range(0, len(held), 64)])
    truth = np.array([answer[labels[n]] for n in held])
    scale = min(np.geomspace(0.25, 8, 26), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    scores = _softmax(logits / scale)
    best, right = scores.max(axis=1), scores.argmax(axis=1) == truth
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) >= accuracy * np.arange(1, len(order) + 1))
    return Model(languages, embedding, weights, bias, float(scale), float(best[order][good[-1]]) if len(good) else 1.0)


class Reader:
    """Scores texts; remembers the logits of words, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.embedding @ model.weights
        self.clear()

    def clear(self) -> None:
        self.words = WordIds()
        self.logits, self.counts = np.zeros((0, len(self.model.languages))), np.zeros(0)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities per text, and whether it has letters at all."""
        numbers = [self.words.of_all(letter_words(t or "")) for t in texts]
        if fresh := self.words.take():
            buckets, owner = word_features(fresh)
            counts = np.bincount(owner, minlength=len(fresh))
            logits = np.stack([np.bincount(owner, self.table[buckets, k], len(fresh)) for k in range(self.table.shape[1])], axis=1)
            self.logits, self.counts = np.concatenate([self.logits, logits]), np.concatenate([self.counts, counts])
        sums, sizes = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for n, found in enumerate(numbers):
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                sums[n] += self.logits[part].sum(axis=0)
                sizes[n] += self.counts[part].sum()
        if self.words.full():
            self.clear()
        return _softmax((sums / np.maximum(sizes, 1)[:, None] + self.model.bias) / self.model.temperature), sizes > 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 4000) -> Model | None:
    """Fit the model on labelled documents outside the held-out quarter, at most `sample_rows` of them, taken by
    the order of a hash of their id. Only their feature counts reach the driver, a few kB each however long
    the text. Rows with a null id, text or language are not learnt from."""
    prepare(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~in_held_out(F.col(doc_id)))
    chosen = settle(labelled.select(F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_rows), "language-sample")

    @F.pandas_udf("buckets array<int>, counts array<int>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for value in batch:
                total = np.zeros(BUCKETS, np.int64)
                for words in letter_words(value or ""):
                    seen = WordIds()
                    numbers = seen.of(words)
                    buckets, owner = word_features(list(seen))
                    if len(buckets):
                        total += np.bincount(buckets, np.bincount(numbers)[owner], BUCKETS).astype(np.int64)
                held = np.flatnonzero(total)
                rows.append((held.astype(np.int32), total[held].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["buckets", "counts"])

    rows = (labelled.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(chosen, "_id")
            .select("_id", "_lang", counted("_text").alias("f")).select("_id", "_lang", "f.*").dropDuplicates(["_id"]).toArrow().to_pandas())
    rows = rows.sort_values("_id")
    return fit(list(zip(rows["buckets"], rows["counts"])), rows["_lang"].tolist())


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add `lang_pred`, `score` (calibrated probability of it) and `accepted` (score high enough to be trusted).

    Texts that are null or hold no letter get `und`, score 0 and are not accepted; so does everything without a
    model. Equal probabilities go to the first language in the alphabet. Whole texts are read. Repeated
    rows and extra columns pass; input columns named like the results are replaced.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(model) if model else None
        for batch in texts:
            values = [None if pd.isna(t) else t for t in batch]
            if reader is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(values), "score": 0.0, "accepted": False})
                continue
            scores, lettered = reader.read(values)
            best = np.where(lettered, scores.max(axis=1), 0.0)
            names = np.array(model.languages, object)[scores.argmax(axis=1)]
            yield pd.DataFrame({"lang_pred": np.where(lettered, names, "und"), "score": np.clip(best, 0, 1),
                                "accepted": lettered & (best >= model.reject_below)})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return docs.select(*kept, read(text).alias("_read")).select(*kept, "_read.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
