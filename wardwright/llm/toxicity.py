"""Toxicity: a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import WordIds, in_held_out, matches, prepare, subword_buckets, table
from wardwright.session import settle

_WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 15
#: A word's embedding is the mean over its own bucket and those of its character n-grams.
SIZES = (3, 4, 5)
WIDTHS = (1, 2, 3)
CUT = 0.3  # the score from which on a text counts as toxic
_BLOCK = 1 << 17  # words that are convolved at a time
_TURNS = 64  # buckets of a word that are added up together with those of other words
_START = 1e-8  # of the past gradients
RATE = 0.1
_GROUP = 2048  # documents, about, that a copy of the model learns from
_BATCH = 64  # of them a step
_APART = 100  # documents of a label from which on a fifth is kept for calibration
_TEXT = 1 << 23  # characters that are held for the steps, about
_BLOCKS = 16  # the embedding travels in so many rows
_GRAIN = 256  # parts of a unit that logits are counted by
_FAR = 64.0  # where counted logits end


def words_of(text: str) -> Iterator[list[str]]:
    return matches(_WORD, text.lower())


def _vectors(words: list[str], embedding: np.ndarray) -> np.ndarray:
    buckets, owner = subword_buckets([w.encode("utf-8") for w in words], SIZES, len(embedding))
    count = np.bincount(owner, minlength=len(words))
    summed = np.stack([np.bincount(owner, embedding[buckets, k], len(words)) for k in range(embedding.shape[1])], axis=1)
    return (summed / np.maximum(count, 1)[:, None]).astype(np.float32)


def _summed(embedding: np.ndarray, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word the sum over its buckets, `flat[first : first + size]`: the k-th buckets of all words in turn, and the
    rest of a very long word by itself."""
    order = np.argsort(-sizes, kind="stable")  # the words with a k-th bucket lie in front
    first, sizes = first[order], sizes[order]
    total = np.zeros((len(sizes), embedding.shape[1]), embedding.dtype)
    for k in range(min(_TURNS, int(sizes[0]))):
        there = first[: np.searchsorted(-sizes, -k)]
        total[: len(there)] += embedding.take(flat[there + k], axis=0)
    for n in range(np.searchsorted(-sizes, -_TURNS)):
        total[n] += embedding[flat[first[n] + _TURNS : first[n] + sizes[n]]].sum(axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dimensions
    filters: dict[int, np.ndarray]  # width -> width x dimensions x filters
    bias: dict[int, np.ndarray]
    out: np.ndarray  # all filters -> logit
    out_bias: float = 0.0
    slope: float = 1.0  # calibration of the logit
    shift: float = 0.0
    languages: list[str] = field(default_factory=list)
    tongue: np.ndarray | None = None  # dimensions + 1 x languages
    cuts: list[float] = field(default_factory=list)  # probability from which on a text counts, by language

    def score(self, pooled: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Calibrated scores: the cut of the language that the text looks like maps to CUT, 0 and 1 to themselves."""
        p = self.probability(pooled)
        cut = np.array(self.cuts)[self.language(mean)]
        return np.clip(np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut)), 0.0, 1.0)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return self.curve(self.logit(pooled))

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def curve(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))

    def language(self, mean: np.ndarray) -> np.ndarray:
        if self.tongue is None:
            return np.zeros(len(mean), np.int64)
        return (mean @ self.tongue[:-1] + self.tongue[-1]).argmax(axis=1)


class Reader:
    """Pools the filters over texts; remembers what each word adds to each filter, up to a bound of words."""

    def __init__(self, model: Model):
        self.model = model
        # Columns: for each width and place in it, that place's part of the filters; then the embedding itself.
        self.project = np.concatenate([model.filters[w][k] for w in WIDTHS for k in range(w)], axis=1).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.words = WordIds(100_000)
        self.words[""] = 0  # padding
        self.parts = np.zeros((1, self.project.shape[1]), np.float32)
        self.vectors = np.zeros((1, self.model.embedding.shape[1]), np.float32)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the pooled filters and the mean word embedding."""
        numbers = [self.words.of_all(words_of(t)) for t in texts]
        if fresh := self.words.take():
            vectors = _vectors(fresh, self.model.embedding)
            self.vectors = np.concatenate([self.vectors, vectors])
            self.parts = np.concatenate([self.parts, vectors @ self.project])
        reach = max(WIDTHS) - 1
        pad = np.zeros(reach, np.int64)
        stream = np.concatenate([x for n in numbers for x in (n, pad)] or [pad])
        owner = np.repeat(np.arange(len(texts)), [len(n) + reach for n in numbers])
        filters = self.model.out.shape[0] // len(WIDTHS)
        pooled = np.full((len(texts), self.model.out.shape[0]), -np.inf, np.float32)
        mean = np.zeros((len(texts), self.vectors.shape[1]))
        for at in range(0, len(owner), _BLOCK):
            part, here = stream[at : at + _BLOCK + reach], owner[at : at + _BLOCK]
            part = np.concatenate([part, np.zeros(max(0, len(here) + reach - len(part)), np.int64)])
            starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            column = 0
            for i, width in enumerate(WIDTHS):
                total = np.zeros((len(here), filters), np.float32)
                for k in range(width):
                    total += self.parts[part[k : k + len(here)], column : column + filters]
                    column += filters
                best = np.maximum.reduceat(total, starts, axis=0) + self.model.bias[width]
                places = slice(i * filters, (i + 1) * filters)
                pooled[here[starts], places] = np.maximum(pooled[here[starts], places], best)
            mean[here[starts]] += np.add.reduceat(self.vectors[part[: len(here)]], starts, axis=0)
        mean /= np.maximum([len(n) for n in numbers], 1)[:, None]
        if self.words.full():
            self.clear()
        return pooled, mean


class Trainer:
    """Steps of descent over the texts that it holds, with a step size per weight that falls with its past gradients. Gradients run
    through the pooled maxima only."""

    def __init__(self, texts: list[str], model: Model, past: dict, rate: float = RATE):
        self.model, self.past, self.rate = model, past, rate
        seen = WordIds()
        self.numbers = [seen.of_all(words_of(t)).astype(np.int32) for t in texts]
        words = list(seen)
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for k in range(0, len(words), 20_000):  # a part at a time, as the driver's memory is small
            buckets, owner = subword_buckets([w.encode("utf-8") for w in words[k : k + 20_000]], SIZES, BUCKETS)
            order = np.argsort(owner, kind="stable")
            parts.append((buckets[order].astype(np.int32), np.bincount(owner, minlength=len(words[k : k + 20_000])).astype(np.int32)))
        self.flat, self.count = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count
        self.place = np.zeros(len(words), np.int64)  # of a word among those of a step

    def _moved(self, key, value, gradient):
        self.past[key] += gradient**2
        return value - self.rate * gradient / np.sqrt(self.past[key])

    def step(self, rows: list[int], y: np.ndarray, weight: np.ndarray | None = None) -> None:
        model, past, place, filters = self.model, self.past, self.place, len(self.model.out) // len(WIDTHS)
        dimensions, reach = model.embedding.shape[1], max(WIDTHS) - 1
        place[:] = 0
        for n in rows:
            place[self.numbers[n]] = 1
        distinct = np.flatnonzero(place)
        if not len(distinct):
            return
        place[distinct] = np.arange(len(distinct))
        sizes = self.count[distinct]
        vectors = np.concatenate([_summed(model.embedding, self.flat, self.first[distinct], sizes) / sizes[:, None].astype(np.float32),
                                  np.zeros((1, dimensions), np.float32)])
        lengths = [len(self.numbers[n]) for n in rows]
        cut = [place[self.numbers[n]] for n in rows]
        pad = np.full(reach, len(distinct))
        stream = np.concatenate([x for c in cut for x in (c, pad)] + [pad])
        starts = np.cumsum([0, *[length + reach for length in lengths[:-1]]])
        total = sum(length + reach for length in lengths)
        pooled, peaks = [], []
        for w in WIDTHS:
            response = np.tile(model.bias[w], (total, 1))
            for k in range(w):
                response += (vectors @ model.filters[w][k]).take(stream[k : k + total], axis=0)
            ends = [*starts[1:], total]
            peak = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
            peaks.append(peak)
            pooled.append(response[peak, np.arange(filters)])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
        slope = (p - y) / len(y) if weight is None else weight * (p - y) / weight.sum()
        back = (np.outer(slope, model.out) * (hidden > 0)).astype(np.float32)
        by_vector = np.zeros_like(vectors)
        for i, w in enumerate(WIDTHS):
            own = back[:, i * filters : (i + 1) * filters]
            gradient = np.empty_like(model.filters[w])
            for k in range(w):
                tokens = stream[peaks[i] + k]
                gradient[k] = np.einsum("rf,rfd->df", own, vectors[tokens])
                np.add.at(by_vector, tokens.ravel(), (own[:, :, None] * model.filters[w][k].T[None]).reshape(-1, dimensions))
            model.filters[w] = self._moved(("f", w), model.filters[w], gradient)
            model.bias[w] = self._moved(("b", w), model.bias[w], own.sum(axis=0))
        model.out = self._moved("o", model.out, active.T @ slope)
        past["ob"] += slope.sum() ** 2
        model.out_bias -= self.rate * slope.sum() / np.sqrt(past["ob"])
        touched = np.flatnonzero(np.abs(by_vector[:-1]).sum(axis=1))
        if len(touched):
            words = distinct[touched]
            sizes = self.count[words]
            ends = np.cumsum(sizes)
            subs = self.flat[np.repeat(self.first[words] - (ends - sizes), sizes) + np.arange(ends[-1])]
            spread = np.repeat(by_vector[touched] / sizes[:, None].astype(np.float32), sizes, axis=0)
            hit, local = np.unique(subs, return_inverse=True)
            gradient = np.zeros((len(hit), dimensions), np.float32)
            np.add.at(gradient, local, spread)
            past["e"][hit] += gradient**2
            model.embedding[hit] -= self.rate * gradient / np.sqrt(past["e"][hit])


def learn(texts: list[str], labels: list[int], train: list[int], dimensions: int = 16, filters: int = 12, steps: int = 500,
          rate: float = RATE, batch: int = 32, seed: int = 11) -> tuple[Model, dict] | None:
    """A model from steps over batches of the texts `train` with as many toxic texts as others, and its past gradients. None without
    words or texts of both labels."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (BUCKETS, dimensions)).astype(np.float32),
                  {w: rng.normal(0, 0.3, (w, dimensions, filters)).astype(np.float32) for w in WIDTHS},
                  {w: np.zeros(filters, np.float32) for w in WIDTHS}, rng.normal(0, 0.3, len(WIDTHS) * filters))
    past = {"e": np.full(model.embedding.shape, _START, np.float32), "o": np.full(model.out.shape, _START), "ob": _START,
            **{("f", w): np.full(model.filters[w].shape, _START, np.float32) for w in WIDTHS},
            **{("b", w): np.full(filters, _START, np.float32) for w in WIDTHS}}
    trainer = Trainer(texts, model, past, rate)
    drawn = {k: np.array([n for n in train if labels[n] == k]) for k in (0, 1)}
    if not (len(trainer.count) and len(drawn[0]) and len(drawn[1])):
        return None
    waiting = {k: np.zeros(0, np.int64) for k in (0, 1)}
    for _ in range(steps):
        rows = []
        for k in (0, 1):
            while len(waiting[k]) < batch // 2:
                waiting[k] = np.concatenate([waiting[k], rng.permutation(drawn[k])])
            rows += waiting[k][: batch // 2].tolist()
            waiting[k] = waiting[k][batch // 2 :]
        trainer.step(rows, np.array([labels[n] for n in rows], float))
    return model, past


def fit(texts: list[str], labels: list[int], languages: list[str | None], prior: float, dimensions: int = 16, filters: int = 12,
        steps: int = 500, rate: float = RATE, batch: int = 32, seed: int = 11) -> Model | None:
    """Train on a list of labelled texts; every fifth one calibrates, as `calibrate` says. None without texts of both labels."""
    held = set(range(0, len(texts), 5)) if len(texts) >= 100 else set()
    train = [n for n in range(len(texts)) if n not in held]
    made = learn(texts, labels, train, dimensions, filters, steps, rate, batch, seed)
    if made is None:
        return None
    model, reader = made[0], Reader(made[0])
    states = [reader.read(texts[k : k + 256]) for k in range(0, len(texts), 256)]
    pooled, mean = np.concatenate([s[0] for s in states]), np.concatenate([s[1] for s in states])
    spoken = [n for n, lang in enumerate(languages) if lang is not None]
    names = [languages[n] for n in spoken]
    _fit_language(model, {lang: _moments(mean[[n for n, x in zip(spoken, names) if x == lang]]) for lang in set(names)})
    rows = sorted(held) or train
    calibrate(model, model.logit(pooled[rows]), model.language(mean[rows]), np.array(labels)[rows], np.ones(len(rows)), prior)
    return model


def calibrate(model: Model, logit: np.ndarray, spoken: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float) -> None:
    """A logistic curve maps logits to probabilities, weighted to the share `prior` of toxic texts, and each language gets the cut
    with the best F-measure (midway to the next score below); a language with few toxic texts gets the cut of all. `n`: how many texts."""
    share = (n * y).sum() / n.sum()
    weight = n * np.where(y == 1, prior / share, (1 - prior) / (1 - share)) if 0 < share < 1 else n
    _fit_curve(model, logit, y, weight)
    p = model.curve(logit)
    whole = _best_cut(p, y, weight)
    model.cuts = [_best_cut(p[here], y[here], weight[here]) if (n[here] * y[here]).sum() >= 20 else whole
                  for here in (spoken == k for k in range(max(1, len(model.languages))))]


def _moments(mean: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of mean embeddings."""
    return np.concatenate([[len(mean)], mean.sum(axis=0), (mean.T @ mean).ravel()])


def _fit_language(model: Model, moments: dict[str, np.ndarray]) -> None:
    """The linear discriminant of mean embeddings by language, from their moments: one spread for all languages."""
    model.languages = sorted(moments)
    if len(model.languages) < 2:
        return
    size = model.embedding.shape[1]
    n = np.array([moments[k][0] for k in model.languages])
    center = np.stack([moments[k][1 : size + 1] for k in model.languages]) / n[:, None]
    products = sum(moments[k][size + 1 :] for k in model.languages).reshape(size, size)
    spread = (products - (center * n[:, None]).T @ center) / n.sum()
    spread += np.eye(size) * (1e-3 * np.trace(spread) / size + 1e-9)
    weights = np.linalg.solve(spread, center.T)
    model.tongue = np.concatenate([weights, (np.log(n / n.sum()) - 0.5 * (center.T * weights).sum(axis=0))[None]])


def _fit_curve(model: Model, logits: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> None:
    """Weighted logistic regression on the logit by Newton steps, slightly damped so that it ends on separable data."""
    center, spread = logits.mean(), logits.std() + 1e-9
    x = np.stack([(logits - center) / spread, np.ones(len(logits))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w -= np.linalg.solve(curve, slope)
    model.slope, model.shift = float(max(w[0], 1e-3) / spread), float(w[1] - max(w[0], 1e-3) * center / spread)


def _best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability with the best F-measure; midway to the next text below it, inside (0, 1)."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    right, taken = np.cumsum(weight * y), np.cumsum(weight)
    measure = 2 * right / (taken + (weight * y).sum())
    measure[:-1][p[:-1] == p[1:]] = -1  # a cut lies between two scores
    k = int(measure.argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 1e-3, 1 - 1e-3))


def _labelled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Documents and labels of an id side by side, the label first, in groups by a hash of the id. Ids and labels meet by sorting, so
    that texts are shuffled once, and in the same order however the rows are dealt out."""
    groups = max(1, round(marked.count() / _GROUP))
    none = F.lit(None).cast("string")
    rows = docs.select("_id", F.lit(None).cast("int").alias("_label"), "_lang", "_text").unionByName(
        marked.select("_id", "_label", none.alias("_lang"), none.alias("_text")))
    rows = rows.select(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(groups)).alias("_group"), "*")
    order = ["_group", F.xxhash64("_id"), "_id", F.col("_label").isNull(), F.xxhash64("_text"), "_lang"]
    return rows.repartition("_group").sortWithinPartitions(*order).select("_group", F.col("_id").cast("string").alias("_id"), "_label", "_lang", "_text")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[str | None]]]:
    """Texts, labels and languages of a group, in parts if its texts are long. Documents without a label are left out."""
    at, label, rows, size = None, (None, None), [], 0
    for batch in batches:
        for k in range(len(batch)):
            group, doc, toxic, lang, text = (c[k].as_py() for c in batch.columns)
            if rows and (group != at or size >= _TEXT):
                yield [r[0] for r in rows], np.array([r[1] for r in rows], float), [r[2] for r in rows]
                rows, size = [], 0
            at = group
            if toxic is not None:
                label = doc, toxic
            elif label[0] == doc:
                rows.append((text, label[1], lang))
                size += len(text)
    if rows:
        yield [r[0] for r in rows], np.array([r[1] for r in rows], float), [r[2] for r in rows]


def _small(model: Model) -> np.ndarray:
    """All weights but the embedding."""
    return np.concatenate([*(x.ravel() for w in WIDTHS for x in (model.filters[w], model.bias[w])), model.out, [model.out_bias]]).astype(float)


def _refined(rows: DataFrame, model: Model, past: dict, prior: float) -> Model:
    """One pass of steps over all labelled documents. Each group steps from `model`, its texts weighted so that both labels count alike; a weight
    becomes the mean of the groups', an embedding's that of the groups that moved it. Tasks send sums, added up by block of the embedding."""
    sent = rows.sparkSession.sparkContext.broadcast(({**vars(model)}, past))  # some MB, fixed by the model's parameters

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = sent.value
        base = _small(Model(**start))
        moved, times = np.zeros(start["embedding"].shape), np.zeros(len(start["embedding"]))
        small, groups = np.zeros(len(base)), 0
        for texts, y, _ in _together(batches):
            own = copy.deepcopy(Model(**start))
            trainer = Trainer(texts, own, copy.deepcopy(before))
            weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior))
            for k in range(0, len(texts), _BATCH):
                part = slice(k, k + _BATCH)
                trainer.step(list(range(len(texts)))[part], y[part], weight[part])
            change = own.embedding.astype(float) - start["embedding"]
            moved += change
            times += change.any(axis=1)
            small += _small(own) - base
            groups += 1
        if groups:
            out = [(-1, small.tobytes(), np.array([groups], float).tobytes())]
            out += [(k, m.astype(np.float32).tobytes(), t.tobytes()) for k, (m, t) in enumerate(zip(np.split(moved, _BLOCKS), np.split(times, _BLOCKS)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "moved", "times"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k in range(len(batch)):
                block, moved, times = (c[k].as_py() for c in batch.columns)
                here = np.frombuffer(moved, float if block < 0 else np.float32), np.frombuffer(times, float)
                sums[block] = [x + y for x, y in zip(sums.get(block, (0.0, 0.0)), here)]
        for block, (moved, times) in sums.items():
            yield pa.RecordBatch.from_pylist([{"block": block, "moved": moved.astype(float).tobytes(), "times": times.tobytes()}],
                                             schema=pa.schema([("block", pa.int32()), ("moved", pa.binary()), ("times", pa.binary())]))

    schema = "block int, moved binary, times binary"
    sums = {r.block: (np.frombuffer(r.moved), np.frombuffer(r.times))
            for r in rows.mapInArrow(stepped, schema).repartition("block").mapInArrow(added, schema).collect()}
    if not sums:
        return model
    shape = model.embedding.shape
    moved, times = (np.concatenate([sums[k][i] for k in range(_BLOCKS)]) for i in (0, 1))
    model.embedding = (model.embedding + moved.reshape(shape) / np.maximum(times, 1)[:, None]).astype(np.float32)
    small, at = _small(model) + sums[-1][0] / sums[-1][1][0], 0
    for w in WIDTHS:
        for part in (model.filters, model.bias):
            part[w] = small[at : at + part[w].size].reshape(part[w].shape).astype(np.float32)
            at += part[w].size
    model.out, model.out_bias = small[at:-1], float(small[-1])
    return model


def _calibrated(rows: DataFrame, model: Model, prior: float) -> Model:
    """Languages from the moments of mean embeddings, curve and cuts from how many documents have each logit, to 1/256: all of `rows`
    are counted, and the driver gets counts, of a size that does not depend on the rows."""
    sent = rows.sparkSession.sparkContext.broadcast({**vars(model)})

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Model(**sent.value))
        for texts, y, langs in _together(batches):
            for k in range(0, len(texts), 256):
                pooled, mean = reader.read(texts[k : k + 256])
                columns = [pa.array(y[k : k + 256].astype(np.int32)), pa.array(langs[k : k + 256], pa.string()), pa.array(reader.model.logit(pooled).astype(float)), pa.array(list(mean))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "lang", "logit", "mean"])

    states = settle(rows.mapInArrow(seen, "label int, lang string, logit double, mean array<double>"), "toxic-states")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, mean = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0.0) + _moments(mean[[x == lang for x in langs]])
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(np.arange(len(x))), pa.array(x)], names=["lang", "place", "x"])

    summed = (states.where("lang IS NOT NULL").select("lang", "mean").mapInArrow(moments, "lang string, place long, x double")
              .groupBy("lang", "place").agg(F.sum("x").alias("x")).toPandas().sort_values(["lang", "place"]))
    _fit_language(model, {lang: part["x"].to_numpy() for lang, part in summed.groupby("lang")})
    tongues = rows.sparkSession.sparkContext.broadcast({**vars(model)})

    @F.pandas_udf("long")
    def language(mean: pd.Series) -> pd.Series:
        return pd.Series(Model(**tongues.value).language(np.stack(mean.to_numpy())) if len(mean) else [], dtype="int64")

    grain = F.round(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), F.col("logit"))) * _GRAIN).cast("long")
    found = states.groupBy(language("mean").alias("spoken"), "label", grain.alias("grain")).count().toPandas().sort_values(["grain", "spoken", "label"])
    if len(found):
        calibrate(model, found["grain"].to_numpy() / _GRAIN, found["spoken"].to_numpy(), found["label"].to_numpy(), found["count"].to_numpy().astype(float), prior)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          label: str = "toxic", rows_per_label: int = 2000) -> Model | None:
    """Fit the model on all labelled documents outside the held-out quarter.

    A fifth of them, by a hash of their id, calibrates: languages, curve and cuts come from all of it. The others train. With fewer
    than 100 documents of a label all do both. The driver
    makes a first model from at most `rows_per_label` of each label, taken by the order of a hash; from it, one pass in tasks learns
    from every training document. The true share of labels is counted over all. A document labelled twice counts as toxic if any label
    says so; each row that repeats an id is a document; null labels, ids and texts are not learnt from."""
    prepare(docs.sparkSession)
    marked = settle(labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~in_held_out(F.col(doc_id)))
                    .groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label")).where("_label IN (0, 1)"), "toxic-labels")
    counts = dict(marked.groupBy("_label").count().collect())
    if len(counts) < 2:
        return None
    prior = counts[1] / (counts[0] + counts[1])
    spoken = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    known = docs.where(~in_held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), spoken.alias("_lang"), F.col(text).alias("_text"))
    apart = min(counts.values()) >= _APART
    aside = F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(5)) == 0 if apart else F.lit(False)
    picks = [marked.where((F.col("_label") == k) & ~aside).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_label) for k in (0, 1)]
    chosen = settle(picks[0].union(picks[1]), "toxic-start")
    rows = known.join(chosen, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).toArrow().to_pandas().sort_values("_id")
    made = learn(rows["_text"].tolist(), rows["_label"].tolist(), list(range(len(rows))))
    if made is None:
        return None
    del rows
    model = _refined(_labelled(known.where(~aside), marked.where(~aside)), *made, prior)
    rest = aside if apart else F.lit(True)
    return _calibrated(_labelled(known.where(rest), marked.where(rest)), model, prior)


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from 0.3 on). A null or empty text is scored as a text without words;
    without a model every score is 0. Whole texts are read, however long. Repeated rows and extra columns pass;
    input columns named like the results are replaced."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model and {**vars(model)})  # some MB, fixed by the model's parameters

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(Model(**sent.value)) if sent.value else None
        for batch in texts:
            if reader is None:
                yield pd.Series(np.zeros(len(batch)))
            else:
                yield pd.Series(reader.model.score(*reader.read(["" if pd.isna(t) else t for t in batch])))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(text).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
