"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hash and the hashes of its byte n-grams with boundary marks, so a misspelling
or an unseen ending shares most of its vectors with words seen in training. The vectors of a window of words
are averaged and fed to a two-class softmax; vectors and softmax are trained together by Adagrad in numpy on
the driver. A document is as toxic as its most toxic window: training first takes every window for its
document's label, then only each document's highest window, and a logistic curve fitted on a fold of labelled
rows that the vectors never saw turns the highest window's logit into a score.

Training reads a bounded sample: at most ``MOST_ROWS`` labelled rows of each class, first in hash order among those
whose text has 1 to ``MOST_CHARS`` characters. Scoring reads every whole text. As everything after the vectors is
linear, a feature's vector is one number by then, and a word's number is kept by each worker process.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread, written

MOST_ROWS, MOST_CHARS = 1000, 20_000
BUCKETS, DIMENSIONS, GRAMS = 1 << 16, 8, (3, 4, 5)
WINDOW = 8
#: Steps of the two phases at least, whole epochs each.
STEPS_ALL, STEPS_TOP, BATCH, RATE, SEED = 300, 300, 512, 0.3, 7
INIT = 0.01
THRESHOLD = 0.3
#: Words whose logits a task keeps, a power of two.
CACHE_WORDS = 1 << 18
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Buckets of the word and of its byte n-grams."""
    b = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    crc, mask, n = zlib.crc32, BUCKETS - 1, len(b)
    out = [crc(b, 1) & mask]
    for g in GRAMS:
        out += [crc(b[i : i + g]) & mask for i in range(n - g + 1)]
    return out


@dataclass(frozen=True)
class Model:
    """``weights``: the logit difference of each bucket's vector; ``bias``; slope and shift of the final curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        """The mean weight of each word's features."""
        if not words:
            return np.empty(0)
        each = [features(x) for x in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int64, sizes.sum())
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -50, 50)))


def top_window(logits: np.ndarray, bias: float) -> float:
    """The highest mean over ``WINDOW`` words in a row (all words, if there are fewer); of no words, the bias alone."""
    n = len(logits)
    if n == 0:
        return bias
    total = np.concatenate([[0.0], np.cumsum(logits, dtype=np.float64)])
    w = min(n, WINDOW)
    return bias + float((total[w:] - total[:-w]).max()) / w


def _bags(texts: list[str]):
    """Word numbers in windows: (features of each word flat, their starts, windows x WINDOW word numbers with -1 as padding, document of each window)."""
    number: dict[str, int] = {}
    rows, owner = [], []
    for d, text in enumerate(texts):
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        for at in range(0, len(ids), WINDOW):
            part = ids[at : at + WINDOW]
            rows.append(part + [-1] * (WINDOW - len(part)))
            owner.append(d)
    each = [features(w) for w in number]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in each])]).astype(np.int64)
    flat = np.fromiter((x for f in each for x in f), np.int64, starts[-1])
    return flat, starts, np.array(rows, np.int64).reshape(-1, WINDOW), np.array(owner, np.int64)


def _word_features(flat: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of some words, flat, and the word (by its place in ``words``) of each."""
    length = starts[words + 1] - starts[words]
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return flat[starts[words][of] + at], of


def fit(texts: list[str], labels: list[int], curve_fold: list[bool]) -> Model:
    """Trains on the rows outside ``curve_fold`` and fits the curve on those inside it. With one class only, the score is constant."""
    y, fold = np.array(labels, np.int64), np.array(curve_fold, bool)
    if len(set(labels)) < 2:
        always = bool(labels) and labels[0] == 1
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 4.0 if always else -4.0)
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), bool)
    flat, starts, windows, owner = _bags(texts)
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, INIT, (BUCKETS, DIMENSIONS))
    head, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-3) for x in (vectors, head, bias)]
    per_document = np.bincount(owner, minlength=len(y))
    share = np.bincount(y[~fold], minlength=2) / max(1, (~fold).sum())
    balance = 0.5 / np.maximum(share, 1e-9)

    def forward(rows: np.ndarray):
        words, place = np.unique(rows, return_inverse=True)
        place = place.reshape(rows.shape)
        real = words >= 0
        f, of = _word_features(flat, starts, words[real])
        n_f = np.bincount(of, minlength=real.sum()).astype(float)
        mean = np.zeros((len(words), DIMENSIONS))
        for d in range(DIMENSIONS):
            mean[real, d] = np.bincount(of, vectors[f, d], minlength=real.sum()) / n_f
        n_words = (rows >= 0).sum(axis=1, keepdims=True)
        bag = mean[place].sum(axis=1) / n_words
        return words, place, real, f, of, n_f, n_words, bag

    def step(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        words, place, real, f, of, n_f, n_words, bag = forward(rows)
        z = bag @ head + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        g = p * (weight / weight.mean())[:, None] / len(label)
        g_bag = g @ head.T / n_words
        g_mean = np.zeros((len(words), DIMENSIONS))
        for d in range(DIMENSIONS):
            g_mean[:, d] = np.bincount(place.ravel(), np.repeat(g_bag[:, d], WINDOW), minlength=len(words))
        g_mean = g_mean[real] / n_f[:, None]
        used, at = np.unique(f, return_inverse=True)
        g_vec = np.stack([np.bincount(at, g_mean[of, d], minlength=len(used)) for d in range(DIMENSIONS)], axis=1) * len(label)
        for x, grad, total, rows_of in ((vectors, g_vec, sums[0], used), (head, bag.T @ g, sums[1], slice(None)), (bias, g.sum(axis=0), sums[2], slice(None))):
            total[rows_of] += grad**2
            x[rows_of] -= RATE * grad / np.sqrt(total[rows_of])

    def logits() -> np.ndarray:
        out = np.empty(len(windows))
        for a in range(0, len(windows), 4 * BATCH):
            bag = forward(windows[a : a + 4 * BATCH])[-1]
            out[a : a + 4 * BATCH] = bag @ (head[:, 1] - head[:, 0])
        return out

    learn = np.flatnonzero(~fold[owner])
    others = learn[y[owner[learn]] == 0]

    def epoch(rows: np.ndarray, top: bool) -> int:
        rows = rng.permutation(rows)
        for a in range(0, len(rows), BATCH):
            d = owner[rows[a : a + BATCH]]
            step(windows[rows[a : a + BATCH]], y[d], balance[y[d]] / (1 if top else per_document[d]))
        return -(-len(rows) // BATCH)

    done = 0
    while done < STEPS_ALL and len(learn):
        done += epoch(learn, False)
    done = 0
    while done < STEPS_TOP and len(learn):
        z = logits()
        order = learn[np.lexsort((-z[learn], owner[learn]))]
        first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        for _ in range(10):
            done += epoch(np.concatenate([first, rng.choice(others, min(len(others), 2 * len(first)), replace=False)]), True)
            if done >= STEPS_TOP:
                break

    weights = (vectors @ (head[:, 1] - head[:, 0])).astype(np.float32)
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    chosen = np.flatnonzero(fold) if fold.any() else np.arange(len(y))
    tops = np.array([top_window(np.array(model.word_logits(words_of(texts[i]))), model.bias) for i in chosen])
    slope, shift = _curve(tops, y[chosen])
    return Model(weights, model.bias, slope, shift)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on one number by Newton steps, with a ridge and softened targets."""
    centre, scale = x.mean(), x.std() + 1e-9
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - target) + 1e-2 * w)
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * centre)


def bucket_of(doc_id):
    """crc32 of the id's decimal text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(documents: DataFrame, labels: DataFrame, held_out: int = 2) -> Model:
    """Fits on a bounded sample of labelled rows, none of which has ``bucket_of`` = ``held_out``.

    Labels that repeat count once, as toxic if any says so; null labels and labels without a text are ignored.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.filter(bucket_of(F.col("doc_id")) != held_out).withColumn("_order", F.xxhash64("doc_id"))
    # First the ids, of rows with a text of the right length, then these rows' texts: a broadcast of 2 * MOST_ROWS ids at most.
    fitting = documents.filter(F.length("text").between(1, MOST_CHARS)).select("doc_id").join(known, "doc_id").distinct()
    fitting = written(fitting, "labelled")
    chosen = [fitting.filter(F.col("_toxic") == label).orderBy("_order", "doc_id").limit(MOST_ROWS) for label in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").filter(F.length("text").between(1, MOST_CHARS))
    # Of rows that share a doc_id one is taken: the number of texts stays bounded.
    found = rows.groupBy("doc_id", "_toxic", "_order").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: (r["_order"], r["doc_id"]))
    sample = [r for label in (0, 1) for r in found if r["_toxic"] == label]
    ids = [r["doc_id"] for r in sample]
    return fit([r["text"] for r in sample], [r["_toxic"] for r in sample], [zlib.crc32(f"curve {i}".encode()) % 4 == 0 for i in ids])


def _scorer(model: Model):
    """Scores of lists of texts. Words seen lately are kept with their logits in a table of fixed size, by the slot of their hash, where a later word takes the place of an earlier one."""
    keys, kept = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.float64)

    def logits(words: list[str]) -> np.ndarray:
        h = np.fromiter(map(hash, words), np.int64, len(words))
        h[h == 0] = 1  # 0 is an empty slot
        slot = h & (CACHE_WORDS - 1)
        out = kept[slot]
        missed = np.flatnonzero(keys[slot] != h)
        if len(missed):
            fresh = list({words[i] for i in missed})
            value = dict(zip(fresh, model.word_logits(fresh), strict=True))
            out[missed] = [value[words[i]] for i in missed]
            keys[slot[missed]], kept[slot[missed]] = h[missed], out[missed]
        return out

    def scores(texts: list[str | None]) -> np.ndarray:
        return model.score(np.array([top_window(logits(words_of(t)), model.bias) for t in texts], np.float64))

    return scores


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every whole text. Null and empty texts get the score of no words at all."""

    def rate(batches):
        scorer = _scorer(model)
        for batch in batches:
            scores = scorer(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(rate, "doc_id long, score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows whose score reaches the threshold, all columns as they are."""

    def keep(batches):
        scorer = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch["text"].to_pylist()) < THRESHOLD))

    return documents.mapInArrow(keep, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains, then scores all documents: doc_id, held_out, score, predicted."""
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
