"""Quality classifier by co-training.

Two logistic classifiers see a document differently: one its text (hashed words
and shares of repeats, capitals, marks and the like), the other only its metadata
(language, source, length).  Over ROUNDS rounds both are fitted, calibrated on
held-out labels (Platt), and each gives the unlabelled documents of which it is sure
to the other as pseudo-labels.  At last both calibrated views are
combined by a logistic fit on the held-out labels, and all documents are scored.

This is done twice: for good quality, and for toxic documents, which are rejected
however well they are written.  A few words make a document toxic, so that classifier's
text view sees only words (hashed to WORDS) that stand out in toxic training documents:
by a log odds ratio of MARK_Z standard errors, near copies together counted once.

Of labelled documents MAX_LABELLED are taken, those with the smallest hashes of
doc_id among those that docs holds.  All other documents take part without a label: their
features are written once, and each round's sure ones are found, and fitted on, by
sums over all of them that Spark's tasks make (a histogram of scores, then losses and
gradients for L-BFGS), for both classifiers in the same pass.  Sums of many tasks are added up in further tasks,
so that the driver gets MEET vectors at most.  A task finds a document's pseudo-labels from the views of the
earlier rounds, so none are stored.  Scoring is one pass over all whole texts without
a shuffle; what goes to the tasks has a fixed size.

Cases: null and blank texts have no words and are scored by what is left; null
metadata is a value of its own; labels that repeat a doc_id count by their mean,
null quality or toxic not at all; of rows that repeat a labelled doc_id one is fitted, that with
the least text; repeated rows get the same score; with no labels, or
labels of one class, every document gets that class's share, and no document is rejected
unless all labels have quality 0 or all are toxic; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
import queue
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import SPACE, U64, Texts, mix, numbered, pick, slices, windows

#: Most labelled documents that are used to fit the classifiers.
MAX_LABELLED = 8000
#: Rounds in which pseudo-labels are exchanged.
ROUNDS = 3
#: Calibrated probabilities from which a view is sure.
SURE = 0.97
#: Share of the pool that a view may label in a round, of each class; equal scores go together.
SHARE = 0.15
#: Passes over the pool for a round's fit.
PASSES = 12
#: Tasks whose sums meet in one, and the most whose sums the driver gets.
MEET = 64
#: Bins of scores, from a logit of -30 to 30.
BINS = 1 << 14
#: Buckets of hashed words, and of hashed metadata.
BUCKETS, META = 1 << 12, 1 << 8
DENSE = 30
#: Dense features that are shares of what shouldn't be frequent: capitals, exclamation marks, digits, signs, repeats.
SHARES = [2, 3, 4, 5, 6, 7, 8, 9, 10]
KEEP_FROM = 0.5
TOXIC_FROM = 0.5
#: Buckets of words among which marks of toxic documents are looked for, a multiple of BUCKETS; how far marks stand out, and the most of them.
WORDS, MARK_Z, MARKS = 1 << 18, 5.0, 256
#: Penalty on squared weights of buckets, in documents; dense features have a tenth.
RIDGE = 3.0
#: Buckets of rows that are worked on at once, so that what is computed in between stays small beside the driver's memory.
FLAT = 1 << 17


def distinct(bucket: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different buckets (flat), and where each document's begin."""
    key = np.sort(doc.astype(np.int64) * size + bucket.astype(np.int64))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key % size, np.searchsorted(key, np.arange(n + 1) * size)


def text_features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word among WORDS, and dense features by text."""
    h, doc = t.word_hashes(), t.doc_of_words()
    n = np.diff(t.first).astype(float)
    lower = t.word_hashes(lower=True)

    def share(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.int64)))
        got = total[t.off[1:]] - total[t.off[:-1]] if len(values) == len(t.data) else total[t.first[1:]] - total[t.first[:-1]]
        return got / np.maximum(of, 1)

    data = t.data
    ink = share(~SPACE[data], np.ones(t.n))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    first = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(h) else np.zeros(0, bool)
    different = np.bincount(doc[order][first], minlength=t.n)
    w = windows(h, 3, 0xBF58476D1CE4E5B9)
    inside = np.flatnonzero(doc[:len(w)] == doc[2:]) if len(w) else np.zeros(0, np.int64)
    key3 = mix(w[inside] + (doc[inside].astype(U64) + U64(1)) * U64(0x94D049BB133111EB))
    by_key = np.argsort(key3, kind="stable")
    new = np.ones(len(inside), bool)
    new[by_key[1:]] = key3[by_key[1:]] != key3[by_key[:-1]]
    repeats = np.bincount(doc[inside][~new], minlength=t.n)
    dense = np.stack([
        np.log1p(n), ink / np.maximum(n, 1) / 10, share((data >= 65) & (data <= 90), ink), share(data == 33, ink), share((data >= 48) & (data <= 57), ink),
        share(((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126)), ink),
        share(data >= 0x80, ink), share(same, n), 1 - different / np.maximum(n, 1), repeats / np.maximum(n, 1), share(data == 10, ink), (n == 0).astype(float),
    ], axis=1)
    dense = np.column_stack((dense, np.sqrt(dense[:, SHARES]), np.minimum(10 * dense[:, SHARES], 1)))  # small shares tell much
    return (lower % U64(WORDS)).astype(np.int64), dense


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Buckets of language, source, length and both names together, by document."""

    def bucket(kind: str, value: object) -> int:
        raw = np.frombuffer(f"{kind}:{value}".encode(), np.uint8).astype(U64)
        return int(mix((raw * U64(0x100000001B3) ** np.arange(len(raw), dtype=U64)).sum(keepdims=True))[0] % U64(META))

    kept: dict[tuple[str, object], int] = {}

    def known(kind: str, value: object) -> int:
        if (kind, value) not in kept:
            kept[kind, value] = bucket(kind, value)
        return kept[kind, value]

    size = ["none" if n is None else int(2 * math.log2(max(0, n) + 1)) for n in n_chars]
    return np.array([[known("lang", a), known("source", b), known("size", c), known("both", (a, b))] for a, b, c in zip(lang, source, size)], np.int64).reshape(-1, 4)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with FLAT buckets or so, at least one row each; at: where each row's buckets begin, and the end."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + FLAT, "right")) - 1)
        yield a, b
        a = b


@dataclass
class Rows:
    """Features of one view: buckets of each row (flat, of any integer type) with weights, and dense ones."""

    bucket: np.ndarray
    at: np.ndarray
    dense: np.ndarray

    def __post_init__(self):
        self.size = np.diff(self.at)
        self.weight = 1 / np.sqrt(np.maximum(self.size, 1))

    def take(self, rows: np.ndarray) -> Rows:
        size, begin = self.size[rows], self.at[:-1][rows]
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(at[-1]), self.bucket.dtype)
        for a, b in runs(at):
            out[at[a]:at[b]] = self.bucket[np.arange(at[a], at[b]) + np.repeat(begin[a:b] - at[a:b], size[a:b])]
        return Rows(out, at, self.dense[rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.size))
        for a, b in runs(self.at):
            at = self.at[a:b + 1] - self.at[a]
            total = np.concatenate(([0.0], np.cumsum(w[self.bucket[self.at[a]:self.at[b]]])))
            out[a:b] = total[at[1:]] - total[at[:-1]]
        return out * self.weight

    def by_bucket(self, value: np.ndarray, buckets: int) -> np.ndarray:
        """The sum of the values of the rows that have each bucket."""
        out = np.zeros(buckets)
        for a, b in runs(self.at):
            out += np.bincount(self.bucket[self.at[a]:self.at[b]], np.repeat(value[a:b], self.size[a:b]), buckets)
        return out


class View:
    """A logistic classifier over one view, with Platt calibration."""

    def __init__(self, buckets: int, dense: int, decay: float):
        self.w, self.d, self.b = np.zeros(buckets), np.zeros(dense), 0.0
        self.mean, self.scale = np.zeros(dense), np.ones(dense)
        self.decay, self.slope, self.shift = decay, 1.0, 0.0

    def margin(self, x: Rows) -> np.ndarray:
        return x.times(self.w) + ((x.dense - self.mean) / self.scale) @ self.d + self.b

    def fit(self, x: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> None:
        """Full gradients with Adam's step sizes."""
        self.mean, self.scale = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
        dense = (x.dense - self.mean) / self.scale
        theta = [np.zeros_like(self.w), np.zeros_like(self.d), np.zeros(1)]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        weight = weight / weight.sum()
        for k in range(1, steps + 1):
            g = (sigmoid(x.times(theta[0]) + dense @ theta[1] + theta[2]) - y) * weight
            ridge = self.decay / len(y)
            grads = [x.by_bucket(g * x.weight, len(self.w)) + ridge * theta[0], dense.T @ g + 0.1 * ridge * theta[1], np.array([g.sum()])]
            for j, grad in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * grad
                second[j] = 0.99 * second[j] + 0.01 * grad * grad
                theta[j] = theta[j] - 0.2 * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.99**k)) + 1e-8)
        self.w, self.d, self.b = theta[0], theta[1], float(theta[2][0])

    def calibrate(self, x: Rows, y: np.ndarray) -> None:
        slopes, self.shift = platt(self.margin(x)[:, None], y)
        self.slope = max(0.0, float(slopes[0]))

    def probability(self, x: Rows) -> np.ndarray:
        return sigmoid(self.logit(x))

    def logit(self, x: Rows) -> np.ndarray:
        return self.slope * self.margin(x) + self.shift


def platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic fit by Newton steps, drawn to taking the first column as it is where labels are few."""
    x = np.column_stack((z, np.ones(len(z))))
    prior = np.eye(x.shape[1])[0]
    theta = prior.copy()
    for _ in range(50):
        p = sigmoid(x @ theta)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(theta)), x.T @ (p - y) + theta - prior)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def marks_of(words: Rows, toxic: np.ndarray) -> np.ndarray:
    """Buckets of words that stand out in toxic documents; documents that agree in four minima of hashes count as one."""
    copies = np.zeros(len(words.size), U64)
    for a, b in runs(words.at):
        some, bucket = a + np.flatnonzero(words.size[a:b]), words.bucket[words.at[a]:words.at[b]].astype(U64)
        for salt in range(1, 5):
            if len(some):
                copies[some] = mix(copies[some] ^ np.minimum.reduceat(mix(bucket + U64(salt << 32)), words.at[some] - words.at[a]))
    _, group, times = np.unique(copies, return_inverse=True, return_counts=True)
    count = 1 / times[group]
    odds, error = np.zeros(WORDS), np.zeros(WORDS)
    for sign, of in ((1, toxic == 1), (-1, toxic == 0)):
        having = words.by_bucket(count * of, WORDS) + 0.5
        lacking = np.maximum((count * of).sum() + 1 - having, 0.5)
        odds += sign * np.log(having / lacking)
        error += 1 / having + 1 / lacking
    z = odds / np.sqrt(error)
    best = np.lexsort((np.arange(WORDS), -z))[:MARKS]
    return np.sort(best[z[best] >= MARK_Z])


def marked(bucket: np.ndarray, doc: np.ndarray, dense: np.ndarray, marks: np.ndarray) -> Rows:
    """The text view of toxic documents: which marks each has, and how many words."""
    table = np.full(WORDS, -1, np.int16)
    table[marks] = np.arange(len(marks))
    found = table[bucket]
    hit = np.flatnonzero(found >= 0)
    return Rows(*distinct(found[hit], doc[hit], len(dense), MARKS), dense[:, :1])


def text_views(words: Rows, marks: np.ndarray) -> tuple[Rows, Rows]:
    """The text views of quality and of toxic documents, by the words among WORDS of each."""
    parts: tuple[list[Rows], list[Rows]] = [], []
    for a, b in runs(words.at):
        bucket, doc, dense = words.bucket[words.at[a]:words.at[b]], np.repeat(np.arange(b - a), words.size[a:b]), words.dense[a:b]
        for own, view in zip(parts, (Rows(*distinct(bucket % BUCKETS, doc, b - a, BUCKETS), dense), marked(bucket, doc, dense, marks))):
            own.append(Rows(view.bucket.astype(np.int16), view.at, view.dense))
    return tuple(Rows(np.concatenate([r.bucket for r in own]), np.concatenate(([0], np.cumsum(np.concatenate([r.size for r in own])))), np.concatenate([r.dense for r in own])) for own in parts)


@dataclass
class CoTrained:
    """Both views and how their logits are combined."""

    text: View
    meta: View
    slopes: np.ndarray
    shift: float
    constant: float | None = None

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            out = np.full(len(text.at) - 1, self.constant)
            return out, out, out
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.slopes[0] * a + self.slopes[1] * b + self.shift)


def bins_of(view: View, x: Rows) -> np.ndarray:
    return ((np.clip(view.logit(x), -30, 30) + 30) * ((BINS - 1) / 60)).astype(np.int64)


def pseudo_labels(x: tuple[Rows, Rows], history: list) -> list[np.ndarray]:
    """What each view got from the other in all rounds, the first label counts; -1: nothing. history: views and, for each, the last bin of label 0 and first of 1."""
    out = [np.full(len(x[0].at) - 1, -1), np.full(len(x[0].at) - 1, -1)]
    for views, limits in history:
        for k in (0, 1):
            bins, (low, high) = bins_of(views[k], x[k]), limits[k]
            mine = out[1 - k]
            new = mine < 0
            mine[new & (bins <= low)] = 0
            mine[new & (bins >= high)] = 1
    return out


def histogram(x: tuple[Rows, Rows], views: tuple[View, View]) -> np.ndarray:
    return np.concatenate([np.bincount(bins_of(v, r), minlength=BINS) for v, r in zip(views, x)]).astype(float)


def limits_of(count: np.ndarray) -> tuple[int, int]:
    """Last bin of label 0 and first of label 1 by SURE and SHARE."""
    edge = math.log(SURE / (1 - SURE))
    most = max(1, int(SHARE * count.sum()))
    low = min(int((30 - edge) * ((BINS - 1) / 60)) - 1, int(np.searchsorted(np.cumsum(count), most)))
    high = max(int((30 + edge) * ((BINS - 1) / 60)) + 1, BINS - 1 - int(np.searchsorted(np.cumsum(count[::-1]), most)))
    return low, high


def loss(view: View, x: Rows, y: np.ndarray, weight: float) -> np.ndarray:
    """Loss, weight and number of rows, and the gradient, as sums."""
    z = view.margin(x)
    g = (sigmoid(z) - y) * weight
    dense = (x.dense - view.mean) / view.scale
    return np.concatenate(([weight * (np.logaddexp(0, z) - y * z).sum(), weight * len(y), len(y)], x.by_bucket(g * x.weight, len(view.w)), dense.T @ g, [g.sum()]))


def pool_loss(x: tuple[Rows, Rows], views: tuple[View, View], history: list) -> np.ndarray:
    got = pseudo_labels(x, history)
    some = [np.flatnonzero(y >= 0) for y in got]
    return np.concatenate([loss(v, r.take(k), y[k].astype(float), 0.5) for v, r, y, k in zip(views, x, got, some)])


def lbfgs(f, x: np.ndarray, calls: int) -> np.ndarray:
    """The best point that L-BFGS finds in so many calls of f, which gives value and gradient."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1.0
    calls -= 1
    while calls > 0 and np.abs(grad).max() > 1e-7:
        q, back = grad.copy(), []
        for s, y in reversed(pairs):
            back.append(s @ q / (s @ y))
            q -= back[-1] * y
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1e-12, np.linalg.norm(grad))
        for (s, y), a in zip(pairs, reversed(back)):
            q += s * (a - y @ q / (s @ y))
        new = x - step * q
        got, slope = f(new)
        calls -= 1
        if got > value - 1e-4 * step * (q @ grad):
            step /= 4
            continue
        if (new - x) @ (slope - grad) > 1e-12:
            pairs = [*pairs[-7:], (new - x, slope - grad)]
        x, value, grad, step = new, got, slope, 1.0
    return x


def refit(views: tuple[View, View], x: tuple[Rows, Rows], y: np.ndarray, sums, history: list) -> None:
    """Fits both views anew, from where they are, on labelled rows x and on the pseudo-labels of the whole pool."""
    sizes = [len(v.w) + len(v.d) + 1 for v in views]

    def put(theta: np.ndarray) -> list[np.ndarray]:
        parts = np.split(theta, [sizes[0]])
        for v, part in zip(views, parts):
            v.w, v.d, v.b = part[:len(v.w)], part[len(v.w):-1], float(part[-1])
        return parts

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        parts = put(theta)
        pool = np.split(sums(pool_loss, views, history), [3 + sizes[0]])
        value, grads = 0.0, []
        for v, r, part, other in zip(views, x, parts, pool):
            total = loss(v, r, y, 1.0) + other
            ridge = v.decay / total[2] * np.concatenate((np.ones(len(v.w)), np.full(len(v.d), 0.1), [0.0]))
            value += total[0] / total[1] + (ridge * part * part).sum() / 2
            grads.append(total[3:] / total[1] + ridge * part)
        return value, np.concatenate(grads)

    put(lbfgs(f, np.concatenate([np.concatenate((v.w, v.d, [v.b])) for v in views]), PASSES))


@dataclass
class Model:
    """The classifiers of good quality and of toxic documents, and the buckets of the latter's words."""

    quality: CoTrained
    toxic: CoTrained
    marks: np.ndarray

    def scores(self, text: Rows, meta: Rows, marks: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return (*self.quality.scores(text, meta), self.toxic.scores(marks, meta)[2])

    def keeps(self, score: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        return (score >= KEEP_FROM) & (toxic < TOXIC_FROM)


def co_train(text: Rows, meta: Rows, label: np.ndarray, fold: np.ndarray, sums=None, buckets: int = BUCKETS, unlabelled: float = 1.0) -> CoTrained:
    """label: 0, 1, or -1 for the pool; fold: True for labelled rows that are held out.

    sums: gives the sum of function(rows of both views, *arguments) over a pool that is elsewhere.
    unlabelled: the score of all documents where there are no labels.
    """
    views = View(buckets, text.dense.shape[1], RIDGE), View(META, 0, RIDGE)
    known = label[label >= 0]
    if not len(known) or known.min() == known.max():
        return CoTrained(*views, np.zeros(2), 0.0, float(known.mean()) if len(known) else unlabelled)
    held = np.flatnonzero((label >= 0) & fold)
    if not len(held) or label[held].min() == label[held].max():
        held = np.flatnonzero(label >= 0)
    if sums is None:
        pool = np.flatnonzero(label < 0)
        here = text.take(pool), meta.take(pool)
        sums = lambda function, *arguments: function(here, *arguments)
    train = np.flatnonzero((label >= 0) & ~fold) if len(held) < len(known) else held
    if label[train].min() == label[train].max():
        train = held
    x, test, y = (text.take(train), meta.take(train)), (text.take(held), meta.take(held)), label[train].astype(float)
    history: list = []
    for view, rows, of in zip(views, x, test):
        view.fit(rows, y, np.ones(len(y)))
        view.calibrate(of, label[held])
    for _ in range(ROUNDS):
        count = np.split(sums(histogram, views), 2)
        if not count[0].sum():
            break
        history.append((copy.deepcopy(views), [limits_of(c) for c in count]))
        refit(views, x, y, sums, history)
        for view, of in zip(views, test):
            view.calibrate(of, label[held])
    slopes, shift = platt(np.column_stack([v.logit(r) for v, r in zip(views, test)]), label[held])
    return CoTrained(*views, slopes, shift)


def rows_of(batch: pa.RecordBatch, marks: np.ndarray) -> tuple[Rows, Rows, Rows]:
    """Both views of quality, text and metadata, and the text view of toxic documents."""
    t = Texts(batch.column("text")).split()
    words, dense = text_features(t)
    doc = t.doc_of_words()
    buckets = metadata_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    return Rows(*distinct(words % BUCKETS, doc, t.n, BUCKETS), dense), meta_rows(buckets), marked(words, doc, dense, marks)


def meta_rows(buckets: np.ndarray) -> Rows:
    n = buckets.size // 4
    return Rows(buckets.ravel().astype(np.int64), np.arange(n + 1) * 4, np.zeros((n, 0)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        t = Texts(batch.column("text")).split()
        words, dense = text_features(t)
        words, at = distinct(words, t.doc_of_words(), t.n, WORDS)
        meta = metadata_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("good"), batch.column("toxic"), lists, pa.array(dense.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.int32())),
        ], ["doc_id", "good", "toxic", "words", "dense", "meta"])


def _packed(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The features of each slice of documents as one row of bytes."""
    for batch in slices(batches):
        text, meta, few = rows_of(batch, marks)
        parts = []
        for view in (text, few):
            parts += view.bucket.astype(np.int16), np.diff(view.at).astype(np.int32), view.dense
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (*parts, meta.bucket.astype(np.int16))], PACKED)


PACKED = ["words", "sizes", "dense", "marks", "mark_sizes", "mark_dense", "meta"]


def together(fits: list, answer) -> list:
    """Results of functions that each get `sums` (see co_train); what all that aren't done ask for at a time, answer(requests by place) gives at once."""
    asked: queue.Queue = queue.Queue()
    told: list[queue.Queue] = [queue.Queue() for _ in fits]
    turn = threading.Lock()  # one works at a time, so that what they need for it isn't there twice

    def run(k: int) -> None:
        def sums(function, *arguments) -> np.ndarray:
            asked.put((k, (function, arguments), None))
            turn.release()
            got = told[k].get()
            turn.acquire()
            if got is None:
                raise RuntimeError("the pass over the pool failed")
            return got

        with turn:
            try:
                asked.put((k, None, (fits[k](sums), None)))
            except BaseException as e:  # raised again where the results are waited for
                asked.put((k, None, (None, e)))

    for k in range(len(fits)):
        threading.Thread(target=run, args=(k,), daemon=True).start()
    open_, requests, results = set(range(len(fits))), {}, [None] * len(fits)
    try:
        while open_:
            k, request, done = asked.get()
            if done:
                open_.remove(k)
                results[k], error = done
                if error:
                    raise error
            else:
                requests[k] = request
            if requests and len(requests) == len(open_):
                for k, got in answer(dict(requests)).items():
                    del requests[k]
                    told[k].put(got)
    finally:
        for k in open_:
            told[k].put(None)
    return results


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of all."""
    parts = sorted(x for batch in batches for x in batch.column("sums").to_pylist())  # in one order, that reruns agree; MEET or so
    if parts:
        total = np.frombuffer(parts[0])
        for part in parts[1:]:
            total = total + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def pool_sums(pool: DataFrame, marks: np.ndarray, meet: int = MEET):
    """Function for `together` for the classifiers of quality (0) and toxic documents (1).

    The features of the pool's documents (doc_id, text, lang, source, n_chars) are written once; each pass
    reads what is asked of them, for both at once, and adds up: in each task, then among `meet` tasks
    and so on, until the driver gets `meet` rows at most, however many tasks there are.
    """
    spark = pool.sparkSession
    packed = stored(pool.mapInArrow(lambda it: _packed(it, marks), ", ".join(f"{c} binary" for c in PACKED)), "pool-features")
    tasks = packed.rdd.getNumPartitions()
    views = {0: (PACKED[:3], DENSE), 1: (PACKED[3:6], 1)}

    def answer(requests: dict) -> dict:
        sent = spark.sparkContext.broadcast(requests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
                for n in range(batch.num_rows):
                    meta = meta_rows(np.frombuffer(columns["meta"][n], np.int16))
                    got = []
                    for k, (function, arguments) in sent.value.items():
                        (words, sizes, dense), width = views[k]
                        at = np.concatenate(([0], np.cumsum(np.frombuffer(columns[sizes][n], np.int32), dtype=np.int64)))
                        text = Rows(np.frombuffer(columns[words][n], np.int16).astype(np.int64), at, np.frombuffer(columns[dense][n]).reshape(len(at) - 1, width))
                        got.append(function((text, meta), *arguments))
                    got = np.concatenate(got)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts, count = packed.select(*[c for k in requests for c in views[k][0]], "meta").mapInArrow(run, "sums binary"), tasks
        while count > meet:
            count = -(-count // meet)
            parts = parts.repartition(count).mapInArrow(_added, "sums binary")
        nothing = {k: function((no_rows(views[k][1]), no_rows(0)), *arguments) for k, (function, arguments) in requests.items()}
        total = np.concatenate(list(nothing.values()))
        for part in sorted(bytes(r.sums) for r in parts.collect()):
            total = total + np.frombuffer(part)
        sent.unpersist()
        return dict(zip(nothing, np.split(total, np.cumsum([len(x) for x in nothing.values()])[:-1])))

    return answer


def no_rows(dense: int) -> Rows:
    return Rows(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, dense)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits both classifiers on the labelled sample and, without labels, on all other documents."""
    given = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    known = given.groupBy("doc_id").agg(*((F.avg(c) >= 0.5).cast("int").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    every = pick(docs, "doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    sample = known.join(every.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(MAX_LABELLED)
    fields = ["text", "lang", "source", "n_chars"]
    columns = every.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good", "toxic").agg(F.min(F.struct(*fields)).alias("row")).select("doc_id", "good", "toxic", "row.*")
    got = columns.mapInArrow(_features, "doc_id long, good int, toxic int, words array<int>, dense array<double>, meta array<int>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    n = got.num_rows
    if not n:
        nothing = np.zeros(0, np.int64), np.zeros(0, bool)
        return Model(co_train(no_rows(DENSE), no_rows(0), *nothing), co_train(no_rows(1), no_rows(0), *nothing, buckets=MARKS, unlabelled=0.0), np.zeros(0, np.int64))
    lists, dense, meta = (got.column(c).combine_chunks() for c in ("words", "dense", "meta"))
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
    words, meta = Rows(lists.flatten().to_numpy(), at, dense.flatten().to_numpy().reshape(n, DENSE).copy()), meta_rows(meta.flatten().to_numpy().copy())
    good, toxic = (got.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("good", "toxic"))
    fold = mix(got.column("doc_id").to_numpy().astype(np.int64).view(U64) + U64(5)) % U64(4) == 0
    marks = marks_of(words, np.where(fold, -1, toxic))
    text, few = ((view, meta) for view in text_views(words, marks))
    del got, lists, dense, words  # the driver has little room
    pa.default_memory_pool().release_unused()
    fits = [
        lambda sums: co_train(*labelled(text, good), *(x[good >= 0] for x in (good, fold)), sums),
        lambda sums: co_train(*labelled(few, toxic), *(x[toxic >= 0] for x in (toxic, fold)), sums, MARKS, 0.0),
    ]
    if not any(len({*y.tolist()} - {-1}) > 1 for y in (good, toxic)):
        return Model(*(f(None) for f in fits), marks)
    return Model(*together(fits, pool_sums(every.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti"), marks)), marks)


def labelled(views: tuple[Rows, Rows], label: np.ndarray) -> tuple[Rows, Rows]:
    return views[0].take(np.flatnonzero(label >= 0)), views[1].take(np.flatnonzero(label >= 0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score (probability of good quality), toxic_score (of a toxic document), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *views, score, toxic = model.scores(*rows_of(batch, model.marks))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (*views, score, toxic, model.keeps(score, toxic)))], ["doc_id", "text_score", "meta_score", "score", "toxic_score", "kept"])

    return pick(docs, "doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, toxic_score double, kept boolean")


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    same, name = numbered(docs)
    names = {c: name(c) for c in ("text", "lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names["text"]):
            seen = pa.RecordBatch.from_arrays([batch.column(n) for n in names.values()], list(names))
            yield batch.filter(pa.array(model.keeps(*model.scores(*rows_of(seen, model.marks))[2:])))

    return same.mapInArrow(run, same.schema).toDF(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
