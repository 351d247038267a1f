"""Quality by ordinal regression and toxicity by subword-bag embeddings.

Both learn on the driver in numpy from a bounded sample of labelled rows
(``sample`` rows, those with the least hash of doc_id) and score every whole text
on the executors.  A null text is empty; an empty text gets the model's bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.arrays import _BYTE_VALUES, _LOWER, U64, Words, chunks, mix, powers, texts_of
from wayfare.llm.storage import bound_batches

# --- hashed text features ---------------------------------------------------------

WORD_BITS, SHAPE_BITS = 17, 13
FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def shape_hashes(words: Words) -> np.ndarray:
    """Hash of each word's shape: letters, capitals, digits and single signs, runs counted once."""
    kind = _CLASS[words.bytes]
    kept = np.ones(len(kind), dtype=bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[words.start] = True
    place = np.cumsum(kept) - 1
    up, down = powers(len(kind) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(np.where(kept, _BYTE_VALUES[kind] * up[place], U64(0)))])
        return mix((total[words.end] - total[words.start]) * down[place[words.start]])


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first document, and (document, feature, value) of hashed words and word shapes, each kind of unit length."""
    for first, last in chunks(texts):
        words = Words(texts[first:last])
        word = (words.hash >> U64(64 - WORD_BITS)).astype(np.int64)
        shape = (shape_hashes(words) >> U64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
        again = np.zeros(len(shape), dtype=bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        shape[again] = FEATURES - 1  # a word said again at once has one shape of its own
        doc = np.concatenate([words.doc, words.doc])
        cell, count = np.unique(doc * FEATURES + np.concatenate([word, shape]), return_counts=True)
        doc, feature = cell // FEATURES, cell % FEATURES
        value = count.astype(np.float64)
        kind = doc * 2 + (feature >= 1 << WORD_BITS)
        length = np.sqrt(np.bincount(kind, value * value, minlength=2 * (last - first)))
        yield first, doc, feature, value / length[kind]


def sample_of(docs: DataFrame, labels: DataFrame, label: str, sample: int, where: str = "true", positive: float | None = None) -> DataFrame:
    """(id, text, label) of at most ``sample`` labelled rows, the same ones at every run.

    With ``positive``, that share of them is kept for labels over 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.expr(where)).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))

    def least(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("id"), "id").limit(n)

    if positive is None:
        known = least(known, sample)
    else:
        n = int(sample * positive)
        known = least(known.where("label > 0"), n).unionByName(least(known.where("label <= 0"), sample - n))
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(known, "id").select("id", "text", "label")


# --- cumulative-link regression ---------------------------------------------------


class CumulativeLink:
    """P(grade > k) = sigmoid(w.x - theta_k) with shared weights w and ordered thresholds theta."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> CumulativeLink:
        """AdaGrad over (features, values, grade) rows; thresholds are a first one plus positive steps."""
        grades = sorted({g for _, _, g in rows}) or [0]
        k = len(grades) - 1
        weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-3)
        theta, steps = 0.0, np.zeros(max(k - 1, 0))
        theta_sq, steps_sq = 1e-3, np.full(max(k - 1, 0), 1e-3)
        place = {g: i for i, g in enumerate(grades)}
        random = np.random.default_rng(seed)
        for _ in range(epochs if k else 0):
            for i in random.permutation(len(rows)):
                feature, value, grade = rows[i]
                y = place[grade]
                cuts = theta + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
                upper, lower = _tails(float(weights[feature] @ value), cuts)
                tail = np.concatenate([[1.0], upper, [0.0]])
                slope = np.concatenate([[0.0], upper * lower, [0.0]])
                likely = max(tail[y] - tail[y + 1], 1e-9)
                # d log P / d score and d log P / d cut
                score_slope = (slope[y] - slope[y + 1]) / likely
                cut_slope = np.zeros(k)
                if y > 0:
                    cut_slope[y - 1] -= slope[y] / likely
                if y < k:
                    cut_slope[y] += slope[y + 1] / likely
                g = -score_slope * value + l2 * weights[feature]
                squares[feature] += g * g
                weights[feature] -= rate * g / np.sqrt(squares[feature])
                g0 = -cut_slope.sum()
                theta_sq += g0 * g0
                theta -= 0.1 * g0 / np.sqrt(theta_sq)
                if k > 1:
                    gs = -np.array([cut_slope[j + 1 :].sum() for j in range(k - 1)]) * np.exp(steps)
                    steps_sq += gs * gs
                    steps -= 0.1 * gs / np.sqrt(steps_sq)
        return cls(grades, weights, theta + np.concatenate([[0.0], np.cumsum(np.exp(steps))])[:k])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and every k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _tails(score: float, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    upper = 1 / (1 + np.exp(np.clip(cuts - score, -60, 60)))
    return upper, 1 - upper


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000) -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows (a bound, whatever the size of the tables)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = texts_of(batch["text"]), []
            for first, doc, feature, value in features(texts):
                cut = np.searchsorted(doc, np.arange(len(texts) - first + 1))
                end = doc.max() + 1 if len(doc) else 0
                out += [(first + d, feature[cut[d] : cut[d + 1]].astype(np.int32).tobytes(), value[cut[d] : cut[d + 1]].astype(np.float32).tobytes()) for d in range(end)]
            ids, label_of = batch["id"].to_pylist(), batch["label"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in out], pa.int64()), pa.array([f for _, f, _ in out], pa.binary()), pa.array([v for _, _, v in out], pa.binary()), pa.array([label_of[d] for d, _, _ in out], pa.int32())], names=["id", "f", "v", "label"])

    rows = sample_of(docs, labels, label, sample).mapInArrow(run, "id long, f binary, v binary, label int").collect()
    rows.sort(key=lambda r: (r.id, r.f))
    return CumulativeLink.fit([(np.frombuffer(r.f, np.int32), np.frombuffer(r.v, np.float32).astype(float), r.label) for r in rows])


def score_quality(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade above the lowest), tails (of all), grade of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.grades, model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, weights, thresholds = sent.value
        own = CumulativeLink(grades, weights, thresholds)
        for batch in batches:
            texts = texts_of(batch["text"])
            score = np.zeros(len(texts))
            for first, doc, feature, value in features(texts):
                got = np.bincount(doc, weights[feature] * value)
                score[first : first + len(got)] = got
            tails = own.tails(score)
            expected = grades[0] + tails @ np.diff(np.array(grades, float))
            first_tail = tails[:, 0] if tails.shape[1] else np.ones(len(score))
            grade = np.array(grades)[(tails >= 0.5).sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tails.size + 1, max(tails.shape[1], 1))[: len(texts) + 1] if tails.shape[1] else np.zeros(len(texts) + 1), pa.int32()), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(expected, pa.float64()), pa.array(first_tail, pa.float64()), lists, pa.array(grade, pa.int32())], names=["doc_id", "expected_grade", "tail_probability", "tails", "grade"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, tails array<double>, grade int")


def select_quality(docs: DataFrame, model: CumulativeLink, least: float = 0.5) -> DataFrame:
    """The rows whose probability of more than the lowest grade is ``least`` or more, with their columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.grades, model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, weights, thresholds = sent.value
        own = CumulativeLink(grades, weights, thresholds)
        for batch in batches:
            texts = texts_of(batch["text"])
            score = np.zeros(len(texts))
            for first, doc, feature, value in features(texts):
                got = np.bincount(doc, weights[feature] * value)
                score[first : first + len(got)] = got
            tails = own.tails(score)
            yield batch.filter(pa.array(tails[:, 0] >= least if tails.shape[1] else np.ones(len(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


# --- subword bags -----------------------------------------------------------------

BUCKET_BITS = 18
#: Words of a window.
WINDOW = 4
#: Share of the positive class that training weighs rows to.
PRIOR = 0.25
#: Share of a positive window's subwords that a step leaves out, as a misspelling would: what is left must do.
DROPPED = 0.4


class SubwordBag:
    """Hashed words and character n-grams of 3 to 5 bytes, embedded, averaged, and put through a linear softmax.

    Words that were never seen still have the vectors of their n-grams.  Averages
    are over all subwords of ``WINDOW`` words in a row, at every place (a shorter text is one window); a text is as toxic as its worst window,
    so that a few words count in a long text too, wherever they begin.  Training starts on whole-text averages and then
    learns on the window that is worst so far, of positive ones without some of its subwords, so that no single one carries a word.
    """

    def __init__(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.vectors, self.softmax, self.bias = vectors, softmax, bias

    def buckets(self) -> np.ndarray:
        """What each bucket adds to the log-odds: the model is linear after training."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    @property
    def log_odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def subwords(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): the word itself and its n-grams with the edges < and > marked."""
    folded = _LOWER[words.bytes].copy()
    up, down = powers(len(folded) + 8)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE_VALUES[folded] * up[: len(folded)])])
        lengths = words.end - words.start
        owners, out = [np.arange(len(words.start))], [(words.hash >> U64(64 - BUCKET_BITS)).astype(np.int32)]
        for n in (3, 4, 5):
            counts = np.maximum(lengths - n + 1, 0)
            owner = np.repeat(np.arange(len(counts)), counts)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = words.start[owner] + offset
            edge = (offset == 0).astype(U64) + U64(2) * (offset == lengths[owner] - n).astype(U64)
            value = mix((total[at + n] - total[at]) * down[at] + U64(n) + (edge << U64(40)))
            owners.append(owner)
            out.append((value >> U64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(out)


def window_means(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Averages over ``WINDOW`` words from each place, of words with sums ``total`` over ``count`` subwords; one of all words if they are fewer."""
    size = min(WINDOW, len(total))
    sums, counts = (np.concatenate([[0.0], np.cumsum(x)]) for x in (total, count))
    return (sums[size:] - sums[:-size]) / (counts[size:] - counts[:-size])


def _window_scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Greatest window average of each text, without bias; 0 without words."""
    best = np.zeros(len(texts))
    for first, last in chunks(texts, 1 << 19):
        words = Words(texts[first:last])
        if not len(words.start):
            continue
        owner, bucket = subwords(words)
        total = np.bincount(owner, table[bucket], minlength=len(words.start))
        count = np.bincount(owner, minlength=len(words.start))
        means = window_means(total, count)
        # windows that lie in one text; those of shorter texts are made one by one
        whole = words.doc[: len(means)] == words.doc[len(words.doc) - len(means) :]
        top = np.full(last - first, -np.inf)
        np.maximum.at(top, words.doc[: len(means)][whole], means[whole])
        for doc in np.flatnonzero((words.per_doc > 0) & (words.per_doc < WINDOW)):
            a, b = words.first[doc], words.first[doc + 1]
            top[doc] = total[a:b].sum() / count[a:b].sum()
        best[first:last] = np.where(np.isfinite(top), top, 0)
    return best


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 4000, where: str = "true", dims: int = 8, epochs: int = 6, seed: int = 11) -> SubwordBag:
    """Train vectors and softmax together on at most ``sample`` labelled texts that satisfy ``where`` (over the columns of labels)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = []
            for text in texts_of(batch["text"]):
                words = Words([text])
                owner, bucket = subwords(words)
                order = np.argsort(owner, kind="stable")
                listed.append((bucket[order].tobytes(), np.bincount(owner, minlength=len(words.start)).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([b for b, _ in listed], pa.binary()), pa.array([c for _, c in listed], pa.binary()), batch["label"].cast(pa.int32())], names=["id", "b", "c", "label"])

    rows = sample_of(docs, labels, label, sample, where, 0.4).mapInArrow(run, "id long, b binary, c binary, label int").collect()
    rows.sort(key=lambda r: (r.id, r.b))
    return train_bag([(np.frombuffer(r.b, np.int32), np.frombuffer(r.c, np.int32), int(r.label > 0)) for r in rows], dims, epochs, seed)


def train_bag(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int = 8, epochs: int = 6, seed: int = 11, rate: float = 0.3, least_rows: int = 3) -> SubwordBag:
    """AdaGrad on (buckets by word, subwords of each word, class) rows.

    Buckets of fewer than ``least_rows`` rows would only learn these rows by heart: they stay zero, as do those never seen.
    """
    random = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    softmax, bias = random.normal(0, 0.5, (dims, 2)), np.zeros(2)
    share = np.mean([y for _, _, y in rows]) if rows else 0.5
    if not rows or share in (0.0, 1.0):
        bias[1] = 0 if not rows else (8 if share else -8)
        return SubwordBag(np.zeros((size, dims), np.float32), softmax, bias)
    spread = np.zeros(size, np.int64)
    for bucket, _, _ in rows:
        spread[np.unique(bucket)] += 1
    kept = spread >= least_rows
    vectors = (random.uniform(-0.5, 0.5, (size, dims)) / dims * kept[:, None]).astype(np.float32)
    vector_sq = np.full(size, 1e-4, np.float32)
    softmax_sq, bias_sq = np.full((dims, 2), 1e-2), np.full(2, 1e-2)
    weight = ((1 - PRIOR) / (1 - share), PRIOR / share)
    for epoch in range(epochs):
        for i in random.permutation(len(rows)):
            bucket, counts, y = rows[i]
            if not len(bucket):
                continue
            if epoch >= 2 and len(counts) > WINDOW:
                edges = np.concatenate([[0], np.cumsum(counts)])
                odds = np.add.reduceat(vectors[bucket] @ (softmax[:, 1] - softmax[:, 0]), edges[:-1])
                k = int(np.argmax(window_means(odds, counts)))
                bucket = bucket[edges[k] : edges[k + WINDOW]]
            all_of = len(bucket)
            bucket = bucket[kept[bucket]]
            if epoch >= 2 and y:
                bucket = bucket[random.random(len(bucket)) >= DROPPED]
            mean = vectors[bucket].sum(axis=0) / all_of
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            g = p.copy()
            g[y] -= 1
            g *= weight[y]
            into = softmax @ g
            gs = np.outer(mean, g)
            softmax_sq += gs * gs
            softmax -= rate * gs / np.sqrt(softmax_sq)
            bias_sq += g * g
            bias -= rate * g / np.sqrt(bias_sq)
            kinds, times = np.unique(bucket, return_counts=True)
            gv = (times / all_of)[:, None] * into[None, :]
            vector_sq[kinds] += (gv * gv).sum(axis=1)
            vectors[kinds] -= (rate * gv / np.sqrt(vector_sq[kinds])[:, None]).astype(np.float32)
    return SubwordBag(vectors, softmax, bias)


def score_toxicity(docs: DataFrame, model: SubwordBag) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.buckets(), model.log_odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(_window_scores(texts_of(batch["text"]), table) + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
