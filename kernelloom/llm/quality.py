"""Document quality from random-indexing word vectors and a two-layer network.

Random indexing: each word has a sparse ternary index vector drawn from its hash, and its context
vector is the sum of the index vectors of the words around it, over all documents.  Words share
``SLOTS`` hashed rows, so the two tables have a fixed size.  A document's vector pools its
words' index and context vectors (mean), the context vectors' spread, and a few moments.  Each word
counts twice: by its letters, and by its shape (capitals, digits, marks, repeats of one character).

The network (one hidden layer, logistic output) is fitted in numpy on a bounded sample of labelled
rows, and a temperature fitted on rows left out of its training calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import small_batches
from kernelloom.llm.words import blocks, chunks, mix, spans, utf8, word_hashes

SLOTS, DIM, ONES, WINDOW = 1 << 14, 48, 4, 2
_LETTER = np.zeros(256, np.uint8)
for _a, _b, _kind in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 255, 4)):
    _LETTER[_a : _b + 1] = _kind
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def index_table(seed: int = 7) -> np.ndarray:
    """Sparse ternary index vectors: ``ONES`` entries of +1 and as many of -1 in ``DIM``."""
    rng = np.random.default_rng(seed)
    at = rng.random((SLOTS, DIM)).argsort(1)
    table = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(table, at[:, :ONES], 1, 1)
    np.put_along_axis(table, at[:, ONES : 2 * ONES], -1, 1)
    return table / np.float32(np.sqrt(2 * ONES))


def _letter_slots(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (mix(word_hashes(_LOWER[buf], starts, ends)) & np.uint64(SLOTS // 2 - 1)).astype(np.int32)


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word's shape: of each kind of character none, one, some or all, and the last byte."""
    lo = int(starts[0])
    kinds, edges = _LETTER[buf[lo : int(ends[-1])]], np.stack([starts, ends], 1).ravel()[:-1] - lo
    size, last = ends - starts, buf[ends - 1].astype(np.uint64)
    shape = np.zeros(len(starts), np.uint64)
    for k in range(5):
        n = np.add.reduceat(kinds == k, edges, dtype=np.int32)[0::2]
        part = np.where(n == 0, 0, np.where(n == 1, 1, np.where(n < size, 2, 3)))
        shape = shape * np.uint64(4) + part.astype(np.uint64)
    # the last byte tells marks apart; a letter there says nothing more
    return shape * np.uint64(257) + np.where(_LETTER[buf[ends - 1]] == 0, last, np.uint64(256))


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot by letters, slot by shape, first word of each text and the end)."""
    buf, starts, ends, first = spans(texts)
    letters, shape = _letter_slots(buf, starts, ends), np.empty(len(starts), np.int32)
    for i, j in blocks(starts, ends):
        # whether the word is the same again
        again = np.zeros(j - i, np.uint64)
        again[1:] = letters[i + 1 : j] == letters[i : j - 1]
        again[0] = i > 0 and letters[i] == letters[i - 1]
        shape[i:j] = mix(_shapes(buf, starts[i:j], ends[i:j]) * np.uint64(2) + again) & np.uint64(SLOTS // 2 - 1)
    return letters, shape + SLOTS // 2, first


def context_sums(texts: list, signs: np.ndarray) -> np.ndarray:
    """Sums of the index vectors' signs within ``WINDOW`` words, by letters' slot, over the texts.

    Whole numbers, so that sums don't depend on their order.
    """
    total = np.zeros((SLOTS // 2, DIM), np.int64)
    for a, b in chunks(texts):
        buf, starts, ends, first = spans([utf8(t) for t in texts[a:b]])
        all_letters, all_docs = _letter_slots(buf, starts, ends), np.repeat(np.arange(b - a), np.diff(first))
        for i, j in blocks(starts, ends):
            # the words on both sides of the block serve as neighbours only
            lo, hi = max(0, i - WINDOW), min(len(starts), j + WINDOW)
            letters, doc = all_letters[lo:hi], all_docs[lo:hi]
            own, near = signs[letters], np.zeros((len(letters), DIM), np.int8)
            for step in range(1, WINDOW + 1):
                same = (doc[step:] == doc[:-step]).astype(np.int8)[:, None]
                near[step:] += own[:-step] * same
                near[:-step] += own[step:] * same
            # sums by slot through sorting: np.add.at is far slower
            key, near = letters[i - lo : j - lo].astype(np.uint16), near[i - lo : j - lo]
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(np.diff(key.astype(np.int32), prepend=-1))
            total[key[cut]] += np.add.reduceat(near[order], cut, axis=0, dtype=np.int32)
    return total


FEATURES = 3 * DIM + 5


def _sums(table: np.ndarray, slots: np.ndarray, first: np.ndarray, size: int = 1 << 14) -> np.ndarray:
    """Sums of the table's rows over each text's words; texts without words have zeros."""
    out = np.zeros((len(first) - 1, DIM))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for i in range(0, len(slots), size):
        own = text[i : i + size]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[cut]] += np.add.reduceat(table[slots[i : i + size]], cut, axis=0)
    return out


def pool(texts: list, index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): means of index and context vectors, and moments; zeros for no words."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for a, b in chunks(texts):
        raw = [utf8(t) for t in texts[a:b]]
        letters, shape, first = word_slots(raw)
        n = np.diff(first)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        count = n[some]
        means = [_sums(table, slots, first)[some] / count[:, None] for table, slots in ((index, letters), (context, letters), (index, shape))]
        text = np.repeat(np.arange(len(n)), n)
        distinct = np.bincount(np.unique(text * SLOTS + letters) // SLOTS, minlength=len(n))[some]
        same = (letters[1:] == letters[:-1]) & (text[1:] == text[:-1])
        again = np.bincount(text[1:][same], minlength=len(n))[some]
        size = np.array([len(raw[i]) for i in some])
        moments = np.stack([np.log1p(count) / 5, size / count / 10, distinct / count, again / count, np.sqrt((means[0] ** 2).sum(1))], axis=1)
        out[a + some] = np.concatenate([*means, moments], axis=1)
    return out


@dataclass
class Model:
    index: np.ndarray
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, texts: list) -> np.ndarray:
        z = self.logits(pool(texts, self.index, self.context).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> tuple:
    """Adam on the logistic loss; returns (mean, scale, w1, b1, w2, b2)."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 128):
            own = order[i : i + 128]
            h = np.maximum(z[own] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -35, 35))) - y[own]) / len(own)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [z[own].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, p[0], p[1], p[2], float(p[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    a, b, g = -1.5, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def context_table(texts: DataFrame, index: np.ndarray) -> np.ndarray:
    """Context vectors of unit length, by slot, over all rows of ``texts`` (text).

    A task sends one table of a fixed size, summed by slot; the driver gets one such table.  A slot
    seen nowhere keeps its index vector, as do the shapes', whose context nothing reads.
    """
    signs = np.sign(index).astype(np.int8)
    names = [f"c{i}" for i in range(DIM)]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SLOTS // 2, DIM), np.int64)
        for p in parts:
            total += context_sums(p["text"].tolist(), signs)
        seen = np.flatnonzero(total.any(1))
        out = pd.DataFrame(total[seen], columns=names)
        out.insert(0, "slot", seen)
        yield out

    by_slot = texts.mapInPandas(sums, "slot long, " + ", ".join(f"{n} long" for n in names)).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])
    table = by_slot.toPandas()
    context = np.zeros((SLOTS, DIM))
    context[table["slot"].to_numpy(np.int64)] = table[names].to_numpy(np.float64)
    norm = np.sqrt((context**2).sum(1, keepdims=True))
    return np.where(norm > 0, context / np.maximum(norm, 1e-9), index).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> Model:
    """A model from at most ``sample`` labelled rows that satisfy ``train``, those of the smallest hash.

    Of them, every fifth calibrates the temperature; the others train the network.  Context vectors need
    no labels and are summed over all of ``docs``.
    Rows without id, or whose label isn't 0 or 1, are left out; of several labels of one id the smallest
    counts, and of several texts the least.  Without rows of both labels the model gives their share, 0.5
    without any.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & train).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    index = index_table()

    small_batches(docs.sparkSession)
    context = context_table(texts.select("text"), index)
    rows = rows.repartition(8, "doc_id").persist()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))

    def featurise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "y": p["y"], "x": list(pool(p["text"].tolist(), index, context))})

    table = rows.mapInPandas(featurise, "doc_id long, y int, x array<float>").withColumn("part", part).orderBy("doc_id").toPandas()
    rows.unpersist()
    y = table["y"].to_numpy(np.float64) if len(table) else np.zeros(0)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        flat = np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)) if len(y) else 0.0
        return Model(index, context, np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(flat), 1.0)
    x = np.array(table["x"].tolist(), np.float64)
    held = (table["part"] == 0).to_numpy()
    if len(set(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    net = fit_network(x[~held], y[~held])
    model = Model(index, context, *net, 1.0)
    if held.any():
        model.temperature = fit_temperature(model.logits(x[held]), y[held])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with one more column, ``out``: 0 to 1, for null and empty texts too.

    Whole texts count, however long.  A column of that name is replaced; repeated rows repeat; an empty
    table stays empty.
    """
    small_batches(docs.sparkSession)
    # tables of a fixed size
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.scores(texts.tolist()))

    return docs.withColumn(out, scores(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id's decimal text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
