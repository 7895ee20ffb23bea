"""Toxicity by a classifier chain.

Categories are predicted one after another. The model of a category is a sparse logistic
regression (L1) on the words a text has and on the probabilities of all earlier categories. It is
trained with out-of-fold probabilities of those: each labelled row's comes from a model that has
not seen the row, so a later model learns how far the earlier ones can be trusted on new text.
For scoring, every category has a model fitted on all training rows.

Training uses at most ``max_rows`` labelled rows, those with the smallest hash of their id;
their hashed words come to the driver, where the models are fitted. All documents are scored,
whole texts, in Arrow batches with the non-zero weights; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain as chain_lists

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels in the order of the chain: (name, condition on the labels table).
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
FEATURES = 1 << 20
#: Lengths in bytes of the beginnings of words that are features.
PREFIXES = (4, 5, 6)
#: Lower case for A-Z; other ASCII but letters parts words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)


class WordIds(dict):
    """Feature numbers of a word, remembered: its own and those of its beginnings, which
    inflected and joined forms share."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:  # memory is bounded whatever the vocabulary
            self.clear()
        parts = [word, *(word[:k] + b"*" for k in PREFIXES if len(word) >= k)]
        found = self[word] = tuple(xxhash.xxh64_intdigest(x) % FEATURES for x in parts)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """Features of a text: each different one once; none for null."""
        words = set((text or b"").translate(LETTERS).split())
        ids = chain_lists.from_iterable(map(self.__getitem__, words))
        return np.unique(np.fromiter(ids, np.int32))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Link:
    """A fitted category: weights of words, of earlier probabilities, and the constant."""

    name: str
    words: np.ndarray | dict[int, float]
    earlier: np.ndarray
    constant: float

    def probability(self, word_sum, earlier):
        return sigmoid(word_sum + np.asarray(earlier, float) @ self.earlier + self.constant)


@dataclass(frozen=True)
class Rows:
    """Texts as features: ``ids`` one after another, ``sizes`` of each, labels, folds."""

    ids: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    folds: np.ndarray
    features: int = FEATURES

    def where(self, mask: np.ndarray) -> Rows:
        ids = self.ids[np.repeat(mask, self.sizes)]
        return Rows(ids, self.sizes[mask], self.labels[mask], self.folds[mask], self.features)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        so_far = weights[self.ids]
        np.cumsum(so_far, out=so_far)
        ends = np.cumsum(self.sizes)
        whole = np.where(ends > 0, so_far[ends - 1] if len(so_far) else 0.0, 0.0)
        return np.diff(whole, prepend=0.0)


def fit(name: str, rows: Rows, y: np.ndarray, earlier: np.ndarray, penalty: float, steps: int) -> Link:
    """Logistic regression with an L1 penalty on words, by accelerated proximal gradients.

    Steps are scaled per weight by a diagonal bound of the curvature. Without rows, or with one
    label value, there is only a constant (probability 0 without rows)."""
    n, m = len(y), earlier.shape[1]
    none = np.zeros(rows.features)
    if not n or y.min() == y.max():
        return Link(name, none, np.zeros(m), 40.0 if n and y[0] else -40.0)
    dense = np.hstack([earlier, np.ones((n, 1))])
    load = rows.sizes + dense.sum(axis=1)
    bound_w = np.bincount(rows.ids, np.repeat(load, rows.sizes), rows.features) / (4 * n) + 1e-12
    bound_d = (dense * load[:, None]).sum(axis=0) / (4 * n) + 1e-12
    w, d = none.copy(), np.zeros(m + 1)
    d[-1] = np.log(y.mean() / (1 - y.mean()))
    w_ahead, d_ahead, pace = w, d, 1.0
    for _ in range(steps):
        miss = (sigmoid(rows.sums(w_ahead) + dense @ d_ahead) - y) / n
        step = w_ahead - np.bincount(rows.ids, np.repeat(miss, rows.sizes), rows.features) / bound_w
        w_next = np.sign(step) * np.maximum(np.abs(step) - penalty / bound_w, 0)
        d_next = d_ahead - dense.T @ miss / bound_d
        pace_next = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / pace_next
        w_ahead, d_ahead = w_next + momentum * (w_next - w), d_next + momentum * (d_next - d)
        w, d, pace = w_next, d_next, pace_next
    return Link(name, w, d[:-1], float(d[-1]))


def train_chain(rows: Rows, names: Sequence[str], folds: int, penalty: float, steps: int) -> list[Link]:
    chain, earlier = [], np.zeros((len(rows.sizes), 0))
    for i, name in enumerate(names):
        y = rows.labels[:, i]
        chain.append(fit(name, rows, y, earlier, penalty, steps))
        if i == len(names) - 1:
            break
        unseen = np.zeros(len(y))
        for k in range(folds):
            out = rows.folds == k
            if out.any():
                model = fit(name, rows.where(~out), y[~out], earlier[~out], penalty, steps)
                unseen[out] = model.probability(rows.where(out).sums(model.words), earlier[out])
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def training_rows(
    docs: DataFrame, labels: DataFrame, chain: Sequence[tuple[str, str]], max_rows: int, folds: int
) -> Rows:
    names = [n for n, _ in chain]
    chosen = (
        labels.select(
            F.col("doc_id").cast("long"), *(F.expr(f"CAST({c} AS INT)").alias(n) for n, c in chain)
        )
        .dropna()
        .withColumn("_order", F.xxhash64("doc_id"))
        .orderBy("_order", "doc_id", *names)
        .limit(max_rows)
    )
    # at most max_rows rows of a few numbers
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds()
        for batch in batches:
            texts = batch.column(1)
            ids = [word_ids.of(texts[i].as_py()) for i in range(len(texts))]
            arrays = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                arrays + [batch.column(2 + k) for k in range(len(names))], ["doc_id", "ids", *names]
            )

    listed = ", ".join(f"{n} int" for n in names)
    got = rows.mapInArrow(run, f"doc_id long, ids array<int>, {listed}").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    ids = [np.asarray(x, np.int32) for x in got["ids"]]
    return Rows(
        np.concatenate([np.zeros(0, np.int32), *ids]),
        np.array([len(x) for x in ids], np.int64),
        got[names].to_numpy(float).reshape(-1, len(names)),
        np.array([xxhash.xxh64_intdigest(str(x)) % folds for x in got["doc_id"]], int),
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    chain: Sequence[tuple[str, str]] = CHAIN,
    max_rows: int = 5_000,
    folds: int = 3,
    penalty: float = 2e-4,
    steps: int = 120,
) -> list[Link]:
    """Fit the chain on labelled documents.

    Rows of ``labels`` with a null id or a null label in the chain are left out; of rows that
    repeat an id, and of documents that do, all combinations train (so that documents with
    repeated ids can exceed ``max_rows``, which bounds the labels).
    """
    rows = training_rows(docs, labels, chain, max_rows, folds)
    # the slope of a weight is at most its feature's share of rows: at the penalty or below,
    # also among the rows of a fold's model, it stays 0
    least = penalty * len(rows.sizes) * (folds - 1) / folds
    used = np.flatnonzero(np.bincount(rows.ids, minlength=FEATURES) > least)
    slot = np.full(FEATURES, -1, np.int32)
    slot[used] = np.arange(len(used))
    ids = slot[rows.ids]
    stays = ids >= 0
    passed = np.concatenate([[0], np.cumsum(stays)])
    sizes = np.diff(passed[np.concatenate([[0], np.cumsum(rows.sizes)])])
    # indices of the native width, which numpy would otherwise copy to at every step
    small = Rows(ids[stays].astype(np.intp), sizes, rows.labels, rows.folds, len(used))
    del ids, stays, passed
    models = train_chain(small, [n for n, _ in chain], folds, penalty, steps)
    return [Link(m.name, dict(zip(used.tolist(), m.words)), m.earlier, m.constant) for m in models]


def score(docs: DataFrame, model: Sequence[Link], threshold: float = 0.25) -> DataFrame:
    """``docs`` with p_<category> of each category and ``rejected``: the last category's
    probability is ``threshold`` or more. Columns of ``docs`` of these names are replaced.

    Null, empty and wordless texts get the probability of no words at all.
    """
    added = [*(f"p_{x.name}" for x in model), "rejected"]
    carried = [c for c in docs.columns if c not in added]
    position = carried.index("text")
    used = sorted({i for x in model for i, w in x.words.items() if w})
    slot = np.zeros(FEATURES, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    weights = np.array([[0.0, *(x.words.get(i, 0.0) for i in used)] for x in model])
    tails = [Link(x.name, np.zeros(0), x.earlier, x.constant) for x in model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = WordIds()
        for batch in batches:
            texts = batch.column(position)
            sums = np.zeros((len(tails), len(texts)))
            for i in range(len(texts)):
                text = texts[i].as_py()
                found = slot[word_ids.of(text.encode() if isinstance(text, str) else text)]
                sums[:, i] = weights[:, found].sum(axis=1)
            p = np.zeros((len(texts), 0))
            for k, link in enumerate(tails):
                p = np.hstack([p, link.probability(sums[k], p)[:, None]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= threshold)],
                [*carried, *added],
            )

    base = docs.select(*(F.col(f"`{c}`") for c in carried))
    fields = [T.StructField(c, T.DoubleType()) for c in added[:-1]]
    schema = T.StructType([*base.schema.fields, *fields, T.StructField("rejected", T.BooleanType())])
    return base.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, toxic."""
    model = train(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", *(f"p_{x.name}" for x in model), F.col("rejected").alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, unchanged."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    scored = score(packed, train(docs, labels, **options))
    return scored.where(~F.col("rejected")).select("doc.*")
