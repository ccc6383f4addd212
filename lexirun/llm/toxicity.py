"""Toxicity by a classifier chain: linear models in sequence, each fed with the probabilities of those before it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_where, slices
from .shingles import distinct, hashes_of

#: Labelled rows that the models are fitted on at most: those whose ids hash lowest. This bounds what the driver holds.
TRAIN_ROWS = 6000
FOLDS = 5
#: Words that a model looks at most, and what their association with the category must reach (chi-squared, one degree), in LEAST_ROWS rows.
WORDS, ASSOCIATION = 400, 12.0
LEAST_ROWS = 3
PENALTY, ROUNDS, THRESHOLD = 0.5, 25, 0.5
#: The chain: categories in order, and how the label table spells them.
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic"}

NUMBERS = 6
#: Bytes of the word beginnings that are features too: they catch inflected forms.
PREFIXES = (4, 5, 6, 7)
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 32-bit hashes of words and word beginnings, and NUMBERS numbers.

    Words are runs of ASCII letters, A-Z lower-cased, apostrophes and all that is not ASCII.
    """
    data = (text or "").encode("utf-8", "replace")
    words = data.translate(_LETTERS).split()
    n = len(data)
    once = set(words)
    tokens = once | {w[:size] + b"*" for size in PREFIXES for w in once if len(w) > size}
    found = distinct((hashes_of(tokens) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    upper, symbols, digits = (n - len(data.translate(None, drop)) for drop in (_UPPER, _SYMBOLS, b"0123456789"))
    size = max(n, 1)
    numbers = np.array([np.log1p(len(words)), upper / size, symbols / size, digits / size, len(once) / max(len(words), 1), n / max(len(words), 1) / 10], np.float64)
    return found, np.minimum(numbers, 20)


@dataclass
class Linear:
    """Logistic regression on presence of words, numbers, and earlier probabilities."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def matrix(self, rows: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 + len(self.words) + NUMBERS + earlier.shape[1]))
        x[:, 0] = 1
        for k, (words, _) in enumerate(rows):
            if len(self.words) and len(words):
                at = np.searchsorted(self.words, words)
                at[at == len(self.words)] = 0
                x[k, 1 + at[self.words[at] == words]] = 1
        dense = np.hstack([np.array([r[1] for r in rows]).reshape(len(rows), NUMBERS), earlier])
        x[:, 1 + len(self.words) :] = (dense - self.mean) / self.scale
        return x

    def predict(self, rows: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(self.matrix(rows, earlier) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _telling(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """The words whose presence is most associated with y, sorted by hash."""
    every = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint32)
    words, place = np.unique(every, return_inverse=True)
    has = np.repeat(y, [len(r[0]) for r in rows])
    total, a = np.bincount(place, minlength=len(words)).astype(float), np.bincount(place, has, minlength=len(words))
    n, pos = len(y), y.sum()
    expected = total * pos / max(n, 1)
    chi = (a - expected) ** 2 * n * n / np.maximum(1e-9, total * pos * (n - total) * (n - pos) / max(n, 1))
    chi[total < LEAST_ROWS] = 0
    best = np.lexsort((words, -chi))[:WORDS]
    return np.sort(words[best[chi[best] >= ASSOCIATION]])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, earlier: np.ndarray) -> Linear:
    """Penalised maximum likelihood by Newton's method; without rows of both classes, the smoothed share of y for all."""
    dense = np.hstack([np.array([r[1] for r in rows]).reshape(len(rows), NUMBERS), earlier])
    mean, scale = (dense.mean(0), dense.std(0) + 1e-6) if len(rows) else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    model = Linear(_telling(rows, y), mean, scale, np.zeros(0))
    x = model.matrix(rows, earlier)
    model.weights = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
    model.weights[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        ridge = np.full(x.shape[1], PENALTY)
        ridge[0] = 1e-3
        for _ in range(ROUNDS):
            p = _sigmoid(x @ model.weights)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * model.weights)
            model.weights += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-4:
                break
    return model


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model for each column of labels (0, 1 or NaN for not known).

    A later model learns from the probabilities that models fitted without a row's fold give that row, so it
    trusts them as far as they can be trusted on unseen text.
    """
    chain, earlier = [], np.zeros((len(rows), 0))
    words, times = np.unique(np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint32), return_counts=True)
    frequent = words[times >= LEAST_ROWS]
    rows = [(np.intersect1d(w, frequent, assume_unique=True), x) for w, x in rows]
    for y in labels.T:
        known = np.flatnonzero(~np.isnan(y))

        def fitted(at, y=y, earlier=earlier):
            return fit([rows[i] for i in at], y[at], earlier[at])

        chain.append(fitted(known))
        if len(chain) == labels.shape[1]:
            break  # nothing learns from the last one's probabilities
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            mine = np.flatnonzero(folds == k)
            if len(mine):
                out[mine] = fitted(known[folds[known] != k]).predict([rows[i] for i in mine], earlier[mine])
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def predict_chain(chain: list[Linear], rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    earlier = np.zeros((len(rows), 0))
    for model in chain:
        earlier = np.hstack([earlier, model.predict(rows, earlier)[:, None]])
    return earlier


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    """The chain CHAIN, fitted on at most train_rows labelled documents (lowest hash of the id; of rows with one id any one)."""
    wanted = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.expr(c).cast("double")).alias(k) for k, c in CHAIN.items()])
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", *CHAIN)
    kind = raw.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for b in slices(batches):
            got = [features(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), pa.array([w.tobytes() for w, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "words", "numbers", *CHAIN])

    got = raw.mapInArrow(read, f"doc_id {kind}, words binary, numbers binary, " + ", ".join(f"{c} double" for c in CHAIN)).toPandas()
    got = got.drop_duplicates("doc_id").sort_values("doc_id").reset_index(drop=True)
    rows = [(np.frombuffer(w, np.uint32), np.frombuffer(x)) for w, x in zip(got["words"], got["numbers"], strict=True)]
    folds = (pd.util.hash_array(got["doc_id"].to_numpy(), categorize=False) % FOLDS).astype(int) if len(got) else np.zeros(0, int)
    return fit_chain(rows, got[list(CHAIN)].to_numpy(float).reshape(len(got), len(CHAIN)), folds)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, p_<category> for each of CHAIN, and toxic (p_toxic of THRESHOLD at least).

    The chain is fitted on the labelled rows of docs, see train. A null text is empty. Without labels of both
    kinds a category's probability is one small or smoothed share for all. Texts of any length are read whole. Ids may
    be null or come twice; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows, id_col, text_col))
    names = [f"p_{c}" for c in CHAIN]

    def scored(batches):
        for b in slices(batches, 256):
            p = predict_chain(chain.value, [features(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in p.T], pa.array(p[:, -1] >= THRESHOLD)], names=["doc_id", *names, "toxic"])

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(scored, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that score finds toxic, each judged by its own text.

    Rows that share an id, or have none, don't share a fate; a null text is empty and judged like any other; columns
    may have any names; an empty table gives an empty one.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return keep_where(docs, "text", lambda: lambda text: predict_chain(chain.value, [features(text)])[0, -1] < THRESHOLD)
