"""A quality classifier of supervised subword embeddings, trained by numpy stochastic gradient descent.

A word's vector is the mean of rows of one hashed table: the word's own row and those of its character n-grams (with word-boundary marks). A
word n-gram (of two words, up to ``Settings.word_ngrams``) has a hashed row of its own, and so has the return of a word after 1, 2, 3 to 4, 5 to 8, ... words, whatever the word.
A document's vector is the mean of the vectors of all its words, word n-grams and returns; a linear layer with softmax gives the class probabilities. Table and layer are learnt together on the driver from a bounded number of labelled documents, each of them whole, which tasks have made into rows and shares: at most ``Settings.rows`` of each, deflated, and opened one document at a time;
every document of the corpus is scored whole.

Because the output is linear in the mean, each distinct word contributes a fixed number: workers keep it, and the word's hash, in a bounded cache of the
last model they scored with; word n-grams are hashed from their words' hashes a whole text at a time.

Defined results: a null or empty text has no words and scores from the bias alone; a null label or a label without a document teaches
nothing; with no teaching rows at all, or rows of one class, every score is 0.5 or tends to that class; repeated rows score alike; labels, lang, source and ids are never
inputs of a score; an input column of the score's name is replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and runs of marks, so that marks glued to a word are features of their own.
_WORD = re.compile(r"\w+|[^\w\s]+")
#: Words kept per worker.
CACHE_WORDS = 450_000
#: Characters of a word whose n-grams are told apart at a time, and rows of the table looked up at a time.
WORD_PIECE, ROWS_AT_ONCE = 4096, 1 << 20


@dataclass(frozen=True)
class Settings:
    """Bound of the sample and the model's sizes."""

    sample_rows: int = 6000
    dim: int = 8
    rows: int = 1 << 16
    min_n: int = 3
    max_n: int = 3
    word_ngrams: int = 3
    epochs: int = 4
    rate: float = 1.0
    seed: int = 7


#: Odd multipliers of the word n-grams' hashes, by the word's place.
_TIMES = np.random.default_rng(3).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def features(word: str, s: Settings) -> list[int] | np.ndarray:
    """Rows of the table: the word and its character n-grams, each once in every WORD_PIECE places of the word."""
    own = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % s.rows]
    marked = f"<{word}>"
    if len(marked) <= WORD_PIECE:
        return own + _grams(marked, len(marked), s)
    return np.concatenate([np.array(x, np.int64) for x in (own, *(_grams(marked[at : at + WORD_PIECE + s.max_n - 1], WORD_PIECE, s) for at in range(0, len(marked), WORD_PIECE)))])


def _grams(piece: str, places: int, s: Settings) -> list[int]:
    """Rows of the n-grams that begin at the first places of a piece."""
    raw = piece.encode("utf-32-le", "surrogatepass")
    grams = {raw[i : i + 4 * n] for n in range(s.min_n, s.max_n + 1) for i in range(0, min(4 * places, len(raw) - 4 * n + 1), 4)}
    return sorted([zlib.crc32(g, 1) % s.rows for g in grams])


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), 2)


def ngram_rows(hashes: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Of each length the rows of the word n-grams at all places of a text, from its words' hashes (uint64)."""
    h = hashes * _TIMES[0]
    for n in range(2, s.word_ngrams + 1):
        if len(hashes) < n:
            return
        h = h[:-1] + hashes[n - 1 :] * _TIMES[n - 1]
        yield ((h ^ h >> np.uint64(29)) * _TIMES[-1] >> np.uint64(32)).astype(np.int64) % s.rows


def return_rows(place: np.ndarray, s: Settings) -> np.ndarray:
    """The rows of the returns in a text, from a number for each word that tells which word it is; by powers of two of the distance."""
    order = np.argsort(place, kind="stable")
    apart = np.diff(order)[np.diff(place[order]) == 0]
    return _RETURNS[np.ceil(np.log2(apart)).astype(np.int64)] % s.rows


#: By powers of two; no word holds a blank.
_RETURNS = np.array([zlib.crc32(f"again after {k}".encode(), 3) for k in range(64)], np.int64)


def bag(text: str | None, s: Settings, rows_of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, shares) of a whole text, each row once: its vector is shares @ table[rows]."""
    own = words(text)
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    times = Counter(own)
    for w in times:
        if w not in rows_of:
            rows_of[w] = np.array(features(w, s), np.int64)
    hashes = np.fromiter(map(word_hash, own), np.uint64, len(own))
    grams = [*ngram_rows(hashes, s), return_rows(hashes, s)]
    rows = [rows_of[w] for w in times]
    share = [np.full(len(r), c / len(r)) for r, c in zip(rows, times.values())] + [np.ones(len(g)) for g in grams]
    rows, share = np.concatenate([*rows, *grams]), np.concatenate(share)
    rows, at = np.unique(rows, return_inverse=True)
    return rows.astype(np.min_scalar_type(s.rows - 1)), (np.bincount(at, share) / (len(own) + sum(map(len, grams)))).astype(np.float32)


def packed(rows: np.ndarray, share: np.ndarray) -> bytes:
    """A bag as bytes, deflated: steps between its ascending rows, and of each share its place among the distinct ones. At most Settings.rows of each."""
    distinct, at = np.unique(share, return_inverse=True)
    return zlib.compress(np.array([len(rows), len(distinct)], np.uint32).tobytes() + np.diff(rows, prepend=rows[:1] * 0).astype(np.uint32).tobytes() + at.astype(np.uint32).tobytes() + distinct.astype(np.float32).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n, k = np.frombuffer(raw, np.uint32, 2)
    steps, at = np.frombuffer(raw, np.uint32, 2 * n, 8).reshape(2, n)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(raw, np.float32, k, 8 + 8 * int(n))[at]


class Bags:
    """Bags kept deflated; each is opened when it is asked for."""

    def __init__(self, data: pa.ChunkedArray):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return unpacked(self.data[int(i)].as_py())


class Model:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s, self.table = s, rng.uniform(-1 / s.dim, 1 / s.dim, (s.rows, s.dim)).astype(np.float32)
        self.weight, self.bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)

    def bag(self, text: str | None, rows_of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return bag(text, self.s, rows_of)

    def fit(self, texts: Sequence[str | None], labels: Sequence[int]) -> Model:
        rows_of: dict[str, np.ndarray] = {}
        return self.fit_bags([self.bag(t, rows_of) for t in texts], labels)

    def fit_bags(self, docs: Sequence[tuple[np.ndarray, np.ndarray]] | Bags, labels: Sequence[int]) -> Model:
        """SGD, a whole document a step, the rate falling to zero. A step is divided by the length of the document's shares, so that long texts teach as much as short ones."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        if not len(docs):
            return self
        y = np.asarray(labels)
        self.bias[:] = np.log((np.bincount(y, minlength=2) + 1) / (len(y) + 2))
        steps, step = s.epochs * len(docs), 0
        for _ in range(s.epochs):
            for i in rng.permutation(len(docs)):
                rate = s.rate * (1 - step / steps)
                step += 1
                rows, share = docs[i]
                if not len(rows):
                    continue
                x = share @ self.table[rows]
                p = self._softmax(x @ self.weight + self.bias)
                p[y[i]] -= 1
                back = self.weight @ p
                self.weight -= rate * np.outer(x, p)
                self.bias -= rate * 0.1 * p
                self.table[rows] -= (rate / np.linalg.norm(share)) * share[:, None] * back[None, :]
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def scorer(self) -> Scorer:
        return Scorer(self.table @ (self.weight[:, 1] - self.weight[:, 0]), float(self.bias[1] - self.bias[0]), self.s)


class Scorer:
    """The model with the layer multiplied into the table: a number for each row."""

    def __init__(self, logits: np.ndarray, bias: float, s: Settings):
        self.logits, self.bias, self.s = logits, bias, s

    def __call__(self, text: str | None, known: Known | None = None) -> float:
        known, own = known or Known(), words(text)
        if not own:
            return float(1 / (1 + np.exp(-self.bias)))
        place = known.places(own, self)
        hashes = known.hash[place]
        rows = np.concatenate([*ngram_rows(hashes, self.s), return_rows(hashes, self.s)])
        total = known.logit[place].sum() + self.logits[rows].sum(dtype=np.float64)
        return float(1 / (1 + np.exp(-self.bias - total / (len(own) + len(rows)))))


class Known:
    """The logits and hashes of at most CACHE_WORDS words of one model."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.logit, self.hash = np.zeros(1 << 12), np.zeros(1 << 12, np.uint64)

    def places(self, part: list[str], model: Scorer) -> np.ndarray:
        new = set(filterfalse(self.at.__contains__, part))
        if new:
            if len(self.at) + len(new) > CACHE_WORDS:
                self.at.clear()
                new = set(part)
            self._learn(sorted(new), model)
        return np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))

    def _learn(self, new: list[str], model: Scorer) -> None:
        first = len(self.at)
        while len(self.logit) < first + len(new):
            self.logit, self.hash = np.concatenate([self.logit] * 2), np.concatenate([self.hash] * 2)
        self.at.update(zip(new, range(first, first + len(new))))
        self.hash[first : first + len(new)] = np.fromiter(map(word_hash, new), np.uint64, len(new))
        rows, held, done = [], 0, first
        for w in [*new, None]:
            if w is not None:
                rows.append(features(w, model.s))
                held += len(rows[-1])
            if rows and (w is None or len(rows) == 5000 or held > ROWS_AT_ONCE):
                sizes = np.array([len(r) for r in rows])
                flat = model.logits[np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))].astype(np.float64)
                self.logit[done : done + len(rows)] = np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes
                rows, held, done = [], 0, done + len(rows)


_KNOWN: dict[str, Known] = {}


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", teach=None) -> Scorer:
    """Learn from at most ``s.sample_rows`` labelled documents, those of the smallest hashed id; teach: a condition on the id column, if any."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if teach is not None:
        own = own.where(teach)
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(s.seed))
    chosen = own.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"), order.alias("_h")).groupBy("_id").agg(F.min("_y").alias("_y"), F.first("_h").alias("_h")).orderBy("_h", "_id").limit(s.sample_rows)
    def bags(batches):
        for b in batches:
            rows_of: dict[str, np.ndarray] = {}
            for i, text in enumerate(b.column(2)):
                if len(rows_of) > CACHE_WORDS:
                    rows_of.clear()
                rows, share = bag(text.as_py(), s, rows_of)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(3), one.column(4), one.column(5), pa.array([packed(rows, share)], pa.binary())], names=["_id", "_y", "_h", "_a", "_b", "bag"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_a"), F.xxhash64(text, F.lit(1)).alias("_b")).join(F.broadcast(chosen), "_id")  # sample_rows short rows
    rows = rows.select("_id", "_y", "_t", "_h", "_a", "_b").mapInArrow(bags, "_id long, _y int, _h long, _a long, _b long, bag binary")
    rows = rows.orderBy("_h", "_id", "_a", "_b").limit(s.sample_rows).select("bag", "_y").toArrow()  # at most Settings.rows numbers each, however long a text is
    return Model(s).fit_bags(Bags(rows.column(0)), rows.column(1).to_pylist()).scorer()


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    shared, key = docs.sparkSession.sparkContext.broadcast(scorer), uuid.uuid4().hex  # Settings.rows numbers

    @F.pandas_udf("double")
    def p(texts: pd.Series) -> pd.Series:
        if key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[key] = Known()
        model, known = shared.value, _KNOWN[key]
        return pd.Series([model(t, known) for t in texts], dtype="float64")

    return docs.withColumn(out_col, p(F.col(text_col).cast("string")))
