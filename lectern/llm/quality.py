"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text in one pass over Arrow batches.  Cyclic
boosting of shallow trees, one feature at a time with a small step, learns a
lookup table of log-odds for each feature; then the pairs that best explain what
is left get two-way tables.  A score is the sum of the tables' entries of a
document's bins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAMES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "unique_words", "short_words", "upper", "digits", "marks", "symbols",
    "wide", "blanks", "log_lines", "words_a_line", "repeated_lines", "closed", "glued", "shouted", "top_byte", "entropy",
)

_CLASS = np.zeros((256, 6), dtype=np.float64)  # columns: upper, lower, digit, mark, symbol, wide
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c, 0] = "A" <= _ch <= "Z"
    _CLASS[_c, 1] = "a" <= _ch <= "z"
    _CLASS[_c, 2] = "0" <= _ch <= "9"
    _CLASS[_c, 3] = _ch in ".,;:'\"-()?"
    _CLASS[_c, 4] = 32 < _c < 127 and not _ch.isalnum() and _ch not in ".,;:'\"-()?"
    _CLASS[_c, 5] = _c >= 128


def features_of(text: str | None) -> list[float]:
    """The features of one whole text; a null or blank text has those of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, nw = len(raw), len(words)
    if not nw:
        return [math.log1p(n)] + [0.0] * (len(NAMES) - 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit, mark, symbol, wide = counts @ _CLASS
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=nw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    inked = counts.copy()
    inked[[32, 9, 10, 11, 12, 13]] = 0
    solid = max(1, inked.sum())
    share = inked[inked > 0] / solid
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)
    firsts = np.frombuffer(b"".join([w[:1] for w in words]), dtype=np.uint8)
    return [
        math.log1p(n), math.log1p(nw), float(sizes.mean()), float(min(200, sizes.max())), len(set(words)) / nw, float((sizes <= 3).mean()),
        upper / max(1, upper + lower), digit / solid, mark / solid, symbol / solid, wide / solid, 1 - solid / n,
        math.log1p(len(lines)), nw / len(lines), 1 - len(set(lines)) / len(lines), float(_CLASS[ends, 3].mean()), float(_CLASS[ends, 4].mean()),
        float(_CLASS[firsts, 0].mean()), float(share.max()), float(-(share * np.log2(share)).sum()),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [features_of(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


def _step(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values, a bin each, of the best tree of ``depth`` over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    ga, hb = g.sum() - a, h.sum() - b
    gain = np.where((b >= least) & (hb >= least), a * a / (b + ridge) + ga * ga / (hb + ridge), -np.inf)
    k = int(np.argmax(gain))
    if not gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate([_step(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _step(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)])


class AdditiveModel:
    """Lookup tables over binned features and over pairs of coarser bins."""

    def __init__(self, bins: int = 48, coarse: int = 8, cycles: int = 120, pairs: int = 6, pair_cycles: int = 40, rate: float = 0.1, depth: int = 2, ridge: float = 1.0, least: float = 2.0):
        self.bins, self.coarse, self.cycles, self.pairs, self.pair_cycles, self.rate, self.depth, self.ridge, self.least = bins, coarse, cycles, pairs, pair_cycles, rate, depth, ridge, least

    def _cuts(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        at = np.linspace(0, 1, n + 1)[1:-1]
        return [np.unique(np.quantile(x[:, j], at)) if len(x) else np.zeros(0) for j in range(x.shape[1])]

    @staticmethod
    def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.fine, self.rough = self._cuts(x, self.bins), self._cuts(x, self.coarse)
        n, k = x.shape
        prior = (y.sum() + 1) / (n + 2)
        self.base = math.log(prior / (1 - prior))
        self.tables = [np.zeros(len(c) + 1) for c in self.fine]
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}
        if n == 0:
            return self
        at, f = self._binned(x, self.fine), np.full(n, self.base)
        for _ in range(self.cycles):
            for j in range(k):
                if len(self.tables[j]) < 2:
                    continue
                p = 1 / (1 + np.exp(-f))
                step = self.rate * _step(*(np.bincount(at[:, j], w, len(self.tables[j])) for w in (y - p, p * (1 - p))), self.depth, self.ridge, self.least)
                self.tables[j] += step
                f += step[at[:, j]]
        at = self._binned(x, self.rough)
        side = self.coarse

        def cell_sums(i, j):
            p = 1 / (1 + np.exp(-f))
            return (np.bincount(at[:, i] * side + at[:, j], w, side * side) for w in (y - p, p * (1 - p)))

        def gain(i, j):
            g, h = cell_sums(i, j)
            return float((g * g / (h + self.ridge)).sum())

        best = sorted(((gain(i, j), i, j) for i in range(k) for j in range(i)), reverse=True)[: self.pairs]
        self.pair_tables = {(i, j): np.zeros(side * side) for _, i, j in best}
        for _ in range(self.pair_cycles):
            for i, j in self.pair_tables:
                g, h = cell_sums(i, j)
                step = self.rate * g / (h + 10 * self.ridge)
                self.pair_tables[i, j] += step
                f += step[at[:, i] * side + at[:, j]]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at, f = self._binned(x, self.fine), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[at[:, j]]
        at = self._binned(x, self.rough)
        for (i, j), t in self.pair_tables.items():
            f += t[at[:, i] * self.coarse + at[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 40000, **how) -> AdditiveModel:
    """A model from the labelled rows of ``docs`` that are not held out.

    Above ``max_rows`` labelled rows, a hash of doc_id draws about so many; this
    bounds what the driver fits on, and features are computed of these rows only.
    Of repeated labels the smallest counts, of repeated documents the one with the
    smallest features; a null label does not.  Without labelled rows every score
    is 1/2.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(max_rows / max(n, 1) * (1 << 30)))
    own = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")  # about max_rows ids
    rows = with_features(own).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("features").alias("x"), F.first("_y").alias("y")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(NAMES))
    return AdditiveModel(**how).fit(x, (rows["y"].to_numpy() == 1).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 40000, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs(doc_id, text)``.

    Equal texts get equal scores, also under one doc_id; null and blank texts are
    scored as such, and texts of any length as a whole.  A null doc_id is never
    learnt from.  An empty table gives no rows.
    """
    model, kind = fit_quality(docs, labels, max_rows, **how), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array([features_of(t) for t in b.column(1).to_pylist()], dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.predict(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 40000, **how) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns."""
    model = fit_quality(docs, labels, max_rows, **how)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            x = np.array([features_of(t) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.predict(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``, learnt from the labels that are not held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
