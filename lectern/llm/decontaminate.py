"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The test items are the indexed documents and every passage of the training texts
is a query: windows of words, each twice as long as the longest item and
overlapping by half, so that some window holds any occurrence whole.  Scores are
shares of an item's score against itself, so one threshold holds for all.  A
pivot test of WAND runs for many passages of a text at once: block maxima of the
postings are summed, and only blocks of items whose bound reaches the threshold
are scored.  So every item above the threshold is found, and each is verified by
its overlap with the question (word trigrams) and the answer (words).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WORDS = re.compile(r"\w+")
FOUND = "item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def split_item(text: str, least: int = 5) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the last ``least`` words where it is shorter; never more than half."""
    words = words_of(text)
    last = words_of(re.split(r"[.!?]+\s+|\n+", text.strip())[-1])
    n = min(-(-len(words) // 2), max(least, len(last)))
    return words[: len(words) - n], words[len(words) - n :]


def grams(words: list[str], n: int) -> set:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if n else set()


@dataclass
class Statistics:
    """What scores and passages depend on: number, mean and largest size in words of all items, and how many items have a term."""

    n: int
    mean: float
    most: int
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Statistics:
        own = [w for w in (words_of(text) for _, text in items) if w]
        return cls(len(own), sum(map(len, own)) / max(1, len(own)), max(map(len, own), default=1), Counter(t for w in own for t in set(w)))


class ItemIndex:
    """Postings with block maxima over a bounded set of test items.

    ``known`` has the statistics of all items where these are only a part.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float, block: int = 8, k1: float = 1.2, b: float = 0.75, known: Statistics | None = None):
        self.threshold, self.overlap, self.block = threshold, overlap, block
        kept = [(i, words_of(text), text) for i, text in sorted(items) if words_of(text)]
        known = known or Statistics.of(items)
        self.ids = [i for i, _, _ in kept]
        self.parts = [split_item(text) for _, _, text in kept]
        self.stride, mean = known.most, known.mean
        df = {t: known.df[t] for _, w, _ in kept for t in set(w)}
        self.vocabulary = {t: k for k, t in enumerate(sorted(df))}
        docs: list[list[int]] = [[] for _ in df]
        impacts: list[list[float]] = [[] for _ in df]
        for at, (_, w, _) in enumerate(kept):
            own = {}
            for t in set(w):
                tf = w.count(t)
                idf = math.log(1 + (known.n - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
            whole = sum(own.values())
            for t, x in own.items():
                docs[self.vocabulary[t]].append(at)
                impacts[self.vocabulary[t]].append(x / whole)
        self.most = np.array([max(x) for x in impacts] + [0.0])  # the last is for words of no item
        entries = []  # for each term, its largest impact in each block of items that has it
        for at, w in zip(docs, impacts, strict=True):
            own: dict[int, float] = {}
            for i, x in zip(at, w, strict=True):
                own[i // block] = max(x, own.get(i // block, 0.0))
            entries.append(own)
        self.n_blocks = -(-len(kept) // block)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in entries]))).astype(np.int64)
        self.block_of = np.array([k for x in entries for k in x], dtype=np.int64)
        self.block_most = np.array([v for x in entries for v in x.values()], dtype=np.float64)
        # of each block: its terms, and their impacts on its items
        at = [(i, t, x) for t, (items_, w) in enumerate(zip(docs, impacts, strict=True)) for i, x in zip(items_, w, strict=True)]
        self.tables = [[] for _ in range(self.n_blocks)]
        for i, t, x in at:
            self.tables[i // block].append((i % block, t, x))
        for k, own in enumerate(self.tables):
            terms = np.unique([t for _, t, _ in own])
            table_ = np.zeros((len(terms), block))
            for i, t, x in own:
                table_[np.searchsorted(terms, t), i] = x
            self.tables[k] = (terms, table_)
        self.present = np.zeros(len(df) + 1, dtype=bool)

    def block_bounds(self, terms: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in each block of items (columns) for each passage (rows) of a text's terms.

        Block maxima are summed over the words of each stride; a passage is two
        strides.  A word that both strides have counts twice, which only raises a bound.
        """
        known = np.flatnonzero(terms < len(self.vocabulary))
        own = np.unique(known // self.stride * len(self.vocabulary) + terms[known])
        row, t = np.divmod(own, max(1, len(self.vocabulary)))
        n = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        strides = -(-len(terms) // self.stride)
        sums = np.bincount(np.repeat(row, n) * self.n_blocks + self.block_of[at], self.block_most[at], strides * self.n_blocks).reshape(strides, self.n_blocks)
        sums[:-1] += sums[1:]
        return sums

    def candidates(self, terms: np.ndarray, most: int = 1 << 20):
        """(passage, block) of those whose bound reaches the threshold, by passage.

        Strides are taken together as long as they have about ``most`` postings and
        cells of bounds, so memory doesn't grow with the text.
        """
        strides = -(-len(terms) // self.stride)
        length = np.append(self.first[1:] - self.first[:-1], 0)[np.minimum(terms, len(self.vocabulary))]
        cost = np.bincount(np.arange(len(terms)) // self.stride, length, strides) + self.n_blocks
        lot = (np.cumsum(cost) // most).astype(np.int64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(lot)) + 1, [strides]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # with the stride behind, which the last passage reaches into
            bounds = self.block_bounds(terms[a * self.stride : (b + 1) * self.stride])[: b - a]
            for k, block in np.argwhere(bounds >= self.threshold - 1e-9):
                yield a + k, block

    def leaks(self, text: str | None) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word) of each item that a whole text holds; the best passage of each."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        none, get = len(self.vocabulary), self.vocabulary.get
        terms = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
        if self.most[terms].sum() < self.threshold - 1e-9:
            return []
        best: dict[int, tuple] = {}
        passage = -1
        for k, block in self.candidates(terms):
            if k != passage:
                passage, a = k, int(k) * self.stride
                b = min(len(words), a + 2 * self.stride)
                self.present[:] = False
                self.present[terms[a:b]] = True
            own, table_ = self.tables[block]
            scores = self.present[own] @ table_
            for i in np.flatnonzero(scores >= self.threshold):
                item, score = int(block) * self.block + int(i), float(scores[i])
                if item in best and best[item][0] >= score:
                    continue
                near = words[max(0, a - self.stride) : b + self.stride]
                question, answer = self.parts[item]
                q, w = grams(question, 3), set(answer)
                q = len(q & grams(near, min(3, max(1, len(question))))) / len(q) if q else 1.0
                w = len(w & set(near)) / len(w)
                if q >= self.overlap and w >= self.overlap:
                    best[item] = (score, q, w, a)
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def item_indexes(benchmark: DataFrame, threshold: float, overlap: float, chunk: int, chunk_words: int = 1 << 21):
    """Indexes of about ``chunk`` items and ``chunk_words`` words each at most; both are counted first, so none is larger than a task can hold.

    Statistics are those of all items, so ``chunk`` decides no score and no passage.
    """
    spark, scratch = benchmark.sparkSession, Scratch(benchmark.sparkSession, "items")

    def cut(batches):
        for b in batches:
            own = [words_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in own], pa.int64()), pa.array([sorted(set(w)) for w in own], pa.list_(pa.string()))], ["item_id", "text", "n", "terms"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    items = scratch.put(items.mapInArrow(cut, "item_id long, text string, n long, terms array<string>").where("n > 0"))
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.max("n").alias("most")).first()
    parts = max(-(-whole["n"] // chunk), math.ceil(whole["n"] * (whole["mean"] or 0) / chunk_words))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    df = scratch.put(items.select(F.explode("terms").alias("term")).groupBy("term").count()) if parts else None
    for k in range(parts):
        own = items.where(part == k)
        terms = own.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()  # those of about ``chunk`` items
        known = Statistics(whole["n"], whole["mean"], whole["most"], {x["term"]: x["count"] for x in terms})
        yield spark.sparkContext.broadcast(ItemIndex([tuple(x) for x in own.select("item_id", "text").collect()], threshold, overlap, known=known))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, chunk: int = 20000) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)`` and benchmark item that its text holds.

    Columns: doc_id, item_id, score (share of the item's score against itself),
    question_overlap, answer_overlap, first_word (of the passage).  Null and
    blank texts hold nothing; items without words or id are held by nothing.
    Items with equal texts are all reported, and repeated rows of documents each.
    A benchmark above ``chunk`` items is searched chunk after chunk, with the same
    result.  A text is held whole with its words.  No row is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for index in item_indexes(benchmark, threshold, overlap, chunk):

        def run(batches, index=index):
            for b in batches:
                ids, found = b.column(0).to_pylist(), []
                for i, text in zip(ids, b.column(1).to_pylist(), strict=True):
                    found += [(i, *x) for x in index.value.leaks(text)]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                types = [b.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FOUND}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, {FOUND}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, chunk: int = 20000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    for index in item_indexes(benchmark, threshold, overlap, chunk):

        def run(batches, index=index):
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not index.value.leaks(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
