"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A byte-pair tokenizer never merges across pre-tokens, so a document's count is
the sum of its pre-tokens' counts.  Leaves hold runs of pre-tokens with their
counts, inner nodes the sums of characters and tokens.  An edit finds its place
by the sums, cuts pre-tokens anew from the last that may look at the edit
until a boundary falls on an old one behind it, and updates the sums above the
leaves it touched.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: how the byte-level vocabularies cut a text into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 64


@lru_cache(maxsize=4)
def vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file (about a megabyte), read where the file is."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def counter(ranked: bytes, held: int = 500_000) -> tuple[object, Callable[[list[str]], list[int]]]:
    """(compiled pattern, counts of pre-tokens) of a vocabulary; counts are remembered up to a bound."""
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranked.splitlines() if x.strip())}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def counts(pieces: list[str]) -> list[int]:
        out = list(map(known.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    p = pieces[i]
                    n = out[i] = known.get(p) or len(coder.encode_ordinary(p))
                    if len(known) >= held:
                        known.clear()
                    known[p] = n
        return out

    return regex.compile(PATTERN), counts


class CountedText:
    """A text's pre-tokens under a segment tree of characters and tokens."""

    def __init__(self, text: str, ranked: bytes | None = None):
        self.pattern, self.counts = counter(ranked or vocabulary(VOCABULARY))
        pieces = self.pattern.findall(text)
        self._plant(pieces, self.counts(pieces))
        self.recut = 0  # characters cut anew by edits

    def _plant(self, pieces: list[str], counts: list[int]) -> None:
        self.pieces = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.leaves = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.size = 1 << (len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (p, c) in enumerate(zip(self.pieces, self.leaves, strict=True)):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, p)), sum(c)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.pieces for p in leaf)

    def _locate(self, pos: int) -> tuple[int, int, int]:
        """(leaf, piece, its start) of the first pre-token that ends at or behind ``pos``."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] < pos:
                start += self.chars[k]
                k += 1
        leaf = min(k - self.size, len(self.pieces) - 1)
        for i, p in enumerate(self.pieces[leaf]):
            if start + len(p) >= pos:
                return leaf, i, start
            start += len(p)
        return leaf, len(self.pieces[leaf]), start

    def edit(self, pos: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``pos`` on by ``inserted``; both ends are held inside the text."""
        pos = max(0, min(pos, self.n_chars))
        end = min(pos + max(0, removed), self.n_chars)
        leaf, i, start = self._locate(pos - 1)  # a pre-token may look at the two characters behind it
        l, j, at, old, bounds, reach = leaf, i, start, [], set(), 8
        while True:
            while l < len(self.pieces) and (at <= end or len(bounds) < reach):  # gather pre-tokens until some end behind the edit
                if j == len(self.pieces[l]):
                    l, j = l + 1, 0
                    continue
                old.append(self.pieces[l][j])
                at += len(self.pieces[l][j])
                j += 1
                if at > end:
                    bounds.add(at)
            last = l >= len(self.pieces) or (j == len(self.pieces[l]) and not any(self.pieces[l + 1 :]))
            before = "".join(old)
            after = before[: pos - start] + inserted + before[end - start :]
            shift, new, done = len(inserted) - (end - pos), [], None
            for m in self.pattern.finditer(after):
                if m.end() >= len(after) - 1 and not last:
                    break  # what follows may change this one
                new.append(m.group())
                if start + m.end() - shift in bounds:
                    done = start + m.end() - shift
                    break
            if done is not None or last:
                break
            reach *= 2
        self.recut += sum(map(len, new))
        done = at if done is None else done
        while at > done:  # give back what lies behind the meeting point
            j -= 1
            while j < 0:
                l -= 1
                j = len(self.pieces[l]) - 1
            at -= len(self.pieces[l][j])
        if l >= len(self.pieces):
            l, j = len(self.pieces) - 1, len(self.pieces[-1])
        tail, tail_counts = self.pieces[l][j:], self.leaves[l][j:]
        head, head_counts = self.pieces[leaf][:i], self.leaves[leaf][:i]
        for k in range(leaf, l + 1):
            self.pieces[k], self.leaves[k] = [], []
        self.pieces[leaf], self.leaves[leaf] = head + new + (tail if l == leaf else []), head_counts + self.counts(new) + (tail_counts if l == leaf else [])
        if l != leaf:
            self.pieces[l], self.leaves[l] = tail, tail_counts
        if len(self.pieces[leaf]) > 8 * LEAF:
            self._plant([p for x in self.pieces for p in x], [c for x in self.leaves for c in x])
            return
        touched = set()
        for k in range(leaf, l + 1):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, self.pieces[k])), sum(self.leaves[k])
            touched.add((self.size + k) // 2)
        while touched and max(touched) >= 1:
            for k in touched:
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            touched = {k // 2 for k in touched if k > 1}


def count_tokens(docs: DataFrame, edits: str | Column, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, recut_chars of every row of ``docs(doc_id, text)``.

    ``edits`` is a column of array<struct<pos int, removed int, inserted string>>,
    applied in order, each to the text that the ones before it left; positions
    are code points and are held inside the text.  Null texts are empty; null
    edits, and null fields of an edit, do nothing.  Repeated rows are counted
    each.  A text is held whole, with its tree; a single pre-token goes to the
    encoder whole, however long.  The driver reads the vocabulary at ``path`` and
    sends it to the tasks, so executors need no such file.  No row is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = "n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, recut_chars long"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        ranked = sent.value
        for b in batches:
            rows = []
            for text, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = CountedText(text or "", ranked)
                n, done = own.n_tokens, 0
                for c in changes or ():
                    if c is not None:
                        own.edit(c["pos"] or 0, c["removed"] or 0, c["inserted"] or "")
                        done += 1
                rows.append((n, done, own.n_tokens, own.n_chars, own.recut))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(5))], ["doc_id", *names])

    edits = F.col(edits) if isinstance(edits, str) else edits
    return docs.select("doc_id", "text", edits.alias("edits")).mapInArrow(run, f"doc_id {kind}, {out}")


def sample_edits() -> Column:
    """Three edits at places that the text's CRC decides: an insertion, a removal and a replacement."""
    n = F.coalesce(F.length("text"), F.lit(0)) + 1
    draw = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    edit = lambda step, removed, inserted: F.struct(F.pmod(draw * step, n).cast("int").alias("pos"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(edit(1, 0, " (revised on review)"), edit(7, 24, ""), edit(31, 9, "don't\n\n  "))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of ``documents`` before and after three edits."""
    return count_tokens(table(spark, sf_dir, "documents"), sample_edits())
