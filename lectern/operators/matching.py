"""Many literals at once: an automaton with fail links reads a text one time for all lists.

``Lexicon`` names lists of terms.  Its columns are Arrow functions over a text, so
a plan may use several beside other expressions, and one Python pass serves them:

- ``counts``: for each list, how often its terms occur; a term's own occurrences
  don't overlap, different terms may;
- ``places``: every such occurrence with its place;
- ``longest``: the longest terms from the left, none overlapping another.

The automaton is built once in a worker.  Terms are given by the caller, so what
is sent to the tasks doesn't grow with the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = "array<struct<term:string,pos:int>>"
_PLACES = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))


@cache
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Links of all terms; a match is (last place, (number of the term, its length))."""
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, (i, len(t)))
    out.make_automaton()
    return out


def each_of(terms: tuple[str, ...], text: str) -> list[tuple[int, int]]:
    """(number, start) of the occurrences of each term that don't overlap an earlier one of the same term, by where they end."""
    free, out = [0] * len(terms), []
    for end, (i, n) in automaton(terms).iter(text) if terms else ():
        if end - n + 1 >= free[i]:
            free[i] = end + 1
            out.append((i, end - n + 1))
    return out


def longest_of(terms: tuple[str, ...], text: str) -> list[tuple[int, int]]:
    """(number, start) of the terms found from the left: at each place the longest, and on behind it."""
    best: dict[int, tuple[int, int]] = {}
    for end, (i, n) in automaton(terms).iter(text) if terms else ():
        start = end - n + 1
        if start not in best or best[start][0] < n:
            best[start] = (n, i)
    return leftmost(best)


def leftmost(best: Mapping[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(number, start) from the left, none overlapping another, of the (length, number) of the longest term at each place."""
    out, free = [], 0
    for start in sorted(best):
        n, i = best[start]
        if start >= free:
            out.append((i, start))
            free = start + n
    return out


#: Rows that a function takes at a time from a batch, so that few of them are Python objects at once.
SLICE = 128


def sliced(of):
    """``of`` over a batch, some rows at a time; what it gives is kept as Arrow arrays."""

    def whole(rows: pa.Array) -> pa.Array:
        return pa.concat_arrays([of(rows.slice(i, SLICE)) for i in range(0, max(len(rows), 1), SLICE)])

    return whole


def once(of, kind: str):
    """``of`` as a column function that the optimizer doesn't copy into what reads it, so that it runs once a row."""
    return F.arrow_udf(sliced(of), kind).asNondeterministic()


class Lexicon:
    """Lists of terms by name; a term may be in several lists, and in one more than once (it counts as often)."""

    def __init__(self, lists: Mapping[str, Iterable[str]]):
        self.lists = {k: tuple(ws) for k, ws in lists.items()}
        self.terms = tuple(dict.fromkeys(w for ws in self.lists.values() for w in ws if w))

    def counts(self, text: str | Column) -> Column:
        """Array of the counts of all lists, in their order; of a null text, zeros."""
        terms, size = self.terms, len(self.lists)
        owners = [[k for k, ws in enumerate(self.lists.values()) for w in ws if w == t] for t in terms]

        def of(texts: pa.Array) -> pa.Array:
            rows = []
            for text in texts.to_pylist():
                n = [0] * size
                for i, _ in each_of(terms, text or ""):
                    for k in owners[i]:
                        n[k] += 1
                rows.append(n)
            return pa.array(rows, pa.list_(pa.int64()))

        return once(of, "array<bigint>")(text)

    def count(self, counted: str | Column, name: str) -> Column:
        """The count of one list in what ``counts`` gave."""
        return F.get(counted, F.lit(list(self.lists).index(name)))

    def _found(self, find, text: str | Column) -> Column:
        terms = self.terms

        def of(texts: pa.Array) -> pa.Array:
            rows = [None if t is None else [{"term": terms[i], "pos": start + 1} for i, start in find(terms, t)] for t in texts.to_pylist()]
            return pa.array(rows, _PLACES)

        return once(of, PLACES)(text)

    def places(self, text: str | Column) -> Column:
        """Array of (term, pos from 1) of all occurrences, by where they end; null of a null text."""
        return self._found(each_of, text)

    def longest(self, text: str | Column) -> Column:
        """Array of (term, pos from 1) of the longest terms from the left; null of a null text."""
        return self._found(longest_of, text)

    def kinds(self, text: str | Column) -> Column:
        """Array of the distinct terms among the longest from the left; null of a null text."""
        terms = self.terms

        def of(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else [terms[i] for i in dict.fromkeys(i for i, _ in longest_of(terms, t))] for t in texts.to_pylist()], pa.list_(pa.string()))

        return once(of, "array<string>")(text)

    def around(self, text: str | Column, near: int) -> Column:
        """``places`` with what stands before and after each, ``near`` characters at most: cut where the text is at hand, as a substring of each place would walk the text again."""
        terms = self.terms

        def of(texts: pa.Array) -> pa.Array:
            cut = lambda t, i, at: {"term": terms[i], "pos": at + 1, "before": t[max(at - near, 0) : at], "after": t[at + len(terms[i]) : at + len(terms[i]) + near]}
            rows = [None if t is None else [cut(t, i, at) for i, at in each_of(terms, t)] for t in texts.to_pylist()]
            return pa.array(rows, pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32()), ("before", pa.string()), ("after", pa.string())])))

        return once(of, "array<struct<term:string,pos:int,before:string,after:string>>")(text)

    def apart(self, text: str | Column, before: int, behind: int) -> Column:
        """Array of (list, term, pos from 1, near): of each list for itself the longest terms from the left; near is the text from ``before`` characters before pos to ``behind`` behind it; empty of a null text."""
        terms, names = self.terms, tuple(self.lists)
        owners = [[k for k, ws in enumerate(self.lists.values()) if t in ws] for t in terms]

        def of(texts: pa.Array) -> pa.Array:
            rows = []
            for t in texts.to_pylist():
                own: dict[int, dict[int, tuple[int, int]]] = {}
                for end, (i, n) in automaton(terms).iter(t) if t and terms else ():
                    for k in owners[i]:
                        best, start = own.setdefault(k, {}), end - n + 1
                        if start not in best or best[start][0] < n:
                            best[start] = (n, i)
                rows.append([{"list": names[k], "term": terms[i], "pos": at + 1, "near": t[max(at - before, 0) : at + behind]} for k, best in own.items() for i, at in leftmost(best)])
            return pa.array(rows, pa.list_(pa.struct([("list", pa.string()), ("term", pa.string()), ("pos", pa.int32()), ("near", pa.string())])))

        return once(of, "array<struct<list:string,term:string,pos:int,near:string>>")(text)

    def lines(self, texts: str | Column) -> Column:
        """Of an array of lines, an array of (term, n, first): in how many lines each term stands, and the place of the first of them, from 1; terms in their order."""
        terms = self.terms

        def of(rows: pa.Array) -> pa.Array:
            out = []
            for own in rows.to_pylist():
                where: dict[int, list[int]] = {}
                for k, line in enumerate(own or (), 1):
                    for i in {i for i, _ in each_of(terms, line or "")}:
                        where.setdefault(i, []).append(k)
                out.append([{"term": terms[i], "n": len(ks), "first": ks[0]} for i, ks in sorted(where.items())])
            return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64()), ("first", pa.int32())])))

        return once(of, "array<struct<term:string,n:bigint,first:int>>")(texts)

    def hits(self, docs: DataFrame, *keep: str, text: str = "text", longest: bool = False) -> DataFrame:
        """keep, list, term, pos: a row for each occurrence and list that holds its term."""
        names: dict[str, list[str]] = {}
        for k, ws in self.lists.items():
            for w in dict.fromkeys(ws):
                names.setdefault(w, []).append(k)
        lists = F.create_map(*[x for w, ks in names.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))]).cast("map<string,array<string>>")
        found = (self.longest if longest else self.places)(text)
        rows = docs.select(*keep, found.alias("_f")).select(*keep, F.explode("_f").alias("x"))
        return rows.select(*keep, F.explode(F.try_element_at(lists, F.col("x.term"))).alias("list"), F.col("x.term").alias("term"), F.col("x.pos").cast("long").alias("pos"))


def chosen(found: str | Column, category: Mapping[str, str]) -> Column:
    """The category of each of the places that ``longest`` gave, in order; terms without one are passed over."""
    lookup = F.create_map(*[F.lit(x) for p in category.items() for x in p]).cast("map<string,string>")
    kinds = F.transform(found, lambda x: F.try_element_at(lookup, x["term"]))
    return F.filter(kinds, lambda k: k.isNotNull())
