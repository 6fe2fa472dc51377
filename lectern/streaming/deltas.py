"""Chapter deltas as a stream: the rulings of ``operators.deltas``, with a state for each book."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.deltas import RULED, Book, prepared


class Members:
    """Ids in a map state, which is read and written one by one."""

    def __init__(self, held):
        self.held = held

    def __contains__(self, i: str) -> bool:
        return self.held.containsKey((i,))

    def add(self, i: str) -> None:
        self.held.updateValue((i,), (True,))


class Rulings(StatefulProcessor):
    """Holds the last chapter, the ages and, as a map, the dead of a book; a degraded delta leaves them as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long, ages string")
        self.dead = handle.getMapState("dead", "id string", "dead boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ages = self.last.get() if self.last.exists() else (0, "{}")
        book = Book(last, json.loads(ages), Members(self.dead))
        # a book's rows of one micro-batch, which maxFilesPerTrigger bounds, in order of arrival
        own = sorted((r for pdf in rows for r in zip(pdf["seq"], pdf["chapter"], pdf["errors"], pdf["facts"], strict=True)), key=lambda r: (r[0], r[1], r[3]))
        out = [(key[0], int(seq), None if pd.isna(chapter) else int(chapter), *book.rule(None if pd.isna(chapter) else int(chapter), errors, facts)) for seq, chapter, errors, facts in own]
        self.last.update((book.last, json.dumps(book.ages)))
        yield pd.DataFrame(out, columns=["book", "seq", "chapter", "status", "errors"])

    def close(self) -> None:
        pass


def delta_stream(deltas: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book, seq, chapter, status, errors of each delta of a streaming ``deltas(book, seq, chapter, delta)``; needs the RocksDB state store.

    A book's deltas must reach the stream in order of ``seq``, those of one
    micro-batch in any order.  ``books`` is a table, joined as it is at each micro-batch.
    """
    return prepared(deltas, books).groupBy("book").transformWithStateInPandas(Rulings(), RULED, "Append", "None")
