"""A check that is due every few chapters, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DUE = "book string, chapter_no long, since long"


class DueChecks(StatefulProcessor):
    """Takes a book's chapters in order of their numbers, whatever order they come in.

    Chapters behind a gap wait in a map state.  A gap that is not filled within
    ``patience`` milliseconds is passed over, when a timer says so.
    """

    def __init__(self, every: int, patience: int):
        self.every, self.patience = every, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last long, checked long")
        self.waiting = handle.getMapState("waiting", "chapter_no long", "here boolean")

    def _go_on(self, book: str, last: int, checked: int) -> pd.DataFrame:
        """Takes the chapters that follow ``last`` and wait, and says where checks are due."""
        out = []
        while self.waiting.containsKey((last + 1,)):
            last += 1
            self.waiting.removeKey((last,))
            if last - checked >= self.every:
                out.append((book, last, checked))
                checked = last
        self.at.update((last, checked))
        return pd.DataFrame(out, columns=["book", "chapter_no", "since"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, checked = self.at.get() if self.at.exists() else (0, 0)
        for pdf in rows:
            for n in pdf["chapter_no"].dropna().unique():
                if n > last:
                    self.waiting.updateValue((int(n),), (True,))
        yield self._go_on(key[0], last, checked)
        if any(True for _ in self.waiting.keys()) and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        behind = min((k[0] for k in self.waiting.keys()), default=None)
        if behind is not None:
            last, checked = self.at.get() if self.at.exists() else (0, 0)
            if behind - 1 > last:
                last = behind - 1
            yield self._go_on(key[0], last, checked)
            if any(True for _ in self.waiting.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def due_stream(chapters: DataFrame, every: int = 5, patience: int = 3_600_000) -> DataFrame:
    """book, chapter_no, since as ``operators.deltas.due_checks`` gives them, of a streaming ``chapters(book, chapter_no)``; needs the RocksDB state store.

    Repeated chapters count once, and so do chapters that come after a gap was
    passed over.  A stream that has brought all chapters in any order and cut has
    given the same rows as the batch.
    """
    return chapters.groupBy("book").transformWithStateInPandas(DueChecks(every, patience), DUE, "Append", "ProcessingTime")
