"""Control of runs and responses: pause, resume and stop of the indexing stream, request sizes by latency, results row by row."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Control:
    """Held by whoever started a run, asked by the run between micro-batches; all methods may be called from any thread."""

    def __init__(self):
        self._go, self._stopped = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def stop(self) -> None:
        self._stopped.set()
        self._go.set()

    @property
    def stopped(self) -> bool:
        return self._stopped.is_set()

    def gate(self) -> bool:
        """Wait while paused; whether to go on."""
        self._go.wait()
        return not self.stopped


@dataclass
class Governor:
    """Sizes of requests to a server: halved where it is slow or fails, grown by a half after quick answers in a row.

    Seconds under `target` are quick, those over `pressure` slow; sizes stay between `least` and the largest.
    """

    most_items: int = 64
    most_chars: int = 128_000
    target: float = 0.9
    pressure: float = 2.2
    patience: int = 2
    least: tuple[int, int] = (1, 4000)
    items: int = field(init=False)
    chars: int = field(init=False)
    _quick: int = field(init=False, default=0)

    def __post_init__(self):
        self.items, self.chars = max(self.least[0], self.most_items // 2), max(self.least[1], self.most_chars // 2)

    def _scale(self, factor: float) -> None:
        self.items = int(min(self.most_items, max(self.least[0], round(self.items * factor))))
        self.chars = int(min(self.most_chars, max(self.least[1], round(self.chars * factor))))
        self._quick = 0

    def took(self, seconds: float) -> None:
        if seconds > self.pressure:
            self._scale(0.5)
        elif seconds < self.target:
            self._quick += 1
            if self._quick >= self.patience:
                self._scale(1.5)
        else:
            self._quick = 0

    def failed(self) -> None:
        self._scale(0.5)


def streamed(df: DataFrame, kind: str = "row") -> Iterator[tuple[str, dict]]:
    """Events of a result: start, one for each row as partitions come in, and done with their number; an error ends it as an event."""
    yield "start", {"columns": df.columns}
    n = 0
    try:
        for row in df.toLocalIterator(prefetchPartitions=True):  # one partition at a time on the driver
            n += 1
            yield kind, row.asDict(recursive=True)
    except Exception as e:
        yield "error", {"message": str(e).split("\n")[0], "rows": n}
        return
    yield "done", {"rows": n}
