"""One task per host: requests in order, with a least time between two to one host.

``by_host`` deals rows so that a host is in one task, and sorts a task's rows so that hosts
take turns: a task asks one host after another and waits only when a host's turn comes too
early. A host's rows are asked one after the other by design, so a host with a third of all
rows takes as long as its own limit says, whatever the cluster's size, and a task holds one
row and a time per host.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import netloc

#: Seconds between requests to one host, unless told otherwise (the model's default).
DELAY = 0.5


def by_host(frame: DataFrame, order: list[str | Column], url: str = "url") -> DataFrame:
    """``frame`` with ``host`` and ``turn`` (from 1 in each host), dealt by host, in order of turn."""
    own = netloc(F.col(url))
    turn = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    return frame.withColumn("host", own).withColumn("turn", turn).sortWithinPartitions("turn", "host")


class Pace:
    """When the hosts of a task may be asked again. ``clock`` and ``sleep`` are parameters for tests."""

    def __init__(self, delay: float, rested: bool = True, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.delay, self.clock, self.sleep = delay, clock, sleep
        self.began = clock() - (delay if rested else 0)
        self.asked: dict[str, float] = {}

    def wait(self, host: str) -> None:
        """Wait until ``host`` may be asked."""
        left = self.asked.get(host, self.began) + self.delay - self.clock()
        if left > 0:
            self.sleep(left)

    def done(self, host: str) -> None:
        """A request to ``host`` has ended."""
        self.asked[host] = self.clock()
