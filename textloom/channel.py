"""Where progress goes: a channel that a run writes lines to, and counters that Spark observes while it runs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

log = logging.getLogger("textloom")


class Channel:
    """Lines to the log, and to a receiver if there is one. A receiver that fails gets nothing more; the run goes on."""

    def __init__(self, receiver: Callable[[str], object] | None = None):
        self.receiver = receiver
        self.failed: Exception | None = None

    @property
    def valid(self) -> bool:
        return self.receiver is not None and self.failed is None

    def send(self, line: str) -> None:
        log.info("%s", line)
        if self.valid:
            try:
                self.receiver(line + "\n")
            except Exception as error:  # whatever a receiver throws is its own affair
                log.error("the receiver failed and gets nothing more: %s", error)
                self.failed = error


class Counted:
    """Rows whose counters are observed on their way, without a pass of their own: `rows` is to be used in place of the frame given;
    report() waits for the action that reads them and sends its counters as one line."""

    def __init__(self, rows: DataFrame, name: str, *counters: Column):
        self.name, self.observation = name, Observation(name)
        self.rows = rows.observe(self.observation, *counters)

    def report(self, channel: Channel) -> dict:
        found = self.observation.get
        channel.send(f"{self.name}: " + ", ".join(f"{k} {v}" for k, v in found.items()))
        return found
