"""Background conversion jobs: idle, running, done or error, one at a time for each document.

A job is a Spark action under a job group, run from a driver thread, so it can be polled and cancelled; two run at once.
State lives in this process only.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class Jobs:
    def __init__(self, spark: SparkSession, at_once: int = 2):
        self.spark, self.pool = spark, ThreadPoolExecutor(at_once)
        self.lock, self.futures = threading.Lock(), dict[str, Future]()

    def start(self, stem: str, work: Callable[[], object]) -> bool:
        """False, without a second job, while one for the document is running."""
        with self.lock:
            held = self.futures.get(stem)
            if held is not None and not held.done():
                return False
            self.futures[stem] = self.pool.submit(self._run, stem, work)
            return True

    def _run(self, stem: str, work: Callable[[], object]) -> object:
        self.spark.sparkContext.setJobGroup(f"convert-{stem}", f"conversion of {stem}", interruptOnCancel=True)
        return work()

    def status(self, stem: str) -> tuple[str, str | None]:
        """(state, error)."""
        held = self.futures.get(stem)
        if held is None:
            return "idle", None
        if not held.done():
            return "running", None
        error = held.exception()
        return ("error", f"{type(error).__name__}: {error}") if error else ("done", None)

    def cancel(self, stem: str) -> None:
        self.spark.sparkContext.cancelJobGroup(f"convert-{stem}")
