"""Independent jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Failed(Exception):
    """One job's failure, kept while the others go on; ``cause`` is what it raised."""

    def __init__(self, cause: Exception) -> None:
        super().__init__(str(cause))
        self.cause = cause


def together(spark: SparkSession, jobs: Mapping[str, Callable[[], Any]]) -> dict[str, Any]:
    """What each job returns, or a ``Failed`` for one that raised, by name and in order.

    Each runs in a thread that has the caller's job group, description and other local
    properties, in a scheduler pool of its name: under fair scheduling
    (``spark.scheduler.mode``, set by ``build_session``) a long job does not hold up
    the others, under any other mode jobs fill the cores that are left.
    """

    def guarded(name: str, job: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        except Exception as error:  # any failure is one job's
            return Failed(error)

    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as threads:
        waiting = {
            name: threads.submit(inheritable_thread_target(spark)(guarded), name, job)
            for name, job in jobs.items()
        }
        return {name: result.result() for name, result in waiting.items()}


def once(make: Callable[[], Any]) -> Callable[[], Any]:
    """``make``, called by the first job that needs it; the others wait for its outcome."""
    lock, outcome = Lock(), []

    def get() -> Any:
        with lock:
            if not outcome:
                try:
                    outcome.append(make())
                except Exception as error:
                    outcome.append(Failed(error))
        if isinstance(outcome[0], Failed):
            raise outcome[0].cause
        return outcome[0]

    return get
