"""Jobs under a time limit: what is done in time is kept, running Spark jobs of the rest are cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")
#: Seconds between two looks at the jobs once the limit has passed.
PAUSE = 0.1


class OutOfTime(TimeoutError):
    """No job of a run was done within its limit."""


def run_within(
    spark: SparkSession, jobs: Mapping[str, Callable[[], Result]], seconds: float | None = None, parallelism: int = 8
) -> dict[str, Result]:
    """Results of the jobs, by name and in the given order, submitted side by side.

    Jobs start in the given order. With a limit, jobs that have not begun by then are left out, and the Spark jobs of
    those still running carry a tag by which they are cancelled, again and again until their threads have ended, as a
    fit is a series of Spark jobs. So a run ends soon after its limit. An error within the limit is raised; when
    nothing was done in time, `OutOfTime` is.
    """
    if not jobs:
        return {}
    context, tag = spark.sparkContext, f"tabloom-{uuid.uuid4().hex}"
    over = threading.Event()

    def run(job: Callable[[], Result]) -> tuple[bool, Result | None]:
        if over.is_set():
            return False, None
        context.addJobTag(tag)
        try:
            return True, job()
        except Exception:
            if over.is_set():
                return False, None
            raise
        finally:
            context.removeJobTag(tag)

    end = None if seconds is None else time.monotonic() + seconds
    with ThreadPoolExecutor(min(parallelism, len(jobs))) as pool:
        # Wrapped once a job, as each wrapper copies the local properties that its thread then changes.
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), job) for name, job in jobs.items()}
        wait(futures.values(), None if end is None else max(0.0, end - time.monotonic()))
        over.set()
        while not all(f.done() for f in futures.values()):
            context.cancelJobsWithTag(tag)
            wait(futures.values(), PAUSE)
        outcomes = {name: f.result() for name, f in futures.items()}
    done = {name: value for name, (in_time, value) in outcomes.items() if in_time}
    if not done:
        raise OutOfTime(f"nothing was done within {seconds} seconds")
    return done


class Budget:
    """A limit shared by the steps of a run."""

    def __init__(self, seconds: float | None):
        self.end = None if seconds is None else time.monotonic() + seconds

    def left(self) -> float | None:
        return None if self.end is None else max(0.0, self.end - time.monotonic())
