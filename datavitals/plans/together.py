"""Submitting independent Spark jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

MOST_AT_ONCE = 4


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run the jobs from threads that share the caller's job group, so that one job's last tasks
    do not leave the cluster idle. The first failure is raised."""
    if len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=min(len(jobs), MOST_AT_ONCE)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [s.result() for s in started]
