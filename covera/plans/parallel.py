"""Independent Spark work submitted from several driver threads.

A grid search has fits that do not depend on one another; each spends most of
its time on small jobs that leave executors idle.  Every task runs in a thread
of its own with a scheduler pool of its own, so that with
``spark.scheduler.mode=FAIR`` their jobs share the executors evenly (with FIFO
they fill what the older jobs leave free).  Results come in the order of the
tasks; the first failure is raised after the running tasks have ended.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Driver threads of one search; more tasks wait for a free one.
THREADS = 8
POOL = "spark.scheduler.pool"
_numbers = itertools.count()


def concurrently(spark: SparkSession, tasks: Sequence[Callable], threads: int = THREADS) -> list:
    """The results of all ``tasks``; nested calls have threads and pools of their own."""
    tasks = list(tasks)
    if threads <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    sc = spark.sparkContext

    def pooled(task):
        name = f"covera-{next(_numbers)}"

        def run():
            outer = sc.getLocalProperty(POOL)
            sc.setLocalProperty(POOL, name)
            try:
                return task()
            finally:
                sc.setLocalProperty(POOL, outer)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(min(threads, len(tasks))) as pool:
        futures = [pool.submit(pooled(t)) for t in tasks]
    return [f.result() for f in futures]
