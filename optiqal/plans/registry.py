"""Checks: an ordered list of functions over the shared tables, each kept apart from the failure of the others."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from threading import Lock, Thread

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Check = Callable[[Mapping[str, DataFrame]], DataFrame]
RESULTS = "name string, rows long, message string"
#: Checks that run at a time, and the seconds after which one that is still running is stopped.
AT_A_TIME, TIME_LIMIT = 4, 1800.0


class Checks:
    def __init__(self) -> None:
        self._checks: dict[str, Check] = {}

    def register(self, name: str, check: Check) -> None:
        """Add a check at the end, or replace the one of that name."""
        self._checks[name] = check

    def run(self, spark: SparkSession, tables: Mapping[str, DataFrame], write: Callable[[str, DataFrame], None], time_limit: float = TIME_LIMIT, at_a_time: int = AT_A_TIME) -> DataFrame:
        """(name, rows, message) of each check, in the order of registration, after all have ended.

        `write` gets each check's rows and writes them; their number is observed meanwhile (null if `write` runs no job on
        them). A check that raises has its message here. One still running after time_limit seconds has its jobs cancelled
        and a message; what it does beyond Spark can't be stopped, but is no longer waited for, and its later jobs are refused.
        """
        results: dict[str, tuple[int | None, str | None]] = {}
        waiting, lock = list(self._checks.items()), Lock()
        context, session = spark.sparkContext, uuid.uuid4().hex
        started: dict[str, float] = {}

        def one(name: str, check: Check) -> tuple[int | None, str | None]:
            seen = Observation(f"rows-{uuid.uuid4().hex}")
            context.addJobTag(f"{session}-{name_tag[name]}")
            try:
                rows = check(tables)
                if time.monotonic() - started[name] > time_limit:
                    raise TimeoutError
                counted: list[int] = []
                write(name, rows.observe(seen, F.count(F.lit(1)).alias("rows")))
                reader = Thread(target=lambda: counted.append(seen.get["rows"]), daemon=True)
                reader.start()
                reader.join(2)  # without a job on the rows there is nothing to see
                return (counted[0] if counted else None), None
            except Exception as e:  # whatever a check raises is its own error row
                return None, f"{type(e).__name__}: {str(e)[:500]}"
            finally:
                context.removeJobTag(f"{session}-{name_tag[name]}")

        name_tag = {name: str(i) for i, name in enumerate(self._checks)}

        def work() -> None:
            while True:
                with lock:
                    if not waiting:
                        return
                    name, check = waiting.pop(0)
                    started[name] = time.monotonic()
                found = one(name, check)
                with lock:
                    if name in results:  # it was given up meanwhile, and so was this worker
                        return
                    results[name] = found

        def worker() -> None:
            Thread(target=inheritable_thread_target(spark)(work), daemon=True).start()

        for _ in range(min(at_a_time, len(waiting))):
            worker()
        while len(results) < len(self._checks):
            time.sleep(0.05)
            with lock:
                late = [n for n, t in started.items() if n not in results and time.monotonic() - t > time_limit]
                for name in late:
                    results[name] = None, f"TimeoutError: stopped after {time_limit:g} seconds"
            for name in late:
                context.cancelJobsWithTag(f"{session}-{name_tag[name]}")
                worker()  # in place of the one that hangs
        with lock:
            return spark.createDataFrame([(n, *results[n]) for n in self._checks], RESULTS)
