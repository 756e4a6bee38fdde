"""Records of a remote service, page by page, with a limit on the rate and retries.

The request itself is injected, so any client will do: ``fetch(key, token)`` gives (records, next token or None), each record a
JSON text. Keys are dealt over tasks; a task keeps its share of the allowed rate. A key whose request still fails after the
last retry gives one row with the error and none of its records, and the others go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests in a second, retries.
PER_SECOND, RETRIES = 10.0, 3
RECORDS = "key string, page int, seq int, record string, error string"
Fetch = Callable[[str, str | None], tuple[list[str], str | None]]


class Pace:
    """Keeps calls at least ``gap`` seconds apart."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.due = gap, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.due:
            self.sleep(self.due - now)
        self.due = max(now, self.due) + self.gap


def with_retries(call: Callable[[], object], retries: int = RETRIES, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's value; connection errors and time-outs are tried again after waits that double, other errors are raised."""
    for n in range(retries + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if n == retries:
                raise
            sleep(first_wait * 2**n)


def pages(fetch: Fetch, key: str, pace: Pace, retries: int = RETRIES, first_wait: float = 1.0) -> Iterator[list[str]]:
    """The records of each page of a key."""
    token = None
    while True:
        pace.wait()
        records, token = with_retries(lambda t=token: fetch(key, t), retries, first_wait)
        yield records
        if token is None:
            return


def fetch_records(keys: DataFrame, key: str, fetch: Fetch, tasks: int = 8, per_second: float = PER_SECOND, most: int | None = None, retries: int = RETRIES, first_wait: float = 1.0) -> DataFrame:
    """key, page, seq, record, error of every key of ``keys``; at most ``most`` records a key, and no page is asked for beyond."""
    gap = tasks / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap)
        for pdf in batches:
            for k in pdf["key"]:
                rows: list[tuple] = []
                try:
                    for page, records in enumerate(pages(fetch, k, pace, retries, first_wait)):
                        rows += [(k, page, len(rows) + i, r, None) for i, r in enumerate(records)]
                        if most is not None and len(rows) >= most:
                            rows = rows[:most]
                            break
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows = [(k, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["key", "page", "seq", "record", "error"]).astype({"page": "Int32", "seq": "Int32"})

    asked = keys.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct().repartition(tasks, "key")
    return asked.mapInPandas(run, RECORDS)
