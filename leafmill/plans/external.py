"""Calls to models, renderers and browsers as injected functions.

A call is a Python function of a request; what surrounds it is DataFrame work: requests are written before any call
(``dry_run`` ends there), calls run in partitions of bounded number with retries, answers are checked, and the rows that
fail are asked again for a bounded number of rounds. Answers are keyed by the request's hash, so a task that runs
twice asks the same thing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.sources.shipping import ship

#: Answers that are worth another try.
RETRY_CODES = (429, 500, 502, 503, 504)


class CallError(Exception):
    """An injected function's failure with a status code."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(message or str(code))
        self.code = code


@dataclass(frozen=True)
class Retries:
    """Tries after the first and the seconds between them: base * backoff ** attempt, at most longest."""

    count: int = 6
    base: float = 2.0
    backoff: float = 2.0
    longest: float = 60.0

    def delay(self, attempt: int) -> float:
        return min(self.longest, self.base * self.backoff**attempt)

    def call(self, function: Callable[[str], str], request: str, sleep: Callable[[float], None] = time.sleep) -> str:
        for attempt in range(self.count + 1):
            try:
                return function(request)
            except (CallError, TimeoutError, ConnectionError) as error:
                if attempt == self.count or (isinstance(error, CallError) and error.code not in RETRY_CODES):
                    raise
                sleep(self.delay(attempt))
        raise AssertionError


def requests(rows: DataFrame, key: str, payload: Column, system: Column | None = None) -> DataFrame:
    """key, request (JSON text) and request_hash."""
    body = F.to_json(F.struct(*([system.alias("system")] if system is not None else []), payload.alias("payload")))
    return rows.select(key, body.alias("request")).withColumn("request_hash", F.sha2("request", 256))


def system_prompt(images: Column, with_images: str, without: str) -> Column:
    return F.when(F.coalesce(images, F.lit(0)) > 0, F.lit(with_images)).otherwise(F.lit(without))


def answers(asked: DataFrame, key: str, function: Callable[..., str], retries: Retries = Retries(), parallel: int = 3, attachments: Sequence[str] = ()) -> DataFrame:
    """key, request_hash, answer and error: one call per row, in ``parallel`` tasks. A failure is a row with an error.

    attachments: columns (a page's picture as binary, say) that the function gets after the request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h, request, *others in zip(b[key], b["request_hash"], b["request"], *(b[c] for c in attachments), strict=True):
                try:
                    rows.append((k, h, retries.call(lambda text, others=others: function(text, *others), request), None))
                except Exception as error:  # one page's failure leaves the others
                    rows.append((k, h, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[key, "request_hash", "answer", "error"])

    kind = dict(asked.dtypes)[key]
    ship(asked.sparkSession)
    return asked.select(key, "request_hash", "request", *attachments).repartition(parallel).mapInPandas(run, f"{key} {kind}, request_hash string, answer string, error string")


def changed_pages(pages: DataFrame, before: DataFrame, key: str, content: str) -> DataFrame:
    """The pages whose content isn't what it was before: the next round measures these only."""
    same = before.select(key, F.sha2(content, 256).alias("_was"))
    return pages.join(same, (pages[key] == same[key]) & (F.sha2(pages[content], 256) == F.col("_was")), "left_anti")


def repaired(asked: DataFrame, key: str, function: Callable[[str], str], problem: Column, store: Callable[[DataFrame], DataFrame], rounds: int = 2, retries: Retries = Retries(), dry_run: bool = False) -> DataFrame:
    """key, answer, error and problem after up to ``rounds`` further questions for the rows that have a problem.

    problem: over answer, null where it is good. store: writes a DataFrame and reads it again, so that no call is made twice. Every
    failing row is asked again in each round and measured after the last; a row that still fails says so. dry_run: the requests
    only, without calls.
    """
    asked = store(asked)
    if dry_run:
        return asked.select(key, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit("not asked").alias("problem"))
    state = store(answers(asked, key, function, retries).withColumn("problem", problem))
    for turn in range(rounds):
        bad = state.where("problem is not null and error is null")
        if bad.isEmpty():
            break
        again = F.to_json(F.struct(F.col("request").alias("request"), F.col("answer").alias("last_answer"), F.col("problem"), F.lit(turn + 1).alias("round")))
        question = asked.join(bad.drop("request_hash"), key).select(key, again.alias("request")).withColumn("request_hash", F.sha2("request", 256))
        new = store(answers(question, key, function, retries).withColumn("problem", problem))
        state = store(state.join(new, key, "left_anti").unionByName(new))
    return state.select(key, "answer", "error", "problem")


def shrink_scale(fits: Callable[[float], bool], least: float = 0.6, steps: int = 8, font: float = 0.0, least_font: float = 11.0) -> float:
    """The largest scale up to 1 at which content fits, to 2 ** -steps of the range; never below ``least``, nor such that the font gets
    smaller than least_font."""
    least = max(least, min(1.0, least_font / font)) if font else least
    if fits(1.0):
        return 1.0
    low, high = least, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low
