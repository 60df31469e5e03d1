"""A data source of saved or fetched answers: pages per partition, retries with backoff, bounds applied by the reader."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from itertools import groupby
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY = (429, 500, 502, 503)


class SourceError(Exception):
    """status: the code of an answer, None for a network failure or a timeout."""

    def __init__(self, kind: str, status: int | None = None, retry_after: float | None = None) -> None:
        super().__init__(f"{kind} {status or ''}".strip())
        self.kind, self.status, self.retry_after = kind, status, retry_after


def with_retries(fetch: Callable[[], str], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """fetch, repeated after 429 and server errors with growing pauses (or as long as the answer asks); others raise."""
    for n in range(tries):
        try:
            return fetch()
        except SourceError as e:
            if e.status not in RETRY or n == tries - 1:
                raise
            sleep(e.retry_after if e.retry_after is not None else 1.5 * 2**n)
    raise AssertionError("not reached")


class Pacer:
    """At least ``gap`` seconds between the calls to one source, whichever thread makes them."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.free = gap, clock, sleep, None
        self.lock = threading.Lock()

    def wait(self) -> float:
        with self.lock:  # each caller books the next free moment, then waits for it by itself
            now = self.clock()
            start = now if self.free is None else max(now, self.free)
            self.free = start + self.gap
        if start > now:
            self.sleep(start - now)
        return start - now


class InFlight:
    """One fetch at a time for each address: callers that ask for it meanwhile get the same answer or failure."""

    def __init__(self) -> None:
        self.lock, self.open = threading.Lock(), {}

    def get(self, address: object, fetch: Callable[[], object]) -> object:
        with self.lock:
            first = address not in self.open
            answer = self.open.setdefault(address, Future())
        if first:
            try:
                answer.set_result(fetch())
            except BaseException as e:
                answer.set_exception(e)
            finally:
                with self.lock:
                    del self.open[address]
        return answer.result()


class _Pages(InputPartition):
    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)


class _Reader(DataSourceReader):
    """Bounds come as options, not as pushed filters: this version of Spark keeps a reader, and with it the filters
    of one query, for all later queries of the same frame."""

    def __init__(self, options: dict) -> None:
        self.root, self.limit = options.get("path", ""), int(options.get("limit", 0))
        self.min_year = int(options["min_year"]) if "min_year" in options else None
        self.field = options.get("field")

    def partitions(self) -> list[InputPartition]:
        pages = [str(p) for p in sorted(Path(self.root).glob("*.json")) if self.field in (None, p.name.split("-")[0])]
        if not self.limit:
            return [_Pages((p,)) for p in pages]
        # a limit counts over the pages of a field, so one task reads them
        return [_Pages(tuple(own)) for _, own in groupby(pages, key=lambda p: Path(p).name.split("-")[0])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 0
        for page in partition.value:
            body = with_retries(lambda page=page: Path(page).read_text(encoding="utf-8"))
            for r in json.loads(body):
                if self.min_year is not None and r.get("year") is not None and r["year"] < self.min_year:
                    continue
                if self.limit and n >= self.limit:
                    return
                n += 1
                yield (Path(page).name.split("-")[0], r.get("title"), r.get("abstract") or "", r.get("year"), r.get("source") or "")


class SavedAnswers(DataSource):
    """format("saved_answers"): JSON pages <field>-<n>.json of records; options min_year, field and limit (per field)."""

    @classmethod
    def name(cls) -> str:
        return "saved_answers"

    def schema(self) -> str:
        return "field string, title string, abstract string, year int, source string"

    def reader(self, schema) -> DataSourceReader:  # type: ignore[no-untyped-def]
        return _Reader(self.options)


def fan_out(jobs: dict[str, Callable[[], object]], deadline: float) -> tuple[dict[str, object], list[tuple[str, str, str]]]:
    """(results, errors) of jobs that run at once under one deadline; failures and stragglers are reported, not raised."""
    from concurrent.futures import ThreadPoolExecutor, wait

    pool = ThreadPoolExecutor(max_workers=8)
    started = {name: pool.submit(job) for name, job in jobs.items()}
    wait(started.values(), timeout=deadline)
    results: dict[str, object] = {}
    errors: list[tuple[str, str, str]] = []
    for name, future in started.items():
        if not future.done():
            errors.append((name, "timeout", f"no answer within {deadline:g} s"))
            continue
        try:
            results[name] = future.result()
        except SourceError as e:
            kind = "timeout" if e.kind == "timeout" else "rate_limit" if e.status == 429 else "http_error" if e.status else "network"
            errors.append((name, kind, str(e)))
        except Exception as e:
            errors.append((name, "bad_response", type(e).__name__))
    pool.shutdown(wait=False, cancel_futures=True)
    return results, errors
