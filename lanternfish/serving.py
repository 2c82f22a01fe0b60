"""What a server around the queries needs besides them: results kept for a while, admission, paths of result pages, when to crawl next."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

#: Seconds that results, the API's lists, numbers and lists of hosts are kept.
KEEP = {"search": 600, "api": 8 * 3600, "statistics": 6 * 3600, "hosts": 8 * 3600}
IN_FLIGHT, LONGEST_WAIT = 64, 512
#: Wednesday and Sunday.
RUN_DAYS = (2, 6)


class Kept:
    """Values by key for some seconds; frames are persisted as long, so that pages of one result don't compute it again.

    search results are kept twice by their callers: by query text before filters, and by text and filters after them.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.held = clock, {}

    def get(self, kind: str, key: Any, make: Callable[[], Any]) -> Any:
        self.drop_old()
        if (kind, key) not in self.held:
            value = make()
            self.held[kind, key] = (self.clock() + KEEP[kind], value.persist() if isinstance(value, DataFrame) else value)
        return self.held[kind, key][1]

    def drop_old(self) -> None:
        for k in [k for k, (until, _) in self.held.items() if until <= self.clock()]:
            value = self.held.pop(k)[1]
            if isinstance(value, DataFrame):
                value.unpersist()


def wait(in_flight: int) -> int | None:
    """Seconds to come back after where too many searches run already; None if there is room."""
    return min(2 ** (in_flight // IN_FLIGHT), LONGEST_WAIT) if in_flight > IN_FLIGHT else None


def page_path(term: str, page: int = 1, verbose: bool = False) -> str:
    """The path of a page of results; term is encoded already. The first page has no number."""
    start = "/v/search" if verbose else "/search"
    return f"{start}/{page}?{term}" if page > 1 else f"{start}?{term}"


def jump(term: str, page: str, verbose: bool = False) -> str | None:
    """Where a request for a page by its number goes; None, that is a question for the number, if it is none."""
    return page_path(term, int(page), verbose) if page.isdigit() and int(page) > 0 else None


def next_run(now: dt.datetime, days: tuple[int, ...] = RUN_DAYS) -> dt.datetime:
    """The next midnight after now that begins one of the weekdays (Monday: 0)."""
    day = dt.datetime.combine(now.date(), dt.time(), now.tzinfo)
    return next(x for x in (day + dt.timedelta(days=k) for k in range(1, 9)) if x.weekday() in days)
