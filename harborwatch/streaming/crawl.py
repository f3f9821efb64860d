"""List pages of a crawl as they land: state per origin, so that a crawl may reach the stream in any number of batches.

A crawl of an origin begins with its first page (number 0) and reads on until it meets the link that was newest when the
crawl before began. Pages may land late or out of order: a page's links are given out once all pages before it have
been, and those after the known link never. A crawl ends when the next one begins, or when nothing has landed for
``idle``; pages that still wait for a missing one are given out then, in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "kind string, origin_id long, page_no long, pos int, value string, key string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CRAWL = "base string, newest string, number long, running boolean, hit boolean, ready long"


class CrawlProcessor(StatefulProcessor):
    """Rows of FOUND from the pages (origin_id, page_no, url, links, next_url, known) of one origin.

    State: the link at which the crawl ends (``base``), the one at which the next will (``newest``), the number of pages
    that have been given out in order (``ready``), pages that wait for one before them, and pages that belong to a crawl
    whose first page hasn't landed. Captures of one page number in one batch count as one page.
    """

    def __init__(self, offset: int, idle_ms: int):
        self.offset, self.idle_ms = offset, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.crawl = handle.getValueState("crawl", _CRAWL)
        self.waiting = handle.getMapState("waiting", "page_no long", "links array<string>")
        self.early = handle.getMapState("early", "page_no long", "links array<string>")

    def close(self) -> None:
        pass

    def _load(self, origin: int, known: str | None) -> None:
        self.origin, self.out, self.given = origin, [], set()
        if self.crawl.exists():
            self.base, self.newest, self.number, self.running, self.hit, self.ready = self.crawl.get()
        else:
            self.base, self.newest, self.number, self.running, self.hit, self.ready = known, known, 0, False, False, 0

    def _save(self) -> Iterator[pd.DataFrame]:
        self.crawl.update((self.base, self.newest, self.number, self.running, self.hit, self.ready))
        if self.out:
            yield pd.DataFrame(self.out, columns=["kind", "origin_id", "page_no", "pos", "value", "key"])

    def _row(self, kind: str, page_no: int, pos: int, value: str, key: str) -> None:
        self.out.append((kind, self.origin, page_no, pos, value, key))

    def _give(self, page_no: int) -> None:
        """The links of a waiting page, up to the known one."""
        (links,) = self.waiting.getValue((page_no,))
        self.waiting.removeKey((page_no,))
        for pos, link in enumerate(links):
            if self.hit or (link is not None and link == self.base):
                self.hit = True
                return
            if link is not None and link not in self.given:
                self.given.add(link)
                self._row("link", page_no, pos, link, link)

    def _numbers(self, pages) -> list[int]:
        return sorted(k[0] for k in pages.keys())

    def _end(self) -> None:
        for page_no in self._numbers(self.waiting):
            self._give(page_no)
        self.running, self.base = False, self.newest

    def _begin(self) -> None:
        self.base, self.number, self.running, self.hit, self.ready = self.newest, self.number + 1, True, False, 0
        for page_no in self._numbers(self.early):
            self.waiting.updateValue((page_no,), self.early.getValue((page_no,)))
        self.early.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        landed = pd.concat(list(rows)).sort_values(["page_no", "url"], kind="stable")
        known = landed["known"].dropna()
        self._load(int(key[0]), known.iloc[0] if len(known) else None)
        for page_no, captures in landed.groupby("page_no", sort=True):
            page_no = int(page_no)
            links = list(dict.fromkeys(x for part in captures["links"] if part is not None for x in part))
            forward = [x for x in dict.fromkeys(captures["next_url"]) if isinstance(x, str)]
            if page_no == 0:
                if self.running:
                    self._end()
                self._begin()
                if len(links) > self.offset:
                    self.newest = links[self.offset]
                    self._row("last_url", 0, -1, self.newest, str(self.number))
            mine = self.running and page_no >= self.ready and not self.waiting.containsKey((page_no,))
            (self.waiting if mine else self.early).updateValue((page_no,), (links,))
            for x in forward:
                self._row("next", page_no, -1, x, f"{self.number}:{page_no}:{x}")
            while self.running and self.waiting.containsKey((self.ready,)):
                self._give(self.ready)
                self.ready += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(int(key[0]), None)
        self._end()
        if self._numbers(self.early):  # the pages of a crawl whose first page never landed
            self._begin()
            self._end()
        yield from self._save()


def found_on_pages(rows: DataFrame, origin: DataFrame, offset: int, idle_ms: int) -> DataFrame:
    """A stream of FOUND from a stream of (origin_id, page_no, url, links, next_url); a link once per origin."""
    known = origin.groupBy("origin_id").agg(F.max("last_url").alias("known"))
    found = rows.join(known, "origin_id", "left").groupBy("origin_id").transformWithStateInPandas(
        CrawlProcessor(offset, idle_ms), FOUND, "Append", "ProcessingTime"
    )
    return found.dropDuplicates(["kind", "origin_id", "key"])
