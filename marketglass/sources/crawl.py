"""Detail pages of a marketplace as a stream whose offset is the crawl's frontier.

A list page names detail pages and the next list page. Each step of the stream reads one list page on the driver; its detail
pages not read before become partitions, read by the executors. A step's links are written in the frontier's folder before the
step begins, so a crawl that was stopped goes on with the same links and reads no page twice.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

DETAIL = r'<a[^>]*class="[^"]*\bproduct\b[^"]*"[^>]*href="([^"]+)"'
NEXT = r'<a[^>]*class="[^"]*\bnext\b[^"]*"[^>]*href="([^"]+)"'


def fetched(url: str) -> tuple[str | None, str | None]:
    """Body and error: one of them is null."""
    from urllib.error import URLError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=5) as answer:  # noqa: S310
            return answer.read().decode("utf-8", "replace"), None
    except (URLError, OSError, ValueError) as error:
        return None, str(error)


class Detail(InputPartition):
    def __init__(self, step: int, url: str):
        self.step, self.url = step, url


class Crawl(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.start, self.folder = options["address"], options["frontier"]
        self.detail, self.next = re.compile(options.get("detail", DETAIL)), re.compile(options.get("next", NEXT))
        os.makedirs(self.folder, exist_ok=True)
        self.seen: set[str] = set()
        self.done = 0
        self.ahead: str | None = self.start
        while (step := self._step(self.done + 1)) is not None:
            self._take(step)

    def _step(self, n: int) -> dict | None:
        try:
            with open(f"{self.folder}/{n}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _take(self, step: dict) -> None:
        self.seen.update([step["list"], *step["urls"]])
        self.done, self.ahead = self.done + 1, step["next"]

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        """One list page further, if there is one that wasn't read; a broken one ends the list, and is told as a page."""
        if self.ahead and self.ahead not in self.seen:
            body, error = fetched(self.ahead)
            links = [urljoin(self.ahead, unescape(m)) for m in self.detail.findall(body or "")]
            following = self.next.search(body or "")
            step = {"list": self.ahead, "urls": [u for u in dict.fromkeys(links) if u not in self.seen] + ([self.ahead] if error else []), "next": urljoin(self.ahead, unescape(following[1])) if following else None}
            with open(f"{self.folder}/.{self.done + 1}", "w", encoding="utf-8") as f:
                json.dump(step, f)
            os.replace(f"{self.folder}/.{self.done + 1}", f"{self.folder}/{self.done + 1}.json")
            self._take(step)
        return {"step": self.done}

    def partitions(self, start: dict, end: dict) -> list[Detail]:
        return [Detail(n, url) for n in range(start["step"] + 1, end["step"] + 1) for url in self._step(n)["urls"]]

    def read(self, partition: Detail) -> Iterator[tuple]:
        yield (partition.step, partition.url, *fetched(partition.url))


class CrawlPages(DataSource):
    """spark.readStream.format("crawl_pages").option("address", first list page).option("frontier", a shared folder);
    options detail and next: expressions whose first group is a link."""

    @classmethod
    def name(cls) -> str:
        return "crawl_pages"

    def schema(self) -> str:
        return "step int, url string, body string, error string"

    def streamReader(self, schema) -> Crawl:
        return Crawl(self.options)
