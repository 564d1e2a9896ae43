"""A batch data source of fetched pages: `spark.read.format("site").option("urls", ...)`.

Each partition fetches its share of the URLs with a pause between requests; a fetcher other than HTTP can be
registered by name, which is how tests run without a network.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, body binary, error string"
Fetched = tuple[int, str, bytes]


def http(url: str, timeout: float = 30.0) -> Fetched:
    request = urllib.request.Request(url, headers={"User-Agent": "atlaskb/1"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status, answer.headers.get("Content-Type", ""), answer.read()


def from_text(url: str, timeout: float = 0) -> Fetched:
    """For tests: the page is in the URL, as in `text:<p>hello</p>`."""
    return 200, "text/html", url.partition(":")[2].encode()


FETCHERS: dict[str, Callable[..., Fetched]] = {"http": http, "text": from_text}


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = max(1, int(options.get("partitions", "1")))
        self.delay = float(options.get("delay", "0.3"))
        self.fetcher = options.get("fetcher", "http")

    def partitions(self) -> list[_Urls]:
        return [_Urls(self.urls[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i and self.delay:
                time.sleep(self.delay)
            try:
                yield (url, *FETCHERS[self.fetcher](url), None)
            except Exception as e:  # noqa: BLE001  a page that can't be fetched is a row with its error
                yield url, None, None, None, f"{type(e).__name__}: {e}"


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
