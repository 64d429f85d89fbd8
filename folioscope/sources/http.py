"""Pages over HTTP as a Spark data source: allowlist before the request and after redirects, size limit, retries with backoff."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, content_type string, body binary, retries int, error string, fetched_at timestamp"
#: Size of a read, and statuses that are worth another try.
READ, AGAIN = 64 << 10, {429, 500, 502, 503, 504}


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.hosts = {h for h in options.get("hosts", "").split(",") if h}
        self.slices = int(options.get("slices", "8"))
        self.limit = int(options.get("max_bytes", str(16 << 20)))
        self.tries = int(options.get("tries", "3"))
        self.timeout = float(options.get("timeout", "20"))
        self.pause = float(options.get("pause", "0.5"))
        self.redirects = options.get("redirects", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[i :: self.slices]) for i in range(min(self.slices, len(self.urls)))] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            yield self._fetch(url)

    def _allowed(self, url: str) -> bool:
        host = (urllib.parse.urlsplit(url).hostname or "").lower().removeprefix("www.")
        return not self.hosts or host in self.hosts

    def _fetch(self, url: str) -> tuple:
        from datetime import datetime, timezone

        def row(status=None, kind=None, body=None, retries=0, error=None, final=None):
            return url, final or url, status, kind, body, retries, error, datetime.now(timezone.utc)

        if not self._allowed(url):
            return row(error="not_allowlisted")
        opener = urllib.request.build_opener(*([] if self.redirects else [_NoRedirect]))
        for attempt in range(self.tries):
            try:
                with opener.open(urllib.request.Request(url, headers={"User-Agent": "folioscope"}), timeout=self.timeout) as r:
                    if not self._allowed(r.geturl()):
                        return row(r.status, retries=attempt, error="redirect_not_allowlisted", final=r.geturl())
                    body = bytearray()
                    while chunk := r.read(READ):
                        body += chunk
                        if len(body) > self.limit:
                            return row(r.status, retries=attempt, error="too_large", final=r.geturl())
                    return row(r.status, r.headers.get("Content-Type"), bytes(body), attempt, None, r.geturl())
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or attempt + 1 == self.tries:
                    return row(e.code, retries=attempt, error="redirect" if 300 <= e.code < 400 else f"http_{e.code}")
            except (OSError, ValueError) as e:
                if attempt + 1 == self.tries:
                    return row(retries=attempt, error=f"transport:{type(e).__name__}")
            time.sleep(self.pause * 2**attempt * (1 + random.random()))
        return row(error="no_tries")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("urls", ...).option("hosts", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))
