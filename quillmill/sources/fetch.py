"""A Python data source that fetches URLs with retries; the transport is injected, so tests need no network."""

from __future__ import annotations

import importlib
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def get_with_retry(get, url: str, tries: int = 3, sleep=time.sleep) -> tuple[int, bytes | None]:
    """(status, body): 200 returns; 429 waits 5 x 2^k, everything else 2^k, up to `tries` times."""
    status = 0
    for k in range(tries):
        try:
            status, body = get(url)
        except OSError:
            status, body = 0, None
        if status == 200:
            return status, body
        if k + 1 < tries:
            sleep((5 if status == 429 else 1) * 2**k)
    return status, None


class _Url(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.least, self.slices = int(options.get("minBytes", "1024")), int(options.get("slices", "8"))
        self.transport = options.get("transport", "")

    def partitions(self):
        return [_Url(self.urls[i :: self.slices]) for i in range(min(self.slices, len(self.urls)))] or [_Url([])]

    def read(self, partition):
        module, _, name = self.transport.partition(":")
        get = getattr(importlib.import_module(module), name)
        for url in partition.urls:
            status, body = get_with_retry(get, url)
            ok = body is not None and len(body) >= self.least
            yield url, status, "ok" if ok else "too_small" if body is not None else "failed", body if ok else None


class FetchSource(DataSource):
    """format("fetch"): options urls (one per line), transport ("module:function"), minBytes, slices."""

    @classmethod
    def name(cls):
        return "fetch"

    def schema(self):
        return "url string, status int, outcome string, content binary"

    def reader(self, schema):
        return _Reader(self.options)
