"""A paged JSON API as a Spark data source.

``spark.dataSource.register(RegistrySource)``, then
``spark.read.format("registry").option("url", ...).load()``.  One partition asks
page after page; answers are checked for contract version, page number, repeated
ids and a bound of pages.  Only timeouts, transport errors, 429 and 5xx are
tried again, after Retry-After where it is given.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

CONTRACT_VERSION = "1.0.0"
SCHEMA = "employee_id string, full_name string, role string, hourly_rate_eur string, contract_start string, contract_end string"


class RegistryError(RuntimeError):
    """An answer that can't be used."""


def get(url: str, attempts: int = 3, timeout: float = 5.0, most: int = 5 << 20, wait: float = 0.2) -> bytes:
    """The body of a url within a byte ceiling."""
    last: Exception | None = None
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                body = answer.read(most + 1)
            if len(body) > most:
                raise RegistryError("answer is over the byte ceiling")
            return body
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise RegistryError(f"status {e.code}") from e
            last = e
            given = e.headers.get("Retry-After", "")
            pause = float(given) if given.isdigit() else wait * 2**k
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last, pause = e, wait * 2**k
        if k + 1 < attempts:
            time.sleep(min(pause, 5.0))
    raise RegistryError(f"no answer after {attempts} attempts: {last}")


def fetch(url: str, page_size: int = 50, max_pages: int = 200) -> Iterator[dict]:
    seen: set[str] = set()
    for page in range(1, max_pages + 1):
        data = json.loads(get(f"{url}?page={page}&page_size={page_size}"))
        if data.get("contract_version") != CONTRACT_VERSION:
            raise RegistryError(f"contract version {data.get('contract_version')}")
        if data.get("page") != page:
            raise RegistryError(f"asked for page {page}, got {data.get('page')}")
        for item in data["items"]:
            if item["employee_id"] in seen:
                raise RegistryError(f"repeated id {item['employee_id']}")
            seen.add(item["employee_id"])
            yield item
        if not data.get("has_more"):
            return
    raise RegistryError("over the bound of pages")


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(self.options)


class RegistryReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url = options["url"]
        self.page_size = int(options.get("page_size", "50"))
        self.max_pages = int(options.get("max_pages", "200"))

    def read(self, partition) -> Iterator[tuple]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for item in fetch(self.url, self.page_size, self.max_pages):
            yield tuple(None if item.get(n) is None else str(item[n]) for n in names)
