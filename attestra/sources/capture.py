"""Capture of public pages: one paced stream of requests for each host.

Urls are dealt by host, so that a host hears from one task at a time, and kept
``interval`` seconds apart.  Before anything is sent a url is checked (scheme,
credentials, the list of hosts), its host resolved, and every address it resolves
to looked at: the connection is then made to the checked address itself, so that a
second look-up can't lead elsewhere.  Redirects are not followed.  What doesn't give
a page is a row with a status, never a failed task.

The pages of one host follow one another by intent; they pass through, none is
held, and a host's share of the work is waiting.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import public_address

CAPTURE = "url string, host string, status string, code int, bytes bigint, sha256 string, content binary, retryable boolean"


def resolve(host: str, port: int) -> list[str]:
    return [info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]


@dataclass(frozen=True)
class Policy:
    """What may be fetched and how.  ``local`` are hosts that may be private (fixtures)."""

    hosts: Sequence[str]
    agent: str = "attestra"
    interval: float = 1.0
    timeout: float = 10.0
    most_bytes: int = 2 << 20
    local: Sequence[str] = ()
    resolve: Callable[[str, int], list[str]] = field(default=resolve)

    def refused(self, url: str) -> str | None:
        """Why a url may not be asked for; nothing, if it may."""
        try:
            parts = urlsplit(url)
            port = parts.port
        except ValueError:
            return "URL"
        if parts.scheme not in ("http", "https"):
            return "SCHEME"
        if parts.username or parts.password:
            return "CREDENTIALS"
        if port == 0 or (parts.hostname or "").lower() not in self.hosts:
            return "HOST"
        return None

    def address(self, host: str, port: int) -> str | None:
        """An address to connect to; nothing, if one of them isn't public."""
        found = self.resolve(host, port)
        if host not in self.local and not all(public_address(a) for a in found):
            return None
        return found[0] if found else None


class _Plain(http.client.HTTPConnection):
    """A connection to a checked address, under the name of its host."""

    address: str

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)


class _Secure(_Plain):
    def connect(self) -> None:
        super().connect()
        self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)


def fetch(url: str, policy: Policy) -> tuple[str, int | None, bytes | None, bool]:
    """(status, code, content, whether trying again may help)."""
    why = policy.refused(url)
    if why:
        return why, None, None, False
    parts = urlsplit(url)
    host, port = parts.hostname.lower(), parts.port or (443 if parts.scheme == "https" else 80)
    deadline = time.monotonic() + policy.timeout
    connection = None
    try:
        address = policy.address(host, port)
        if address is None:
            return "ADDRESS", None, None, False
        connection = (_Secure if parts.scheme == "https" else _Plain)(host, port, timeout=policy.timeout)
        connection.address = str(ipaddress.ip_address(address))
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": policy.agent, "Accept-Encoding": "identity"})
        answer = connection.getresponse()
        if 300 <= answer.status < 400:
            return "REDIRECT", answer.status, None, False
        if answer.status >= 400:
            return "ERROR", answer.status, None, answer.status >= 500
        held, size = [], 0
        while piece := answer.read1(64 << 10):
            size += len(piece)
            if size > policy.most_bytes:
                return "TOO_LARGE", answer.status, None, False
            if time.monotonic() > deadline:
                return "TIMEOUT", answer.status, None, True
            held.append(piece)
        return "CAPTURED", answer.status, b"".join(held), False
    except TimeoutError:
        return "TIMEOUT", None, None, True
    except (OSError, http.client.HTTPException, ValueError):
        return "TRANSPORT", None, None, True
    finally:
        if connection:
            connection.close()


def captures(urls: DataFrame, policy: Policy, url_col: str = "url") -> DataFrame:
    """A row for each distinct url: its page, or why there is none."""
    import hashlib

    schema = [f.split() for f in CAPTURE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, float] | None = None
        for b in batches:
            for url, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last and last[0] == host:
                    time.sleep(max(0.0, policy.interval - (time.monotonic() - last[1])))
                status, code, content, again = fetch(url, policy)
                if code is not None or status in ("TIMEOUT", "TRANSPORT"):
                    last = host, time.monotonic()
                row = (url, host, status, code, None if content is None else len(content), None if content is None else hashlib.sha256(content).hexdigest(), content, again)
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(row, schema, strict=True)], [n for n, _ in schema])

    authority = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    wanted = urls.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).distinct().withColumn("host", host)
    return wanted.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, CAPTURE)
