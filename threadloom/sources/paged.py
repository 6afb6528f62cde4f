"""Conversations of a web service as a data source, for batches and streams: ``spark.read.format("paged_conversations")``.

A transport answers requests; it is named by the option ``transport`` (``module:function``, called with all options), so
that tasks on any machine can make one. Nothing here opens a connection of its own.

A listing comes newest first. In offset pages, neighbouring pages overlap by ``OVERLAP`` items, so that a listing that
moves while it is read shows itself; a page that reaches behind the frontier is read whole and is the last. Details are
fetched by ``parallel`` tasks, each with its part of the pace. A stream's offset is the newest update with the ids that
have it; a batch is what was updated after one offset and up to the next, so it can be asked for again after a restart.

Defined results: an item without an update time belongs to every batch reader's result, and to none of a stream. An
empty listing gives no rows and leaves the offset where it was. An unstable or incomplete listing is an error.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Protocol
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, updated_at timestamp, title string, project string, body string"
# Items of a page, items that two pages share, and requests at once and a second.
PAGE, OVERLAP, BURST, RATE = 100, 20, 20.0, 8 / 15
#: Seconds to wait after a refusal without a time of its own: so many more each time.
REFUSED = 30


class Transport(Protocol):
    """What answers requests, and the clock by which they are paced."""

    def get(self, url: str) -> tuple[int, dict, str]:
        """Status, headers and body; raises ``OSError`` where there is no answer."""

    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class TokenBucket:
    """``burst`` requests at once, then ``rate`` a second."""

    def __init__(self, transport: Transport, burst: float = BURST, rate: float = RATE):
        self.transport, self.burst, self.rate = transport, max(1.0, burst), rate
        self.left, self.at = self.burst, transport.now()

    def take(self) -> None:
        now = self.transport.now()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            self.transport.sleep((1 - self.left) / self.rate)
            self.left, self.at = 1.0, self.transport.now()
        self.left -= 1


@dataclass
class Client:
    """Requests at a bucket's pace, tried again ``retries`` times."""

    transport: Transport
    bucket: TokenBucket
    retries: int = 2
    refused: float = REFUSED

    def get(self, url: str):
        """The JSON at ``url``. A refusal waits longer each time, and at least as long as it says itself; any other fault a few seconds."""
        for attempt in range(self.retries + 1):
            self.bucket.take()
            status, headers = None, {}
            try:
                status, headers, body = self.transport.get(url)
                if status < 400:
                    return json.loads(body)
                fault: Exception = OSError(f"{url}: status {status}")
            except (OSError, ValueError) as e:
                fault = e
            if attempt == self.retries:
                raise fault
            wait = 1.0 + attempt
            if status == 429:
                says = str({k.lower(): v for k, v in headers.items()}.get("retry-after", ""))
                wait = max(self.refused * (attempt + 1), float(says) if says.isdigit() else 0.0)
            self.transport.sleep(wait)
        raise AssertionError("not reached")


def moment(value) -> datetime | None:
    """A time of a listing: seconds, or ISO text."""
    if value is None or value == "":
        return None
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(value, UTC)
    t = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=UTC)


@dataclass(frozen=True)
class Item:
    """One line of a listing, and where its details are."""

    id: str
    updated: datetime | None
    title: str | None
    project: str | None
    url: str


def offset_pages(client: Client, base: str, enough: Callable[[list[Item]], bool]) -> Iterator[Item]:
    """Items of overlapping pages, each once, until a page is ``enough`` or the listing ends."""
    seen: set[str] = set()
    tail: set[str] = set()
    offset, total = 0, None
    while True:
        page = client.get(f"{base}/backend-api/conversations?offset={offset}&limit={PAGE}&order=updated")
        raw, says = page.get("items") or [], page.get("total")
        if total is not None and says is not None and says < total:
            raise OSError(f"the listing shrank from {total} to {says}")
        total = total if says is None else says
        if not raw:
            if says is not None and offset < says:
                raise OSError(f"the listing ends at {offset} of {says}")
            return
        ids = [i["id"] for i in raw]
        if offset and tail.isdisjoint(ids):
            raise OSError(f"the page at {offset} shares nothing with the one before")
        tail = set(ids[-OVERLAP:])
        new = [Item(i["id"], moment(i.get("update_time")), i.get("title"), i.get("gizmo_id"), f"{base}/backend-api/conversation/{quote(i['id'])}") for i in {i["id"]: i for i in raw}.values() if i["id"] not in seen]
        seen.update(i.id for i in new)
        yield from new
        if enough(new) or (says is not None and offset + len(raw) >= says):
            return
        offset += max(1, len(raw) - OVERLAP)


def whole_list(client: Client, base: str, _: Callable[[list[Item]], bool]) -> Iterator[Item]:
    """Items of the first organisation's one listing, newest first."""
    organisations = client.get(f"{base}/api/organizations")
    if not organisations:
        raise OSError("no organisation")
    root = f"{base}/api/organizations/{quote(organisations[0]['uuid'])}/chat_conversations"
    items = [Item(i["uuid"], moment(i.get("updated_at") or i.get("created_at")), i.get("name"), i.get("project_uuid"), f"{root}/{quote(i['uuid'])}") for i in client.get(root)]
    yield from sorted(items, key=lambda i: i.updated or datetime.min.replace(tzinfo=UTC), reverse=True)


LISTINGS = {"offset_pages": offset_pages, "whole_list": whole_list}


@dataclass(frozen=True)
class Span:
    """What was updated after ``start``, its ``done`` ids left out, and up to ``end``; either may be open."""

    start: datetime | None = None
    done: frozenset[str] = frozenset()
    end: datetime | None = None
    ends: frozenset[str] | None = None
    undated: bool = True

    def holds(self, i: Item) -> bool:
        if i.updated is None:
            return self.undated
        late = self.end is not None and (i.updated > self.end or (i.updated == self.end and self.ends is not None and i.id not in self.ends))
        early = self.start is not None and (i.updated < self.start or (i.updated == self.start and i.id in self.done))
        return not late and not early

    def reached(self, page: list[Item]) -> bool:
        """Whether a page reaches behind the frontier."""
        return self.start is not None and any(i.updated is not None and i.updated < self.start for i in page)


class Share(InputPartition):
    """Details that one task fetches."""

    def __init__(self, items: list[Item]):
        super().__init__(items)
        self.items = items


class Fetcher:
    """Lists and fetches by a source's options."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.listing, self.base = LISTINGS[options.get("listing", "offset_pages")], options.get("base", "").rstrip("/")
        self.parallel = max(1, int(options.get("parallel", "4")))

    def client(self, part: int = 1) -> Client:
        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)(self.options)
        bucket = TokenBucket(transport, float(self.options.get("burst", BURST)) / part, float(self.options.get("rate", RATE)) / part)
        return Client(transport, bucket, int(self.options.get("retries", "2")), float(self.options.get("refused", REFUSED)))

    def items(self, span: Span) -> list[Item]:
        return [i for i in self.listing(self.client(), self.base, span.reached) if span.holds(i)]

    def shares(self, span: Span) -> list[Share]:
        # neighbours by url go to one task: a recorded service has them together
        items = sorted(self.items(span), key=lambda i: (len(i.url), i.url))
        n = min(self.parallel, len(items))
        return [Share(items[k * len(items) // n : (k + 1) * len(items) // n]) for k in range(n)] or [Share([])]

    def rows(self, share: Share) -> Iterator[tuple]:
        client = self.client(self.parallel) if share.items else None
        for i in share.items:
            yield (i.id, i.updated, i.title, i.project, json.dumps(client.get(i.url)))  # type: ignore[union-attr]


class PagedReader(DataSourceReader):
    """All conversations updated since the option ``since``; those without a time too."""

    def __init__(self, options: dict[str, str]):
        self.fetcher, self.since = Fetcher(options), moment(options.get("since"))

    def partitions(self) -> list[Share]:
        return self.fetcher.shares(Span(start=self.since))

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.fetcher.rows(partition)


class PagedStream(DataSourceStreamReader):
    """Updates as they come. Offsets are ``updated``, ISO text or '', and ``ids``, those that have just this time."""

    def __init__(self, options: dict[str, str]):
        self.fetcher, self.since = Fetcher(options), moment(options.get("since"))

    def initialOffset(self) -> dict:
        return {"updated": (self.since - timedelta(microseconds=1)).isoformat() if self.since else "", "ids": []}

    def latestOffset(self) -> dict:
        newest: list[Item] = []
        client = self.fetcher.client()
        # the listing is newest first: no more of it is read than holds the newest time
        for i in self.fetcher.listing(client, self.fetcher.base, lambda page: any(i.updated is not None and newest and i.updated < newest[0].updated for i in page)):
            if i.updated is not None:
                if newest and i.updated < newest[0].updated:
                    break
                newest = [*newest, i] if newest and i.updated == newest[0].updated else [i]
        return {"updated": newest[0].updated.isoformat(), "ids": sorted(i.id for i in newest)} if newest else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        span = Span(moment(start["updated"]), frozenset(start["ids"]), moment(end["updated"]), frozenset(end["ids"]), undated=False)
        return self.fetcher.shares(span) if span.end is not None else [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.fetcher.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept beyond the stream's own log of offsets."""


class PagedConversations(DataSource):
    """Register with ``spark.dataSource.register(PagedConversations)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_conversations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)
