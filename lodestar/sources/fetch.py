"""Fetching pages politely.

``fetched`` takes a table of URLs and works in rounds.  In a round one task has all that
is asked of an origin, so that its robots file and the delay between requests
live in one place.  A redirect to another origin becomes a row of the next round's
frontier, which is dealt out by origin again, together with what is known of the
origins: their robots files and when they were last asked.  So no origin is
ever asked by two tasks, and its delay also holds from round to round (by the
clocks of the machines).  There is a round for each redirect that leaves an origin, six at most.

``spark.dataSource.register(PoliteFetch)``, then
``spark.read.format("polite_fetch").option("urls", "http://a/x http://b/y")``
is for the few URLs that an option holds: its one task asks for one after the other, wherever they
lead.  Nothing is retried; a failure is a row.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identifiers import origin_of as origin_column
from ..operators.tables import kept

# Bounds on what is fetched.
PAGE_BYTES, ROBOTS_BYTES = 5 << 20, 512 << 10
TIMEOUT, MIN_INTERVAL, MAX_REDIRECTS = 15.0, 1.0, 5
HTML_TYPES = ("text/html", "application/xhtml+xml")
JSON_TYPES = ("application/json", "application/ld+json")
AGENT = "lodestar-fetch/0.1"
SCHEMA = "url string, final_url string, status int, content_type string, encoding string, bytes long, redirects array<string>, robots string, requests int, taken int, text string, error string"

KINDS = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())


#: What a round gives: rows of SCHEMA as ``page``; as ``hop`` where a URL leads now (final_url); as ``robots`` what is known of an origin.
ROUND = SCHEMA + ", kind string, origin string, rules binary, last double"


class FetchError(Exception):
    pass


@dataclass
class Hop:
    """A redirect to another origin: ``url`` leads to the last of ``hops``."""

    url: str
    hops: list[str]
    taken: int


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def origin_of(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


def decode(raw: bytes, content_type: str) -> tuple[str, str]:
    """Text and encoding: the header's charset, then a meta tag in the first 2048 bytes, then UTF-8."""
    found = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w.:-]+)", raw[:2048].decode("ascii", "replace"), re.I)
    name = found[1].lower() if found else "utf-8"
    try:
        return raw.decode(name), name
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace"), f"{name} (undecodable, replaced)"


@dataclass
class Fetcher:
    agent: str = AGENT
    interval: float = MIN_INTERVAL
    types: tuple[str, ...] = HTML_TYPES
    max_bytes: int = PAGE_BYTES
    requests: int = 0
    robots: dict[str, tuple[RobotFileParser | None, str]] = field(default_factory=dict)
    #: Robots files as they were read, and why an origin is not asked.
    rules: dict[str, bytes] = field(default_factory=dict)
    stopped: dict[str, str] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)
    #: Headers of the last answer.
    headers: dict[str, str] = field(default_factory=dict)

    def _get(self, url: str, limit: int) -> tuple[int, dict[str, str], bytes]:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise FetchError("only http and https URLs with a host are fetched")
        origin = origin_of(url)
        delay = self.interval
        rules = self.robots.get(origin, (None, ""))[0]
        if rules and rules.crawl_delay(self.agent):
            delay = max(delay, float(rules.crawl_delay(self.agent)))
        time.sleep(min(delay, max(0.0, self.last.get(origin, -1e9) + delay - time.time())))
        self.requests += 1
        try:
            with build_opener(_NoRedirect).open(Request(url, headers={"User-Agent": self.agent}), timeout=TIMEOUT) as r:
                got = r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(limit + 1)
        except HTTPError as e:
            got = e.code, {k.lower(): v for k, v in e.headers.items()}, b""
        except (URLError, OSError, ValueError) as e:
            raise FetchError(f"{type(e).__name__}: {e}") from e
        finally:
            self.last[origin] = time.time()  # the interval begins when the answer is there
        if len(got[2]) > limit:
            raise FetchError(f"more than {limit} bytes")
        return got

    def know(self, origin: str, said: str | None, rules: bytes | None, stopped: str | None, last: float | None) -> None:
        """What an earlier round learned of an origin."""
        if last is not None:
            self.last[origin] = last
        if stopped:
            self.stopped[origin] = stopped
        elif said:
            self._settle(origin, said, rules)

    def _settle(self, origin: str, said: str, rules: bytes | None) -> None:
        parser = None
        if rules is not None:
            parser = RobotFileParser()
            parser.parse(rules.decode("utf-8", "replace").splitlines())
            self.rules[origin] = rules
        self.robots[origin] = parser, said

    def allowed(self, url: str) -> str:
        """What the origin's robots file says of ``url``; raises if it forbids it or cannot be read, which is asked once."""
        origin = origin_of(url)
        if origin in self.stopped:
            raise FetchError(self.stopped[origin])
        if origin not in self.robots:
            try:
                status, _, raw = self._get(f"{origin}/robots.txt", ROBOTS_BYTES)
                if not 200 <= status < 300 and not 400 <= status < 500:
                    raise FetchError(f"robots.txt answered {status}")
            except FetchError as e:
                self.stopped[origin] = str(e)
                raise
            self._settle(origin, *(("read", raw) if status < 300 else ("absent", None)))
        rules, said = self.robots[origin]
        if rules and not rules.can_fetch(self.agent, url):
            raise FetchError("robots.txt forbids it")
        return said

    def fetch(self, url: str, hops: tuple[str, ...] | list[str] = (), taken: int = 0, *, leave: bool = True) -> tuple | Hop:
        """A row of SCHEMA; with ``leave`` false, a redirect to another origin is a ``Hop``. ``hops`` and ``taken`` are those of earlier rounds."""
        hops, said, before = list(hops), None, self.requests - taken
        at = hops[-1] if hops else url
        try:
            while True:
                if urlsplit(at).scheme not in ("http", "https") or not urlsplit(at).hostname:
                    raise FetchError("only http and https URLs with a host are fetched")
                said = self.allowed(at)
                status, self.headers, raw = self._get(at, self.max_bytes)
                if status in (301, 302, 303, 307, 308) and self.headers.get("location"):
                    if len(hops) == MAX_REDIRECTS:
                        raise FetchError(f"more than {MAX_REDIRECTS} redirects")
                    here, at = origin_of(at), urljoin(at, self.headers["location"])
                    hops.append(at)
                    if not leave and origin_of(at) != here:
                        return Hop(url, hops, self.requests - before)
                    continue
                kind = self.headers.get("content-type", "")
                if not 200 <= status < 300:
                    raise FetchError(f"status {status}")
                if kind.split(";")[0].strip().lower() not in self.types:
                    raise FetchError(f"content type {kind or '(none)'}")
                text, encoding = decode(raw, kind)
                return url, at, status, kind, encoding, len(raw), hops, said, self.requests, self.requests - before, text, None
        except FetchError as e:
            return url, at, None, None, None, None, hops, said, self.requests, self.requests - before, None, str(e)


@dataclass
class _Urls(InputPartition):
    urls: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Urls]:
        return [_Urls(tuple(dict.fromkeys(self.options.get("urls", "").split())))]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        kinds = JSON_TYPES if self.options.get("accept") == "json" else HTML_TYPES
        fetcher = Fetcher(self.options.get("agent", AGENT), float(self.options.get("interval", MIN_INTERVAL)), kinds)
        for url in partition.urls:
            yield fetcher.fetch(url)


def _round(agent: str, interval: float, kinds: tuple[str, ...]):
    names = [c.split()[0] for c in ROUND.split(", ")]
    types = (*KINDS, pa.string(), pa.string(), pa.binary(), pa.float64())
    none = dict.fromkeys(names)

    def row(**values: object) -> pa.RecordBatch:
        return pa.record_batch([pa.array([(none | values)[n]], t) for n, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher, at = Fetcher(agent, interval, kinds), None

        def learned() -> Iterator[pa.RecordBatch]:
            if at in fetcher.last:
                yield row(kind="robots", origin=at, robots=fetcher.robots.get(at, (None, None))[1], rules=fetcher.rules.get(at), error=fetcher.stopped.get(at), last=fetcher.last[at])

        for b in batches:
            for r in b.to_pylist():
                if r["origin"] != at:
                    yield from learned()
                    at = r["origin"]
                if r["known"]:
                    fetcher.know(at, r["robots"], r["rules"], r["error"], r["last"])
                    continue
                got = fetcher.fetch(r["url"], r["redirects"] or (), r["taken"] or 0, leave=False)
                if isinstance(got, Hop):
                    yield row(kind="hop", url=got.url, final_url=got.hops[-1], redirects=got.hops, taken=got.taken)
                else:  # a row at a time: a page may have megabytes
                    yield row(kind="page", **dict(zip(names, got)))
        yield from learned()

    return run


def fetched(urls: DataFrame, *, accept: str = "html", agent: str = AGENT, interval: float = MIN_INTERVAL) -> DataFrame:
    """Rows of SCHEMA for the distinct URLs of a table (url), written round by round, so that none is asked for twice by reading the result again."""
    run = _round(agent, interval, JSON_TYPES if accept == "json" else HTML_TYPES)
    frontier = urls.select(F.col("url").cast("string").alias("url")).where("url IS NOT NULL").distinct().selectExpr("url", "url AS final_url", "cast(null AS array<string>) AS redirects", "0 AS taken")
    rounds: list[DataFrame] = []
    while True:
        asked = frontier.select("*", origin_column(F.col("final_url")).alias("origin"), F.lit(False).alias("known"))
        if rounds:
            told = reduce(DataFrame.unionAll, [r.where("kind = 'robots'").select("origin", "robots", "rules", "error", "last") for r in rounds])
            asked = asked.unionByName(told.join(asked.select("origin").distinct(), "origin", "left_semi").withColumn("known", F.lit(True)), allowMissingColumns=True)
        else:
            asked = asked.selectExpr("*", "cast(null AS string) AS robots", "cast(null AS binary) AS rules", "cast(null AS string) AS error", "cast(null AS double) AS last")
        # Of an origin first what is known, the latest last, then the URLs.
        dealt = asked.repartition("origin").sortWithinPartitions("origin", F.desc("known"), "last", "url")
        rounds.append(kept(dealt.mapInArrow(run, ROUND)))
        frontier = rounds[-1].where("kind = 'hop'").select("url", "final_url", "redirects", "taken")
        if not frontier.limit(1).count():
            break
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return reduce(DataFrame.unionAll, [r.where("kind = 'page'").select(*names) for r in rounds])


class PoliteFetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polite_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
