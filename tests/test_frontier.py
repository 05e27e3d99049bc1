"""Redirects between origins, from local servers that note when they were asked."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestar.sources import fetch


class Site:
    """Answers by ``self.pages`` (path: status, type, body or place to go) and notes each request."""

    def __init__(self):
        self.pages, self.asked, self.robots = {}, [], (200, "User-agent: *\nDisallow: /private\n")
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked.append((time.time(), self.path))
                status, kind, body, *place = (*((site.robots[0], "text/plain", site.robots[1]) if self.path == "/robots.txt" else site.pages.get(self.path, (404, "text/html", ""))),)
                raw = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                for name, value in place[0].items() if place else ():
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def moves(self, path, to):
        self.pages[path] = (302, "text/html", "", {"Location": to})


@pytest.fixture
def sites():
    three = [Site() for _ in range(3)]
    yield three
    for s in three:
        s.server.shutdown()


def test_two_origins_that_redirect_to_each_other(spark, sites):
    a, b, c = sites
    for i in range(4):
        a.moves(f"/{i}", f"{b.url}/{i}")
        b.moves(f"/{i}", f"{a.url}/back{i}")
        a.pages[f"/back{i}"] = b.pages[f"/own{i}"] = (200, "text/html", f"page {i}")
    a.moves("/loop", f"{b.url}/loop")
    b.moves("/loop", f"{a.url}/loop")
    a.moves("/secret", f"{b.url}/private/x")
    a.moves("/inner", "/back0")
    c.robots = (503, "")
    a.moves("/down", f"{c.url}/1")
    a.moves("/away", "ftp://h/x")
    interval = 0.15
    urls = [f"{s.url}/{p}" for s, n in ((a, ""), (b, "own")) for p in (f"{n}{i}" for i in range(4))] + [a.url + p for p in ("/loop", "/secret", "/inner", "/down", "/away", "/0")] + [f"{c.url}/2"]
    rows = fetch.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), interval=interval).collect()
    got = {r["url"]: r for r in rows}
    assert len(rows) == len(set(urls)) == len(got)
    for i in range(4):
        r = got[f"{a.url}/{i}"]
        assert (r["text"], r["final_url"], r["redirects"]) == (f"page {i}", f"{a.url}/back{i}", [f"{b.url}/{i}", f"{a.url}/back{i}"])
        assert got[f"{b.url}/own{i}"]["text"] == f"page {i}"
    assert "redirects" in got[f"{a.url}/loop"]["error"] and len(got[f"{a.url}/loop"]["redirects"]) == fetch.MAX_REDIRECTS
    assert "forbids" in got[f"{a.url}/secret"]["error"] and got[f"{a.url}/inner"]["text"] == "page 0"
    assert "503" in got[f"{a.url}/down"]["error"] and "503" in got[f"{c.url}/2"]["error"] and "http" in got[f"{a.url}/away"]["error"]
    for s in sites:
        times = sorted(t for t, _ in s.asked)
        gaps = [y - x for x, y in zip(times, times[1:])]
        assert min(gaps, default=1) >= interval, (gaps, sorted(s.asked))
        assert sum(p == "/robots.txt" for _, p in s.asked) == 1  # whatever the rounds
    assert len(c.asked) == 1 and not any(p.startswith("/private") for _, p in b.asked)
    # Every request is counted once, with the URL that took it.
    assert sum(r["taken"] for r in rows) == sum(len(s.asked) for s in sites)
    n = defaultdict(int)
    for s in sites:
        for _, p in s.asked:
            n[s.url, p] += 1
    assert n[a.url, "/0"] == 1 and n[b.url, "/0"] == 1
