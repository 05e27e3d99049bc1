"""Registry pages as a Python data source, for batch reads and for streams.

``format("registry_pages")`` with the options ``path`` (a folder that the cluster shares),
``registry``, ``community``, ``seed`` and ``size`` draws page numbers, once: the size of the
corpus is read from the header ``X-Total`` of the first page, and the draw is kept
beside the answers.  Each answer or failure is a file of its own, written under
another name and then renamed, before its row is given; a page that has one is never
asked for again, whichever run or attempt of a task asks.  So what is recorded is
exactly what was asked, but for the one request during which a process dies.

A batch read has one partition, as one registry is one origin, whose delay one task keeps.
A stream goes through the draw in ranges of ``batch`` pages; its offset is the number of
pages done, so that a query that starts again from its checkpoint goes on where it stood.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.survey import draw_pages
from .fetch import AGENT, JSON_TYPES, FetchError, Fetcher

PAGE = "page int, failure string, envelope string, requests int"
DRAW = "seed long, size int, corpus long, robots string, carried_from string, pages array<int>, requests int"
#: Seconds between requests, and pages in a range of a stream.
INTERVAL, BATCH = 2.0, 20
# Fixed value: how a page without an envelope is recorded.
EMPTY = "empty-page"


class Folder:
    """JSON files under a path of any file system that Arrow reads."""

    def __init__(self, path: str) -> None:
        self.files, self.at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def read(self, name: str) -> dict | None:
        if self.files.get_file_info(f"{self.at}/{name}").type != fs.FileType.File:
            return None
        with self.files.open_input_stream(f"{self.at}/{name}") as f:
            return json.loads(f.read())

    def names(self, folder: str) -> set[str]:
        """The files of a folder, drafts left out."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.at}/{folder}", allow_not_found=True))
        return {x.base_name for x in found if not x.base_name.startswith("_")}

    def write(self, name: str, value: dict) -> None:
        """Whole or not at all."""
        whole = f"{self.at}/{name}"
        folder, _, last = whole.rpartition("/")
        self.files.create_dir(folder)
        # Names that begin with an underscore are not read as data.
        draft = f"{folder}/_{last}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write((json.dumps(value, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8", "replace"))
        self.files.move(draft, whole)


@dataclass
class Draw:
    """What is to be asked of a registry, and where the answers are kept."""

    options: dict

    def __post_init__(self) -> None:
        o = self.options
        self.folder, self.base = Folder(o["path"]), f"{o['registry']}/{o['community']}/envelopes"

    def fetcher(self) -> Fetcher:
        return Fetcher(self.options.get("agent", AGENT), float(self.options.get("interval", INTERVAL)), JSON_TYPES)

    def pages(self) -> list[int]:
        """The draw, made on first use; another seed or size than that of the folder is refused."""
        seed, size = int(self.options["seed"]), int(self.options["size"])
        kept = self.folder.read("draw.json")
        if kept is None:
            f = self.fetcher()
            row = f.fetch(f"{self.base}?page=1&per_page=1&metadata_only=true")
            if row[-1]:
                raise FetchError(f"the size of the corpus cannot be read: {row[-1]}")
            total = f.headers.get("x-total", "")
            if not (total.isascii() and total.isdigit()):
                raise FetchError(f"the header X-Total has no number: {total!r}")
            kept = {"seed": seed, "size": size, "corpus": int(total), "robots": row[7], "carried_from": None, "pages": draw_pages(int(total), size, seed), "requests": f.requests}
            self.folder.write("draw.json", kept)
        if (kept["seed"], kept["size"]) != (seed, size):
            raise ValueError(f"{self.options['path']} holds a draw of seed {kept['seed']} and size {kept['size']}")
        return kept["pages"]

    def answers(self, pages: list[int]) -> Iterator[tuple]:
        fetcher = self.fetcher()
        for page in pages:
            name = f"pages/{page}.json"
            row = self.folder.read(name)
            if row is None:
                *_, taken, text, error = fetcher.fetch(f"{self.base}?page={page}&per_page=1")
                row = {"page": page, "failure": error, "envelope": None, "requests": taken}
                if error is None:
                    try:
                        found = json.loads(text)
                    except ValueError as e:
                        row["failure"] = f"{type(e).__name__}: {e}"
                    else:
                        first = found[0] if isinstance(found, list) and found else None
                        row |= {"envelope": json.dumps(first, ensure_ascii=False)} if isinstance(first, dict) else {"failure": EMPTY}
                self.folder.write(name, row)
            yield row["page"], row["failure"], row["envelope"], row["requests"]


@dataclass
class PageRange(InputPartition):
    pages: list[int]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.draw = Draw(options)

    def partitions(self) -> list[PageRange]:
        return [PageRange(self.draw.pages())]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.draw.answers(partition.pages)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.draw, self.batch = Draw(options), int(options.get("batch", BATCH))
        self.done: int | None = None

    def initialOffset(self) -> dict:
        return {"done": 0}

    def latestOffset(self) -> dict:
        """One range further than what is done; a query that starts again learns that from the folder, as Spark does not say where it stands."""
        pages = self.draw.pages()
        if self.done is None:
            there = self.draw.folder.names("pages")
            self.done = next((i for i, page in enumerate(pages) if f"{page}.json" not in there), len(pages))
        return {"done": min(self.done + self.batch, len(pages))}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        self.done = max(self.done or 0, end["done"])
        return [PageRange(self.draw.pages()[start["done"] : end["done"]])]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.draw.answers(partition.pages)

    def commit(self, end: dict) -> None:
        self.done = max(self.done or 0, end["done"])


class RegistryPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """PAGE of every page of the folder that was asked for, from its files."""
    return spark.read.schema(PAGE).json(f"{path}/pages")


def draw_of(spark: SparkSession, path: str) -> dict | None:
    """The draw that the folder keeps."""
    return Folder(path).read("draw.json")
