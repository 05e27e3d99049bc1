"""Evidence of a survey as a Python data source that is written in two phases.

Tasks write JSON lines of (table, json) rows into a folder of drafts beside the evidence;
when all have ended, the driver moves these files into the tables' folders and writes
the summary last, so that evidence with a summary is whole.  If a task fails for
good, or the moving does, the drafts and what was moved are removed, and nothing is left of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "table string, json string"
#: Where the summary is, as a folder that Spark reads too.
SUMMARY = "summary/part-00000.json"


@dataclass
class Written(WriterCommitMessage):
    #: table, file among the drafts, rows
    files: list[tuple[str, str, int]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.summary, self.tables = options["path"], options["summary"], options["tables"].split()
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        files, at = self._open()
        open_: dict[str, list] = {}
        try:
            for row in iterator:
                if row["table"] not in self.tables:
                    raise ValueError(f"{row['table']} is none of the tables")
                if row["table"] not in open_:
                    # Another attempt of the task writes other files, of which no one is told.
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.json"
                    files.create_dir(f"{at}/{self.drafts}/{row['table']}")
                    open_[row["table"]] = [name, 0, files.open_output_stream(f"{at}/{self.drafts}/{row['table']}/{name}")]
                held = open_[row["table"]]
                held[2].write(row["json"].encode("utf-8", "replace") + b"\n")
                held[1] += 1
        finally:
            for _, _, out in open_.values():
                out.close()
        return Written([(table, name, n) for table, (name, n, _) in open_.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files, at = self._open()
        if files.get_file_info(f"{at}/{SUMMARY}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} holds evidence already")
        moved = []
        try:
            for table in self.tables:
                files.create_dir(f"{at}/{table}")
            for message in messages:
                for table, name, _ in message.files if message else ():
                    files.move(f"{at}/{self.drafts}/{table}/{name}", f"{at}/{table}/{name}")
                    moved.append(f"{at}/{table}/{name}")
            with files.open_output_stream(f"{at}/{self.drafts}.json") as f:
                f.write(self.summary.encode("utf-8", "replace"))
            files.create_dir(f"{at}/{SUMMARY}".rpartition("/")[0])
            files.move(f"{at}/{self.drafts}.json", f"{at}/{SUMMARY}")
        except Exception:
            for x in moved:
                files.delete_file(x)
            self.abort(messages)
            raise
        self._clear(files, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, files: fs.FileSystem, at: str) -> None:
        if files.get_file_info(f"{at}/{self.drafts}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/{self.drafts}")


class EvidenceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "survey_evidence"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))
