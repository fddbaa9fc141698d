"""A sink for JSON lines with a commit of its own: ``df.write.format("committed_jsonl")``.

Every task writes one file for each value of ``split`` under a folder that no reader looks at, and
says in its commit message what it wrote. Only when all tasks are done are the files moved to their
places, and a list of them is written last; a task or job that fails leaves nothing to be
seen. Tasks that are tried again write under a name of their own. So a corpus and its
holdout are written in one job and appear together.

Any file system that ``pyarrow.fs`` can open by URI and all executors share will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from spanloom.sources.jsonlines import opened

STAGED, LIST = "_staged", "_committed"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: split, staged name, rows and characters."""

    files: list[tuple[str, str, int, int]]


class CommittedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, place = opened(self.path)
        own = TaskContext.get()
        name = f"{self.job}-{own.partitionId()}-{own.taskAttemptId()}"
        system.create_dir(f"{place}/{STAGED}/{self.job}", recursive=True)
        out: dict[str, list] = {}
        try:
            for row in iterator:
                split = row["split"]
                if split not in out:
                    staged = f"{STAGED}/{self.job}/{split}-{name}.jsonl"
                    out[split] = [staged, system.open_output_stream(f"{place}/{staged}"), 0, 0]
                held = out[split]
                held[1].write((json.dumps({"text": row["text"]}, ensure_ascii=False) + "\n").encode())
                held[2] += 1
                held[3] += len(row["text"])
        finally:
            for held in out.values():
                held[1].close()
        return Written([(split, staged, n, chars) for split, (staged, _, n, chars) in sorted(out.items())])

    def commit(self, messages: list[Written | None]) -> None:
        system, place = opened(self.path)
        before = self.committed(system, place)
        files = []
        for split, staged, n, chars in (x for m in messages if m is not None for x in m.files):
            to = f"{split}/{staged.rpartition('/')[2]}"
            system.create_dir(f"{place}/{split}", recursive=True)
            system.move(f"{place}/{staged}", f"{place}/{to}")
            files.append({"split": split, "file": to, "rows": n, "chars": chars})
        keep = [] if self.overwrite else before
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{LIST}.{self.job}") as f:
            f.write(json.dumps(keep + files).encode())
        system.move(f"{place}/{LIST}.{self.job}", f"{place}/{LIST}")  # from here on the new list holds
        for x in before if self.overwrite else []:
            system.delete_file(f"{place}/{x['file']}")
        self._drop(system, place)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*opened(self.path))

    def _drop(self, system, place: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{place}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{place}/{STAGED}/{self.job}")

    @staticmethod
    def committed(system, place: str) -> list[dict]:
        try:
            with system.open_input_stream(f"{place}/{LIST}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return []


class CommittedJsonLines(DataSource):
    """Columns ``text`` and ``split``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "committed_jsonl"

    def schema(self) -> str:
        return "text string, split string"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"], overwrite)


def write_committed(rows: DataFrame, path: str, mode: str = "append") -> list[dict]:
    """Write ``rows(text, split)`` below ``path`` as one job, and list all files that hold: split, file, rows, characters."""
    rows.sparkSession.dataSource.register(CommittedJsonLines)
    rows.select("text", "split").write.format("committed_jsonl").option("path", path).mode(mode).save()
    return CommittedWriter.committed(*opened(path))
