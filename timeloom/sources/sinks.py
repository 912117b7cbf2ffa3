"""Texts as files of their own names, written by tasks as unfinished parts and renamed when the whole job is done."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .folders import files_of, opened

#: Files renamed at once by the driver.
THREADS = 32


@dataclass
class Parts(WriterCommitMessage):
    """What one task has written: a folder of parts."""

    folder: str
    count: int


def count_blocks(body: str) -> int:
    """Blocks of a subtitle text: what blank lines part."""
    return len([b for b in re.split(r"\n\s*\n", body.strip()) if b.strip()])


class NamedTextWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        _, path, _ = opened(self.root)
        self.staging = f"{path}/.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, _, _ = opened(self.root)
        folder = f"{self.staging}/{TaskContext.get().taskAttemptId()}"
        names: set[str] = set()
        for row in rows:
            name, body = f"{row.name}{self.suffix}", row.body or ""
            if not row.name or "/" in name or name.startswith("."):
                raise ValueError(f"{name!r} cannot be the name of a file")
            if name in names:
                raise ValueError(f"{name} is given twice")
            if row.expected is not None and count_blocks(body) != row.expected:
                raise ValueError(f"{name} should have {row.expected} blocks, but has {count_blocks(body)}")
            if not names:
                system.create_dir(folder)
            names.add(name)
            with system.open_output_stream(f"{folder}/{name}.part") as file:
                file.write(body.encode())
        return Parts(folder, len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Rename what the successful attempts wrote; one folder of parts is listed at a time. If a file is there already
        and may not be replaced, nothing is renamed."""
        system, path, _ = opened(self.root)
        folders = [m.folder for m in messages if m is not None and m.count]
        try:
            for final in (False, True):
                for folder in folders:
                    moves = [(f.path, f"{path}/{f.base_name.removesuffix('.part')}") for f in files_of(system, folder, False)]
                    if not final:
                        there = [] if self.overwrite or not moves else [f.path for f in system.get_file_info([to for _, to in moves]) if f.is_file]
                        if there:
                            raise FileExistsError(there[0])
                        continue
                    with ThreadPoolExecutor(THREADS) as pool:
                        list(pool.map(lambda move: system.move(*move), moves))
        finally:
            self._clear(system)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(opened(self.root)[0])

    def _clear(self, system) -> None:
        if system.get_file_info(self.staging).type.name == "Directory":
            system.delete_dir(self.staging)


class NamedTexts(DataSource):
    """Sink of rows (name, body, expected): each becomes ``<path>/<name><suffix>``. ``expected``, if not null, is the
    number of subtitle blocks that the body has to have. Tasks write ``.part`` files into a hidden folder; files appear
    under their names only once all tasks are through, and a job that fails leaves none. Append refuses names that are
    there already, overwrite replaces these and leaves other files alone."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(dict(self.options), overwrite)


def write_texts(texts: DataFrame, root: str, suffix: str = ".srt", mode: str = "append") -> None:
    """Texts (media_id, body, and maybe expected) as files ``<media_id><suffix>`` of a folder; see ``NamedTexts``. An id
    given twice, a name that cannot be one, and a count that differs fail the job, and nothing is left of it."""
    texts.sparkSession.dataSource.register(NamedTexts)
    expected = F.col("expected") if "expected" in texts.columns else F.lit(None)
    rows = texts.select(F.col("media_id").cast("string").alias("name"), F.col("body").alias("body"), expected.cast("long").alias("expected"))
    rows.repartition("name").write.format("named_texts").mode(mode).options(path=root, suffix=suffix).save()
