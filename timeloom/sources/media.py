"""Media catalogues and PCM audio."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.jobs import is_supported, stem
from .folders import files_of, opened

BLOCKS = "path string, block_no long, sample_rate int, first_sample long, samples array<smallint>, error string"


def scan_media(spark: SparkSession, root: str, recurse: bool = False) -> DataFrame:
    """Supported media under a folder (its top level, or all of it): media_id, path, ext, size, mtime. Contents are
    not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recurse).load(root)
    return files.where(is_supported(F.col("path"))).select(
        stem(F.col("path")).alias("media_id"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


# ---- 16-bit WAV ----------------------------------------------------------------------------------------------------


class NotPcm(ValueError):
    """A file that is no 16-bit PCM WAV."""


@dataclass(frozen=True)
class Pcm:
    """Where the samples of a WAV file are; ``missing`` bytes are promised by its header but not there."""

    rate: int
    channels: int
    start: int
    size: int
    missing: int


def pcm_of(file, size: int) -> Pcm:
    """Read the header of an open file of ``size`` bytes, chunk by chunk up to the samples."""
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise NotPcm("not a WAV file")
    at, form, long_size = 12, None, None
    while True:
        file.seek(at)
        chunk = file.read(8)
        if len(chunk) < 8:
            raise NotPcm("no samples")
        name, length = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"ds64":
            long_size = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16)) if length >= 16 else None
        elif name == b"data":
            break
        at += 8 + length + length % 2
    if form is None:
        raise NotPcm("no format before the samples")
    kind, channels, rate, _, _, bits = form
    if kind not in (1, 0xFFFE):
        raise NotPcm(f"encoding {kind} is not PCM")
    if bits != 16:
        raise NotPcm(f"samples of {bits} bits")
    if rate <= 0 or channels <= 0:
        raise NotPcm("no sample rate" if rate <= 0 else "no channels")
    start, there = at + 8, max(0, size - at - 8)
    if length == 0xFFFFFFFF:  # unknown when the header was written, or given in ds64
        length = there if long_size is None else long_size
    return Pcm(rate, channels, start, min(length, there), max(0, length - there))


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, size of the file, from, to)."""

    parts: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.recurse = options["path"], options.get("recursive", "false") == "true"
        self.block_samples, self.range_bytes = int(options.get("blocksamples", 16_000)), int(options.get("rangebytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        """Long files in ranges, short ones together: only names and sizes are looked at here."""
        system, path, _ = opened(self.root)
        out: list[list[tuple[str, int, int, int]]] = []
        room = 0
        for file in files_of(system, path, self.recurse):
            if not file.path.lower().endswith(".wav"):
                continue
            for at in range(0, max(file.size, 1), self.range_bytes):
                part = (file.path, file.size, at, min(at + self.range_bytes, max(file.size, 1)))
                if part[3] - at > room:
                    out.append([])
                    room = self.range_bytes
                out[-1].append(part)
                room -= part[3] - at
        return [Ranges(parts) for parts in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _, prefix = opened(self.root)
        for path, size, low, high in partition.parts:
            with system.open_input_file(path) as file:
                try:
                    pcm = pcm_of(file, size)
                except (NotPcm, struct.error, OSError) as problem:
                    if low == 0:
                        yield _row(prefix + path, 0, None, 0, None, str(problem))
                    continue
                if low == 0 and pcm.missing:
                    yield _row(prefix + path, 0, pcm.rate, 0, None, f"{pcm.missing} bytes of samples are missing")
                frame = 2 * pcm.channels
                block = frame * self.block_samples
                # a block belongs to the range that holds its first byte; a header belongs to the first range
                number = max(0, -(-(low - pcm.start) // block))
                while number * block < pcm.size and (begin := pcm.start + number * block) < high:
                    file.seek(begin)
                    raw = file.read(min(block, pcm.size - number * block) // frame * frame)
                    if not raw:
                        break
                    yield _row(prefix + path, number, pcm.rate, number * self.block_samples, np.frombuffer(raw, "<i2")[:: pcm.channels], None)
                    number += 1


_ROW = pa.schema([("path", pa.string()), ("block_no", pa.int64()), ("sample_rate", pa.int32()), ("first_sample", pa.int64()), ("samples", pa.list_(pa.int16())), ("error", pa.string())])


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROW)], schema=_ROW)


class WavBlocks(DataSource):
    """16-bit WAV files of a folder as blocks of their first channel. Options: path, recursive, blockSamples, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))


def scan_wav(spark: SparkSession, root: str, block_samples: int = 16_000, recurse: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """16-bit WAV files as blocks of their first channel: media_id, path, block_no, sample_rate, first_sample, samples,
    error. A file is read in ranges of ``range_bytes``, each a task of its own that reads the header and its blocks only.
    A file that is not readable as such gives one row with its error and no samples; a truncated one gives such a row
    beside the blocks that are there."""
    spark.dataSource.register(WavBlocks)
    options = {"path": root, "recursive": str(recurse).lower(), "blockSamples": str(block_samples), "rangeBytes": str(range_bytes)}
    return spark.read.format("wav_blocks").options(**options).load().select(stem(F.col("path")).alias("media_id"), "*")
