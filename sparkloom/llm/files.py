"""Own file formats in the shared folder, read and written by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored bytes that one reading task aims at.
TASK_BYTES = 32 << 20


class Output:
    """A file that one task attempt writes; its name is never used again, so a repeated attempt can't meet it."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, place = fs.FileSystem.from_uri(self.path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._stream = system.open_output_stream(place, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; the offset at which the data begin."""
        at = self.size
        self._stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._stream.close()


class Input:
    """Byte ranges of a file."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path)
        self._file = system.open_input_file(place)

    def read(self, offset: int, length: int) -> bytes:
        data = self._file.read_at(length, offset)
        if len(data) != length:
            raise OSError("a byte range ends after the file")
        return data

    def close(self) -> None:
        self._file.close()


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads (offset, length, first, last + 1): neighbours up to ``gap`` bytes apart share a read of at most ``most`` bytes."""
    reads: list[list[int]] = []
    for k, (offset, length) in enumerate(ranges):
        end = offset + length
        if reads and offset - (reads[-1][0] + reads[-1][1]) <= gap and end - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], end - reads[-1][0])
            reads[-1][3] = k + 1
        else:
            reads.append([offset, length, k, k + 1])
    return [tuple(r) for r in reads]


def reading_tasks(index: DataFrame, length: str = "length") -> int:
    """Tasks for reading the ranges of a saved index: by the bytes to read, as the index itself is small."""
    total = index.agg(F.sum(length)).first()[0] or 0
    return max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
