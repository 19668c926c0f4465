"""Tailing a growing log file as a stream that survives rotation, truncation and restarts.

An offset is the file's identity (its inode), a place in it behind the last whole line, and a checksum of its first
bytes. A file renamed by rotation is found again by its identity and read to its end before the new one; a
file that was cut or written anew (shorter, or another beginning) is read from its start. So no line is lost or read twice, as
long as rotated files stay beside the log until they are read, and a restart goes on from the checkpoint.

The file has to be on a path that the executors see too. Bytes that are no UTF-8 are replaced; a line without an end
is read once it has one; lines that a truncation removes before they are read are gone. Empty lines are lines.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", "/var/log/access.log").load()
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: First bytes that tell a file from another one with the same identity; most bytes that one task reads.
HEAD, MOST = 64, 64 << 20


class Range(InputPartition):
    """Whole lines of one file between two places."""

    def __init__(self, inode: int, start: int, end: int):
        self.inode, self.start, self.end = inode, start, end


def _head(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


def _whole(path: str) -> int:
    """The place behind the last line end of a file."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            step = min(at, 1 << 16)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return at - step + k + 1
            at -= step
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, from_start: bool):
        self.path, self.from_start = path, from_start

    def _now(self) -> dict:
        try:
            end = _whole(self.path)
            n = min(HEAD, end)
            return {"inode": os.stat(self.path).st_ino, "byte": end, "n": n, "head": _head(self.path, n)}
        except FileNotFoundError:  # between a rotation and the new file
            return {"inode": 0, "byte": 0, "n": 0, "head": 0}

    def initialOffset(self) -> dict:
        return {"inode": 0, "byte": 0, "n": 0, "head": 0} if self.from_start else self._now()

    def latestOffset(self) -> dict:
        return self._now()

    def _beside(self) -> dict[int, str]:
        """The log and its rotated files by identity."""
        folder, name = os.path.split(self.path)
        found = [os.path.join(folder, f) for f in os.listdir(folder or ".") if f.startswith(name)]
        return {os.stat(f).st_ino: f for f in found if os.path.isfile(f) and not f.endswith((".gz", ".zst", ".bz2"))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, parts = self._beside(), []

        def add(inode: int, a: int, b: int) -> None:
            parts.extend(Range(inode, k, min(k + MOST, b)) for k in range(a, b, MOST))

        old = files.get(start["inode"])
        same = old is not None and os.path.getsize(old) >= start["byte"] and _head(old, start["n"]) == start["head"]
        if end["inode"] == start["inode"]:
            add(end["inode"], start["byte"] if same and end["byte"] >= start["byte"] else 0, end["byte"])
            return parts
        if same:  # rotated: the rest of the old file, then what was rotated since, then the new one
            add(start["inode"], start["byte"], _whole(old))
            since = os.stat(old).st_mtime_ns
            between = sorted((os.stat(f).st_mtime_ns, i, f) for i, f in files.items() if i not in (start["inode"], end["inode"]) and os.stat(f).st_mtime_ns > since)
            for _, inode, f in between if end["inode"] else ():
                add(inode, 0, _whole(f))
        add(end["inode"], 0, end["byte"])
        return parts

    def read(self, partition: Range) -> Iterator[tuple]:
        path = self._beside().get(partition.inode)
        if path is None:
            raise FileNotFoundError(f"a rotated file of {self.path} went before it was read")
        with open(path, "rb") as f:
            at = partition.start
            if at and (f.seek(at - 1), f.read(1))[1] != b"\n":  # the line belongs to the range before
                f.seek(at)
                at += len(f.readline())
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), os.path.basename(path), at
                at += len(line)


class TailSource(DataSource):
    """value, file and at (the line's place) of each new line. Options: path, fromStart (true)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], str(self.options.get("fromStart", "true")).lower() == "true")
