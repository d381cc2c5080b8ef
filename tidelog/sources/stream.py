"""A streaming source over a log kept as files of JSON lines, one file a log file."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidelog.model import BINLOG_EVENTS
from tidelog.operators.state import gtid_within


def _number(name: str) -> int:
    digits = name.removesuffix(".json").rpartition(".")[2]
    return int(digits) if digits.isdigit() else -1


def _files(path: str) -> list[str]:
    return sorted((f for f in os.listdir(path) if f.endswith(".json")), key=_number)


def _row(event: dict, names: list[str]) -> tuple:
    rows = event.get("rows")
    return tuple([(r.get("before"), r.get("after")) for r in rows] if n == "rows" and rows is not None else event.get(n) for n in names)


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class LogBatchReader(DataSourceReader):
    """All events, one task a file."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[_File]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(os.path.join(self.path, partition.name)) as f:
            for line in f:
                yield _row(json.loads(line), self.names)


class _Piece(InputPartition):
    """Bytes [first, end) of a file: the lines that begin in it."""

    def __init__(self, name: str, first: int, end: int):
        super().__init__((name, first, end))
        self.name, self.first, self.end = name, first, end


class _Start:
    """Where a stream begins: earliest, latest, file:position, or gtid:set (what the set does not hold)."""

    def __init__(self, text: str):
        self.latest, self.gtids, self.file, self.position = text == "latest", None, "", 0
        if text.startswith("gtid:"):
            self.gtids = text[5:]
        elif text not in ("earliest", "latest"):
            name, _, position = text.rpartition(":")
            self.file, self.position = f"{name}.json", int(position)

    def offset(self, path: str) -> dict:
        if self.latest:
            return _end(path)
        return {"file": self.file, "byte": 0}

    def wants(self, name: str, event: dict) -> bool:
        if self.file and (_number(name) < _number(self.file) or (name == self.file and event["position"] < self.position)):
            return False
        return self.gtids is None or event.get("gtid_set") is None or not gtid_within(event["gtid_set"], self.gtids)


def _complete(path: str, name: str) -> int:
    """Bytes of a file up to its last complete line."""
    size = os.path.getsize(os.path.join(path, name))
    with open(os.path.join(path, name), "rb") as f:
        at = size
        while at > 0:
            step = min(at, 1 << 16)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


def _end(path: str) -> dict:
    files = _files(path)
    return {"file": files[-1], "byte": _complete(path, files[-1])} if files else {"file": "", "byte": 0}


def _lines(path: str, name: str, first: int, end: int | None) -> Iterator[tuple[int, dict]]:
    """(byte after it, event) of the complete lines that begin in [first, end)."""
    with open(os.path.join(path, name), "rb") as f:
        f.seek(max(0, first - 1))
        if first:
            f.readline()  # the line that began before, or the rest of its line end
        while end is None or f.tell() < end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            if line.strip():
                yield f.tell(), json.loads(line)


class LogPartsReader(DataSourceStreamReader):
    """The log in pieces of bytes, read by tasks. The offset is {"file": name, "byte": place after the last complete line}.

    A batch takes all that has come since the one before, at the first start the whole backlog, spread over tasks.
    """

    def __init__(self, path: str, names: list[str], options: dict):
        self.path, self.names = path, names
        self.start = _Start(options.get("startingposition", "earliest"))
        self.piece = int(options.get("piecebytes", str(32 << 20)))

    def initialOffset(self) -> dict:
        return self.start.offset(self.path)

    def latestOffset(self) -> dict:
        return _end(self.path)

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        found = []
        for name in _files(self.path):
            if (start["file"] and _number(name) < _number(start["file"])) or not end["file"] or _number(name) > _number(end["file"]):
                continue
            first = start["byte"] if name == start["file"] else 0
            last = end["byte"] if name == end["file"] else _complete(self.path, name)
            found += [_Piece(name, at, min(at + self.piece, last)) for at in range(first, last, self.piece)]
        return found

    def read(self, partition: _Piece) -> Iterator[tuple]:
        for _, e in _lines(self.path, partition.name, partition.first, partition.end):
            if self.start.wants(partition.name, e):
                yield _row(e, self.names)

    def commit(self, end: dict) -> None:
        pass


class LogStreamReader(SimpleDataSourceStreamReader):
    """Events in log order from a place on, at most max_events a batch (the reader's admission control), read by the driver.

    Offsets are as those of LogPartsReader; a batch goes on at its byte, so no line is read twice. delay_ms holds events back until they
    are that old.
    """

    def __init__(self, path: str, names: list[str], options: dict):
        self.path, self.names = path, names
        self.start = _Start(options.get("startingposition", "earliest"))
        self.most = int(options.get("maxevents", "10000"))
        self.delay_ms = int(options.get("delayms", "0"))

    def initialOffset(self) -> dict:
        return self.start.offset(self.path)

    def _events(self, start: dict, end: dict | None) -> Iterator[tuple[dict, str, dict]]:
        """(offset after it, file, event)."""
        for name in _files(self.path):
            if start["file"] and _number(name) < _number(start["file"]):
                continue
            if end is not None and _number(name) > _number(end["file"]):
                return
            for after, e in _lines(self.path, name, start["byte"] if name == start["file"] else 0, end["byte"] if end is not None and name == end["file"] else None):
                yield {"file": name, "byte": after}, name, e

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import time

        out, end = [], start
        newest = time.time() * 1000 - self.delay_ms
        for after, name, e in self._events(start, None):
            if len(out) >= self.most or (self.delay_ms and e["timestamp_ms"] > newest):
                break
            if self.start.wants(name, e):
                out.append(_row(e, self.names))
            end = after
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([_row(e, self.names) for _, name, e in self._events(start, end) if self.start.wants(name, e)] if end["file"] else [])

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """spark.read / readStream .format("tidelog_files") .load(path).

    Options of streams: startingPosition (earliest, latest, file:position, gtid:set), pieceBytes (of a task), maxEvents and delayMs (either makes
    the driver read, batch by batch). The directory must be one that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog_files"

    def schema(self) -> str:
        return BINLOG_EVENTS.replace("\n", " ")

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> LogBatchReader:
        return LogBatchReader(self._options()["path"], schema.names)

    def streamReader(self, schema: StructType) -> LogPartsReader:
        if {"maxevents", "delayms"} & set(self._options()):
            return super().streamReader(schema)  # type: ignore[return-value]  # says that there is only the simple one
        return LogPartsReader(self._options()["path"], schema.names, self._options())

    def simpleStreamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(self._options()["path"], schema.names, self._options())
