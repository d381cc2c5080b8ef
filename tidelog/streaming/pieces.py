"""Events of a log in pieces: rows of bytes that hold many events, so that a long log is sorted, shuffled and kept in little space."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece: its source, its lowest and highest offset, bytes of its events in memory, and the events as a compressed Arrow stream.
PIECES = "source_id string, first bigint, last bigint, size bigint, data binary"
#: Bytes of events, as they are in memory, that are looked at together; bytes of pieces from which on they wait on disk.
TOGETHER, IN_MEMORY = 6 << 20, 32 << 20
#: Parts that overlapping pieces are cut into at once, at most.
_PARTS = 32
_LAST = np.iinfo(np.int64).max


class Piece(NamedTuple):
    """A piece in a Spool. Events without offset come last."""

    first: int
    last: int
    size: int
    at: int
    length: int


def to_bytes(events: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, events.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(events)
    return out.getvalue().to_pybytes()


def of_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def offsets(events: pa.Table) -> np.ndarray:
    return pc.fill_null(events["offset"].combine_chunks(), _LAST).to_numpy(zero_copy_only=False)


def by_offset(events: pa.Table) -> pa.Table:
    """Events in the order of their offsets; those of one offset stay as they are."""
    at = offsets(events)
    return events if (at[1:] >= at[:-1]).all() else events.take(np.argsort(at, kind="stable"))


def piece_row(source: str | None, events: pa.Table) -> dict:
    """The row of PIECES for ordered events."""
    at = offsets(events)
    return {"source_id": source, "first": int(at[0]), "last": int(at[-1]), "size": events.nbytes, "data": to_bytes(events)}


def into_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of events one piece a source, in order within itself."""
    schema = pa.schema([("source_id", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
    for batch in batches:
        events = pa.Table.from_batches([batch])
        for source in pc.unique(events["source_id"]).to_pylist():
            own = pc.is_null(events["source_id"]) if source is None else pc.fill_null(pc.equal(events["source_id"], source), False)
            yield pa.RecordBatch.from_pylist([piece_row(source, by_offset(events.filter(own).combine_chunks()))], schema)


class Spool:
    """Pieces of one source, which wait in memory or, if they are many, in a temporary file of the executor."""

    def __init__(self, together: int = TOGETHER):
        self.together = together
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.file = tempfile.SpooledTemporaryFile(IN_MEMORY, dir=folder if folder and os.path.isdir(folder) else None)

    def put(self, first: int, last: int, size: int, data: bytes) -> Piece:
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(data)
        return Piece(first, last, size, at, len(data))

    def _read(self, p: Piece) -> pa.Table:
        self.file.seek(p.at)
        return of_bytes(self.file.read(p.length))

    def ordered(self, pieces: list[Piece]) -> Iterator[pa.Table]:
        """All events in the order of their offsets, in tables of about `together` bytes, whatever order the pieces have and however they overlap."""
        held: list[Piece] = []
        for some in _overlapping(pieces):
            n = sum(p.size for p in some)
            if held and sum(p.size for p in held) + n > self.together:
                yield self._joined(held)
                held = []
            if n > self.together and len(some) > 1 and some[0].first < max(p.last for p in some):
                yield from self.ordered(self._cut(some, n))
            else:
                held += some
        if held:
            yield self._joined(held)

    def _joined(self, pieces: list[Piece]) -> pa.Table:
        return by_offset(pa.concat_tables([self._read(p) for p in pieces]).combine_chunks())

    def _cut(self, pieces: list[Piece], n: int) -> list[Piece]:
        """The same events in pieces of which none reaches over a cut. Every cut has events on both sides, so cutting comes to an end."""
        low, high = pieces[0].first, max(p.last for p in pieces)
        spread = np.sort(np.concatenate([np.linspace(float(p.first), float(p.last), 9) for p in pieces]))
        parts = min(_PARTS, 1 + int(n // self.together))
        wanted = spread[[len(spread) * k // parts for k in range(1, parts)]]
        cuts = sorted({min(max(int(c), low + 1), high) for c in wanted})
        found = []
        for p in pieces:
            events = self._read(p)
            at = offsets(events)
            ends = [0, *np.searchsorted(at, cuts), len(at)]
            for a, b in zip(ends, ends[1:]):
                if a < b:
                    own = events.slice(a, b - a)
                    found.append(self.put(int(at[a]), int(at[b - 1]), p.size * int(b - a) // len(at), to_bytes(own)))
        return found

    def close(self) -> None:
        self.file.close()


def _overlapping(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Pieces in order, those together whose stretches of offsets touch."""
    found: list[Piece] = []
    end = 0
    for p in sorted(pieces, key=lambda p: (p.first, p.last)):
        if found and p.first > end:
            yield found
            found = []
        end = max(end, p.last) if found else p.last
        found.append(p)
    if found:
        yield found
