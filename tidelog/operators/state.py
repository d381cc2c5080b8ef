"""Saved states of sources: as tables, and as what a running pipe keeps in the shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.shared import SharedLog

#: States that a source's history keeps, and the factor by which repeated roll-backs grow.
HISTORY, ROLLBACK_GROWTH = 50, 2


def fenced(states: DataFrame, keys: list[str], epoch: str, order: str) -> DataFrame:
    """The state that stands after all were saved in order: a save by a leader of a lower epoch than the current state's is ignored.

    So it is the last one among those of the highest epoch. Null epochs are below all others.
    """
    best = F.max_by(F.struct(*states.columns), F.struct(F.coalesce(F.col(epoch), F.lit(-(2**62))), F.col(order)))
    return states.groupBy(*keys).agg(best.alias("_s")).select("_s.*")


def kept_history(states: DataFrame, keys: list[str], order: str, capacity: int = HISTORY) -> DataFrame:
    """The last `capacity` states of each source, with back = 1 for the latest. The limit is kept on the map side too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return states.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= capacity)


def rollback_targets(states: DataFrame, keys: list[str], order: str, capacity: int = HISTORY) -> DataFrame:
    """States that repeated resets without a good checkpoint return to: 1 back, then 2, 4, 8 ... further.

    Adds attempt (1 is the first). The attempts after the last row of a source go to the earliest position.
    """
    kept = kept_history(states, keys, order, capacity)
    # Attempts remove 1, 2, 4 ... states: attempt n lands on the (2^n - 1)th from the end.
    n = F.log2(F.col("back") + 1)
    return kept.filter(n == F.floor(n)).withColumn("attempt", F.round(n).cast("int")).drop("back")


def accepted_checkpoints(states: DataFrame, keys: list[str], offset: str, order: str) -> DataFrame:
    """States that advance: their offset is above all earlier ones of the same keys (source and server). Null offsets never advance."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return states.withColumn("_high", F.max(offset).over(before)).filter(F.col(offset) > F.coalesce("_high", F.lit(-(2**63)))).drop("_high")


@dataclass(frozen=True)
class SourceState:
    """Where a source stands: time and offset of the last published mutation, end of its last transaction."""

    last_timestamp: int = 0
    last_offset: int = 0
    leader_epoch: int = 0
    last_position: str = ":4:4"  # the earliest position: an empty file name
    server_uuid: str | None = None
    gtid_set: str | None = None

    @classmethod
    def from_json(cls, text: str) -> SourceState:
        return cls(**{k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__})  # unknown fields are ignored


def _intervals(gtid_set: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for part in gtid_set.replace("\n", "").replace("\r", "").split(","):
        uuid, *ranges = part.strip().split(":")
        if uuid:
            found.setdefault(uuid.lower(), []).extend((int(a), int(b or a)) for a, _, b in (r.partition("-") for r in ranges))
    out = {}
    for uuid, ranges in found.items():
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        out[uuid] = merged
    return out


def gtid_within(a: str, b: str) -> bool:
    x, y = _intervals(a), _intervals(b)
    return all(u in y and all(any(s <= i and j <= e for s, e in y[u]) for i, j in r) for u, r in x.items())


class Repository:
    """A value kept in the shared folder, changed by compare-and-set: of two writers one is first, and the other decides on what that has left."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = SharedLog(spark, path)

    def _now(self, entries: list[dict]):
        return entries[-1].get("value") if entries else None

    def exists(self) -> bool:
        return self._now(self.log.read()[1]) is not None

    def get(self):
        return self._now(self.log.read()[1])

    def set(self, value) -> None:
        self.update(value, lambda _, new: new)

    def create(self, value) -> None:
        """Set the first value; FileExistsError if there is one."""
        if not self.log.change(lambda entries: (None, False) if self._now(entries) is not None else ({"snapshot": True, "value": value}, True)):
            raise FileExistsError(self.log.folder.path)

    def update(self, value, change: Callable) -> None:
        """Set change(current, value), or value if there is none yet. change may be called again after a conflict."""
        self.log.change(lambda entries: ({"snapshot": True, "value": value if self._now(entries) is None else change(self._now(entries), value)}, None))
        self.log.trim()

    def remove(self) -> None:
        self.log.change(lambda entries: ({"snapshot": True, "value": None}, None))


@dataclass
class Checkpointer:
    """State, history and roll-back of one source, in one repository. Saving is fenced by the leader's epoch, in the repository itself.

    generation counts the roll-backs: each starts a stream of its own.
    """

    repository: Repository
    leader_epoch: int = 0
    initial: SourceState = field(default_factory=SourceState)
    capacity: int = HISTORY

    def __post_init__(self) -> None:
        self.history: list[SourceState] = []
        self.step, self.generation = 1, 0
        self.saved: SourceState | None = None
        self._read()

    def _read(self) -> None:
        if data := self.repository.get():
            self.saved = SourceState.from_json(json.dumps(data["state"])) if data.get("state") else None
            self.history = [SourceState.from_json(json.dumps(s)) for s in data["history"]]
            self.step, self.generation = data.get("step", 1), data.get("generation", 0)

    def _store(self) -> bool:
        """Put what is here, unless a leader of a higher epoch has been there; then what it has left is taken. Whether it was put."""
        mine = {"state": asdict(self.saved) if self.saved else None, "history": [asdict(s) for s in self.history], "step": self.step, "generation": self.generation}

        def later(now: dict, new: dict) -> dict:
            epoch = lambda d: (d.get("state") or {}).get("leader_epoch", -1)
            return now if epoch(now) > self.leader_epoch and epoch(now) > epoch(new) else new

        self.repository.update(mine, later)
        if self.repository.get() == mine:
            return True
        self._read()
        return False

    def state(self) -> SourceState:
        return self.saved or self.initial

    def save(self, state: SourceState) -> bool:
        """Fenced: a state of a lower epoch than the saved one's is not stored."""
        if self.saved and self.saved.leader_epoch > state.leader_epoch:
            return False
        self.saved = state
        return self._store()

    def add(self, state: SourceState) -> None:
        self.history = [*self.history, state][-self.capacity :]
        self._store()

    def remove_last(self, count: int = 1) -> SourceState:
        if count <= 0 or not self.history or count > len(self.history):
            raise ValueError(f"cannot remove {count} of {len(self.history)} states")
        found = self.history[-count]
        del self.history[-count:]
        self._store()
        return found

    def commit(self, mutation: dict | None) -> bool:
        """Checkpoint at a mutation (ts_ms, offset, last_position, server_uuid, gtid_set) if it lies beyond the saved state."""
        if mutation is None:
            return False
        now = self.state()
        uuid, gtid_set = mutation.get("server_uuid"), mutation.get("gtid_set")
        by_place = (uuid or "").lower() == (now.server_uuid or "").lower() != "" or gtid_set is None or now.gtid_set is None
        if (by_place and now.last_offset >= mutation["offset"]) or (gtid_set is not None and now.gtid_set is not None and gtid_within(gtid_set, now.gtid_set)):
            return False
        state = SourceState(mutation["ts_ms"], mutation["offset"], self.leader_epoch, mutation["last_position"], uuid, gtid_set)
        if now.leader_epoch > self.leader_epoch:
            return False
        self.saved, self.history, self.step = state, [*self.history, state][-self.capacity :], 1
        return self._store()

    def reset(self) -> SourceState:
        """Back to an earlier state: 1, then 2, 4 ... states; to the earliest position when the history is too short."""
        if len(self.history) >= self.step:
            state = self.history[-self.step]
            self.history = self.history[: -self.step]
            self.step *= ROLLBACK_GROWTH
        else:
            self.history, state = [], SourceState(leader_epoch=self.leader_epoch)
        self.saved = state
        self.generation += 1
        self._store()
        return state


def with_retries(call: Callable, seconds: float = 180.0, longest_wait: float = 30.0, sleep: Callable[[float], None] | None = None):
    """call(), again after waits that double up to longest_wait, until it succeeds or `seconds` have gone. Only RuntimeErrors are tried again."""
    import time

    waited, n = 0.0, 0
    while True:
        try:
            return call()
        except RuntimeError:
            n += 1
            wait = min(0.002 * 2**n, longest_wait)
            if waited + wait > seconds:
                raise
            (sleep or time.sleep)(wait)
            waited += wait
