"""Publishing mutations: wire records, and sinks for batches that may be repeated."""

from __future__ import annotations

import copy
import queue
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import DestinationError
from tidelog.functions.keys import record_key, topic
from tidelog.operators.mutate import wire_image
from tidelog.operators.route import pool_checkpoint, to_pool, with_member
from tidelog.shared import Folder

Publish = Callable[[DataFrame, int], None]


def wire_table() -> Column:
    """Table as it is sent: key columns in the order of their names, columns by name, overriding database only if it is not empty."""
    return F.struct(
        "table_id", F.col("table_name").alias("name"), F.col("database_name").alias("database"), F.array_sort(F.coalesce("primary_key", F.array().cast("array<string>"))).alias("primary_key"),
        F.array_sort(F.transform("table_columns", lambda c: F.struct(c["col_name"].alias("name"), c["col_type"].alias("type"), c["is_primary_key"].alias("is_primary_key"), c["col_position"].alias("position")))).alias("columns"),
        F.nullif("overriding_database", F.lit("")).alias("overriding_database"),
    )


def wire_header() -> Column:
    return F.struct(
        F.col("binlog_pos").alias("pos"), "server_id", F.col("ts_ms").alias("timestamp"), F.col("mutation_type").alias("type"), "last_transaction_pos", F.col("last_transaction_ts_ms").alias("last_transaction_timestamp"),
        "leader_epoch", F.col("mutation_id").alias("id"), "event_row_position", "server_uuid", "last_transaction_gtid_set", "begin_transaction_pos", "begin_transaction_gtid",
    )


def wire_records(mutations: DataFrame, prefix: str, service: Column) -> DataFrame:
    """(topic, key, header, table, entity, previous_entity) of mutations; previous_entity only for updates, values as bytes."""
    db = F.col("database_name")
    return mutations.select(
        topic(prefix, service, db, "table_name", "overriding_database").alias("topic"), record_key(db, "table_name", "entity", F.coalesce("primary_key", F.array().cast("array<string>"))).alias("key"),
        wire_header().alias("header"), wire_table().alias("table"), wire_image(F.col("entity")).alias("entity"), F.when(F.col("mutation_type") == 2, wire_image(F.col("previous_entity"))).alias("previous_entity"),
    )


def file_sink(path: str) -> Publish:
    """Writes each batch to its own directory, which a repeated batch replaces."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return publish


def kafka_records(batch: DataFrame) -> DataFrame:
    """(topic, key, value): the value is the record as JSON, with bytes in base64."""
    value = F.to_json(F.struct(*[c for c in batch.columns if c not in ("topic", "key")]))
    return batch.select("topic", F.col("key").cast("binary").alias("key"), value.cast("binary").alias("value"))


def kafka_sink(options: dict[str, str]) -> Publish:
    """Writes (topic, key, value) with acknowledgement by all replicas. Needs Spark's Kafka connector on the class path."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        kafka_records(batch).write.format("kafka").options(**{"kafka.acks": "all", "kafka.max.in.flight.requests.per.connection": "1"} | options).save()

    return publish


def memory_sink(to: list) -> Publish:
    """Keeps rows in a list; for tests of small batches only."""
    return lambda batch, batch_id: to.append((batch_id, batch.collect()))


class Validator:
    """A check that reports a batch's offending rows and may remember things from batch to batch. Rows are published all the same."""

    def validate(self, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def reset(self) -> None:
        """Forget what came before: the source starts again."""


class Check(Validator):
    """A check of each batch on its own."""

    def __init__(self, check: Callable[[DataFrame], DataFrame]):
        self.validate = check  # type: ignore[method-assign]


class OrderCheck(Validator):
    """Rows whose offset is below that of the row before, the last row of the batch before included (one number a source is remembered)."""

    def __init__(self, offset: str = "offset", order: tuple[str, ...] = ("offset",), source: str = "source_id", ignore_special: bool = False):
        self.offset, self.order, self.source, self.ignore_special = offset, order, source, ignore_special
        self.last: dict[str, int] = {}

    def validate(self, batch: DataFrame) -> DataFrame:
        ends = batch.groupBy(self.source).agg(F.max_by(self.offset, F.struct(*self.order)).alias("o")).collect()  # one row a source
        known = F.create_map(*[x for s, o in self.last.items() if s is not None for x in (F.lit(s), F.lit(o))]) if self.last else F.create_map().cast("map<string,bigint>")
        w = Window.partitionBy(self.source).orderBy(*self.order)
        before = F.coalesce(F.lag(self.offset).over(w), F.try_element_at(known, F.col(self.source)))
        late = (F.col(self.offset) < F.col("previous_offset")) & (F.col(self.offset) > 0 if self.ignore_special else F.lit(True))
        found = batch.withColumn("previous_offset", before).filter(late)
        self.last = self.last | {r[self.source]: r.o for r in ends if r.o is not None}
        return found

    def reset(self) -> None:
        self.last = {}


@dataclass
class Destination:
    """Validates, maps, publishes and remembers what was published. on_error listeners hear of a failure once.

    validators: by name, checks (Validators, or functions from a batch to its offending rows), counted under their name.
    delay_ms: a batch waits until its latest mutation is that old. pool_size: rows are spread over members by key, in order.
    counts: of published and failed rows, and of failures by their kind (send.failure.<kind>).
    keep: whether a batch is kept while it is sent; False where what it is made from is kept (a pipe with a transformation keeps its pieces)
    and making its rows again takes less room than they do.
    """

    publish: Publish
    mapper: Callable[[DataFrame], DataFrame] = lambda df: df
    delay_ms: int = 0
    pool_size: int = 0
    key: str = "routing_key"
    order: tuple[str, ...] = ("offset",)
    offset: str = "offset"
    timestamp: str = "ts_ms"
    validators: dict[str, Validator | Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    on_error: list[Callable[[Exception], None]] = field(default_factory=list)
    on_send: list[Callable[[DataFrame], None]] = field(default_factory=list)
    on_start: list[Callable[[], None]] = field(default_factory=list)
    last_published: dict[int, int] = field(default_factory=dict)
    last_mutation: dict | None = None
    counts: dict[str, int] = field(default_factory=lambda: {"publish.success": 0, "send.failure": 0})
    started: bool = False
    keep: bool = True

    def open(self) -> None:
        """Start: validators forget what they have seen. Opening twice does nothing."""
        if self.started:
            return
        for v in self.validators.values():
            if isinstance(v, Validator):
                v.reset()
        self.started = True
        for listener in self.on_start:
            listener()

    def close(self) -> None:
        self.started = False

    def send(self, batch: DataFrame, batch_id: int) -> None:
        """Publish one batch; an empty one is nothing. Raises DestinationError. The batch is computed once, whatever looks at it, if it is kept."""
        sent = to_pool(batch, self.key, self.pool_size, list(self.order)) if self.pool_size else batch.withColumn("member", F.lit(0))
        if self.keep:
            sent.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            header = [c for c in (self.timestamp, self.offset, "binlog_pos", "last_txn", "server_uuid", "gtid_set") if c in batch.columns]
            latest = F.max_by(F.struct(*header), F.col(self.offset)).alias("latest")
            figures = [F.max(self.offset).alias("offset"), F.max(self.timestamp).alias("ts"), F.count("*").alias("n"), latest]
            if not self.keep and not (self.pool_size or self.delay_ms or self.validators or self.on_send):  # one look at the batch will do
                if not batch.isEmpty():
                    seen = Observation()
                    self.publish(self.mapper(batch.observe(seen, *figures)), batch_id)
                    self._published([Row(member=0, **seen.get)])
                return
            stats = sent.groupBy("member").agg(*figures).collect()  # one row a member
            if not stats:
                return
            checked = sent.drop("member")
            for name, validator in self.validators.items():
                offending = validator.validate(checked) if isinstance(validator, Validator) else validator(checked)
                self.counts[name] = self.counts.get(name, 0) + offending.count()
            self._wait(max((r.ts for r in stats if r.ts is not None), default=0))
            self.publish(self.mapper(checked), batch_id)
            self._published(stats)
            for listener in self.on_send:
                listener(checked)
        except Exception as e:
            self.counts["send.failure"] += 1
            kind = f"send.failure.{type(e).__name__}"
            self.counts[kind] = self.counts.get(kind, 0) + 1
            for heard in self.on_error:
                heard(e)
            raise DestinationError(str(e)) from e
        finally:
            if self.keep:
                sent.unpersist()

    def _published(self, stats: list[Row]) -> None:
        for r in stats:
            self.last_published[r.member] = max(r.offset, self.last_published.get(r.member, r.offset))
        self.last_mutation = max((r.latest.asDict(recursive=True) for r in stats), key=lambda m: m[self.offset])
        self.counts["publish.success"] += sum(r.n for r in stats)

    def _wait(self, latest_ms: int) -> None:
        left = latest_ms + self.delay_ms - time.time() * 1000 if self.delay_ms else 0
        if left > 0:
            threading.Event().wait(left / 1000)

    def checkpoint_offset(self) -> int | None:
        """Least last published offset of the members that have published; see pool_checkpoint for the table form."""
        return min(self.last_published.values(), default=None)


class BufferedDestination:
    """Takes batches into a bounded queue, from which one thread sends them on, all that wait as one batch.

    A batch waits as files in the shared folder, as what it was made from ends with its call; what was not sent when a process ended is
    sent when the buffer is opened again, so nothing is lost between two checkpoints. A repeated batch replaces its files. A full
    queue makes send() wait. After a failure the thread has ended and listeners have heard of it; send() then raises.
    """

    def __init__(self, spark: SparkSession, destination: Destination, size: int, path: str):
        if size < 1:
            raise ValueError("a buffer must hold a batch")
        self.spark, self.destination, self.path = spark, destination, path
        self.queue: queue.Queue = queue.Queue(size)
        self.on_error = destination.on_error
        self.counts = destination.counts
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()
        self._failed: Exception | None = None

    def remaining_capacity(self) -> int:
        return self.queue.maxsize - self.queue.qsize()

    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def open(self) -> None:
        if self.is_running():
            return
        self.destination.open()
        self._failed, self.queue = None, queue.Queue(self.queue.maxsize)
        self._stop.clear()
        self._left = [n for n in Folder(self.spark, self.path).names() if n.startswith("batch-")]
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def send(self, batch: DataFrame, batch_id: int) -> None:
        """Put a batch into the queue, waiting while it is full. Raises DestinationError if sending on has failed."""
        name = f"batch-{batch_id:012d}"
        if self._failed is None and self.is_running():
            batch.write.mode("overwrite").parquet(f"{self.path}/{name}")
            if self.queue.full():
                self.counts["buffer.full"] = self.counts.get("buffer.full", 0) + 1
            while self._failed is None and self.is_running():
                try:
                    self.queue.put(name, timeout=0.1)
                    self.counts["buffer.size"] = self.queue.qsize()
                    return
                except queue.Full:
                    pass
        raise DestinationError(f"the buffer does not run: {self._failed}")

    def drain(self, wait: float = 0.1) -> bool:
        """Send on what waits, as one batch; whether there was anything."""
        names = self._left
        self._left = []
        try:
            names = names or [self.queue.get(timeout=wait)]
        except queue.Empty:
            return False
        while True:
            try:
                names.append(self.queue.get_nowait())
            except queue.Empty:
                break
        names = sorted(set(names))
        files = Folder(self.spark, self.path)
        rows = self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])
        self.destination.send(rows, int(names[-1].split("-")[1]))
        for n in names:
            files.remove(n)
        return True

    def _run(self) -> None:
        try:
            while not self._stop.is_set() or self._left or not self.queue.empty():
                self.drain()
        except Exception as e:  # the destination has told its listeners
            self._failed = e

    def close(self, seconds: float = 30.0) -> None:
        """Send what waits, then stop."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join(seconds)
        self.destination.close()

    @property
    def last_mutation(self) -> dict | None:
        return self.destination.last_mutation

    def checkpoint_offset(self) -> int | None:
        return self.destination.checkpoint_offset()


class DestinationPool:
    """Members that publish, and fail, on their own; a batch's rows go to them by their key's hash, in order within a member.

    send() returns when all members have; if any failed, listeners hear of the first failure and it is raised. The checkpoint is the
    least of the members' last published offsets; a member that never had rows does not hold it back.
    """

    def __init__(self, members: list, key: str = "routing_key"):
        self.members, self.key = members, key
        self.on_error: list[Callable[[Exception], None]] = []

    def open(self) -> None:
        for m in self.members:
            m.open()

    def close(self) -> None:
        for m in self.members:
            m.close()

    def send(self, batch: DataFrame, batch_id: int) -> None:
        rows = with_member(batch, self.key, len(self.members)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with ThreadPoolExecutor(len(self.members)) as pool:
                sent = [pool.submit(m.send, rows.filter(F.col("member") == n).drop("member"), batch_id) for n, m in enumerate(self.members)]
            errors = [e for s in sent if (e := s.exception())]
        finally:
            rows.unpersist()
        if errors:
            for listener in self.on_error:
                listener(errors[0])
            raise errors[0] if isinstance(errors[0], DestinationError) else DestinationError(str(errors[0]))

    @property
    def counts(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for m in self.members:
            for k, v in m.counts.items():
                found[k] = found.get(k, 0) + v
        return found

    @property
    def last_mutation(self) -> dict | None:
        """That of the member that is behind, so that a checkpoint there skips nothing."""
        return min((m.last_mutation for m in self.members if m.last_mutation), key=lambda m: m["offset"], default=None)

    def checkpoint_offset(self) -> int | None:
        return min((o for m in self.members if (o := m.checkpoint_offset()) is not None), default=None)


def build_destination(publish: Publish | None, mapper: Callable[[DataFrame], DataFrame] | None, validators: dict[str, Validator] | None = None, delay_ms: int = 0, buffer_size: int = 0, pool_size: int = 0, spark: SparkSession | None = None, buffers: str = "", **more):
    """A destination put together: validators are inside, then the buffer, and the pool outermost (each member has its own buffer).

    publish and mapper must be given; buffers is the folder in which buffers keep waiting batches.
    """
    if publish is None or mapper is None:
        raise ValueError("a destination needs a publisher and a mapper")

    def one(n: int):
        made = Destination(publish if not pool_size else _member(publish, n), mapper, delay_ms, validators={k: _fresh(v) for k, v in (validators or {}).items()}, **more)
        return BufferedDestination(spark, made, buffer_size, f"{buffers}/{n}") if buffer_size else made

    return DestinationPool([one(n) for n in range(pool_size)]) if pool_size else one(0)


def _member(publish: Publish, n: int) -> Publish:
    """Members have batch numbers of their own, as they write side by side."""
    return lambda batch, batch_id: publish(batch, batch_id * 1000 + n)


def _fresh(v: Validator) -> Validator:
    return copy.deepcopy(v) if isinstance(v, OrderCheck) else v


__all__ = ["BufferedDestination", "Check", "Destination", "DestinationError", "DestinationPool", "OrderCheck", "Validator", "build_destination", "file_sink", "kafka_sink", "memory_sink", "pool_checkpoint", "wire_header", "wire_records", "wire_table"]
