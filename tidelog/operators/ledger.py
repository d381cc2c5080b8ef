"""Incremental processing with a ledger of work items."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.shared import SharedLog
from tidelog.session import shared_folder, small_side

PENDING, LEASED, DONE, RELEASED = "pending", "leased", "done", "released"
_EVENTS = "item string, event string, token bigint, worker string, until_ms bigint, through bigint"
#: Changes after which the ledger's events are folded into one snapshot.
SNAPSHOT_EVERY = 32


class WorkLedger:
    """Work items that are pending, leased or done, kept as events in the shared folder.

    A lease raises the item's fencing token and lasts for a time; when it has run out, the item may be leased again.
    A commit counts only with the item's highest token, so a writer that lost its lease changes nothing, however late
    it comes. A lease may be given back (released), as if it had never been. Output of an item lies at a path made of its token and
    name, which a retry replaces. through: how far an item is done already (an offset; null: nothing); a lease keeps it.

    Every change writes its events to a folder of its own and then puts one entry into a log with compare-and-set (SharedLog): of two
    workers that lease at once, one has the entry, and the other decides anew on what is left. So no two leases share a token.

    Items are control data: one for a bounded piece of input (here some log files), held as a table, never collected.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark, "ledger")
        self.log = SharedLog(spark, f"{self.path}/log")

    def _events(self, entries: list[dict]) -> DataFrame:
        folders = [f"{self.path}/events/{e['events']}" for e in entries]
        return self.spark.read.schema(_EVENTS).parquet(*folders) if folders else self.spark.createDataFrame([], _EVENTS)

    @staticmethod
    def _fold(events: DataFrame, now_ms: int) -> DataFrame:
        """item, state, token, until_ms, through."""
        by_token = events.groupBy("item", "token").agg(
            F.max(F.col("event") == DONE).alias("done"), F.max(F.col("event") == RELEASED).alias("released"),
            F.max("until_ms").alias("until_ms"), F.max("through").alias("through"), F.max_by("worker", "until_ms").alias("worker"),
        )
        last = by_token.groupBy("item").agg(F.max("token").alias("top"), F.max_by(F.struct("token", "done", "until_ms", "through", "worker"), F.when(~F.col("released"), F.col("token"))).alias("s"))
        state = F.when(F.col("s.done"), DONE).when(F.col("s.until_ms") >= now_ms, LEASED).otherwise(PENDING)
        # A token that was given back is not given out again: the next lease's is above all that were.
        return last.select("item", state.alias("state"), F.coalesce("s.token", "top").alias("token"), F.col("s.until_ms").alias("until_ms"), F.col("s.through").alias("through"), F.col("s.worker").alias("worker"), "top")

    def _change(self, make) -> DataFrame:
        """make(state): events to add. They are written, then put; after a conflict all is done anew. The events that were put."""
        while True:
            number, entries = self.log.read()
            name = uuid.uuid4().hex
            added = make(entries).select("item", "event", F.col("token").cast("long"), F.col("worker").cast("string"), F.col("until_ms").cast("long"), F.col("through").cast("long"))
            added.write.parquet(f"{self.path}/events/{name}")
            if self.log.put(number, {"events": name}):
                if len(entries) >= SNAPSHOT_EVERY:
                    self.compact()
                return self.spark.read.schema(_EVENTS).parquet(f"{self.path}/events/{name}")

    def compact(self) -> None:
        """Fold all events into one folder and forget the others. Given up if another worker changes the ledger meanwhile."""
        number, entries = self.log.read()
        name = uuid.uuid4().hex
        now = self._fold(self._events(entries), 0)
        event = F.when(F.col("state") == DONE, DONE).when(F.col("until_ms").isNotNull(), LEASED).otherwise(PENDING)
        kept = now.select("item", event.alias("event"), "token", "worker", "until_ms", "through")
        given_back = now.filter("top > token").select("item", F.lit(RELEASED).alias("event"), F.col("top").alias("token"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("long").alias("until_ms"), F.lit(None).cast("long").alias("through"))
        kept.unionByName(given_back).write.parquet(f"{self.path}/events/{name}")
        if self.log.put(number, {"events": name, "snapshot": True}):
            self.log.trim()

    def state(self, now_ms: int | None = None) -> DataFrame:
        """item, state, token, until_ms, through, worker. An expired lease counts as pending."""
        return self._fold(self._events(self.log.read()[1]), int(time.time() * 1000) if now_ms is None else now_ms).drop("top")

    def seed(self, events: DataFrame) -> None:
        """Enter what is known of items from elsewhere: rows item, event, token, worker, until_ms, through. Null items are ignored."""
        self._change(lambda _: events.filter(F.col("item").isNotNull()))

    def enqueue(self, items: DataFrame) -> None:
        """Add the items (column item) that the ledger does not have; null items are ignored."""

        def new(entries: list[dict]) -> DataFrame:
            missing = items.select("item").dropna().distinct().join(self._events(entries).select("item"), "item", "left_anti")
            return missing.select("item", F.lit(PENDING).alias("event"), F.lit(0).alias("token"), F.lit(None).alias("worker"), F.lit(None).alias("until_ms"), F.lit(None).alias("through"))

        self._change(new)

    def lease(self, worker: str | None = None, lease_ms: int = 600_000, now_ms: int | None = None) -> DataFrame:
        """Lease all items that are pending; returns (item, token, through) of what this call has leased. worker: a name of its own if none is given."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        name = worker or f"worker-{uuid.uuid4().hex}"

        def free(entries: list[dict]) -> DataFrame:
            pending = self._fold(self._events(entries), now_ms).filter(F.col("state") == PENDING)
            return pending.select("item", F.lit(LEASED).alias("event"), (F.col("top") + 1).alias("token"), F.lit(name).alias("worker"), F.lit(now_ms + lease_ms).alias("until_ms"), "through")

        return self._change(free).select("item", "token", "through")

    def write(self, rows: DataFrame, leases: DataFrame) -> None:
        """Write rows (with a column item) of the leased items, each to its own path; a retry replaces what it wrote. An item with many rows is written by several tasks."""
        held = rows.join(small_side(leases.select("item", F.col("token").alias("lease_token"))), "item")
        held.hint("rebalance", "item").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lease_token", "item").parquet(f"{self.path}/data")

    def commit(self, leases: DataFrame) -> None:
        """Mark leased items done. Leases that another worker has overtaken are left out, and would count for nothing."""

        def done(entries: list[dict]) -> DataFrame:
            current = leases.select("item", "token").join(self._fold(self._events(entries), 0).select("item", "token", "through"), ["item", "token"])
            return current.select("item", F.lit(DONE).alias("event"), "token", F.lit(None).alias("worker"), F.lit(None).alias("until_ms"), "through")

        self._change(done)

    def release(self, leases: DataFrame) -> None:
        """Give leases back: their items are as they were before."""
        self._change(lambda _: leases.select("item", F.lit(RELEASED).alias("event"), "token", F.lit(None).alias("worker"), F.lit(None).alias("until_ms"), F.lit(None).alias("through")))

    def results(self, schema: str) -> DataFrame:
        """Rows of all items that are done, as their valid writer wrote them. schema: of the rows, without item."""
        done = self.state().filter(F.col("state") == DONE).select("item", F.col("token").alias("lease_token"))
        data = self.spark.read.schema(f"{schema}, lease_token bigint, item string").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        return data.join(small_side(done), ["item", "lease_token"], "left_semi").drop("lease_token")


def last_valid_states(states: DataFrame) -> DataFrame:
    """Of each source's committed states, the one with the highest leader epoch, then the highest state id.

    Letter case and blanks of the status do not matter. Columns source_id, server_uuid, done_offset.
    A null epoch or offset is below all others.
    """
    ok = states.filter(F.upper(F.trim("run_status")) == "COMMITTED")
    best = F.max_by(F.struct("server_uuid", "last_offset"), F.struct(F.coalesce("leader_epoch", F.lit(-1)), "state_id"))
    return ok.groupBy("source_id").agg(best.alias("s")).select("source_id", "s.server_uuid", F.coalesce("s.last_offset", F.lit(-(2**62))).alias("done_offset"))


def item_name(source: str, term: str, file_no: Column, files_per_item: int = 16) -> Column:
    """A piece of a source's log: some files in succession. Their sizes are bounded by the server, whatever the source's size."""
    return F.concat_ws("~", F.coalesce(F.col(source), F.lit("")), F.col(term).cast("string"), F.floor(file_no / files_per_item).cast("string"))


def run_events(states: DataFrame, items: DataFrame, source: str = "source_id", term: str = "term_no", now_ms: int | None = None) -> DataFrame:
    """What saved states of runs say about items, as a ledger's events.

    states: source, term, leader_epoch, state_id, run_status, last_offset, saved_ms. items: item, source, term, low and high (the offsets
    that it spans). A leader's epoch is the fencing token (counted from 1 within a source), so what the runs of a replaced
    leader have committed counts for nothing, however late it was saved; of one leader the last committed state counts. Under a
    token an item before the state is done, one behind it is leased by a run that is long over (so pending again), and that in
    which the state lies is leased and done through the state's offset. Failed and withdrawn runs have leases that are given back.

    Every item is pending under token 0, which is all that is known of sources without states. Some rows an item and leader.
    """
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    known = states.withColumn("epoch", F.coalesce("leader_epoch", F.lit(-1)))
    good = F.upper(F.trim("run_status")) == "COMMITTED"
    last = known.filter(good).groupBy(source, "epoch").agg(F.max_by(F.struct(F.col(term).alias("t"), F.coalesce("last_offset", F.lit(-(2**62))).alias("o"), "state_id", "saved_ms"), "state_id").alias("s"))
    bad = known.filter(~good | good.isNull()).groupBy(source, "epoch").agg(F.max(F.struct("state_id", "saved_ms")).alias("f"))
    # Tokens leave room for the leases that were given back: those of an epoch's failed runs have the odd number above the epoch's.
    at = (2 * F.row_number().over(Window.partitionBy(source).orderBy("epoch"))).cast("long")  # one row a leader
    runs = last.join(bad, [source, "epoch"], "full_outer").select(source, F.struct("s", "f").alias("e"), at.alias("at"))
    each = items.join(small_side(runs), source, "left")
    over = lambda ms: F.least(F.coalesce(ms, F.lit(0)), F.lit(now_ms - 1))
    mark = F.struct("e.s.t", "e.s.o")
    before, within = F.struct(F.col(term), F.col("high")) <= mark, F.struct(F.col(term), F.col("low")) <= mark
    name = lambda s: F.concat(F.lit("run-"), s["state_id"].cast("string"))
    committed = F.when(F.col("e.s").isNotNull(), F.struct(
        F.when(before, DONE).otherwise(LEASED).alias("event"), F.col("at").alias("token"), name(F.col("e.s")).alias("worker"), over(F.col("e.s.saved_ms")).alias("until_ms"), F.when(within & ~before, F.col("e.s.o")).alias("through")))
    failed = F.when(F.col("e.f").isNotNull() & ~(before & F.col("e.s").isNotNull()), F.struct(
        F.lit(RELEASED).alias("event"), (F.col("at") + 1).alias("token"), name(F.col("e.f")).alias("worker"), over(F.col("e.f.saved_ms")).alias("until_ms"), F.lit(None).cast("long").alias("through")))
    none = F.struct(F.lit(PENDING).alias("event"), F.lit(0).cast("long").alias("token"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("long").alias("until_ms"), F.lit(None).cast("long").alias("through"))
    return each.select("item", F.explode(F.array_compact(F.array(none, committed, failed))).alias("x")).select("item", "x.*")


def process_new(spark: SparkSession, rows: DataFrame, work, columns: list[str], worker: str | None = None, path: str | None = None, known: DataFrame | None = None, offset: str | None = None) -> DataFrame:
    """Run `work` (DataFrame to DataFrame, keeping column item) over the rows (with item) that the ledger does not have as done; its committed rows.

    Items are entered (with what is known of them, see run_events), leased, written and committed. Only rows of leased items,
    and of these only those whose offset is beyond what an item is done through, go into the work. After a failure the same call with the same path
    continues: done items stay done, leased ones return to pending when their lease has run out.
    """
    ledger = WorkLedger(spark, path)
    if known is not None and not ledger.log.folder.names():
        ledger.seed(known)
    else:
        ledger.enqueue(rows.select("item"))
    leases = ledger.lease(worker)
    held = rows.join(small_side(leases.drop("token")), "item")
    held = (held if offset is None else held.filter(F.col("through").isNull() | (F.col(offset) > F.col("through")))).drop("through")
    out = work(held).select("item", *columns)
    ledger.write(out, leases)
    ledger.commit(leases)
    kinds = dict(out.dtypes)
    return ledger.results(", ".join(f"`{c}` {kinds[c]}" for c in columns)).select(*columns)
