"""Sets of global transaction ids as column functions.

A set is a map from lower-case server uuid to sorted, collapsed closed intervals. Null texts are null sets, the empty
text is the empty set; intervals that cannot be read are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTERVAL = "struct<s:bigint,e:bigint>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _interval(text: Column) -> Column:
    ends = F.split(F.trim(text), "-")
    first = F.get(ends, F.lit(0)).try_cast("long")
    return F.struct(first.alias("s"), F.coalesce(F.get(ends, F.lit(1)).try_cast("long"), first).alias("e"))


def collapse(intervals: Column) -> Column:
    """Sort closed intervals and merge those that overlap or touch."""
    empty = F.array().cast(f"array<{_INTERVAL}>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= last["e"] + 1), merged).otherwise(F.concat(done, F.array(x)))

    return F.reduce(F.array_sort(intervals), empty, add)


def parse(text: Column | str) -> Column:
    """Set of a text `uuid:1-5:7,uuid2:3`: line ends are dropped, uuids lower-cased and merged, `n` is `n-n`."""
    plain = F.regexp_replace(_col(text), r"[\r\n]", "")
    parts = F.filter(F.split(plain, ","), lambda p: F.trim(p) != "")
    entries = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.get(F.split(p, ":"), F.lit(0)))).alias("u"), F.filter(F.transform(F.slice(F.split(p, ":"), F.lit(2), F.greatest(F.size(F.split(p, ":")) - 1, F.lit(0))), _interval), lambda i: i["s"].isNotNull()).alias("i")))
    uuids = F.array_sort(F.array_distinct(F.transform(entries, lambda x: x["u"])))
    each = F.transform(uuids, lambda u: F.struct(u.alias("key"), collapse(F.flatten(F.transform(F.filter(entries, lambda x: x["u"] == u), lambda x: x["i"]))).alias("value")))
    return F.map_from_entries(each)


def text(gtids: Column) -> Column:
    """Canonical text: uuids in order, every interval as s-e."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(gtids)), lambda u: F.concat_ws(":", u, F.array_join(F.transform(F.element_at(gtids, u), lambda i: F.concat_ws("-", i["s"].cast("string"), i["e"].cast("string"))), ":"))), ",")


def contained(a: Column, b: Column) -> Column:
    """Whether every interval of a lies within one of b's; the empty set lies in all. Null if a is null, false if b is."""
    within = lambda i, u: F.exists(F.coalesce(F.try_element_at(b, u), F.array().cast(f"array<{_INTERVAL}>")), lambda j: (j["s"] <= i["s"]) & (i["e"] <= j["e"]))
    return F.when(a.isNull(), F.lit(None).cast("boolean")).when(b.isNull(), F.lit(False)).otherwise(F.forall(F.map_keys(a), lambda u: F.map_contains_key(b, u) & F.forall(F.element_at(a, u), lambda i: within(i, u))))


def equal(a: Column, b: Column) -> Column:
    return text(a) == text(b)


def same_server(uuid_a: Column, gtid_a: Column, uuid_b: Column, gtid_b: Column) -> Column:
    """Whether two positions are to be compared by file and place: same server, or a side without GTID set."""
    return F.coalesce(F.lower(uuid_a) == F.lower(uuid_b), F.lit(False)) | gtid_a.isNull() | gtid_b.isNull()


def compare_positions(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """-1, 0 or 1 for two positions with file_no, position, gtids (a set) and uuid. What follows a position does not count.

    By file number and place if same_server, else by GTID sets: equal 0, contained -1, otherwise 1. Not a total order
    between servers: use it in predicates, never to sort.
    """
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    by_place = F.coalesce(order(a["file_no"], b["file_no"]), order(a["position"], b["position"]), F.lit(0))
    by_gtid = F.when(equal(a["gtids"], b["gtids"]), 0).when(contained(a["gtids"], b["gtids"]), -1).otherwise(1)
    return F.when(same_server(a["uuid"], a["gtids"], b["uuid"], b["gtids"]), by_place).otherwise(by_gtid)
