"""Schemas that drift: versions, fingerprints, migration steps, routing of rows through them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.asof import previous_row
from tidelog.operators.skew import OrderPlan

_ID = r"(`[^`]+`|[\w$]+)"
_TABLE = rf"(?:`[^`]+`|[\w$]+)(?:\s*\.\s*(?:`[^`]+`|[\w$]+))?"
#: A clause begins after the table's name or after a comma.
_CLAUSE = rf"(?:\btable\s+(?:if\s+exists\s+)?{_TABLE}|,)\s*"
_CHANGE = rf"(?is){_CLAUSE}change\s+(?:column\s+)?(?:if\s+exists\s+)?{_ID}\s+{_ID}"
_RENAME = rf"(?is){_CLAUSE}rename\s+column\s+{_ID}\s+to\s+{_ID}"


def bare_statement(sql: Column) -> Column:
    """A statement without comments and text literals."""
    no_text = F.regexp_replace(sql, r"'(?:[^'\\]|\\.|'')*'", "''")
    return F.regexp_replace(no_text, r"(?s)/\*.*?\*/|(?m)(?:--\s|#).*$", " ")


# Text literals and comments, told apart by which begins first.
_LITERAL = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\""""
_TOKEN = rf"(?s){_LITERAL}|/\*.*?\*/|--\s[^\n]*|#[^\n]*"
_ADD = rf"(?is)(?:\btable\s+(?:if\s+exists\s+)?{_TABLE}|,)\s*add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?{_ID}\s+\w+(?:\s*\([^)]*\))?(?:\s+(?!default\b)[^\s,]+)*\s+default\s+('\d+'|[+-]?[\w.]+)"


def stated_defaults(sql: Column) -> Column:
    """Map of column (lower case) -> default that an ALTER TABLE statement states for a column it adds. Null text: empty.

    Literals only: a default that the server computes (CURRENT_TIMESTAMP, an expression) is not known here and is left out.
    """
    text = F.coalesce(sql, F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    between = F.split(text, _TOKEN, -1)
    mark = lambda i: F.when(F.get(tokens, i).rlike("^['\"]"), F.concat(F.lit("'"), i.cast("string"), F.lit("'"))).otherwise(F.lit(" "))
    numbered = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(mark(i), F.lit("")))), "")
    names = F.transform(F.regexp_extract_all(numbered, F.lit(_ADD), F.lit(1)), lambda n: F.lower(F.translate(n, "`", "")))

    def value(v: Column) -> Column:
        literal = F.get(tokens, F.translate(v, "'", "").try_cast("int"))
        inner = F.regexp_replace(F.regexp_replace(F.substring(literal, F.lit(2), F.length(literal) - 2), "''", "'"), r"\\(.)", "$1")
        return F.when(v.startswith("'"), inner).when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), v).when(F.lower(v) == "true", "1").when(F.lower(v) == "false", "0")

    pairs = F.zip_with(names, F.regexp_extract_all(numbered, F.lit(_ADD), F.lit(2)), lambda n, v: F.struct(n.alias("key"), value(v).alias("value")))
    known = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.map_from_entries(F.filter(known, lambda p, i: ~F.exists(F.slice(known, F.lit(1), i), lambda q: q["key"] == p["key"])))


def stated_renames(sql: Column) -> Column:
    """Array of (old, new) that an ALTER TABLE statement renames, lower case; CHANGE a a is no rename. Null text: empty."""
    text = bare_statement(F.coalesce(sql, F.lit("")))

    def pairs(pattern: str) -> Column:
        name = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: F.lower(F.translate(x, "`", "")))
        return F.zip_with(name(1), name(2), lambda a, b: F.struct(a.alias("old"), b.alias("new")))

    return F.filter(F.concat(pairs(_CHANGE), pairs(_RENAME)), lambda p: p["old"] != p["new"])


def plain_type(column_type: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(column_type, F.lit("")), r"\s+", ""))


def plain_columns(columns: Column) -> Column:
    """Columns as array of (name, type) with the spelling that counts; null columns: empty."""
    return F.transform(F.coalesce(columns, F.array().cast("array<struct<col_name:string,data_type:string,column_type:string,primary_key:boolean>>")), lambda c: F.struct(c["col_name"].alias("name"), plain_type(c["column_type"]).alias("type")))


def fingerprint(columns: Column) -> Column:
    """Hash of a version's column names and types whatever their order, keys and spelling."""
    return F.sha2(F.array_join(F.array_sort(F.transform(plain_columns(columns), lambda c: F.concat_ws("\1", c["name"], c["type"]))), "\2"), 256)


# Kinds of columns by the codes of a log's table maps; kinds that share a code are one here, whatever the statement calls them.
_KINDS = {"decimal": (0, 246), "tinyint": (1,), "smallint": (2,), "int": (3,), "float": (4,), "double": (5,), "timestamp": (7, 17), "bigint": (8,), "mediumint": (9,), "date": (10, 14), "time": (11, 19), "datetime": (12, 18), "year": (13,), "varchar": (15, 253), "bit": (16,), "json": (245,), "text": (249, 250, 251, 252), "char": (247, 248, 254), "geometry": (255,)}
_SAME = {"numeric": "decimal", "dec": "decimal", "fixed": "decimal", "bool": "tinyint", "boolean": "tinyint", "integer": "int", "real": "double", "varbinary": "varchar", "binary": "char", "enum": "char", "set": "char"} | {f"{size}{kind}": "text" for size in ("tiny", "", "medium", "long") for kind in ("text", "blob")}


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def recorded_kinds(columns: Column) -> Column:
    """Columns of a recorded version as array of (name, kind), in the terms of listed_kinds()."""
    word = lambda t: F.regexp_extract(t, "^[a-z]*", 0)
    return F.transform(plain_columns(columns), lambda c: F.struct(F.lower(c["name"]).alias("name"), F.coalesce(F.try_element_at(_lookup(_SAME), word(c["type"])), word(c["type"])).alias("type")))


def listed_kinds(columns: Column) -> Column:
    """Column list of a mutation (col_name, col_type a code) as array of (name, kind)."""
    kinds = _lookup({code: kind for kind, codes in _KINDS.items() for code in codes})
    return F.transform(columns, lambda c: F.struct(F.lower(c["col_name"]).alias("name"), F.coalesce(F.try_element_at(kinds, c["col_type"].cast("int")), c["col_type"].cast("string"), F.lit("")).alias("type")))


def kind_fingerprint(kinds: Column) -> Column:
    """Hash of names and kinds whatever their order: equal for a recorded version and a mutation's list of the same columns."""
    return F.sha2(F.array_join(F.array_sort(F.transform(kinds, lambda c: F.concat_ws("\1", c["name"], c["type"]))), "\2"), 256)


def as_recorded(kinds: Column) -> Column:
    """A mutation's (name, kind) list in the form of schema_history's column_list."""
    return F.transform(kinds, lambda c: F.struct(c["name"].alias("col_name"), c["type"].alias("data_type"), c["type"].alias("column_type"), F.lit(False).alias("primary_key")))


def migration_steps(old: Column, new: Column, renames: Column) -> Column:
    """Array of (kind, old_name, new_name, old_type, new_type) that lead from one version's plain columns to the next's.

    A rename counts if the statement says so, the old name is gone and the new one has come. Names are compared without
    letter case. A name that does not exist is the empty text.
    """
    low = lambda c: F.lower(c["name"])
    named = lambda cols, n: F.filter(cols, lambda c: low(c) == n)
    has = lambda cols, n: F.exists(cols, lambda c: low(c) == n)
    moved = F.filter(renames, lambda r: has(old, r["old"]) & has(new, r["new"]))
    real = F.filter(moved, lambda r: (~has(new, r["old"]) | F.exists(moved, lambda q: q["new"] == r["old"])) & (~has(old, r["new"]) | F.exists(moved, lambda q: q["old"] == r["new"])))

    def step(kind: str, a: Column, b: Column, s: Column, t: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("old_name"), b.alias("new_name"), s.alias("old_type"), t.alias("new_type"))

    none = F.lit("")
    one = lambda cols, n: F.get(named(cols, n), F.lit(0))
    is_old = lambda c: F.exists(real, lambda r: r["old"] == low(c))
    is_new = lambda c: F.exists(real, lambda r: r["new"] == low(c))
    pairs = F.concat(
        F.transform(real, lambda r: F.struct(one(old, r["old"]).alias("a"), one(new, r["new"]).alias("b"))),
        F.transform(F.filter(old, lambda c: ~is_old(c) & has(new, low(c)) & ~F.exists(real, lambda r: r["new"] == low(c))), lambda c: F.struct(c.alias("a"), one(new, low(c)).alias("b"))),
    )
    return F.concat(
        F.transform(F.filter(old, lambda c: ~is_old(c) & (~has(new, low(c)) | is_new(c))), lambda c: step("removed", c["name"], none, c["type"], none)),
        F.transform(F.filter(new, lambda c: ~is_new(c) & (~has(old, low(c)) | is_old(c))), lambda c: step("added", none, c["name"], none, c["type"])),
        F.transform(real, lambda r: step("renamed", one(old, r["old"])["name"], one(new, r["new"])["name"], one(old, r["old"])["type"], one(new, r["new"])["type"])),
        F.transform(F.filter(pairs, lambda p: p["a"]["type"] != p["b"]["type"]), lambda p: step("retyped", p["a"]["name"], p["b"]["name"], p["a"]["type"], p["b"]["type"])),
    )


def schema_versions(history: DataFrame, keys: list[str], order: list[str], hint: Column, columns: str = "column_list", sql: str = "sql_text", plan: OrderPlan | None = None) -> DataFrame:
    """history with plain columns (cols), fingerprint and the migration steps from the table's version before.

    Rows without table (any null key) are no versions and are dropped. steps is empty for the first version, for one
    whose predecessor had no columns, and for one without columns (the table has gone). Statements are read with
    column functions only. Repeated rows give versions without steps; order must be total.
    """
    rows = history.dropna(subset=keys).withColumns({"cols": plain_columns(F.col(columns)), "fingerprint": fingerprint(F.col(columns)), "renames": stated_renames(F.col(sql))})
    paired = previous_row(rows, keys, order, ["cols"], hint, "before", plan)
    both = (F.size("cols") > 0) & (F.size("before.cols") > 0)
    return paired.withColumn("steps", F.when(both, migration_steps(F.col("before.cols"), F.col("cols"), F.col("renames"))).otherwise(F.array().cast("array<struct<kind:string,old_name:string,new_name:string,old_type:string,new_type:string>>"))).drop("before")


def column_changes(versions: DataFrame, columns: list[str]) -> DataFrame:
    """One row a change: the given columns of the version, change_kind, old_name, new_name."""
    return versions.select(*columns, F.explode("steps").alias("s")).select(*columns, F.col("s.kind").alias("change_kind"), F.col("s.old_name").alias("old_name"), F.col("s.new_name").alias("new_name"))


_LINEAGE = "array<struct<name:string,lineage:bigint,type:string>>"


def _lineages(rows: Iterable[tuple], n_keys: int) -> Iterator[list]:
    """Follow columns through a table's versions: a column keeps its number through renames and type changes.

    rows: (key..., version, cols, steps) in order; yields (key..., version, [(name, number, type)]).
    """
    table: tuple | None = None
    now: dict[str, int] = {}
    made = 0
    for row in rows:
        key, (version, cols, steps) = row[:n_keys], row[n_keys:]
        if key != table:
            table, now, made = key, {}, 0
        if cols:
            moved = {s["new_name"].lower(): now.get(s["old_name"].lower()) for s in steps if s["kind"] == "renamed"}
            fresh = {s["new_name"].lower() for s in steps if s["kind"] == "added"}
            then: dict[str, int] = {}
            for c in cols:
                name = c["name"].lower()
                number = moved[name] if name in moved else None if name in fresh else now.get(name)
                if number is None:
                    made += 1
                    number = made
                then[name] = number
            now = then
        else:
            now = {}
        yield [*key, version, [{"name": c["name"], "lineage": now[c["name"].lower()], "type": c["type"]} for c in cols or ()]]


def lineage(versions: DataFrame, keys: list[str], order: list[str], version: str) -> DataFrame:
    """(keys, version, columns with their lineage): explicit chain of steps, walked in order with one version in memory.

    Versions are control data (one row a statement); a table's chain is walked by one task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    lean = versions.select(*keys, version, "cols", "steps", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    schema = lean.select(*keys, version, F.lit(None).cast(_LINEAGE).alias("lineage")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        rows = (row[: len(keys) + 3] for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        found = _lineages(rows, len(keys))
        while out := list(islice(found, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return lean.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).mapInArrow(run, schema)


def unified_columns(lineages: DataFrame, versions: DataFrame, keys: list[str], order: list[str], version: str, sql: str = "sql") -> DataFrame:
    """For each version, how its columns go into the table's one schema: (keys, version, route, target).

    route is a map name (lower case) -> (to_name, to_type). The one schema has a column for each lineage, under its last
    name and type; if a later column took that name, the older gets the suffix _<lineage>. target has all columns of the
    one schema: to_name -> (names it had, to_type, fill), where fill is what a row of this version has in a column that
    came later: the default stated when it was added, else null.
    """
    from pyspark.sql import Window

    stated = stated_defaults(F.col(sql)) if sql in versions.columns else F.create_map().cast("map<string,string>")
    placed = lineages.join(versions.select(version, F.struct(*order).alias("_at"), stated.alias("_stated")), version)
    each = placed.select(*keys, version, "_at", F.explode("lineage").alias("c"), F.try_element_at("_stated", F.lower("c.name")).alias("_default"))
    last = each.groupBy(*keys, "c.lineage").agg(
        F.max_by(F.struct("c.name", "c.type"), "_at").alias("_last"), F.max("_at").alias("_end"), F.min("_at").alias("_start"), F.min_by("_default", "_at").alias("_default"), F.collect_set(F.lower("c.name")).alias("_names")
    )
    taken = F.row_number().over(Window.partitionBy(*keys, F.lower("_last.name")).orderBy(F.desc("_end"), F.desc("lineage")))
    to_name = F.when(F.col("_rank") == 1, F.col("_last.name")).otherwise(F.concat_ws("_", "_last.name", F.col("lineage").cast("string")))
    final = last.withColumn("_rank", taken).select(*keys, "lineage", to_name.alias("to_name"), F.col("_last.type").alias("to_type"), "_start", "_default", "_names")
    whole = final.groupBy(*keys).agg(F.collect_list(F.struct("to_name", "to_type", "_start", "_default", "_names")).alias("_whole"))
    routed = each.select(*keys, version, "_at", F.lower("c.name").alias("name"), F.col("c.lineage").alias("lineage")).join(final, [*keys, "lineage"])
    routes = routed.groupBy(*keys, version, "_at").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("to_name", "to_type")))).alias("route")).join(whole, keys)
    fill = lambda c: F.when(c["_start"] > F.col("_at"), cast_text(c["_default"], c["to_type"]))
    target = F.transform("_whole", lambda c: F.struct(c["to_name"].alias("key"), F.struct(c["_names"].alias("names"), c["to_type"].alias("to_type"), fill(c).alias("fill")).alias("value")))
    return routes.select(*keys, version, "route", F.map_from_entries(target).alias("target"))


#: Classes of column types by how a value's text is made canonical: whole numbers, floating ones, times; 0 stands for all others.
_CLASSES = {1: r"^(tinyint|smallint|mediumint|int|bigint)", 2: r"^(float|double)", 3: r"^(datetime|timestamp)"}


def _class(kind: Column) -> Column:
    found = F.lit(0)
    for n, pattern in _CLASSES.items():
        found = F.when(kind.rlike(pattern), n).otherwise(found)
    return found


def _cast(value: Column, group: Column) -> Column:
    number = F.coalesce(value.try_cast("decimal(38,0)").cast("string"), value)
    return (
        F.when(group == 1, F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), number).otherwise(value))
        .when(group == 2, F.coalesce(value.try_cast("double").cast("string"), value))
        .when(group == 3, F.coalesce(F.date_format(value.try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), value))
        .otherwise(value)
    )


def cast_text(value: Column, kind: Column) -> Column:
    """A value in the canonical text of a column type; what the type cannot hold stays as it is (a drift never loses data)."""
    return _cast(value, _class(kind))


def route_image(image: Column, route: Column) -> Column:
    """An image renamed and cast to the one schema; columns that the version does not list keep name and value."""

    def one(e: Column) -> Column:
        to = F.try_element_at(route, F.lower(e["key"]))
        return F.struct(F.coalesce(to["to_name"], e["key"]).alias("key"), F.when(to.isNull(), e["value"]).otherwise(cast_text(e["value"], to["to_type"])).alias("value"), to.isNotNull().alias("listed"))

    moved = F.transform(F.map_entries(image), one)
    taken = lambda e, i: F.exists(moved, lambda o: o["listed"] & ~e["listed"] & (o["key"] == e["key"])) | F.exists(F.slice(moved, F.lit(1), i), lambda o: (o["listed"] == e["listed"]) & (o["key"] == e["key"]))
    return F.map_from_entries(F.transform(F.filter(moved, lambda e, i: ~taken(e, i)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


PLAN = "array<struct<name:string,names:array<string>,kind:int,fill:string>>"


def column_plan(route: Column, target: Column, extra: Column) -> Column:
    """How an image of a version becomes a row of the one schema: its columns in the order of their names, each with the names under which an
    image may have it, the class of its type, and what stands for it if it is absent.

    route, target: from unified_columns(). A column that the version lists is taken from there first; a name that it does not list goes
    where that name went in another version (the first column by name, if it went to several). extra: names that no version has.
    Plans are made once a version: rows only look them up.
    """
    columns = F.array_sort(F.map_entries(target))
    own = lambda c: F.transform(F.filter(F.map_entries(route), lambda e: e["value"]["to_name"] == c["key"]), lambda e: e["key"])
    stray = lambda c, i: F.filter(F.array_sort(c["value"]["names"]), lambda n: ~F.map_contains_key(route, n) & ~F.exists(F.slice(columns, F.lit(1), i), lambda d: F.array_contains(d["value"]["names"], n)))
    planned = F.transform(columns, lambda c, i: F.struct(c["key"].alias("name"), F.concat(own(c), stray(c, i)).alias("names"), _class(c["value"]["to_type"]).alias("kind"), c["value"]["fill"].alias("fill")))
    taken = F.flatten(F.transform(planned, lambda c: F.concat(c["names"], F.array(c["name"]))))
    return F.array_sort(F.concat(planned, extra_plan(F.array_except(extra, taken)))).cast(PLAN)


def extra_plan(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.array(n).alias("names"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("fill"))).cast(PLAN)


def planned_rows(rows: DataFrame, image: str, plan: str, into: str) -> DataFrame:
    """Rows with `into`: an array of (name, value) in the order of names, all columns of the plan and what else the image has under its own name.

    Names are compared in lower case; of names that are then equal the first counts. A null image or plan is an empty one. What every column
    of a row needs is made once a row, in a projection of its own.
    """
    keys = F.map_keys(image)
    lower = F.transform(keys, F.lower)
    firsts = F.filter(F.transform(F.map_entries(image), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), lambda e, i: F.array_position(lower, e["key"]) == i + 1)
    low = F.coalesce(F.when(F.forall(keys, lambda k: k == F.lower(k)), F.col(image)).otherwise(F.map_from_entries(firsts)), F.create_map().cast("map<string,string>"))
    made = rows.withColumns({"_low": low, "_plan": F.coalesce(F.col(plan), F.array().cast(PLAN))})

    def value(c: Column) -> Column:
        first = F.get(c["names"], F.lit(0))
        other = F.get(F.filter(c["names"], lambda n: F.map_contains_key("_low", n)), F.lit(0))
        return F.when(F.map_contains_key("_low", first), _cast(F.try_element_at("_low", first), c["kind"])).when((F.size(c["names"]) > 1) & other.isNotNull(), _cast(F.try_element_at("_low", other), c["kind"])).otherwise(c["fill"])

    row = F.transform("_plan", lambda c: F.struct(c["name"].alias("name"), value(c).alias("value")))
    made = made.withColumns({"_row": row, "_stray": F.array_except(F.map_keys("_low"), F.flatten("_plan.names"))})
    more = F.concat(F.filter("_row", lambda c: ~F.array_contains("_stray", c["name"])), F.transform("_stray", lambda n: F.struct(n.alias("name"), F.try_element_at("_low", n).alias("value"))))
    return made.withColumn(into, F.when(F.size("_stray") == 0, F.col("_row")).otherwise(F.array_sort(more))).drop("_low", "_plan", "_row", "_stray")
