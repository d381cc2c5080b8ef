"""p4_unified over whole tables against a plain program: dictionaries and loops, row by row."""

import os
import re
from collections import defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest

from tidelog.plans import problems

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CODES = {0: "decimal", 246: "decimal", 1: "tinyint", 2: "smallint", 3: "int", 4: "float", 5: "double", 7: "timestamp", 17: "timestamp", 8: "bigint", 9: "mediumint", 10: "date", 14: "date", 11: "time", 19: "time", 12: "datetime", 18: "datetime", 13: "year", 15: "varchar", 253: "varchar", 16: "bit", 245: "json", 249: "text", 250: "text", 251: "text", 252: "text", 247: "char", 248: "char", 254: "char", 255: "geometry"}
WORDS = {"numeric": "decimal", "bool": "tinyint", "boolean": "tinyint", "integer": "int", "real": "double", "varbinary": "varchar", "binary": "char", "enum": "char", "set": "char"} | {a + b: "text" for a in ("tiny", "", "medium", "long") for b in ("text", "blob")}


def clauses(sql):
    """Clauses of an ALTER TABLE statement, without comments and back-quotes."""
    text = re.sub(r"/\*.*?\*/", " ", sql or "", flags=re.S).strip().rstrip(";")
    m = re.match(r"(?is)alter\s+table\s+\S+\s+(.*)", text)
    return [c.strip().replace("`", "") for c in re.split(r",(?![^(]*\))", m[1])] if m else []


def renames(sql):
    found = {}
    for c in clauses(sql):
        m = re.match(r"(?i)change\s+(?:column\s+)?(\w+)\s+(\w+)", c) or re.match(r"(?i)rename\s+column\s+(\w+)\s+to\s+(\w+)", c)
        if m and m[1].lower() != m[2].lower():
            found[m[2].lower()] = m[1].lower()
    return found


def defaults(sql):
    found = {}
    for c in clauses(sql):
        m = re.match(r"(?i)add\s+(?:column\s+)?(\w+)\s.*\bdefault\s+('[^']*'|[+-]?[\d.]+)", c)
        if m:
            found.setdefault(m[1].lower(), m[2].strip("'"))
    return found


def cast(value, kind):
    if value is None:
        return None
    if re.match(r"(tinyint|smallint|mediumint|int|bigint)", kind) and re.fullmatch(r"\s*[+-]?\d+\s*", value):
        return str(int(value))
    if re.match(r"(float|double)", kind):
        try:
            return str(float(value))
        except ValueError:
            return value
    if re.match(r"(datetime|timestamp)", kind):
        try:
            return datetime.fromisoformat(value.strip()).strftime("%Y-%m-%d %H:%M:%S")
        except ValueError:
            return value
    return value


def load(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def place(text):
    m = re.search(r"(\d+):(\d+):\d+$", text or "")
    return (int(m[1]) << 32) + int(m[2]) if m else 0


def brute():
    servers = defaultdict(dict)
    for d in load("data_sources"):
        servers[d["source_id"]].setdefault((d["server_uuid"] or "").strip().lower(), d["term_no"])

    def term(r):
        own = servers.get(r["source_id"], {})
        return next(iter(own.values())) if len(own) == 1 else own.get((r["server_uuid"] or "").strip().lower(), 0)

    tables = defaultdict(lambda: {"versions": [], "lists": {}, "rows": []})
    for h in load("schema_history"):
        if h["table_name"] is not None:
            cols = [(c["col_name"], re.sub(r"\s", "", c["column_type"].lower())) for c in h["column_list"] or []]
            kinds = frozenset((n.lower(), WORDS.get(w := re.match("[a-z]*", t)[0], w)) for n, t in cols)
            tables[h["source_id"], h["database_name"], h["table_name"]]["versions"].append({"at": (term(h), place(h["binlog_file_position"])), "id": h["schema_id"], "key": f"v{h['schema_id']}", "cols": cols, "kinds": kinds, "sql": h["sql_text"]})
    for m in load("mutations"):
        t = tables[m["source_id"], m["database_name"], m["table_name"]]
        m["at"] = (term(m), m["mutation_id"] if m["mutation_id"] is not None else place(m["binlog_pos"]))
        m["kinds"] = frozenset((c["col_name"].lower(), CODES.get(c["col_type"], str(c["col_type"]))) for c in m["table_columns"] or [])
        t["rows"].append(m)
        if m["kinds"]:
            t["lists"][m["kinds"]] = min(m["at"], t["lists"].get(m["kinds"], m["at"]))
    out = {}
    for t in tables.values():
        out |= one_table(t)
    return out


def one_table(t):
    recorded = t["versions"]
    first_at = min((v["at"] for v in recorded if v["cols"]), default=None)
    early = [{"at": at, "id": None, "key": f"l{sorted(k)}", "cols": sorted(k), "kinds": k, "sql": None} for k, at in t["lists"].items() if all(v["kinds"] != k for v in recorded) and (first_at is None or at < first_at)]
    order = lambda v: (v["at"], v["id"] is not None, v["id"] or 0, v["key"])
    chain = sorted([*recorded, *early], key=order)
    now, made, columns, before = {}, 0, {}, None
    for n, v in enumerate(chain):
        names = {c.lower() for c, _ in v["cols"]}
        moved = {}
        if before and before["cols"] and v["cols"]:
            old = {c.lower() for c, _ in before["cols"]}
            moved = {new: was for new, was in renames(v["sql"]).items() if was in old and new in names}
            moved = {new: was for new, was in moved.items() if (was not in names or was in moved) and (new not in old or new in moved.values())}
        then = {}
        for c, kind in v["cols"]:
            low = c.lower()
            number = now.get(moved[low]) if low in moved else now.get(low) if before and before["cols"] and low not in moved.values() else None
            if number is None:
                made += 1
                number = made
                columns[number] = {"start": n, "default": defaults(v["sql"]).get(low), "names": set()}
            columns[number] |= {"name": c, "kind": kind, "end": n}
            columns[number]["names"].add(low)
            then[low] = number
        v["route"], v["n"], now, before = then, n, then, v
    taken = set()
    for number in sorted(columns, key=lambda k: (-columns[k]["end"], -k)):
        c = columns[number]
        c["to"] = c["name"] if c["name"].lower() not in taken else f"{c['name']}_{number}"
        taken.add(c["name"].lower())
    known = {n for v in chain for n, _ in v["kinds"]}
    extra = {n for k in t["lists"] for n, _ in k} - known
    some = [v for v in chain if v["kinds"]]
    out = {}
    for m in t["rows"]:
        past = [v for v in recorded if v["at"] <= m["at"]]
        latest = max((v["at"] for v in past), default=None)
        force = min((v for v in past if v["at"] == latest), key=lambda v: v["id"], default=None)
        force = force if force and force["cols"] else None
        same = sorted((v for v in some if v["kinds"] == m["kinds"]), key=order)
        listed = ([v for v in same if v["at"] <= m["at"]] or [None])[-1] or (same[0] if same else None)
        first = min(some, key=lambda v: (v["id"] is None, *order(v)), default=None)
        image = {}
        for k, x in m["entity"] or ():
            image.setdefault(k.lower(), x)
        fits = lambda v: v is not None and set(image) <= {n for n, _ in v["kinds"]}
        choice = next((v for v in (force, listed, first) if fits(v)), force or listed or first)
        route = choice["route"] if choice else {}
        row, used = {}, set()
        for number in sorted(columns, key=lambda k: columns[k]["to"]) if choice else ():
            c = columns[number]
            own = [n for n, k in route.items() if k == number]
            others = [n for n in sorted(c["names"]) if n not in route and n not in used]
            used |= set(others)
            hit = next((n for n in [*own, *others] if n in image), None)
            fill = cast(c["default"], c["kind"]) if c["start"] > choice["n"] else None
            row[c["to"]] = cast(image[hit], c["kind"]) if hit is not None else fill
            used |= set(own)
        for n in [*image, *extra]:
            if n not in used and n not in row:
                row[n] = image.get(n)
        out[m["delivery_id"]] = (choice["id"] if choice else None, ";".join(f"{k}={'\\N' if x is None else x}" for k, x in sorted(row.items())))
    return out


def test_every_row_equals_the_plain_program(spark):
    want = brute()
    got = {r.delivery_id: (r.schema_id, r.unified_row) for r in problems.p4_unified(spark, SF).collect()}
    assert len(got) == len(want)
    wrong = [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), wrong[:3])


def test_every_row_of_a_table_has_the_same_columns(spark):
    found = defaultdict(set)
    for r in problems.p4_unified(spark, SF).collect():
        found[r.source_id, r.database_name, r.table_name].add(tuple(e.split("=")[0] for e in r.unified_row.split(";")))
    assert found and all(len(x) == 1 for x in found.values())
