"""A small interpreter of MySQL schema statements: applies them to a catalog, and renames databases in their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[ \t][^\n]*|\#[^\n]*|/\*.*?\*/)
      |(?P<quoted>`(?:[^`]|``)*`)
      |(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      |(?P<word>[\w$]+)
      |(?P<sign>.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def name(self) -> str:
        return self.text[1:-1].replace("``", "`") if self.kind == "quoted" else self.text

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.lower() in words

    def is_name(self) -> bool:
        return self.kind in ("quoted", "word")


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup or "sign", m[0]) for m in _TOKEN.finditer(sql)]


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    column_type: str
    primary_key: bool = False


@dataclass
class Catalog:
    """Columns by database and table, as a server's information schema would list them."""

    databases: dict[str, dict[str, list[Column]]] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog({d: {t: list(c) for t, c in tables.items()} for d, tables in self.databases.items()})

    def table(self, database: str, table: str) -> list[Column] | None:
        return self.databases.get(database, {}).get(table)


class UnsupportedStatement(ValueError):
    """A statement that the interpreter cannot follow (CREATE TABLE ... SELECT, partition clauses)."""


class _Reader:
    """Significant tokens of a statement, read from the left."""

    def __init__(self, items: list[Token]):
        self.items = [t for t in items if t.kind != "space"]
        self.at = 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else Token("end", "")

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def take(self, *words: str) -> bool:
        """Skip these words if they come next."""
        if all(self.peek(i).is_word(w) for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.peek().kind == "sign" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def table_name(self, default: str | None) -> tuple[str, str]:
        first = self.next()
        if not first.is_name():
            raise UnsupportedStatement(f"no table name at {first.text!r}")
        return (first.name, self.next().name) if self.sign(".") else (default or "", first.name)

    def group(self) -> list[Token]:
        """Tokens within the parentheses that open next."""
        depth, out = 0, []
        while self.at < len(self.items):
            t = self.next()
            if t.text == "(" and t.kind == "sign":
                depth += 1
                if depth == 1:
                    continue
            elif t.text == ")" and t.kind == "sign":
                depth -= 1
                if not depth:
                    break
            out.append(t)
        return out


def _parts(items: list[Token]) -> Iterator[list[Token]]:
    """Split at commas outside parentheses."""
    depth, part = 0, []
    for t in items:
        if t.kind == "sign" and t.text in "()":
            depth += 1 if t.text == "(" else -1
        if t.kind == "sign" and t.text == "," and not depth:
            yield part
            part = []
        else:
            part.append(t)
    if part:
        yield part


# What may follow a type and belongs to it, and words that begin a table element that is no column.
_TYPE_TAIL = ("unsigned", "signed", "zerofill")
_NO_COLUMN = ("primary", "unique", "key", "index", "fulltext", "spatial", "constraint", "foreign", "check")


def _definition(r: _Reader, name: str) -> Column:
    """Column from its type on: data type, full type, whether the definition makes it the primary key."""
    kind = r.next().text.lower()
    full = kind
    if kind == "double" and r.take("precision"):
        pass
    if r.peek().text == "(" and r.peek().kind == "sign":
        inner = r.group()
        full += "(" + "".join(t.text for t in inner) + ")"
    while r.peek().is_word(*_TYPE_TAIL):
        full += " " + r.next().text.lower()
    primary = False
    depth = 0
    while r.peek().kind != "end":
        t = r.peek()
        if t.kind == "sign" and t.text in "()":
            depth += 1 if t.text == "(" else -1
        if not depth and (t.is_word("first", "after")):
            break
        if r.take("primary", "key") or (t.is_word("key") and not r.items[r.at - 1].is_word("unique") and r.take("key")):
            primary = True
            continue
        r.next()
    return Column(name, kind, full, primary)


def _key_names(items: list[Token]) -> list[str]:
    return [part[0].name for part in _parts(items) if part]


def _marked(columns: list[Column], names: list[str] | None) -> list[Column]:
    lower = None if names is None else {n.lower() for n in names}
    return [replace(c, primary_key=c.name.lower() in lower) if lower is not None else c for c in columns]


def _create_table(r: _Reader, catalog: Catalog, database: str | None) -> None:
    unless = r.take("if", "not", "exists")
    db, name = r.table_name(database)
    tables = catalog.databases.setdefault(db, {})
    if name in tables and unless:
        return
    if r.take("like") or (r.peek().text == "(" and r.peek(1).is_word("like")):
        if r.sign("("):
            r.take("like")
        tables[name] = list(catalog.table(*r.table_name(database)) or [])
        return
    if r.peek().text != "(":
        raise UnsupportedStatement("CREATE TABLE without columns")
    columns, keys = [], None
    for part in _parts(r.group()):
        p = _Reader(part)
        if p.peek().kind == "word" and p.peek().is_word(*_NO_COLUMN):
            if p.take("constraint") and not p.peek().is_word("primary", "unique", "foreign", "check"):
                p.next()
            if p.take("primary", "key"):
                while p.peek().kind != "end" and p.peek().text != "(":
                    p.next()
                keys = _key_names(p.group())
            continue
        columns.append(_definition(p, p.next().name))
    if any(t.is_word("select") for t in r.items[r.at :]):
        raise UnsupportedStatement("CREATE TABLE ... SELECT")
    tables[name] = _marked(columns, keys)


def _place(columns: list[Column], column: Column, r: _Reader, at: int | None = None) -> None:
    if r.take("first"):
        columns.insert(0, column)
    elif r.take("after"):
        columns.insert(1 + _find(columns, r.next().name), column)
    else:
        columns.insert(len(columns) if at is None else at, column)


def _find(columns: list[Column], name: str) -> int:
    for i, c in enumerate(columns):
        if c.name.lower() == name.lower():
            return i
    raise KeyError(f"no column {name}")


def _alter_table(r: _Reader, catalog: Catalog, database: str | None) -> None:
    db, name = r.table_name(database)
    tables = catalog.databases.setdefault(db, {})
    if name not in tables:
        raise KeyError(f"no table {db}.{name}")
    columns = list(tables[name])
    to = (db, name)
    for part in _parts(r.items[r.at :]):
        p = _Reader(part)
        if p.take("add"):
            if p.peek().kind == "word" and p.peek().is_word(*_NO_COLUMN):
                if p.take("constraint") and not p.peek().is_word("primary", "unique", "foreign", "check"):
                    p.next()
                if p.take("primary", "key"):
                    while p.peek().kind != "end" and p.peek().text != "(":
                        p.next()
                    columns = _marked(columns, _key_names(p.group()))
                continue
            p.take("column")
            unless = p.take("if", "not", "exists")
            if p.peek().text == "(":
                columns += [_definition(q, q.next().name) for q in map(_Reader, _parts(p.group()))]
                continue
            column = _definition(p, p.next().name)
            if not (unless and any(c.name.lower() == column.name.lower() for c in columns)):
                _place(columns, column, p)
        elif p.take("drop"):
            if p.take("primary", "key"):
                columns = _marked(columns, [])
            elif not p.peek().is_word("index", "key", "foreign", "constraint", "check", "partition"):
                p.take("column")
                maybe = p.take("if", "exists")
                gone = p.next().name
                if not maybe or any(c.name.lower() == gone.lower() for c in columns):
                    columns.pop(_find(columns, gone))
        elif p.peek().is_word("change", "modify"):
            change = p.next().is_word("change")
            p.take("column")
            p.take("if", "exists")
            at = _find(columns, p.next().name)
            old = columns.pop(at)
            new = _definition(p, p.next().name if change else old.name)
            _place(columns, replace(new, primary_key=new.primary_key or old.primary_key), p, at)
        elif p.take("rename", "column"):
            at = _find(columns, p.next().name)
            p.take("to")
            columns[at] = replace(columns[at], name=p.next().name)
        elif p.take("rename"):
            if p.peek().is_word("index", "key"):
                continue
            if not p.take("to"):
                p.take("as")
            to = p.table_name(db)
        elif p.peek().is_word("partition"):
            raise UnsupportedStatement("ALTER TABLE ... PARTITION")
    if to != (db, name):
        del tables[name]
    catalog.databases.setdefault(to[0], {})[to[1]] = columns


def apply(catalog: Catalog, sql: str, database: str | None) -> Catalog:
    """The catalog after a statement. database: the session's, for names without one. Statements about anything but
    tables and databases (indexes among them) change nothing; ones that cannot be followed raise UnsupportedStatement,
    ones about missing tables or columns KeyError."""
    out = catalog.copy()
    r = _Reader([t for t in tokens(sql) if t.text != ";"])
    if r.take("create", "database") or r.take("create", "schema"):
        r.take("if", "not", "exists")
        out.databases.setdefault(r.next().name, {})
    elif r.take("drop", "database") or r.take("drop", "schema"):
        r.take("if", "exists")
        out.databases.pop(r.next().name, None)
    elif r.take("create", "table"):
        _create_table(r, out, database)
    elif r.take("alter", "table"):
        _alter_table(r, out, database)
    elif r.take("drop", "table"):
        maybe = r.take("if", "exists")
        while r.peek().is_name():
            db, name = r.table_name(database)
            if out.databases.get(db, {}).pop(name, None) is None and not maybe:
                raise KeyError(f"no table {db}.{name}")
            if not r.sign(","):
                break
    elif r.take("rename", "table"):
        while r.peek().is_name():
            db, name = r.table_name(database)
            r.take("to")
            to = r.table_name(database)
            out.databases.setdefault(to[0], {})[to[1]] = out.databases.get(db, {}).pop(name)
            if not r.sign(","):
                break
    return out


def _name_places(items: list[Token]) -> Iterator[tuple[int, bool]]:
    """(token number, is a database): where a statement names databases and tables, as far as a prefix matters."""
    sig = [i for i, t in enumerate(items) if t.kind != "space"]
    word = lambda n, *w: n < len(sig) and items[sig[n]].is_word(*w)
    n = 0
    head = [items[i].text.lower() for i in sig[:4]]

    def skip(n: int, *words: str) -> int:
        return n + len(words) if all(word(n + k, w) for k, w in enumerate(words)) else n

    if head[:1] in (["create"], ["drop"]) and word(1, "database", "schema"):
        n = skip(skip(2, "if", "not", "exists"), "if", "exists")
        yield sig[n], True
        return
    index = [k for k in range(1, min(3, len(sig))) if word(k, "index")]
    if head[:1] in (["create"], ["drop"]) and index:
        on = next((k for k in range(index[0] + 1, len(sig)) if word(k, "on")), None)
        if on is not None and on + 1 < len(sig):
            yield sig[on + 1], False
        return
    if not (head[:1] and head[0] in ("create", "alter", "drop", "rename") and word(1, "table")):
        return
    n = skip(skip(2, "if", "not", "exists"), "if", "exists")
    yield sig[n], False
    depth = 0
    for k in range(n, len(sig)):
        t = items[sig[k]]
        if t.kind == "sign" and t.text in "()":
            depth += 1 if t.text == "(" else -1
        elif k > n and not depth:
            before = items[sig[k - 1]]
            listed = head[0] in ("drop", "rename") and before.kind == "sign" and before.text == ","
            moved = (head[0] == "rename" and before.is_word("to")) or (head[0] == "alter" and before.is_word("to", "as") and any(items[sig[j]].is_word("rename") for j in (k - 2,)))
            like = head[0] == "create" and before.is_word("like")
            if listed or moved or like:
                yield sig[k], False


def with_prefix(sql: str, prefix: str) -> str:
    """The statement with prefix/ before every database name. Tables without database stay; all other text stays.

    Names after a database are quoted, also those that begin with a digit.
    """
    items = tokens(sql)
    quote = lambda n: "`" + n.replace("`", "``") + "`"
    out = [t.text for t in items]
    for at, database in _name_places(items):
        if at >= len(items) or not items[at].is_name():
            continue
        if database:
            out[at] = quote(f"{prefix}/{items[at].name}")
        elif at + 2 < len(items) and items[at + 1].text == "." and items[at + 2].is_name():
            out[at] = quote(f"{prefix}/{items[at].name}")
            out[at + 2] = quote(items[at + 2].name)
    return "".join(out)

