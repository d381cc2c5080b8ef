"""Keys and names of rows: primary-key text, routing key, record key, topic, member of a pool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic prefix by the role of the host that is read.
TOPIC_PREFIX = {"MASTER": "tidelog", "REPLICA": "tidelog_mysql_replica", "MIGRATION": "tidelog_mysql_migration"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pk_text(values: Column | str) -> Column:
    """Values of a primary key in key order, run together; a null value is the text null; an empty or null array is null."""
    v = _col(values)
    return F.when(F.size(v) > 0, F.array_join(v, "", "null"))


def image_values(image: Column | str, names: Column | str) -> Column:
    """Values of an image by an array of names; a name that the image lacks is null."""
    m = _col(image)
    return F.transform(_col(names), lambda n: F.try_element_at(m, n))


def canonical_name(database: Column | str, table: Column | str) -> Column:
    return F.concat_ws(":", _col(database), _col(table))


def database_of(canonical: Column | str) -> Column:
    return F.substring_index(_col(canonical), ":", 1)


def routing_key(database: Column | str, table: Column | str, pk: Column | str) -> Column:
    """database:table:pk; without primary key database:table:null."""
    return F.concat_ws(":", _col(database), _col(table), F.coalesce(_col(pk), F.lit("null")))


def record_key(database: Column | str, table: Column | str, image: Column | str, pk_names: Column | str) -> Column:
    """database:table:value of each key column, columns in the order of their names."""
    values = F.transform(image_values(image, F.array_sort(_col(pk_names))), lambda v: F.coalesce(v, F.lit("null")))
    return F.concat_ws(":", F.concat(F.array(_col(database), _col(table)), values))


def topic(prefix: str, service: Column | str, database: Column | str, table: Column | str, overriding: Column | str) -> Column:
    """prefix.service-database-table, with the overriding database if that is not empty."""
    db = F.coalesce(F.nullif(_col(overriding), F.lit("")), _col(database))
    return F.concat(F.lit(f"{prefix}."), F.concat_ws("-", _col(service), db, _col(table)))


def java_hash(text: Column | str) -> Column:
    """The 32-bit string hash s[0]*31^(n-1) + ... + s[n-1], for characters of the basic plane; null for null."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c != "")
    wrap = lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x)
    return F.reduce(F.transform(chars, lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)), wrap).cast("int")


def pool_member(key: Column | str, size: int) -> Column:
    """Member of a pool of destinations for a key: the remainder of the hash without its sign."""
    return F.abs(java_hash(key) % size)
