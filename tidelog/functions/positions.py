"""Log positions `file:position:nextPosition` and the offsets made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File numbers of a missing and of an empty file name: after and before every real file.
LAST_FILE, FIRST_FILE = 2**63 - 1, -(2**63)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(position: Column | str) -> Column:
    """Name in front of the last two fields; the text `null` is a missing name. Null and malformed texts give null."""
    name = F.regexp_extract(_col(position), r"^(.*):(-?\d+):(-?\d+)$", 1)
    return F.when(_col(position).rlike(r"^(.*):(-?\d+):(-?\d+)$") & (name != "null"), name)


def file_number(name: Column | str) -> Column:
    """Digits after the last dot; a null name is LAST_FILE, an empty one FIRST_FILE, one without number null."""
    n = _col(name)
    return F.when(n.isNull(), F.lit(LAST_FILE)).when(n == "", F.lit(FIRST_FILE)).otherwise(F.substring_index(n, ".", -1).try_cast("long"))


def position_file_number(position: Column | str) -> Column:
    """File number of a position text; null if the text is null or malformed."""
    return F.regexp_extract(_col(position), r"(\d+):-?\d+:-?\d+$", 1).try_cast("long")


def position_start(position: Column | str) -> Column:
    return F.regexp_extract(_col(position), r":(-?\d+):(-?\d+)$", 1).try_cast("long")


def position_next(position: Column | str) -> Column:
    return F.regexp_extract(_col(position), r":(-?\d+):(-?\d+)$", 2).try_cast("long")


def offset_of(file_no: Column | str, position: Column | str) -> Column:
    """file number << 32 | position; the missing file wraps to the offset -2^32, as 64-bit shifts do."""
    return F.shiftleft(_col(file_no).cast("long"), 32).bitwiseOR(_col(position).cast("long"))


def position_offset(position: Column | str) -> Column:
    return offset_of(position_file_number(position), position_start(position))


def position_text(name: Column | str, position: Column | str, next_position: Column | str) -> Column:
    return F.concat_ws(":", F.coalesce(_col(name), F.lit("null")), F.coalesce(_col(position), F.lit(0)).cast("string"), F.coalesce(_col(next_position), F.lit(0)).cast("string"))


def log_file_name(prefix: str, number: Column | str) -> Column:
    """`prefix.` and the number with at least six digits."""
    return F.format_string(prefix.replace("%", "%%") + ".%06d", _col(number).cast("long"))


def canonical_uuid(uuid: Column | str) -> Column:
    """Letter case and blanks around it do not matter; an empty text is a missing one."""
    return F.nullif(F.lower(F.trim(_col(uuid))), F.lit(""))
