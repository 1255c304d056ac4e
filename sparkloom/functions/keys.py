"""Escaping, padding, hashing and composing of text keys, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of composed keys.  Fixed values of the key format.
FIELD, VALUE, CHOICE, ORDER_END, DATA_ROW, INDEX_MARK = "_", "::", "|", "##", "_t_", "0ai"
#: Milliseconds of 2105-10-04 00:30:07 UTC, from which descending date keys count down.
DATE_TOP = 4_284_145_807_000
INT_TOP = 2_147_483_647


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def format_name(c: Column) -> Column:
    """Names without separators, in lower case."""
    return F.lower(format_name_keep_case(c))


def format_name_keep_case(c: Column) -> Column:
    return _swap(c, ("_", "-"), ("::", ";;"), ("|", "!"), ("#", "$"))


def format_value(c: Column) -> Column:
    """Values without separators."""
    return _swap(c, ("_", "$-$"), ("::", ";;"), ("|", "!!"), ("#", "$"))


def unformat_value(c: Column) -> Column:
    """Back again; a ``$`` of the value itself comes back as ``#``."""
    return _swap(c, ("$-$", "_"), (";;", "::"), ("!!", "|"), ("$", "#"))


def zero_pad(c: Column, n: int) -> Column:
    """Zeros on the left up to ``n`` characters; longer text stays."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def fixed_number(c: Column, n: int) -> Column:
    """Whole numbers as their ``n`` low digits, sign in front; other text zero-padded."""
    v = c.try_cast("bigint")
    digits = F.right(F.lpad(F.abs(v.cast("decimal(20,0)")).cast("string"), max(n, 20), "0"), F.lit(n))
    return F.when(v.isNull(), zero_pad(c, n)).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), digits))


def string_hash(c: Column) -> Column:
    """The 32-bit polynomial hash (31) over the UTF-16 units of a text, signed."""
    step = lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32))

    def add(h: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        beyond = point - 0x10000  # characters outside the basic plane are two units
        return F.when(beyond < 0, step(h, point)).otherwise(step(step(h, F.shiftright(beyond, 10) + 0xD800), F.pmod(beyond, F.lit(0x400)) + 0xDC00))

    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), add)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def hash_prefix(c: Column) -> Column:
    """A salt from the id: its hash modulo 36, then the hash, both in base 36.  Blank ids have none."""
    h = string_hash(c)
    return F.when(F.length(F.trim(c)) > 0, F.concat(base36(F.abs(h % 36)), base36(F.abs(h))))


def shard(c: Column, n: int) -> Column:
    return F.abs(string_hash(c)) % n


def index_doc_id(prefix: Column, family: Column, column: Column, main_id: Column) -> Column:
    return F.concat_ws(FIELD, prefix, family, column, main_id)


def index_name(table: Column, family: Column, column: Column, tenant: Column | None = None, prefix: str = "idx-") -> Column:
    """``prefix`` and the parts joined by ``-``; a blank tenant is ``2017``."""
    tenant = F.lit(None).cast("string") if tenant is None else tenant
    tenant = F.when(F.length(F.trim(F.coalesce(tenant, F.lit("")))) > 0, tenant).otherwise("2017")
    return F.concat(F.lit(prefix), F.concat_ws("-", table, family, column, tenant))


def key_map(c: Column) -> Column:
    """Composed key text to a map; an order prefix goes, a part without value is ``NULL``."""
    body = F.when(F.instr(c, ORDER_END) > 0, F.element_at(F.split(c, ORDER_END, 2), 2)).otherwise(c)
    parts = F.filter(F.split(body, FIELD), lambda p: p.contains(VALUE))
    pair = lambda p: F.struct(F.split(p, VALUE)[0].alias("k"), F.coalesce(F.nullif(F.split(p, VALUE)[1], F.lit("")), F.lit("NULL")).alias("v"))
    return F.map_from_entries(F.transform(parts, pair))


def build_key(prefix: Column, columns: Sequence[str], pk: str, width: int, order_code: Column | None = None) -> Column:
    """``prefix_t_[order##]name::value_...`` with the columns in name order and the primary key at fixed width."""
    parts = [F.concat(F.lit(c + VALUE), fixed_number(F.col(c).cast("string"), width) if c == pk else F.col(c).cast("string")) for c in sorted(columns)]
    lead = F.lit("") if order_code is None else F.coalesce(F.concat(order_code, F.lit(ORDER_END)), F.lit(""))
    return F.concat(prefix, F.lit(DATA_ROW), lead, F.concat_ws(FIELD, *parts))


def parse_date(c: Column) -> Column:
    return F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def date_countdown(ts: Column) -> Column:
    """Milliseconds from a timestamp to ``DATE_TOP``: later dates sort first.  Session time zone UTC."""
    return F.lit(DATE_TOP) - F.unix_millis(ts.cast("timestamp"))


def order_code(c: Column, descending: bool = False) -> Column:
    """Eight base-36 characters that sort as the number does; none if it doesn't fit."""
    v = F.lit(INT_TOP) - c if descending else c
    code = base36(v)
    return F.when((v >= 0) & (F.length(code) <= 8), F.lpad(code, 8, "0"))


def sanitized_set(values: Column, ordered: bool = True) -> Column:
    """Distinct formatted names: sorted, or in order of appearance."""
    out = F.array_distinct(F.transform(values, format_name))
    return F.array_sort(out) if ordered else out


def has_separator(c: Column) -> Column:
    """May a value not be stored, for holding a separator?"""
    return c.rlike(r"_|::|\||##")
