"""Joins against a side that is usually small: broadcast when measured small, salted otherwise. Ranges to work through one by one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
LOCAL_ROWS = 10_000
LOCAL_BYTES = 8 << 20
PUSHED_VALUES = 1_000
SALTS = 64
#: Ranges that a table is worked through in, at most, and the rows of one at least.
RANGES, RANGE_ROWS = 8, 4_000_000


@dataclass(frozen=True)
class Size:
    """Rows and bytes of a table, counted up to the broadcast bound."""

    rows: int
    bytes: int

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def row_bytes_sql(schema: T.StructType) -> str:
    """The bytes of one row: strings by length, nested values by their JSON form."""
    widths = ["0"]
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType):
            widths.append(f"16 + coalesce(octet_length(`{field.name}`), 0)")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(f"16 + coalesce(octet_length(to_json(`{field.name}`)), 0)")
        else:
            widths.append("16")
    return " + ".join(widths)


def measure(df: DataFrame) -> Size:
    """Count at most one row more than may be broadcast; never reads past that."""
    probe = df.limit(BROADCAST_ROWS + 1).selectExpr(f"bigint({row_bytes_sql(df.schema)}) AS width")
    rows, total = probe.agg(F.expr("count(*)"), F.expr("coalesce(sum(width), 0)")).collect()[0]
    return Size(rows, total)


def in_tasks(df: DataFrame, kept: Sequence[str], **made: Column) -> DataFrame:
    """The `kept` columns and the made ones, row by row, the latter worked out by tasks.

    Expressions on literal rows are otherwise worked out while planning, in the driver: a first `lower` there fills the
    tables of all title cases, some gigabytes of garbage.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def key_ranges(df: DataFrame, column: str, rows: str = "1", most: int = RANGES, least_rows: int = RANGE_ROWS) -> list[Column]:
    """Conditions on a string column, one of which each row meets, of about as many `rows` each; nulls meet the first.

    The bounds are first letters, two where both are ASCII; rows are counted by these, so no more than 16,384 pairs and
    the other letters that begin a value are fetched.
    """
    two = F.substring(column, 1, 2)
    start = F.when(F.octet_length(two) <= 2, two).otherwise(F.substring(column, 1, 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(start.alias("start")).agg(F.expr(f"sum({rows})").alias("rows"))
    starts = sorted(counts.collect(), key=lambda r: r["start"].encode("utf-8", "surrogatepass"))
    total = sum(r["rows"] for r in starts)
    n, seen, firsts = max(1, min(most, total // least_rows)), 0, []
    for r in starts:
        if seen * n >= (len(firsts) + 1) * total:
            firsts.append(r["start"])
        seen += r["rows"]
    if not firsts:
        return [F.lit(True)]
    value = F.col(column)
    return [value.isNull() | (value < firsts[0]), *[(value >= a) & (value < b) for a, b in zip(firsts, firsts[1:])], value >= firsts[-1]]


def settle(df: DataFrame) -> tuple[DataFrame, Size]:
    """The table and its size; a table of few rows is fetched once and goes on as local rows.

    What a query asks for is mostly that small, and is used in several places of a plan:
    it is then not worked out again in each. A larger table stays as it is.
    """
    head = df.limit(LOCAL_ROWS + 1).toArrow()
    if head.num_rows <= LOCAL_ROWS and head.nbytes <= LOCAL_BYTES:
        return df.sparkSession.createDataFrame(head, schema=df.schema), Size(head.num_rows, head.nbytes)
    return df, measure(df)


def broadcast_if(df: DataFrame, max_rows: int | None) -> DataFrame:
    """The table marked for broadcast if a bound on its rows is known and small, for a sort merge join otherwise.

    For narrow tables of keys and numbers, whose bytes follow from their rows. Without the mark Spark broadcasts
    either side by its size in files, which compression makes small: tables of documents would pass through the driver.
    """
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, spread: Sequence[str],
                salts: int = SALTS) -> DataFrame:
    """Shuffle join that shares out one hot key among many tasks.

    The rows of `big` are spread over salts taken from the `spread` columns and `small`
    is repeated per salt, so every row of `big` still meets its partners exactly once.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
                spread: Sequence[str] | str = (), size: Size | None = None) -> DataFrame:
    """Join `big` to a side that is expected to be small (inner, left, left_semi, left_anti).

    Broadcast within the bound, salted shuffle join beyond it. `size` is the measure of
    `small`, or of a table it cannot outgrow; without it `small` is settled here.
    """
    on = [on] if isinstance(on, str) else list(on)
    spread = [spread] if isinstance(spread, str) else list(spread)
    if size is None:
        small, size = settle(small)
    if size.small:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, spread)
