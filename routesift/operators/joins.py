"""Joins whose small side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed

#: Rows that a checked side may have to be broadcast.
BROADCAST_ROWS = 200_000
#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def sized(table: DataFrame, max_rows: int = BROADCAST_ROWS, stored: bool = False) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffle join, with AQE against skew).

    The table is computed once, into a checkpoint that is then counted and joined; ``stored``
    says that it is one already.
    """
    table = table if stored else checkpointed(table)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def salting(rows: DataFrame, on: list[str]) -> list[str]:
    """Columns that a row's salt is hashed from: all but the key and those that can't be hashed; the key if there are no others."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return [c for c, kind in kinds.items() if c not in on and "map<" not in kind and "variant" not in kind] or on


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS, stored: bool = False) -> DataFrame:
    """Left join of ``big`` with a table of one row per key, for keys of which some may be hot.

    Up to ``max_rows`` rows the table is broadcast. Beyond that both sides are shuffled by the key
    and a salt: the table's rows are repeated ``SALTS`` times, the hot key's rows spread over as
    many tasks. The salt is a hash of the row, so a task that is run again deals its rows as before,
    in whatever order they come. Null keys match nothing. ``stored`` is as in ``sized``.
    """
    table = table if stored else checkpointed(table)
    if table.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(table), on, "left")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salting(big, on)]), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")
