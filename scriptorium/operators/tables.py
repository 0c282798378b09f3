"""Table-level operators: paging, inserts, upserts, deletes, bucketed counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page behind a key: a filter that reaches the scan, then a top-n."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def newest_page(df: DataFrame, key: str, size: int, skip: int = 0) -> DataFrame:
    return df.orderBy(F.desc(key)).offset(skip).limit(size)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def blank(col: str) -> Column:
    """Null, empty, or an empty JSON value."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).isin("", "[]", "null")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def one_row_each(df: DataFrame, key: str, order: str, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """One row for each key, the greatest by ``order`` and then the other columns, and the rows of null keys.

    Also gives the rows chosen for keys of several rows, if there are any.  Only the keys are shuffled, and the rows
    of such keys; up to ``bound`` of these keys are broadcast.
    """
    again = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    again = cut(again, "repeated_keys")
    n = again.count()
    if not n:
        return df, None
    again = F.broadcast(again) if n <= bound else again
    rest = [c for c in df.columns if c not in (key, order)]
    chosen = df.join(again, key, "left_semi").groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    chosen = cut(chosen.select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns]), "repeated_rows")
    return df.join(again, key, "left_anti").select(df.columns).unionByName(chosen), chosen


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """The incoming rows that are new, one for each key."""
    return first_by(incoming.join(existing.select(key), key, "left_anti"), [key], *order)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows overwrite existing ones."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def upsert_fill(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming values overwrite, nulls don't."""
    new = incoming.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c != key])
    joined = existing.join(new, key, "full_outer")
    value = lambda c: F.coalesce(f"_new_{c}", c) if c in incoming.columns else F.col(c)
    return joined.select(key, *[value(c).alias(c) for c in existing.columns if c != key])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """What stays: rows where the condition isn't true."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
