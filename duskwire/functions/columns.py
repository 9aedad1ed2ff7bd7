"""Small column helpers shared by the function modules."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F



def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    """Literal map lookup for fixed tables of a few entries."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def ranked(values: Column, limit: int | None = None) -> Column:
    """Distinct values in sorted order; the first ``limit`` of them if one is given."""
    out = F.array_sort(F.array_distinct(values))
    return out if limit is None else F.slice(out, 1, limit)


def counted(values: Column) -> Column:
    """The distinct values of an array of strings with how often each occurs: ``ARRAY<STRUCT<value, n>>``.

    Runs of the sorted array, so a row is counted by itself and nothing is shuffled.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return bind(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")
        )))

    return bind(F.sort_array(values), runs)


def first_non_empty(*cols: Column) -> Column:
    """First column that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded towards minus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)).cast("long")
