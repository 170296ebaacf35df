"""Joins in which one key may hold a third of all rows.

Hot keys are looked for among a share of the rows' groups, chosen by a hash; at
most HOT of them are kept, those with no fewer rows than these have on average,
and LEAST at least.  Their rows are dealt over SALTS tasks, with as many copies
of the few rows that the other side has for them; all other keys are joined as
usual, in the same join.  Which keys count as hot only decides how rows are
dealt: the result is that of a plain join in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT, LOOK, LEAST, SALTS = 1000, 64, 16, 64


def hot_keys(rows: DataFrame, on: str, by: Column) -> list:
    """At most HOT values of a column; by: what rows are grouped by for the look."""
    seen = rows.where(F.col(on).isNotNull() & (F.pmod(F.xxhash64(by), F.lit(LOOK)) == 0)).groupBy(on).agg(F.count("*").alias("n"))
    top = seen.orderBy(F.desc("n"), on).limit(HOT).collect()
    least = max(LEAST, sum(r.n for r in top) // max(1, len(top)))
    return [r[on] for r in top if r.n >= least]


def folded(rows: DataFrame, on: str, row: str) -> DataFrame:
    """rows without the later copies of common values: of each hot one only the row with the least number stays.

    For work that a second row of a value adds nothing to; which values count as
    hot decides only how many copies are left.  Nothing is shuffled but counts."""
    hot = hot_keys(rows.select(on, row), on, F.col(row))
    if not hot:
        return rows
    first = [r.n for r in rows.where(F.col(on).isin(hot)).groupBy(on).agg(F.min(row).alias("n")).collect()]
    return rows.where(~F.col(on).isin(hot) | F.col(row).isin(first))


def join_around(rows: DataFrame, side: DataFrame, on: str | list[str], hot: list, how: str = "inner") -> DataFrame:
    """rows joined with a side that has each key once (or few times); hot: values of the first key column."""
    keys = [on] if isinstance(on, str) else list(on)
    if not hot:
        return rows.join(side, keys, how)
    own = [f.name for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    often = F.col(keys[0]).isin(hot)
    left = rows.withColumn("__salt", F.when(often, F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).otherwise(0))
    right = side.withColumn("__salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
