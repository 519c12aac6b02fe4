"""De-duplication, merge rules and incremental state, each with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``.

    For wide rows or hot keys ``best`` is cheaper; this keeps the row as it is."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def best(df: DataFrame, key: list[str], order: Column, columns: list[str], last: bool = True) -> DataFrame:
    """One row for each key by a grouped extreme, which is combined before the shuffle: a key
    that holds most rows costs one row for each task."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(pick(F.struct(*columns), order).alias("_row")).select(*key, "_row.*")


def last_value_first_place(df: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last row of each key at the place of its first."""
    made = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("_row"), F.min(seq).alias("place"))
    return made.select(key, "place", "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones by key; the rest of the old rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed(rows: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose (key, hash) the state does not hold: new or changed ones."""
    return rows.join(state.select(key, digest), [key, digest], "left_anti")


def filled_from(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge by key; non-empty right values win, field by field."""
    l, r = left.alias("l"), right.alias("r")
    picked = [F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.col(f"l.{c}")).alias(c) for c in columns]
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer").select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), *picked)


def first_known_by(value: Column, seq: Column) -> Column:
    """Aggregate: the value of the first row (by ``seq``) that has one."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def last_writer(local: DataFrame, remote: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The newest row of each key on either side, and the side; the local one wins ties."""
    both = local.withColumn("side", F.lit("local")).unionByName(remote.withColumn("side", F.lit("remote")))
    return best(both, [key], F.struct(F.col(at), (F.col("side") == "local").cast("int")), [*columns, "side"])


def first_candidate(rows: DataFrame, key: str, candidates: str, known: DataFrame, name: str) -> DataFrame:
    """(key, place, other columns of ``known``): the first of a row's candidate keys, counted from
    one, that ``known`` has."""
    values = [c for c in known.columns if c != name]
    tried = rows.select(key, F.posexplode(candidates).alias("place", name)).withColumn("place", F.col("place") + 1)
    found = tried.join(known, name)
    return found.groupBy(key).agg(F.min_by(F.struct("place", *values), "place").alias("_row")).select(key, "_row.*")
