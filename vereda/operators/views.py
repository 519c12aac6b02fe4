"""Materialised views that are kept up to date by what changed.

A view is a grouped table: counts, sums and extremes of each key.  Its rows lie in buckets of the
key's hash, as Parquet.  A refresh folds the changes into partial sums, rewrites the buckets
that hold a changed key, and leaves the others where they are.  A version is a small table that
names the folder of each bucket; it is written last and becomes current when it is complete, so
readers never see half a refresh, and older versions stay readable.

Counts and sums of removed rows are taken off.  An extreme that may have been the removed row's
is computed again from the base, for those keys alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """Group by ``keys``; ``n`` counts rows, ``sums`` and ``least``/``most`` map a name to SQL over
    the base.  Sums should be integers or decimals, so that taking off is exact."""

    keys: list[str]
    sums: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    most: dict[str, str] = field(default_factory=dict)
    buckets: int = 32

    @property
    def names(self) -> list[str]:
        return [*self.keys, "n", *self.sums, *self.least, *self.most]

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")


def computed(view: View, base: DataFrame) -> DataFrame:
    """The view of a whole table."""
    aggregates = [F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in view.sums.items()], *[F.min(F.expr(e)).alias(k) for k, e in view.least.items()], *[F.max(F.expr(e)).alias(k) for k, e in view.most.items()]]
    return base.groupBy(*view.keys).agg(*aggregates)


def _write(view: View, rows: DataFrame, root: str) -> str:
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows.select("*", view.bucket()).repartition(view.buckets, "bucket").write.partitionBy("bucket").parquet(folder)
    return folder


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [p.getPath() for p in fs.listStatus(path)]
    complete = [p for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in complete)


def _layout(spark: SparkSession, root: str, version: int | None) -> tuple[int, dict[int, str]]:
    """Bucket → folder, of the current version or a given one; ``buckets`` rows."""
    known = _versions(spark, root)
    if not known:
        raise ValueError(f"no complete version of a view under {root}")
    version = known[-1] if version is None else version
    rows = spark.read.schema("bucket int, folder string").parquet(f"{root}/versions/{version}").collect()
    return version, {r["bucket"]: r["folder"] for r in rows}


def _switch(spark: SparkSession, root: str, version: int, layout: dict[int, str]) -> None:
    spark.createDataFrame(sorted(layout.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{root}/versions/{version}")


def _read(spark: SparkSession, view: View, schema, layout: dict[int, str]) -> DataFrame:
    folders = {}
    for bucket, folder in layout.items():
        folders.setdefault(folder, []).append(bucket)
    out = spark.createDataFrame([], schema)
    for folder, buckets in folders.items():
        part = spark.read.parquet(folder).filter(F.col("bucket").isin(buckets))
        out = out.unionByName(part.select(*view.names))
    return out


def create(view: View, base: DataFrame, root: str) -> None:
    """Version 0, from the whole base."""
    spark = base.sparkSession
    folder = _write(view, computed(view, base), root)
    _switch(spark, root, 0, dict.fromkeys(range(view.buckets), folder))


def current(spark: SparkSession, view: View, base: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """The rows of the current version, or of an older one; ``base`` gives the types alone."""
    return _read(spark, view, computed(view, base).schema, _layout(spark, root, version)[1])


def refresh(view: View, removed: DataFrame, added: DataFrame, base: DataFrame, root: str) -> int:
    """Fold a change into the view: rows that went, rows that came (an updated row is both), and
    the base as it is after the change.  Returns the new version.

    Defined cases: null keys are a group; a key without rows leaves the view; removing rows that
    the base never had is not checked, but such a key's count would fall below what is right;
    without changes the new version equals the old one."""
    spark = base.sparkSession
    plus, minus = computed(view, added), computed(view, removed)
    schema = computed(view, base).schema
    changed = plus.select(*view.keys).unionByName(minus.select(*view.keys)).distinct().withColumn("b", view.bucket())
    touched = sorted(r["b"] for r in changed.select("b").distinct().collect())  # at most ``buckets``
    version, layout = _layout(spark, root, None)
    if not touched:
        _switch(spark, root, version + 1, layout)
        return version + 1
    old = _read(spark, view, schema, {b: layout[b] for b in touched})

    sign = lambda df, s: df.select(*view.keys, *[(F.col(c) * s).cast(schema[c].dataType).alias(c) for c in ("n", *view.sums)], *[F.col(c) if s > 0 else F.lit(None).cast(schema[c].dataType).alias(c) for c in (*view.least, *view.most)], *[(F.lit(None).cast(schema[c].dataType) if s > 0 else F.col(c)).alias(f"gone_{c}") for c in (*view.least, *view.most)])
    nothing = [F.lit(None).cast(schema[c].dataType).alias(f"gone_{c}") for c in (*view.least, *view.most)]
    parts = old.select("*", *nothing).unionByName(sign(plus, 1)).unionByName(sign(minus, -1))
    extremes = [(c, F.min) for c in view.least] + [(c, F.max) for c in view.most]
    folded = parts.groupBy(*view.keys).agg(F.sum("n").alias("n"), *[F.sum(c).cast(schema[c].dataType).alias(c) for c in view.sums], *[f(c).alias(c) for c, f in extremes], *[f(f"gone_{c}").alias(f"gone_{c}") for c, f in extremes])
    folded = folded.filter("n > 0")
    # an extreme is in doubt if a removed row's value reached it, and a sum whose terms may all be null
    doubt = F.lit(False)
    for c, _ in extremes:
        doubt = doubt | F.coalesce(F.col(f"gone_{c}") == F.col(c), F.lit(False))
    for c in view.sums:
        doubt = doubt | F.coalesce(F.col(c) == 0, F.lit(False))
    again = folded.filter(doubt).select(*[F.col(k).alias(f"_{k}") for k in view.keys])
    same = F.lit(True)
    for k in view.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = computed(view, base.join(again, same, "left_semi"))
    folder = _write(view, folded.filter(~doubt).select(*view.names).unionByName(fresh.select(*view.names)), root)
    _switch(spark, root, version + 1, {b: folder if b in set(touched) else f for b, f in layout.items()})
    return version + 1
