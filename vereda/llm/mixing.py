"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are cells of (source, lang, topic), weighted by their words.  Raking multiplies the
cells of one source, then one language, then one topic, by what brings their sum to its
target share, again and again, until every marginal is within ``tolerance`` of its target; the
result has the target marginals and keeps the cells' association.  A document's probability
follows its cell's factor, scaled so that the largest is 1, and a hash of its id decides.

Everything here is DataFrame and SQL functions.  Documents are aggregated to cells before
anything is shuffled (a hot source is a few rows by then), and the rounds run over cells
alone: their number is that of the combinations of values, not of the documents.  A step sums
the cells of each value, which is combined before it is shuffled, and joins the sums back, so
that a value with very many cells costs no single task more than its share.

Without a column ``topic`` in the documents a text's *form* (table, code, links, short or long
prose) stands for its topic.

Targets are shares by value, or an exponent: the marginal is then the natural one raised to
it and normalised, which lifts small values.  Values without a given target share what is
left in their natural proportions.

Defined cases: null source, lang or topic is a value of its own; a text without words has
weight 0, lies in its cell like any other and shares its probability (1 where a whole cell has
no words); repeated rows each count and are decided alike; a null id is hashed as the empty
text; an empty table gives an empty result; other columns are kept, and columns named like
the added ones are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

AXES = ("source", "lang", "topic")
Target = dict[str, float] | float
#: The default: every marginal is flattened a little.
TEMPERED: dict[str, Target] = {"source": 0.8, "lang": 0.8, "topic": 0.9}
ADDED = ("topic", "n_words", "weight", "probability", "sampled")


def form_of(text: Column) -> Column:
    """The form of a text, which stands for its topic where no topic column is given."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    return (
        F.when(size == 0, "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("{")), "code")
        .when(F.contains(text, F.lit("http")), "links")
        .when(size < 1000, "short prose")
        .when(size < 5000, "prose")
        .otherwise("long prose")
    )


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _target(axis: str, natural: Column, target: Target, total: float) -> Column:
    if not isinstance(target, dict):
        return F.pow(natural / total, F.lit(float(target)))
    left, out = max(0.0, 1.0 - sum(target.values())), None
    for value, share in sorted(target.items()):
        hit = F.col(axis) == F.lit(value)
        out = F.when(hit, float(share)) if out is None else out.when(hit, float(share))
    rest = natural / total * left
    return rest if out is None else out.otherwise(rest)


def _sums(cells: DataFrame, axis: str, what: str, name: str) -> DataFrame:
    """Sums by value of an axis, named so that they can be joined back."""
    return cells.groupBy(F.col(axis).alias(f"{name}_key")).agg(F.sum(what).alias(name))


def _with(cells: DataFrame, sums: DataFrame, axis: str, name: str) -> DataFrame:
    return cells.join(sums, F.col(axis).eqNullSafe(F.col(f"{name}_key")), "left").drop(f"{name}_key")


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """``cells(source, lang, topic, n)`` with ``weight`` (shares with the target marginals)
    and ``ratio`` (the weight over the natural share).

    After every second round the lineage is cut and the marginals are compared with their
    targets.  Where cells are missing there may be no weights with all the marginals: then
    the last round counts, and a warning says how far off it is.  A target for a value that
    only cells without words have cannot be met and counts as nought.
    """
    total = float(cells.agg(F.sum("n").alias("n")).first()["n"] or 1)
    made = cells.withColumn("_w", F.col("n") / total)
    for axis in AXES:
        made = _with(made, _sums(cells, axis, "n", f"_n_{axis}"), axis, f"_n_{axis}")
        wish = F.when(F.col(f"_n_{axis}") > 0, _target(axis, F.col(f"_n_{axis}"), targets[axis], total)).otherwise(0.0)
        made = made.withColumn(f"_t_{axis}", wish).drop(f"_n_{axis}")
    made = settle(made, "cells")
    for axis in AXES:  # three numbers
        whole = made.select(axis, f"_t_{axis}").distinct().agg(F.sum(f"_t_{axis}").alias("s")).first()["s"]
        made = made.withColumn(f"_t_{axis}", F.col(f"_t_{axis}") / (whole or 1.0))
    for done in range(1, rounds + 1):
        for axis in AXES:
            made = _with(made, _sums(made, axis, "_w", "_have"), axis, "_have")
            made = made.withColumn("_w", F.when(F.col("_have") > 0, F.col("_w") * F.col(f"_t_{axis}") / F.col("_have")).otherwise(0.0)).drop("_have")
        if done % 2 and done < rounds:
            continue
        made = settle(made, "cells")
        off = [made.groupBy(axis).agg(F.abs(F.sum("_w") - F.first(f"_t_{axis}")).alias("d")).agg(F.max("d").alias("d")) for axis in AXES]
        worst = max((r["d"] or 0.0) for r in off[0].unionByName(off[1]).unionByName(off[2]).collect())  # three rows
        if worst <= tolerance:
            break
    else:
        warnings.warn(f"the marginals are still {worst:.2g} off after {rounds} rounds: no weights on these cells may have them all", stacklevel=2)
    return made.select(*AXES, "n", F.col("_w").alias("weight"), F.when(F.col("n") > 0, F.col("_w") / (F.col("n") / total)).alias("ratio"))


def chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, targets: dict[str, Target] | None = None, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """``docs`` with topic, n_words, the cell's weight, probability and sampled."""
    targets = TEMPERED | (targets or {})
    topic = F.col("topic") if "topic" in docs.columns else form_of(F.col("text"))
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*kept).alias("rest"), *[(topic if a == "topic" else F.col(a)).cast("string").alias(a) for a in AXES], F.col("text"), F.col("doc_id"))
    cells = rows.groupBy(*AXES).agg(F.sum(words_of(F.col("text"))).alias("n"))
    raked = rake(settle(cells, "cells"), targets, rounds, tolerance)
    most = float(raked.agg(F.max("ratio").alias("m")).first()["m"] or 1.0)
    raked = raked.select(F.struct(*AXES).alias("cell"), F.round("weight", 9).alias("weight"), F.round(F.coalesce(F.col("ratio") / most, F.lit(1.0)), 9).alias("probability"))
    same = F.struct(*[F.col(f"d.{a}") for a in AXES]).eqNullSafe(F.col("r.cell"))
    out = rows.withColumn("n_words", words_of(F.col("text"))).withColumn("chance", chance(F.col("doc_id"))).alias("d").join(raked.alias("r"), same)
    return out.select("d.rest.*", "d.topic", "d.n_words", "r.weight", "r.probability", (F.col("d.chance") < F.col("r.probability")).alias("sampled"))
