"""Runs, seeds, epochs: registries, grids, statistics and the report layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ESSAY_CODES, REDDIT_TRAITS, RUN_SEEDS, TRAITS, slug
from .dims import literal_table
from .labels import NEGATIVE, POSITIVE

BASE = "base"
MEAN = "mean"
STDEV = "stdev"


def run_label(run: Column) -> Column:
    """0 is the base run, 1..10 are the seeds in their listed order."""
    names = F.array(F.lit(BASE), *[F.lit(str(s)) for s in RUN_SEEDS])
    return F.element_at(names, (run + 1).cast("int"))


def seed_stats(scores: DataFrame, groups: Sequence[str] = (), run: str = "run") -> DataFrame:
    """Mean and population deviation per trait over the seeds; the base run is left out."""
    return (
        scores.where(F.col(run) != BASE)
        .groupBy(*groups, "trait")
        .agg(
            F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("stdev"),
            F.count("*").alias("runs"),
        )
    )


def with_statistics(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Scores of every run followed by a mean and a stdev row per trait."""
    stats = seed_stats(scores, groups)
    rows = stats.select(
        *groups,
        "trait",
        F.explode(
            F.array(
                F.struct(F.lit(MEAN).alias("run"), F.col("mean").alias("score")),
                F.struct(F.lit(STDEV).alias("run"), F.col("stdev").alias("score")),
            )
        ).alias("_s"),
    ).select(*groups, "_s.run", "trait", "_s.score")
    own = scores.select(*groups, "run", "trait", F.col("score").cast("double").alias("score"))
    return own.unionByName(rows)


def report_order(run: Column) -> Column:
    """Base first, seeds as listed, then mean and stdev."""
    order = [BASE, *map(str, RUN_SEEDS), MEAN, STDEV]
    return F.array_position(F.array(*map(F.lit, order)), run) - 1


def wide_report(report: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per run with the five traits as columns, and its place in ``ord``."""
    wide = report.groupBy(*groups, F.col("run").alias("seed")).pivot("trait", TRAITS).agg(F.first("score"))
    for trait in TRAITS:
        wide = wide.withColumnRenamed(trait, slug(trait))
    return wide.withColumn("ord", report_order(F.col("seed")))


def model_registry(corpora: DataFrame) -> DataFrame:
    """Model keys and paths for every registered corpus (family, name).

    Main corpora have a fine-tuned and a from-scratch model, the small labelled ones
    only a fine-tuned one, and one default model has no corpus.
    """
    variants = F.when(
        F.col("family") == "main", F.array(F.lit("fine_tuned"), F.lit("from_scratch"))
    ).when(F.col("family") == "default", F.array(F.lit(""))).otherwise(F.array(F.lit("fine_tuned")))
    rows = corpora.withColumn("variant", F.explode(variants))
    named = F.col("family") == "main"
    plain = F.col("variant") == ""
    return rows.withColumn(
        "key", F.when(named, F.concat_ws("_", "name", "variant")).otherwise(F.col("name"))
    ).withColumn("path", F.when(plain, F.col("name")).otherwise(F.concat_ws("/", "variant", "name")))


def require_registered(wanted: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Look names up; a name the registry lacks fails the query."""
    found = wanted.join(registry.withColumn("_known", F.lit(True)), name, "left")
    known = F.coalesce(
        F.col("_known"), F.raise_error(F.concat(F.lit("unknown model "), F.col(name))).cast("boolean")
    )
    return found.where(known).drop("_known")


def family_names(family: str) -> list[tuple[str, str, str, str]]:
    """(family, trait, polarity, name) of all corpora of a labelled family."""
    if family == "essays":
        return [(family, t, p, f"{code}_{p[:3]}_{family}") for t, code in ESSAY_CODES.items() for p in (POSITIVE, NEGATIVE)]
    traits = REDDIT_TRAITS if family == "reddit" else TRAITS
    return [(family, t, p, f"{slug(t)}_{p}_{family}") for t in traits for p in (POSITIVE, NEGATIVE)]


def labelled_registry(rows: DataFrame, family: str) -> DataFrame:
    """(family, name, rows) of every corpus of a family, with the number of its texts; ``rows`` has
    trait and polarity. A corpus without texts is listed with none."""
    names = literal_table(rows.sparkSession, ["family", "trait", "polarity", "name"], family_names(family))
    counts = rows.groupBy("trait", "polarity").agg(F.count("*").alias("rows"))
    found = names.join(counts, ["trait", "polarity"], "left")
    return found.select("family", "name", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def experiment_grid(corpora: DataFrame, seeds: Sequence[int], epochs: int) -> DataFrame:
    """Every corpus with every seed and epoch 0 (base) .. ``epochs``."""
    return corpora.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs)))
    )


def records_by_epoch(records: DataFrame, groups: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """``groups`` and ``epochs``: one JSON object per run, from epoch to item number to the item's
    record (all further columns). First the 50 items of an epoch are gathered, then the epochs of
    a run, so no group holds more than that."""
    fields = [c for c in records.columns if c not in (*groups, epoch, "item")]
    entry = F.struct(F.col("item").cast("string").alias("key"), F.struct(*fields).alias("value"))
    items = records.groupBy(*groups, epoch).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("items"))
    per_epoch = F.struct(F.col(epoch).cast("string").alias("key"), F.col("items").alias("value"))
    # Maps have no order, so the entries are sorted by their key alone.
    ordered = F.array_sort(F.collect_list(per_epoch), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return items.groupBy(*groups).agg(F.to_json(F.map_from_entries(ordered)).alias("epochs"))


def records_from_json(dump: DataFrame, groups: Sequence[str], record: str, epoch: str = "epoch") -> DataFrame:
    """The rows of a dump: ``groups``, epoch, item and the fields of ``record`` (as DDL)."""
    parsed = dump.select(*groups, F.explode(F.from_json("epochs", f"map<string, map<string, struct<{record}>>>")).alias(epoch, "_items"))
    rows = parsed.select(*groups, F.col(epoch).cast("bigint").alias(epoch), F.explode("_items").alias("item", "_r"))
    return rows.select(*groups, epoch, F.col("item").cast("bigint").alias("item"), "_r.*")
