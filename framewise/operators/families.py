"""Files that belong to one asset: primaries, export plans, sizes, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.files import RAW_EXTENSIONS, SIDECAR_EXTENSIONS, casefold, extension, logical_stem


def with_family(files: DataFrame) -> DataFrame:
    """``files(parent, name, ...)`` with ``stem``; parent and stem name a family."""
    return files.withColumn("stem", logical_stem(F.col("name")))


def primaries(files: DataFrame, preference: str = "raw") -> DataFrame:
    """One image of each family: of the preferred kind if there is one, then by name; ``all`` keeps every image."""
    if preference == "all":
        return files
    if preference not in ("raw", "jpeg"):
        raise ValueError(f"unknown preference {preference!r}; choose raw, jpeg or all")
    liked = extension(F.col("name")).isin(*RAW_EXTENSIONS) == F.lit(preference == "raw")
    of = with_family(files)
    best = of.groupBy("parent", "stem").agg(F.min_by(F.struct(*files.columns), F.struct((~liked).alias("other"), casefold("name"), F.col("name"))).alias("best"))
    return best.select("best.*")


def export_plan(leads: DataFrame, files: DataFrame) -> DataFrame:
    """``source, destination`` of every file of the families of ``leads(parent, name)``, once each."""
    families = with_family(leads).select("parent", "stem").distinct()
    found = with_family(files).join(families, ["parent", "stem"], "left_semi")
    path = F.concat_ws("/", "parent", "name")
    return found.select(path.alias("source"), F.ltrim(path, F.lit("/")).alias("destination"), path.alias("_path"), "size_bytes").distinct().withColumn("destination_key", casefold("_path")).select("source", "destination", "destination_key", "size_bytes")


def collisions(plan: DataFrame) -> DataFrame:
    """``destination_key, n_sources`` of destinations that differ in case alone."""
    return plan.groupBy("destination_key").agg(F.count_distinct("source").alias("n_sources")).where("n_sources > 1")


def checked_plan(plan: DataFrame) -> DataFrame:
    """The plan; running it fails where two sources share a destination."""
    clash = Window.partitionBy("destination_key")
    bad = F.min("source").over(clash) != F.max("source").over(clash)
    ok = F.when(bad, F.raise_error(F.concat(F.lit("two sources for "), F.col("destination"))).cast("string")).otherwise(F.col("destination"))
    return plan.withColumn("destination", ok)


def in_order(plan: DataFrame) -> DataFrame:
    """The plan by destination, as it is told and copied."""
    return plan.orderBy("destination_key", "destination")


def rated_families(selected: DataFrame) -> DataFrame:
    """One row of ``selected(parent, name, rank, ...)`` for each family, that of the best rank, so that no sidecar is rated twice."""
    of = with_family(selected)
    first = of.groupBy("parent", "stem").agg(F.min_by(F.struct(*selected.columns), F.struct("rank", "name")).alias("one"))
    return first.select("one.*", "stem")


def family_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def sidecars(files: DataFrame) -> DataFrame:
    """The rating sidecar of each family: the shortest name, then by name."""
    one = with_family(files.where(extension(F.col("name")) == "xmp"))
    return one.groupBy("parent", "stem").agg(F.min_by("name", F.struct(F.length("name"), casefold("name"), F.col("name"))).alias("sidecar"))


def manifest(plan: DataFrame, rated: DataFrame) -> DataFrame:
    """``destination, kind``: copied, copied and rated, or a sidecar that the export made; ``rated(destination)`` has what ratings were written to."""
    marked = plan.select("destination", "source", "size_bytes").join(rated.select("destination", F.lit(True).alias("_rated")).distinct(), "destination", "full")
    kind = F.when(F.col("source").isNull(), "generated_xmp").when(F.col("_rated"), "copied_and_rated").otherwise("copied")
    return marked.select("destination", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("source_size_bytes"), kind.alias("kind"))


def is_sidecar(name: Column) -> Column:
    return extension(name).isin(*SIDECAR_EXTENSIONS)
