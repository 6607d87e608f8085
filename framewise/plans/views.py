"""Tables of captures made from the test tables, for the registered queries; each with the same view in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.metadata import wall_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id between -499 and 499")  # no other is the rest of a division by 500


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding`` of the captures that name theirs, one row each."""
    return _looks(spark, sf_dir).select("vec_id", "embedding").dropDuplicates(["vec_id"])


def captures(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """A capture for each event; some have no sharpness, and some shares of pixels lie in the middle of two tenths.

    With ``named`` a capture has the ``vec_id`` of its embedding, which is among the :func:`vectors`.
    Its paths are ASCII, so that lower case is their case folding.
    """
    id_ = F.col("event_id")
    path = F.concat(F.lit("/c/"), "event_type", F.lit("/IMG_"), F.lpad(id_.cast("string"), 7, "0"), F.lit(".jpg"))
    exposed = F.lit(0.1) * ((id_ * 29) % 83) / F.lit(82.0)
    events = table(spark, sf_dir, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")  # one small file is one split; narrow rows yet
    rows = events.select(
        id_.alias("capture_id"), path.alias("file_path"), F.lower(path).alias("path_key"), F.element_at(F.split(path, "/"), -1).alias("file_name"),
        wall_micros(F.col("ts")).alias("ts_us"), F.when(id_ % 7 == 0, "").otherwise(F.concat(F.lit("SN"), (F.col("user_id") % 3).cast("string"))).alias("camera_serial"),
        F.concat(F.lit("M"), (F.col("user_id") % 2).cast("string")).alias("camera_model"), F.when(id_ % 5 == 0, "x").otherwise((id_ % 12).cast("string")).alias("sequence_number"),
        F.when(id_ % 97 != 5, F.col("value")).alias("focus_score"), (F.lit(20.0) + F.lit(60.0) * ((id_ * 37) % 101) / F.lit(100.0)).alias("musiq_score"),
        (F.lit(3.0) + F.lit(5.0) * ((id_ * 53) % 97) / F.lit(96.0)).alias("aesthetic_score"), ((id_ * F.lit(2654435761)) % F.lit(4294967296)).alias("phash"),
        F.greatest(F.lit(0.4), F.lit(1.0) - F.lit(5.0) * F.greatest(F.lit(0.0), exposed - F.lit(0.02))).alias("exposure_penalty"),
        (((id_ * 29) % 83) / F.lit(20.0)).alias("blown_pct"), F.lit(0.0).alias("crushed_pct"),
        F.when(id_ % 10 == 0, 0.7).otherwise(1.0).alias("eye_factor"), F.when(id_ % 10 == 0, "Possible closed/obscured eyes").otherwise("").alias("eye_warning"),
        (F.lit(0.5) + F.lit(0.5) * ((id_ * 17) % 89) / F.lit(88.0)).alias("subject_integrity"), (id_ % 500).alias("vec_id"),
    )
    looks = _looks(spark, sf_dir)
    if named:
        return rows.join(F.broadcast(looks.select("vec_id")), "vec_id")
    return rows.join(F.broadcast(looks.select("vec_id", "embedding")), "vec_id").drop("vec_id")


CAPTURES = """captures AS (
  SELECT event_id AS capture_id, '/c/' || event_type || '/IMG_' || lpad(event_id::VARCHAR, 7, '0') || '.jpg' AS file_path,
    lower('/c/' || event_type || '/IMG_' || lpad(event_id::VARCHAR, 7, '0') || '.jpg') AS path_key, 'IMG_' || lpad(event_id::VARCHAR, 7, '0') || '.jpg' AS file_name,
    epoch_us(ts) AS ts_us, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'SN' || (user_id % 3)::VARCHAR END AS camera_serial, 'M' || (user_id % 2)::VARCHAR AS camera_model,
    CASE WHEN event_id % 5 = 0 THEN 'x' ELSE (event_id % 12)::VARCHAR END AS sequence_number, CASE WHEN event_id % 97 <> 5 THEN value END AS focus_score,
    20e0 + 60e0 * ((event_id * 37) % 101) / 100e0 AS musiq_score, 3e0 + 5e0 * ((event_id * 53) % 97) / 96e0 AS aesthetic_score,
    (event_id * 2654435761) % 4294967296 AS phash,
    greatest(4e-1, 1e0 - 5e0 * greatest(0e0, 1e-1 * ((event_id * 29) % 83) / 82e0 - 2e-2)) AS exposure_penalty,
    ((event_id * 29) % 83) / 20e0 AS blown_pct, 0e0 AS crushed_pct, CASE WHEN event_id % 10 = 0 THEN 7e-1 ELSE 1e0 END AS eye_factor,
    CASE WHEN event_id % 10 = 0 THEN 'Possible closed/obscured eyes' ELSE '' END AS eye_warning,
    5e-1 + 5e-1 * ((event_id * 17) % 89) / 88e0 AS subject_integrity, embedding
  FROM events JOIN embeddings ON vec_id = event_id % 500)"""


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, capture_id, decision``: a label is a decision; every ninth is blank and every fifth is given twice."""
    labels = table(spark, sf_dir, "labels")
    word = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("quality") == 1, " Keep").otherwise("reject")
    first = labels.select((F.col("doc_id") * 2).alias("row_id"), F.col("doc_id").alias("capture_id"), word.alias("decision"))
    again = labels.where("doc_id % 5 = 0").select((F.col("doc_id") * 2 + 1).alias("row_id"), F.col("doc_id").alias("capture_id"), F.lit("REJECT ").alias("decision"))
    return first.union(again)


FEEDBACK = """feedback_rows AS (
  SELECT doc_id * 2 AS row_id, doc_id AS capture_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN quality = 1 THEN ' Keep' ELSE 'reject' END AS decision FROM labels
  UNION ALL SELECT doc_id * 2 + 1, doc_id, 'REJECT ' FROM labels WHERE doc_id % 5 = 0),
feedback AS (
  SELECT capture_id, arg_max(lower(trim(decision)), row_id) AS decision FROM feedback_rows WHERE trim(decision) <> '' GROUP BY capture_id)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent, name, size_bytes, modified_ns``: families of a raw image, an image and a sidecar; some paths are to be skipped."""
    id_ = F.col("doc_id")
    first = id_ - id_ % 3
    ending = F.when(id_ % 3 == 0, ".ARW").when(id_ % 3 == 1, ".JPG").otherwise(".ARW.xmp")
    folder = F.when(id_ % 31 == 0, "/.Trash").when(id_ % 37 == 0, "/picks_20260909_120000").otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/c/d"), (first % 5).cast("string"), folder).alias("parent"),
        F.concat(F.when(id_ % 41 == 0, "._IMG_").otherwise("IMG_"), F.lpad(first.cast("string"), 7, "0"), ending).alias("name"),
        F.col("n_chars").alias("size_bytes"), (F.lit(1700000000000000000) + id_ * F.lit(1000000007)).alias("modified_ns"), id_.alias("file_id"),
    )


FILES = """files AS (
  SELECT '/c/d' || ((doc_id - doc_id % 3) % 5)::VARCHAR || CASE WHEN doc_id % 31 = 0 THEN '/.Trash' WHEN doc_id % 37 = 0 THEN '/picks_20260909_120000' ELSE '' END AS parent,
    CASE WHEN doc_id % 41 = 0 THEN '._IMG_' ELSE 'IMG_' END || lpad((doc_id - doc_id % 3)::VARCHAR, 7, '0') || CASE doc_id % 3 WHEN 0 THEN '.ARW' WHEN 1 THEN '.JPG' ELSE '.ARW.xmp' END AS name,
    n_chars AS size_bytes, 1700000000000000000 + doc_id * 1000000007 AS modified_ns, doc_id AS file_id FROM documents)"""


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``capture_id, tags, modified_us``: times with fractions and offsets of several kinds, one month in thirteen impossible."""
    id_ = F.col("event_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.concat(two(1 + id_ % 28), F.lit(" "), two(id_ % 24), F.lit(":"), two(id_ % 60), F.lit(":"), two((id_ * 7) % 60))
    fraction = F.when(id_ % 4 == 0, F.concat(F.lit("."), id_.cast("string"))).otherwise("")
    offset = F.when(id_ % 5 == 0, "Z").when(id_ % 5 == 1, "+05:30").when(id_ % 5 == 2, "-0400").otherwise("")
    main = F.concat(F.lit("2024:"), two(1 + id_ % 13), F.lit(":"), day, fraction, offset)
    tags = F.create_map(
        F.lit("DateTimeOriginal"), main, F.lit("CreateDate"), F.when(id_ % 2 == 0, F.concat(F.lit("2023-05-"), day)).otherwise(""), F.lit("SubSec"), F.when(id_ % 3 == 0, "12").otherwise(""),
        F.lit("Offset"), F.when(id_ % 5 == 3, "-04:00").otherwise(""), F.lit("Model"), F.when(id_ % 2 == 0, "").otherwise("M1"), F.lit("CameraModelName"), F.lit("M2"),
        F.lit("SerialNumber"), F.when(id_ % 3 == 0, "").otherwise(F.concat(F.lit("S"), (id_ % 9).cast("string"))), F.lit("ImageNumber"), id_.cast("string"),
    )
    return table(spark, sf_dir, "events").select(id_.alias("capture_id"), tags.alias("tags"), wall_micros(F.col("ts")).alias("modified_us"))


EXIF = """exif AS (
  SELECT event_id AS capture_id, '2024:' || lpad((1 + event_id % 13)::VARCHAR, 2, '0') || ':' || day || CASE WHEN event_id % 4 = 0 THEN '.' || event_id::VARCHAR ELSE '' END
      || CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-0400' ELSE '' END AS original,
    CASE WHEN event_id % 2 = 0 THEN '2023-05-' || day ELSE '' END AS created, CASE WHEN event_id % 3 = 0 THEN '12' ELSE '' END AS subsec,
    CASE WHEN event_id % 5 = 3 THEN '-04:00' ELSE '' END AS off, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'M1' END AS model,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'S' || (event_id % 9)::VARCHAR END AS serial, event_id::VARCHAR AS image_number, epoch_us(ts) AS modified_us
  FROM (SELECT *, lpad((1 + event_id % 28)::VARCHAR, 2, '0') || ' ' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':' || lpad(((event_id * 7) % 60)::VARCHAR, 2, '0') AS day FROM events))"""


def cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base and preset rows of two thirds of the events; some are stale, half have a preset."""
    id_ = F.col("event_id")
    rows = table(spark, sf_dir, "events").where(id_ % 3 != 0).select(
        F.concat(F.lit("d/"), id_.cast("string")).alias("relative_path"), F.when(id_ % 13 == 0, "algorithm=4").otherwise("algorithm=5").alias("pipeline_signature"),
        (F.lit(1000) + id_ + F.when(id_ % 11 == 0, 1).otherwise(0)).alias("size_bytes"), (id_ * 7).alias("modified_ns"), id_.alias("capture_id"),
    )
    return rows, rows.where("capture_id % 2 = 0").select("relative_path", "pipeline_signature", F.lit("wildlife").alias("preset"))
