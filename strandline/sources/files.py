"""Tolerant readers and keyed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts from JSON lines: blank and broken lines and bad times are dropped, other faults become defaults."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", "surah string, durationSec string, aspectRatio string, at string", {"mode": "PERMISSIVE"}).alias("j")).where(F.col("j").isNotNull())
    at = F.try_to_timestamp("j.at")
    return parsed.select(
        F.expr("try_cast(j.surah AS int)").alias("surah"), F.coalesce(F.expr("try_cast(j.durationSec AS double)"), F.lit(0.0)).alias("duration_sec"), F.col("j.aspectRatio").alias("aspect_ratio"), at.alias("at")
    ).where(F.col("at").isNotNull())


def append_counts(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, verse_key, words: caption lines of text files; `#` lines and blank ones are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    data = lines.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    return data.select("file", "line_no", F.regexp_extract("line", r"^\s*(\d+:\d+)", 1).alias("verse_key"), F.trim(F.regexp_replace("line", r"^\s*\d+:\d+\s*", "")).alias("words"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """file, fact, value: `# fact: value` lines; values that say `unknown` are dropped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    fact, value = F.trim(F.regexp_extract("value", r"^#\s*([^:]+):", 1)), F.trim(F.regexp_extract("value", r"^#\s*[^:]+:(.*)$", 1))
    return lines.select("file", fact.alias("fact"), value.alias("value")).where((F.col("fact") != "") & (F.lower("value") != "unknown"))


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions that `rows` holds and leave the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_ground_truth(captions: DataFrame, path: str) -> None:
    """Captions (file, line_no, verse_key, words) as text files, one folder for each `file`, lines in order."""
    line = F.concat_ws(" ", "verse_key", "words")
    ordered = captions.repartition("file").sortWithinPartitions("file", "line_no").select("file", line.alias("value"))
    ordered.write.mode("overwrite").partitionBy("file").text(path)


def read_manifest(spark: SparkSession, path: str, public: bool = False) -> DataFrame:
    """id, name, file, language of a manifest's entries: numeric ids and plain file names only; a blank language
    is English. In public mode there are none, nor from a file that cannot be read as JSON."""
    entries = spark.read.schema("id string, name string, file string, language string").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    plain = F.col("id").rlike(r"^\d+$") & ~F.col("file").rlike(r"[/\\]") & (F.col("file") != "")
    language = F.when(F.trim(F.coalesce("language", F.lit(""))) != "", F.trim("language")).otherwise("English")
    return entries.where(plain & F.lit(not public)).select("id", "name", "file", language.alias("language"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """id, created_at, state of the jobs under a folder, one JSON file in each subfolder; files that are not
    JSON or have no id are dropped. Order by created_at, descending, for a list."""
    jobs = spark.read.schema("id string, createdAt long, state string").option("mode", "DROPMALFORMED").json(f"{path.rstrip('/')}/*/job.json")
    return jobs.where(F.coalesce("id", F.lit("")) != "").select("id", F.col("createdAt").alias("created_at"), F.col("state"))


def read_optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a JSON export, or none where the file is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
