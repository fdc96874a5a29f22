"""Readers and writers: postings, labels, predictions, reports, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column names of the exchanged files.
ID_NAMES = ("UniqueJobAdID", "job_id")
TITLE_NAMES = ("OrigJobTitle", "title")
DESCRIPTION_NAMES = ("JobDescription", "description")
PREDICTION_COLUMNS = ("job_id", "title", "label", "confidence", "decided_by",
                      "evidence_snippet", "evidence_source", "unsure")

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "encoding": "UTF-8", "maxCharsPerColumn": "-1"}
WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
LABEL_SCHEMA = ("job_id string, label string, title string, unsure string, decided_by string, "
                "evidence_snippet string, evidence_source string")


# Input bytes of one task where rows are dealt out anew.
SPREAD_BYTES = 256 << 20
SPLIT_BYTES = 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, splittable: bool = True) -> DataFrame:
    """Deal rows out where the source's own splits are too few or too large.

    The size is the planner's estimate, so nothing runs here. A splittable source with
    a split for every core is left alone; one file of many GB that only one task can
    read is dealt out in parts of SPREAD_BYTES, whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    wanted = max(cores, -(-size // SPREAD_BYTES))
    if splittable and size >= cores * SPLIT_BYTES:
        return df
    if not splittable and len(df.inputFiles()) >= wanted:
        return df
    return df.repartition(wanted)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted multi-line fields and doubled quotes; all strings."""
    return spark.read.options(**CSV_OPTIONS).csv(path)


def first_filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First of the existing columns with a non-empty value, else the empty string."""
    filled = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit(""))
              for n in names if n in df.columns]
    return F.coalesce(*filled, F.lit(""))


def resolve_columns(df: DataFrame, *extra: str) -> DataFrame:
    """``job_id, title, description`` under either naming; empty counts as missing."""
    return df.select(first_filled(df, ID_NAMES).alias("job_id"),
                     first_filled(df, TITLE_NAMES).alias("title"),
                     first_filled(df, DESCRIPTION_NAMES).alias("description"), *extra)


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``.

    The rank filter is applied per task before the shuffle too, so a key that holds a
    large share of all rows sends at most one row per task.
    """
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return (df.withColumn("x_rank", F.row_number().over(latest))
            .filter("x_rank = 1").drop("x_rank"))


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    """The posting universe of a CSV folder, unique by id, later rows replacing earlier.

    A multi-line file is read by one task, so rows of a file keep their order. Only the
    id is required; an absent title or description is empty.
    """
    raw = read_csv(spark, path).withColumns({
        "x_file": F.col("_metadata.file_path"), "x_row": F.monotonically_increasing_id()})
    named = raw.select(F.coalesce(ID_NAMES[0], F.lit("")).alias("job_id"),
                       first_filled(raw, TITLE_NAMES[:1]).alias("title"),
                       first_filled(raw, DESCRIPTION_NAMES[:1]).alias("description"),
                       "x_file", "x_row")
    return last_wins(named, "job_id", ["x_file", "x_row"]).drop("x_file", "x_row")


def load_label_records(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Label records of JSON arrays, with defaults filled in and tagged by source.

    An array may span lines, so each file is read whole.
    """
    return normalise_labels(spark.read.schema(LABEL_SCHEMA).json(path, multiLine=True), source)


# Any other value of the unsure flag counts as true.
FALSE_VALUES = ("", "false", "0", "0.0", "[]", "{}")


def _valid_label(label: Column) -> Column:
    """The label as int; anything that is no band stops the job with a message."""
    value = label.try_cast("double").cast("int")
    problem = F.concat(F.lit("label is not a band from 1 to 4: "), F.coalesce(label, F.lit("null")))
    return F.when(value.between(1, 4), value).otherwise(F.raise_error(problem).cast("int"))


def write_label_records(rows: DataFrame, path: str, per_file: int = 5000) -> None:
    """Label records as JSON arrays of about ``per_file`` records, one array to a file.

    Arrays are collected within hash groups, whose number follows the rows.
    """
    groups = F.pmod(F.xxhash64("job_id"), F.greatest(F.lit(1), F.floor(F.col("x_n") / per_file)))
    n = rows.agg(F.count("*").alias("x_n"))
    # one row on the right
    arrays = (rows.join(F.broadcast(n), F.lit(True)).groupBy(groups.alias("x_part"))
              .agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def normalise_labels(raw: DataFrame, source: str) -> DataFrame:
    return raw.select(
        F.col("job_id").cast("string").alias("job_id"),
        _valid_label(F.col("label")).alias("label"),
        F.coalesce("title", F.lit("")).alias("title"),
        (~F.coalesce("unsure", F.lit("")).isin(*FALSE_VALUES)).alias("unsure"),
        *[F.coalesce(c, F.lit("")).alias(c)
          for c in ("decided_by", "evidence_snippet", "evidence_source")],
        F.lit(source).alias("source"))


def join_labels(labels: DataFrame, postings: DataFrame) -> DataFrame:
    """Label records with the text of their posting; the posting's title comes first.

    Neither side is forced to be broadcast: the label side is small as a rule and the
    engine sends it whole when its measured size allows, else both sides are shuffled.
    """
    p = postings.select("job_id", F.col("title").alias("x_title"), "description")
    joined = labels.join(p, "job_id")
    title = F.coalesce(F.nullif("x_title", F.lit("")), "title", F.lit(""))
    return joined.withColumn("title", title).drop("x_title")


def unmatched_labels(labels: DataFrame, postings: DataFrame) -> DataFrame:
    """Label records per source without a posting."""
    return (labels.join(postings.select("job_id"), "job_id", "left_anti")
            .groupBy("source").agg(F.count("*").alias("n")))


def three_decimals(value: Column) -> Column:
    """Text of a value from 0 to 1 with three decimals, rounded as in C printf.

    The binary value decides, not its decimal text: times a power of two it is a whole
    number, exactly, and thousandths are taken from that in integers, halves to even.
    """
    small = value < 2.0 ** -10
    unit = F.when(small, F.lit(str(2 ** 73)).cast("decimal(38,0)")).otherwise(
        F.lit(str(2 ** 62)).cast("decimal(38,0)"))
    whole = (value * F.when(small, 2.0 ** 73).otherwise(2.0 ** 62)).cast("bigint")
    scaled = (whole.cast("decimal(20,0)") * F.lit(1000)).cast("decimal(38,0)")
    rest = scaled % unit
    floor = ((scaled - rest) / unit).cast("bigint")
    up = (2 * rest > unit) | ((2 * rest == unit) & (floor % 2 == 1))
    thousandths = floor + up.cast("bigint")
    return F.concat(F.floor(thousandths / 1000).cast("string"), F.lit("."),
                    F.lpad((thousandths % 1000).cast("string"), 3, "0"))


def prediction_rows(df: DataFrame) -> DataFrame:
    """Predictions as text columns, in file order."""
    return df.select(
        "job_id", "title", F.col("label").cast("string").alias("label"),
        three_decimals(F.col("confidence")).alias("confidence"),
        "decided_by", "evidence_snippet", "evidence_source",
        F.col("unsure").cast("string").alias("unsure"))


def review_queue(predictions: DataFrame) -> DataFrame:
    """Only the rows that need a look."""
    return predictions.filter("unsure")


def write_predictions(df: DataFrame, path: str, only_flagged: bool = False) -> None:
    rows = prediction_rows(review_queue(df) if only_flagged else df)
    rows.write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session falls back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="expband-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a new shared folder and read it again: by column, so later steps read only what they use."""
    path = f"{shared_folder(df.sparkSession)}/expband-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, which outlives executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
