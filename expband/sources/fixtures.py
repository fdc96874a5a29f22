"""Postings, labels and probabilities derived from the test tables.

The given documents hold no rule vocabulary, so a posting is a document with one
sentence put in after its first 600 characters, and a title; both are picked by
``doc_id``. Every (sentence, title) pair occurs once in 600 documents, with and
without a section heading once in 1200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.sources import io

LEADS = ("Note. ", "Requirements:\n")

TEMPLATES = (
    "5+ years of experience required.",
    "3 to 5 years of sales experience.",
    "1-3 years experience.",
    "10–15 years of leadership experience.",
    "Minimum of 7 years of professional experience.",
    "At least two years of experience.",
    "20 years of experience.",
    "Sixteen years of industry experience.",
    "15 yrs exp.",
    "4 (four) years of experience.",
    "We have been serving clients for over 25 years with expertise.",
    "Candidate with 5+ years of experience.",
    "Candidate with at least 6 years of experience.",
    "No experience necessary.",
    "This is an entry-level position.",
    "We will train the right person.",
    "No experience required, but 8+ years of experience preferred.",
    "Bachelor degree + 4 years or 8 years.",
    "MBA + three years, or six years.",
    "Manages a team of 12 engineers.",
    "Supervises 4 employees.",
    "6 direct reports.",
    "10 years of combined experience.",
    "5 years expected.",
    "60 years of experience.",
    "5-3 years of experience.",
    "2 years of Java experience and 9 years of sales experience.",
    "1 year old experience.",
    "2 years of experience.",
    "Great benefits.",
)

TITLES = (
    "Software Engineer", "Senior Analyst", "Sr. Accountant", "Chief Technology Officer",
    "Vice President of Sales", "CEO", "Marketing Intern", "Engineer II", "Engineer III",
    "Technician ii", "Director of Operations", "Managing Director", "Principal Engineer",
    "Staff Nurse", "Junior Developer", "Project Manager", "VP of Engineering II",
    "Head of Growth", "Summer Associate", "Team Lead, 5+ years experience",
)

# expected band of each sentence (0: the title decides) and of each title's words
TEMPLATE_BANDS = (2, 2, 1, 3, 3, 1, 4, 4, 3, 2, 0, 0, 3, 1, 1, 1, 3, 2, 2, 4, 3, 3, 3, 2,
                  0, 2, 3, 0, 1, 0)
TITLE_BANDS = (0, 3, 3, 4, 4, 4, 1, 2, 3, 2, 4, 4, 4, 0, 1, 3, 2, 4, 0, 3)

GOLD_EVERY = 5
UNMATCHED_SHIFT = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of long texts, spread over the cores."""
    return io.spread(table(spark, sf_dir, name).select(*columns))


def _pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _template(doc_id) -> F.Column:
    return doc_id % len(TEMPLATES)


def _title(doc_id) -> F.Column:
    return F.floor(doc_id / len(TEMPLATES)) % len(TITLES)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, job_id, title, description`` of every document."""
    d = F.col("doc_id")
    lead = F.floor(d / (len(TEMPLATES) * len(TITLES))) % 2
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        F.concat(F.lit("J"), d.cast("string")).alias("job_id"),
        _pick(TITLES, _title(d)).alias("title"),
        F.concat(F.substring("text", 1, 600), F.lit("\n"), _pick(LEADS, lead),
                 _pick(TEMPLATES, _template(d)), F.lit("\n"),
                 F.expr("substring(text, 601)")).alias("description"),
    )


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records of every labelled document, in the fields a label file has.

    Labels follow the sentence, else the title, one band lower for low-quality
    documents; a few copies point at postings that do not exist.
    """
    d = F.col("doc_id")
    by_template = _pick(TEMPLATE_BANDS, _template(d))
    by_title = _pick(TITLE_BANDS, _title(d))
    band = F.when(by_template > 0, by_template).when(by_title > 0, by_title).otherwise(1)
    labels = table(spark, sf_dir, "labels")
    stray = (labels.filter(d < 5)
             .withColumn("doc_id", d + UNMATCHED_SHIFT))
    rows = labels.unionByName(stray).select(
        "doc_id",
        F.concat(F.lit("J"), d.cast("string")).alias("job_id"),
        F.greatest(F.lit(1), band - F.when(F.col("quality") == 0, 1).otherwise(0))
        .cast("int").alias("label"),
        (F.col("toxic") == 1).alias("unsure"),
        F.lit("").alias("title"),
        F.lit("").alias("decided_by"), F.lit("").alias("evidence_snippet"),
        F.lit("").alias("evidence_source"),
        F.when(d % GOLD_EVERY == 0, "gold").otherwise("silver").alias("source"),
    )
    return rows


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, proba``: class probabilities from the first four embedding entries.

    Some rows are even four-way ties, some have a small margin.
    """
    v = F.col("vec_id")
    soft = F.transform(F.slice("embedding", 1, 4), lambda x: F.exp(x.cast("double") * 4))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    even = F.array(*[F.lit(0.25)] * 4)
    close = F.array(F.lit(0.40), F.lit(0.35), F.lit(0.15), F.lit(0.10))
    return (table(spark, sf_dir, "embeddings")
            .select("vec_id", soft.alias("e"))
            .withColumn("total", total)
            .select("vec_id", F.when(v % 50 == 0, even).when(v % 50 == 1, close)
                    .otherwise(F.transform("e", lambda x: F.round(x / F.col("total"), 9)))
                    .alias("proba")))


def posting_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with a probability vector; all vectors are reused in turn."""
    # one row on the right
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("x_n"))
    return (postings(spark, sf_dir).join(F.broadcast(n), F.lit(True))
            .withColumn("vec_id", F.col("doc_id") % F.col("x_n"))
            .join(probabilities(spark, sf_dir), "vec_id").drop("vec_id", "x_n"))
