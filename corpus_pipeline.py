"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read back as the next
stage's ``docs``. All but the last return the columns of ``documents``; further columns, whatever their names, are carried as
they are. Null texts count as empty, null ids are ids of no row, texts of any length are read whole, and an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import best_fit, exact_dedup, jaccard_join, mixing, quality_classifier
from tidemark.llm.shared import documents, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold.

    Without labels of both kinds all documents stay. Rows of equal text share a verdict; a null text has that of an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality_classifier.held_out()).select("doc_id", "quality")
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = quality_classifier.quality_scores(docs.withColumnsRenamed(own), labels)
    return scored.filter("predicted = 1").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id (nulls last). Null and empty texts are one text."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the least id.

    Documents without a word are copies of nothing; of rows that repeat id and text one stays.
    """
    return jaccard_join.near_dedup(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a Pfair schedule of source blocks: rows and files follow the target weights.

    No row is dropped, repeated rows keep their places, and documents without a source are one source more. The next stage
    reads the order off the files.
    """
    rows = docs.select("doc_id", "source", F.struct("*").alias("_doc"))
    return mixing.mix(rows).orderBy("slot", "place").select("_doc.*")


def _place(docs: DataFrame) -> Column | None:
    """Where a row of a written table stands: the number of its file's task, the file's number in the task, the row in the file. Null without files."""
    try:
        of = docs.metadataColumn("_metadata")
        number = lambda pattern: F.coalesce(F.regexp_extract(of["file_name"], pattern, 1).try_cast("long"), F.lit(0))
        at = F.shiftleft(number(r"^part-(\d+)"), 44) + F.shiftleft(number(r"-c(\d+)\."), 32) + of["row_index"]
        docs.select(at).schema  # noqa: B018  a table without files has no such column
    except AnalysisException:
        return None
    return at


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; columns other than id and text are not read. A text without words is its end id.

    Best fit asks for sizes alone, so the order of the rows in the files of ``docs``, the mixture, decides in which order sequences are
    read: each has the ``position`` of the row that opens it (the piece at offset 0), and rows and files are sorted by it. Tables without
    files have no order, and no ``position``.
    """
    place = _place(docs)
    rows = docs.select("doc_id", "text", *([] if place is None else [place.alias("position")]))
    packed = best_fit.pack(materialize(best_fit.token_pieces(rows, carry=None if place is None else "position").drop("size")))
    if place is None:
        return packed
    opens = F.max(F.when(F.col("offset") == 0, F.col("position"))).over(Window.partitionBy("sequence_id"))  # pieces of one sequence
    return packed.withColumn("position", opens).orderBy("position", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
