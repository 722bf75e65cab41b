"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

Every text gets signals that grow as it gets worse. For each stratum (language), labelled good texts are halved by id
hash. One half proposes cutoffs: level ``x`` cuts every signal at its upper ``x``-quantile among good texts. The other half,
which the cutoffs never saw, tests the levels from the mildest on: level ``x`` is accepted if the number of good texts that
any rule rejects is so small that an exact binomial test refutes "more than ``alpha`` of good texts are rejected" at
``delta / strata``. Testing stops at the first failure (fixed sequence), and the strata share ``delta`` (Bonferroni), so with
probability ``1 - delta`` no stratum loses more than ``alpha`` of its good texts to the rules. A stratum with too few labels
keeps all that the base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialize
from .textops import Hasher, Chunk, chunks, covered

ALPHA, DELTA = 0.05, 0.05
LEVELS = [0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02]
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "n_stutters"]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(1)
    table_of = lambda chars: np.isin(np.arange(256), list(chars))
    symbol, capital, shout = table_of(SYMBOLS), table_of(range(65, 91)), table_of(b"!?")
    for table, texts in chunks(batches):
        chunk = Chunk(texts)
        inside = np.zeros(len(chunk.buf) + 1, np.int8)
        inside[chunk.starts] += 1
        inside[chunk.ends] -= 1
        letters = (np.cumsum(inside[:-1]) > 0) & ((chunk.buf & 0xC0) != 0x80)

        def per_text(mask: np.ndarray, chunk: Chunk = chunk) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[chunk.byte_start[1:]] - total[chunk.byte_start[:-1]]

        words, doc = hasher.words(chunk), chunk.doc_of_word()
        at = chunk.window_starts(REPEAT_WINDOW)
        key, owner = hasher.windows(words, REPEAT_WINDOW)[at], doc[at]
        order = np.lexsort((key, owner))
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeat = np.bincount(doc[covered(at[twice], REPEAT_WINDOW, len(words))], minlength=len(texts))
        stutter = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts)) if len(words) else np.zeros(len(texts), int)
        lines = []
        for text in texts:
            own = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines.append(len(own) - len(set(own)))
        values = [chunk.n_words, per_text(letters), per_text(symbol[chunk.buf]), lines, repeat, per_text(capital[chunk.buf]), per_text(shout[chunk.buf]), stutter]
        rest = table.drop_columns(["text"]).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rest.columns], *[pa.array(np.asarray(v), pa.int64()) for v in values]], names=[*rest.column_names, *COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and the counts of each text; null is a text without words."""
    slim = docs.select("doc_id", "stratum", "text")
    fields = ", ".join(f"{c} bigint" for c in COUNTS)
    return slim.mapInArrow(_counts, f"doc_id bigint, stratum {slim.schema['stratum'].dataType.simpleString()}, {fields}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def signals() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / words,
        "capitals": F.col("n_capitals") / chars,
        "shouts": F.col("n_shouts") / words,
        "stutters": F.col("n_stutters") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p, from the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def chosen_level(rejected: list[int], good: int, alpha: float, delta: float) -> int:
    """Index of the last level accepted in fixed sequence, or -1."""
    level = -1
    for i, k in enumerate(rejected):
        if not good or binomial_tail(k, good, alpha) > delta:
            break
        level = i
    return level


def quality_rules(docs: DataFrame, labelled: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``doc_id, stratum``, the counts, ``base_failed``, ``level`` (the stratum's accepted level, -1: none) and ``kept``.

    ``docs`` has ``doc_id, stratum, text``; ``labelled`` has ``doc_id, quality`` (1 good). Strata (a null one included) are
    few: their cutoffs pass through the driver. Null and empty texts have no words and fail the base rules. Repeated
    rows are judged alike. Without labels only the base rules judge. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    counts = materialize(text_counts(docs))
    rules = signals()
    marks = labelled.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    half = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(2))
    good = counts.filter(~base_failed()).select("doc_id", "stratum", *[c.alias(n) for n, c in rules.items()]).join(marks, "doc_id", "left_semi").withColumn("half", half)
    good = materialize(good)
    at = F.array(*[F.lit(1 - x) for x in LEVELS])
    cuts = good.filter("half = 0").groupBy("stratum").agg(*[F.percentile_approx(n, at, F.lit(100_000)).alias(n) for n in rules])
    cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema).withColumnRenamed("stratum", "_stratum"))
    met = F.col("stratum").eqNullSafe(F.col("_stratum"))

    def over(i: Column) -> Column:
        out = F.lit(False)
        for n, c in rules.items():
            out = out | (c > F.element_at(f"_{n}", i))
        return out

    held = good.filter("half = 1").alias("g").join(cuts.alias("c"), F.col("g.stratum").eqNullSafe(F.col("c._stratum")))
    hit = [F.lit(False)] * len(LEVELS)
    for n in rules:
        hit = [h | (F.col(f"g.{n}") > F.element_at(F.col(f"c.{n}"), i + 1)) for i, h in enumerate(hit)]
    tested = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(h).alias(f"k{i}") for i, h in enumerate(hit)]).collect()
    levels = [(r.stratum, chosen_level([r[f"k{i}"] for i in range(len(LEVELS))], r.n, alpha, delta / len(tested))) for r in tested]
    kind = docs.schema["stratum"].dataType
    table = spark.createDataFrame(levels, f"_s {kind.simpleString()}, level int")
    renamed = cuts.select("_stratum", *[F.col(n).alias(f"_{n}") for n in rules])
    found = counts.join(F.broadcast(renamed), met, "left").join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    found = found.withColumn("level", F.coalesce("level", F.lit(-1))).withColumn("base_failed", base_failed())
    rejected = (F.col("level") >= 0) & over(F.greatest(F.col("level"), F.lit(0)) + 1)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).select("doc_id", "stratum", *COUNTS, "base_failed", "level", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("stratum"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept")
