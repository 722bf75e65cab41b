"""Filter interaction audit: what each order of five filters keeps, removes and hides behind earlier filters.

Four filters look at one text; the fifth fails a text that a smaller ``doc_id`` has as well, anywhere in the table. It is found by a
fingerprint-routed RDD:

1. every task walks its rows in chunks of ``CHUNK_BYTES`` and keeps a chain of (whole text, least id) for each fingerprint; a row
   that loses to a smaller id of the same text is decided at once and needs no text any more;
2. what is left, one entry for each text of a chunk, goes to the partition that its xxhash names; a text that a third of all rows
   have arrives once a chunk;
3. there the same chains, compared by content, meet the entries of all chunks and emit the ids that aren't the least.

A verdict is a narrow row (id, part, mask of failed filters, count). Labels join by id, and ``combineByKey`` merges a
vector of counts by mask for each part; all orders are sums over that vector of 32 x 3 numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, partitions

FILTERS = "ABCDE"
SHORT, REPEATED, CAPITALS, SIGNS, COPY = (1 << i for i in range(5))
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_UPPER, _SIGNS, _LATER_BYTES = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))

#: Bytes of text that a map task combines at a time, and that one partition of chains may stand for.
CHUNK_BYTES, PARTITION_BYTES = 32 << 20, 64 << 20
ENTRY_BYTES = 256  # what an entry takes besides its text

VERDICT = "doc_id bigint, part string, mask int, n bigint"
REPORT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text (UTF-8) fails. ``bytes.split`` cuts at the six ASCII spaces, as the words are defined."""
    words = text.split()
    points = len(text) - _without(text, _LATER_BYTES)
    return (
        SHORT * (len(words) < LEAST_WORDS)
        | REPEATED * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
        | CAPITALS * (100 * _without(text, _UPPER) > CAPITAL_PERCENT * points)
        | SIGNS * (_without(text, _SIGNS) > 0)
    )


def _without(text: bytes, chars: bytes) -> int:
    """How many bytes of ``text`` are among ``chars``."""
    return len(text) - len(text.translate(None, chars))


class Chains:
    """By fingerprint, a chain of ``[text, mask, least id, {part: rows of that id}]``; texts are compared whole."""

    def __init__(self) -> None:
        self.by: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, text: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
        """Takes rows of one id and text; yields the verdicts that this settles."""
        chain = self.by.setdefault(key, [])
        held = next((x for x in chain if x[0] == text), None)
        if held is None:
            chain.append([text, mask, doc_id, dict(parts)])
            self.size += len(text) + ENTRY_BYTES
        elif doc_id > held[2]:
            yield from ((doc_id, part, mask | COPY, n) for part, n in parts.items())
        elif doc_id == held[2]:
            for part, n in parts.items():
                held[3][part] = held[3].get(part, 0) + n
        else:
            yield from ((held[2], part, mask | COPY, n) for part, n in held[3].items())
            held[2:] = [doc_id, dict(parts)]


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _routed(rows, key: Callable[[bytes], int], spread: int, chunk_bytes: int) -> Iterator[tuple[int, tuple]]:
    """``(route, (fingerprint, text, mask, id, parts))`` for what a chunk can't settle, ``(route, verdict)`` for what it can."""
    chains = Chains()
    settled = 0
    for doc_id, text, part in rows:
        text = bytes(text)
        mask = own_failures(text)
        done = [(None, part, mask, 1)] if doc_id is None else chains.add(key(text), text, mask, doc_id, {part: 1})
        for verdict in done:
            settled += 1
            yield settled % spread, verdict
        if chains.size >= chunk_bytes:
            yield from _entries(chains)
            chains = Chains()
    yield from _entries(chains)


def _entries(chains: Chains) -> Iterator[tuple[int, tuple]]:
    for k, chain in chains.by.items():
        for text, mask, doc_id, parts in chain:
            yield k, (k, text, mask, doc_id, parts)


def _met(records) -> Iterator[tuple]:
    chains = Chains()
    for _, record in records:
        if len(record) == 4:
            yield record
        else:
            yield from chains.add(*record)
    for chain in chains.by.values():
        for _, mask, doc_id, parts in chain:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())


def verdicts(docs: DataFrame, *, key: Callable[[bytes], int] = fingerprint, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, part, mask, n``: the filters that each row fails (bits of ``FILTERS``), rows that agree in all three counted together.

    ``docs`` needs ``doc_id, text, source``; further columns aren't read, whatever their names. A null text counts as empty, a
    null source as the part "". A row without id has no smaller id and is none, so it never fails E. Rows that repeat
    the least id of a text all pass E, those that repeat a larger one all fail it. Texts of any length are compared whole. An empty
    table gives an empty one. ``key`` replaces the fingerprint (tests pass a weak one: contents decide, not fingerprints).
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    size = narrow.agg(F.sum(F.octet_length("text").cast("long") + ENTRY_BYTES)).first()[0] or 0
    parts = max(partitions(spark), -(-size // PARTITION_BYTES))
    routed = narrow.rdd.mapPartitions(lambda rows: _routed(rows, key, parts, chunk_bytes)).partitionBy(parts, lambda k: k)
    return spark.createDataFrame(routed.mapPartitions(_met), VERDICT, verifySchema=False)


def repeated_ids(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every row whose text a smaller id has as well."""
    return verdicts(docs).filter(F.col("mask").bitwiseAND(COPY) != 0).select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("doc_id")


def _plans() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) pairs, and for each count the masks that it sums, one row a pair."""
    pairs, kinds = [], {k: [] for k in ("kept", "removed", "redundant", "unique")}
    masks = np.arange(32)
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, earlier = (masks & bit) > 0, (masks & before) > 0
            pairs.append((order, step))
            for k, v in zip(kinds, ((masks & (before | bit)) == 0, fails & ~earlier, fails & earlier, masks == bit), strict=True):
                kinds[k].append(v)
            before |= bit
    return pairs, {k: np.array(v, np.int64) for k, v in kinds.items()}


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The 600 rows of a part from its counts by mask: all rows, good ones, toxic ones (32 x 3)."""
    pairs, sums = _plans()
    n, good, toxic = counts.T
    removed = sums["removed"] @ n
    shapley: dict[str, int] = dict.fromkeys(FILTERS, 0)
    for (order, step), x in zip(pairs, removed.tolist(), strict=True):
        shapley[order[step - 1]] += x
    columns = (sums["kept"] @ n, removed, sums["redundant"] @ n, sums["unique"] @ n, sums["removed"] @ good, sums["removed"] @ toxic)
    for (order, step), row in zip(pairs, np.stack(columns, 1).tolist(), strict=True):
        yield (part, order, step, *row, shapley[order[step - 1]])


def _counted(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: see :data:`REPORT`.

    ``labels`` needs ``doc_id, quality, toxic``: an id is good (toxic) if any of its rows says 1; rows without id label nothing.
    Rows of ``docs`` are read as in :func:`verdicts`; an empty table has no parts and gives no rows.
    """
    spark = docs.sparkSession
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = verdicts(docs).join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    vectors = known.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _counted(np.zeros((32, 3), np.int64), row), _counted, _added, partitions(spark))
    return spark.createDataFrame(vectors.flatMap(lambda x: report(*x)), REPORT, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INTEGER AS earlier FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(step)),
told AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told
"""
