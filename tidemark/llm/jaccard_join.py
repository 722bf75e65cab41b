"""Set-similarity self-join over word n-grams, by rare-first prefix filtering.

A text's set is its distinct lower-cased word shingles. Texts with one set are one class, and only classes are joined.
Shingles are ordered rare first: by how often their hash bucket occurs in the whole table (a fixed number of buckets),
then by hash; any order common to all texts is right, this one keeps frequent shingles out of the prefixes. Two sets of
the wanted similarity share a shingle of their prefixes. Prefix shingles of a single class are dropped (see ``packed``);
classes that share one pass the length filter, the positional filter and the suffix filter (a lower bound of the sets'
distance from the parities of their sizes by hash range), and each remaining pair is verified once, on the whole sets.

Pairs are asked for in rounds, so that a large group of near copies isn't paired all with all: first each class with
one class of the shingle, the one that has the largest part of its own set in common with others (of a text and its copies,
that is the text: copies have shingles of their own). In the last round, for shingles that still hold several components, the
classes outside the component of that class meet all classes of other components. Every candidate pair is so
verified or inside one component already: no link between components is lost. A pair that shares many shingles is met at
one of them: each class knows its ``LEADS`` least shingles, and where two classes have some of these in common, only
the least of them names the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .packed import PACKED, key_partitions, match, pack, places_of, with_uid
from .shared import collect_blocks, documents, lookup, materialize, partitions, release, sum_blocks
from .textops import U64, Chunk, Hasher, chunks, mix

SHINGLE, PERCENT = 4, 85
BUCKET_BITS, BLOCK = 20, 1 << 12
PARITY = 4  # words of 64 hash ranges each, for the suffix filter
ROUNDS = 1  # with one class per shingle, before the last
LEADS = 16
KEY_BYTES = 5
BITMAP_BYTES, MOST_BITMAPS = 4096, 4096  # of texts that pairs ask for: 16 MB at most

_LOWER = bytes.lower  # of A-Z only


def _windows(chunk: Chunk, words: np.ndarray, hasher: Hasher, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and fingerprint of every shingle; a shorter text is one shingle."""
    at = chunk.window_starts(k)
    doc, value = chunk.doc_of_word()[at], hasher.windows(words, k)[at]
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < k))
    if len(short):
        whole = [mix(hasher.windows(words[chunk.word_start[i] : chunk.word_start[i + 1]], int(chunk.n_words[i])) + U64(chunk.n_words[i])) for i in short]
        doc, value = np.concatenate([doc, short.astype(doc.dtype)]), np.concatenate([value, *whole])
    return doc, value


def shingle_sets(texts: list[bytes], hasher: Hasher, k: int, second: Hasher | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct shingle fingerprints of each text, ascending, one text after another; the set sizes; and with ``second`` the
    fingerprints of the same shingles in that family.
    """
    chunk = Chunk(texts)
    words = hasher.words(chunk)
    doc, value = _windows(chunk, words, hasher, k)
    order = np.lexsort((value, doc))
    other = _windows(chunk, words, second, k)[1][order] if second else None
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts)), other[new] if second else None


def exact_shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of each text, as in :func:`shingle_sets`; numbers agree where all words do."""
    chunk = Chunk([_LOWER(t) for t in texts])
    words = pa.array([w for t in chunk.texts for w in t.split()], pa.binary()).dictionary_encode()
    part, doc = words.indices.to_numpy().astype(np.int64), chunk.doc_of_word()
    place = np.arange(len(part)) - chunk.word_start[doc]
    for far in range(1, k):  # a shingle's number after `far + 1` words; where the text ends, the number of what is there
        after = np.full(len(part), -1)
        inside = np.flatnonzero(place + far < chunk.n_words[doc])
        after[inside] = words.indices.to_numpy()[inside + far]
        part = np.unique(part * (len(words.dictionary) + 1) + after + 1, return_inverse=True)[1]
    full = (place + k <= chunk.n_words[doc]) | (place == 0)
    pair = np.unique(doc[full].astype(np.int64) * (len(part) + 1) + part[full])
    return pair % (len(part) + 1), np.bincount(pair // (len(part) + 1), minlength=len(texts))


def _frequencies(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(3, lower=True), np.zeros(1 << BUCKET_BITS, np.int64)
        for _, texts in chunks(batches):
            values = shingle_sets(texts, hasher, k)[0]
            total += np.bincount((values >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        parts = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "data"])

    return run


MEMBERS = "doc_id bigint, uid_a bigint, uid_b bigint, n bigint, set_a bigint, set_b bigint, parity array<bigint>, prefix array<bigint>"


def _members(k: int, percent: int, frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second, often = Hasher(3, lower=True), Hasher(4, lower=True), frequency.value
        for table, texts in chunks(batches):
            values, sizes, other = shingle_sets(texts, hasher, k, second)
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(texts)), sizes)
            full, begin = sizes > 0, ends - sizes
            set_a, set_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            if len(values):
                set_a[full] = mix(np.add.reduceat(mix(values + U64(1)), begin[full])).view(np.int64)
                set_b[full] = mix(np.add.reduceat(mix(other + U64(1)), begin[full])).view(np.int64)
            odd = np.bincount(doc * 64 * PARITY + (values & U64(64 * PARITY - 1)).astype(np.int64), minlength=len(texts) * 64 * PARITY) % 2
            parity = np.packbits(odd.astype(bool), bitorder="little").view("<i8").reshape(-1, PARITY)
            order = np.lexsort((values, often[(values >> U64(64 - BUCKET_BITS)).astype(np.int64)], doc))
            ranked = values[order].view(np.int64)
            length = np.where(full, sizes + (-percent * sizes // 100) + 1, 0)
            prefix = [ranked[b : b + m] for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), table.column("uid_a").combine_chunks(), table.column("uid_b").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(set_a), pa.array(set_b), pa.array(list(parity), pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "uid_a", "uid_b", "n", "set_a", "set_b", "parity", "prefix"])

    return run


def _linked(values: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs link, of sets one after another: all left ones, then all right ones."""
    n = len(sizes) // 2
    pair = np.repeat(np.arange(2 * n) % n, sizes)
    order = np.lexsort((values, pair))
    v, p = values[order], pair[order]
    shared = np.bincount(p[1:][(v[1:] == v[:-1]) & (p[1:] == p[:-1])], minlength=n)
    return 100 * shared >= percent * (sizes[:n] + sizes[n:] - shared)


def _verified(k: int, percent: int):
    """Pairs whose fingerprints say that they link are compared by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3, lower=True)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                for check in (lambda texts: shingle_sets(texts, hasher, k)[:2], lambda texts: exact_shingles(texts, k)):
                    both = [t.encode() for side in ("left_text", "right_text") for t in part.column(side).to_pylist()]
                    part = part.filter(pa.array(_linked(*check(both), percent), pa.bool_()))
                    if not part.num_rows:
                        break
                yield part.select(["left", "right"])

    return run


def _shared(parts: int):
    """Prefix shingles as keys of :func:`packed.pack`: the class is the text, the place in the prefix the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 8192):
                part = batch.slice(begin, 8192)
                lists = part.column("prefix")
                size = np.asarray(pa.compute.list_value_length(lists), np.int64)
                token = np.asarray(lists.flatten()).view(np.uint64)
                doc = np.repeat(np.arange(part.num_rows, dtype=np.int32), size)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                yield from pack(token, None, doc, place, np.zeros(len(token), bool), part.column("set_a").to_numpy(), part.column("set_b").to_numpy(), parts, KEY_BYTES, False)

    return run


PREFIX = "set_a bigint, set_b bigint, n bigint, parity array<bigint>, worth double, at bigint, token bigint"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2048):
            part = batch.slice(begin, 2048)
            at = [places_of(h) for h in part.column("hits").to_pylist()]
            row = np.repeat(np.arange(part.num_rows), [len(x) for x in at])
            lists = part.column("prefix")
            base = np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()
            at = np.concatenate(at)
            token = np.asarray(lists.flatten())[base[row] + at]
            worth = np.bincount(row, minlength=part.num_rows) / part.column("n").to_numpy()
            rest = part.select(["set_a", "set_b", "n", "parity"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(worth[row]), pa.array(at), pa.array(token)], names=["set_a", "set_b", "n", "parity", "worth", "at", "token"])


def _with_leads(group: DataFrame) -> DataFrame:
    """``group`` with ``leads``: the least shingles that the class has in it."""
    leads = group.groupBy("set").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LEADS).alias("leads"))
    return group.join(leads, "set")


def _pairs(group: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """``left, right`` (sorted) of classes that share a shingle, are in different components and pass the three filters.

    With ``leads`` on both sides, a pair that has leads in common is made at the least of them alone. With ``main`` (of the
    shingle), ``group`` holds the classes of other components and each of its pairs is made once.
    """
    led = "leads" in other.columns
    other = other.select(F.col("token").alias("o_token"), *[F.col(c).alias(f"o_{c}") for c in ("set", "n", "at", "parity", "part", *["leads"] * led)])
    n, m, i, j = (F.col(x) for x in ("n", "o_n", "at", "o_at"))
    total = n + m
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    apart = sum((F.bit_count(F.col("parity")[w].bitwiseXOR(F.col("o_parity")[w])) for w in range(PARITY)), F.lit(0))
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * total) & ((100 + percent) * (total - apart) >= 2 * percent * total)
    if "main" in group.columns:
        fits &= (F.col("o_part") == F.col("main")) | (F.col("set") < F.col("o_set"))
    if led:
        fits &= F.coalesce(F.get(F.array_intersect("leads", "o_leads"), 0), F.col("token")) == F.col("token")
    both = group.join(other, (F.col("token") == F.col("o_token")) & (F.col("part") != F.col("o_part")) & fits)
    return both.select(F.least("set", "o_set").alias("left"), F.greatest("set", "o_set").alias("right")).distinct()


def _needed(texts: DataFrame, uids: DataFrame) -> DataFrame:
    """``uid, text`` of the rows of ``texts`` that ``uids`` (``uid``) names, each once, and of few others.

    Which rows may be named is told by bitmaps that are broadcast (a byte a name, ``MOST_BITMAPS`` of 4 KB at most), so that texts that no pair asks for aren't shuffled.
    """
    maps = max(1, min(-(-uids.count() // BITMAP_BYTES), MOST_BITMAPS))
    at = lambda c: (F.pmod(F.shiftright(c, 15), F.lit(maps)).alias("_map"), c.bitwiseAND(8 * BITMAP_BYTES - 1).alias("_bit"))
    held = uids.select(*at(F.col("uid.uid_a"))).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_held"))
    byte = F.conv(F.hex(F.substring("_held", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = texts.select(F.struct("uid_a", "uid_b").alias("uid"), "text", *at(F.col("uid_a"))).join(F.broadcast(held), "_map")
    return rows.filter(F.getbit(byte, F.col("_bit").bitwiseAND(7).cast("int")) == 1).select("uid", "text").dropDuplicates(["uid"])


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, verified on the whole sets. Only the texts of pairs are moved."""
    side = lambda name: reps.select(F.col("set").alias(name), F.col("uid").alias(f"{name}_uid"))
    named = materialize(pairs.join(side("left"), "left").join(side("right"), "right"))
    pool = materialize(_needed(texts, named.select(F.explode(F.array("left_uid", "right_uid")).alias("uid")).distinct()))
    text = lambda name: pool.select(F.col("uid").alias(f"{name}_uid"), F.col("text").alias(f"{name}_text"))
    rows = named.join(text("left"), "left_uid").join(text("right"), "right_uid").select("left", "right", "left_text", "right_text")
    links = materialize(rows.mapInArrow(_verified(k, percent), pairs.schema))
    release(named, pool)
    return links


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    ``members``: a row per row of ``docs`` (``doc_id``, ``text``) with ``doc_id, n_shingles, component_id``: the least
    ``doc_id`` that links reach, itself included; and ``uid_a, uid_b, component``, names of the row and its component
    that are never null (an empty set has a null component). ``links``: ``left_id, right_id`` of classes of equal sets that link
    (the least ids of the classes; copies aren't expanded). Texts that are null or without a word have an empty set and
    link with nothing. Ids that are null rank below others and give way to any id; repeated rows are copies. An empty
    table gives empty results.
    """
    spark = docs.sparkSession
    texts = with_uid(docs.select("doc_id", "text"))
    blocks = (1 << BUCKET_BITS) // BLOCK
    counted = sum_blocks(docs.select("text").coalesce(partitions(spark)).mapInArrow(_frequencies(shingle), "block int, data binary"), "<i8", blocks)
    frequency = spark.sparkContext.broadcast(collect_blocks(counted, "<i8", blocks, BLOCK))
    every = materialize(texts.mapInArrow(_members(shingle, percent, frequency), MEMBERS)).withColumn("set", F.struct("set_a", "set_b"))
    sets = every.filter("n > 0")
    first = sets.groupBy("set").agg(F.min(F.struct("uid_a", "uid_b")).alias("uid"), F.min("doc_id").alias("least_id"))
    reps = materialize(sets.withColumn("uid", F.struct("uid_a", "uid_b")).join(first, ["set", "uid"]).select("set", "set_a", "set_b", "uid", "n", "parity", "prefix", "least_id").dropDuplicates(["set"]))

    parts = key_partitions(docs)
    hits = match(reps.select("set_a", "set_b", "prefix").mapInArrow(_shared(parts), PACKED), parts, width=KEY_BYTES)
    hits = hits.groupBy("hit_a", "hit_b").agg(F.collect_list("hits").alias("hits"))
    some = reps.select("set_a", "set_b", "n", "parity", "prefix").join(hits, (F.col("set_a") == F.col("hit_a")) & (F.col("set_b") == F.col("hit_b")))
    held = materialize(some.select("set_a", "set_b", "n", "parity", "prefix", "hits").mapInArrow(_kept, PREFIX))
    group = held.withColumn("set", F.struct("set_a", "set_b")).drop("set_a", "set_b").withColumn("part", F.col("set"))

    links = asked = group.select(F.col("set").alias("left"), F.col("set").alias("right")).limit(0)
    for step in range(ROUNDS + 1):
        last = step == ROUNDS
        choice = F.struct((-F.col("worth")).alias("w"), F.xxhash64(F.lit(step), "set").alias("h"), "set", "n", "at", "parity", "part")
        split = group.groupBy("token").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.min(choice).alias("one")).filter("_low < _high")
        main = split.select("token", F.col("one.part").alias("main"))
        before, held = held, materialize((_with_leads(group) if last else group).join(main, "token"))
        one = materialize(split.select("token", "one.set", "one.n", "one.at", "one.parity", "one.part")) if not last else None
        release(before)
        if held.isEmpty():
            break
        pairs = _pairs(held.filter("part <> main"), held, percent) if last else _pairs(held.drop("main"), one, percent)
        pairs = materialize(pairs.join(asked, ["left", "right"], "left_anti") if step else pairs)
        found = _links(pairs, reps, texts, shingle, percent)
        asked, links = asked.union(pairs), links.union(found)
        if not last:
            release(one)
            part = connected_components(links, "left", "right").withColumnRenamed("component", "_component")
            before, held = held, materialize(held.drop("main").join(part, F.col("set") == F.col("id"), "left").withColumn("part", F.coalesce("_component", "part")).drop("id", "_component"))
            release(before)
            group = held
    release(held)

    part = connected_components(links, "left", "right")
    ids = reps.select("set", "least_id")
    named = ids.join(part, F.col("set") == F.col("id"), "left").select("set", "least_id", F.coalesce("component", "set").alias("component"))
    least = materialize(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = materialize(named.join(least, "component").select("set", "component_id", "component"))
    full = lookup(sets.select("doc_id", "n", "set", "uid_a", "uid_b"), named, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "uid_a", "uid_b", "component")
    empty = every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "uid_a", "uid_b", F.lit(None).cast(full.schema["component"].dataType).alias("component"))
    name = lambda side: ids.select(F.col("set").alias(side), F.col("least_id").alias(f"{side}_id"))
    return full.unionByName(empty), links.join(name("left"), "left").join(name("right"), "right").select("left_id", "right_id")


def near_dedup(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least ``doc_id`` (nulls last) stays.

    All columns are kept. Texts without words stay, but for rows that repeat both id and text: one of them stays.
    """
    members = near_duplicates(docs, shingle=shingle, percent=percent)[0]
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "uid_a", "uid_b")
    first = members.filter("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("row")).select("row.uid_a", "row.uid_b")
    stay = first.unionByName(members.filter("component IS NULL").select("uid_a", "uid_b").distinct())
    rows = with_uid(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    return rows.join(materialize(stay), ["uid_a", "uid_b"], "left_semi").dropDuplicates(["uid_a", "uid_b"]).select("_row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))[0].select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i+3], ' ')) AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
x AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS shared
  FROM (SELECT * FROM s WHERE k IN (SELECT k FROM rare)) AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT p, q FROM x JOIN c AS m ON m.doc_id = p JOIN c AS n ON n.doc_id = q WHERE 100 * shared >= 85 * (m.n + n.n - shared)),
both_ways AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, both_ways.q FROM reach JOIN both_ways ON reach.b = both_ways.p)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN c ON w.doc_id = c.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS r ON r.a = w.doc_id
"""
