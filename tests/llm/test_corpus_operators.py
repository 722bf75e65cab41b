"""Sharding, mixing, packing, classifiers, rules, licences and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import best_fit, licences, mixing, quality_classifier, quality_rules, registry, sharding

SF = "/root/testdata/sf0.001"


def odd_docs(spark):
    rows = [(1, "a b", "s"), (2, None, "s"), (None, "", None), (None, "", None), (3, "long word " * 3000, "t"), (3, "long word " * 3000, "t"), (4, "x", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_hypergeometric_and_matrix():
    rng = np.random.default_rng(0)
    draws = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    for k in range(5):
        p = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(draws[k] / 20000 - p) < 0.015
    big = [sharding.hypergeometric(rng, 10**10, 39 * 10**10, 10**8) for _ in range(50)]
    assert abs(np.mean(big) - 2.5e6) < 5 * 1600 / math.sqrt(50) + 1
    m = np.array(sharding.communication_matrix([10, 0, 33, 7], [13, 13, 12, 12], 1))
    assert m.sum(1).tolist() == [10, 0, 33, 7] and m.sum(0).tolist() == [13, 13, 12, 12]


def test_shard(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "'x' AS shard").unionByName(spark.createDataFrame([(None, "y")] * 4, "doc_id long, shard string"))
    out = sharding.shard(docs, key=["doc_id"], shards=40)
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([*range(1003), None, None, None, None], key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and {len(s) for s in slots.values()} == {25, 26}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = [r.shard for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)) if r.doc_id is not None]
    assert abs(np.corrcoef(place, range(1003))[0, 1]) < 0.1
    assert sharding.shard(docs.limit(0), key=["doc_id"]).count() == 0
    assert not any(k in out._jdf.queryExecution().toString() for k in ("ArrowEval", "MapInArrow", "MapInPandas", "BatchEvalPython"))


def test_mix(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "big").when(F.col("id") < 1900, "mid").alias("source"), F.lit(0).alias("slot"))
    weights = {"big": 0.5, "mid": 0.3, None: 0.2}
    rows = mixing.mix(docs, weights=weights, block_rows=4, frame=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2000))
    slot_of = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        slot_of.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in slot_of.values())
    had = Counter()
    for t in range(100 * 4 // 4):  # all sources still have blocks
        had[next(iter(slot_of[t]))[0]] += 1
        assert all(abs(had[s] - w * (t + 1)) < 1 for s, w in weights.items())
    sizes = Counter((r.source, r.block) for r in rows)
    assert all(n == 4 for n in sizes.values())
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"big": 1.0})
    assert mixing.mix(odd_docs(spark)).count() == 7


def test_pfair_deviation():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        shares = mixing.whole_weights({f"s{i}": float(x) for i, x in enumerate(rng.random(n) ** 3 + 1e-4)}, 500)
        assert sum(shares.values()) == 500
        had = Counter()
        for t, (s, _, slot, release, deadline) in enumerate(mixing.pfair_frame(shares)):
            had[s] += 1
            assert slot == t and release <= slot < deadline
            assert all(abs(had[x] - w * (t + 1) / 500) < 1 for x, w in shares.items())


def test_mix_follows_the_weights_asked_for(spark):
    from fractions import Fraction

    def check(weights, rows):
        total = sum(map(Fraction, weights.values()))
        slots = {r.slot: (r.source, r.block) for r in rows}
        assert len(slots) == len({(r.source, r.block) for r in rows}) and all(r.release <= r.slot < r.deadline for r in rows)
        last, had = {}, Counter()
        for slot, (s, _) in slots.items():
            last[s] = max(slot, last.get(s, 0))
        for t in range(min(last.values())):  # all sources still have blocks
            had[slots[t][0]] += 1
            assert slots[t][1] == had[slots[t][0]]
            if t % 97 == 0 or t > 4000:
                assert all(abs(had[s] - Fraction(w) / total * (t + 1)) < 1 for s, w in weights.items())
        return min(last.values())

    weights = {"big": 0.91} | {f"s{i}": 0.01 for i in range(9)}
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id < 4550, 'big', concat('s', id % 9)) AS source")
    assert check(weights, mixing.mix(docs, weights=weights, block_rows=1).collect()) > 4500
    weights = {"big": 0.5} | {f"s{i}": 0.001 for i in range(500)}
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id < 2500, 'big', concat('s', id % 500)) AS source")
    assert check(weights, mixing.mix(docs, weights=weights, block_rows=1).collect()) > 3900
    many = mixing.mix(spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source"), block_rows=1).collect()
    assert sorted(r.slot for r in many) == list(range(3000))


def test_encoder_agrees_with_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    contract = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(contract)
    texts = ["", " ", "a b", " a b", "a  b", "a \n b\n", "\n\n x", "x \n", "x ", "a  b", "<|endoftext|> a", "é è  ", "\t a", " \n", "'s a's 's", "日本 語", "a b \n c \n\n d\n e", "word " * 500]
    want = [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert best_fit.Encoder(best_fit.tokenizer_path(), contract)(texts) == want


def test_pieces_follow_the_contract_for_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|><|endoftext|>  a ", "a <|endoftext b", "plain words", " two  blanks <|endoftext|>"]
    ids = [[*reference.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids[0] == [64, 220, 50256, 275, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in best_fit.token_pieces(docs).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_pack(spark):
    docs = odd_docs(spark).unionByName(spark.range(200).selectExpr("id + 10 AS doc_id", "repeat('ab cd ', CAST(id * 7 % 900 AS int)) AS text", "'u' AS source"))
    pieces = best_fit.token_pieces(docs).cache()
    out = best_fit.pack(pieces).collect()
    assert len(out) == pieces.count()
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(r.length for r in out) / 1024 * 1.02 + 2
    for r in out:
        assert r.length == 1024 or r.piece == 0
    assert best_fit.pack(pieces.limit(0)).count() == 0
    one = next(r for r in out if r.doc_id == 1)
    ids = np.frombuffer(best_fit.Encoder(best_fit.tokenizer_path())(["a b"])[0] + np.array([2], "<u4").tobytes(), "<u4")
    assert one.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and one.length == len(ids)


def test_quality_scores_hold_out(spark):
    from tests.llm.helpers import area_under_curve

    d = SF.replace("0.001", "0.01")
    rows = registry.queries()["op5_quality_classifier"](spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert set(held.doc_id) == {i for i in rows.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert area_under_curve(held.quality, held.score) > 0.93
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()


def test_quality_scores_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "1 AS score", "'x' AS _text")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs, labels).collect()
    assert len(out) == 7 and len({r.score for r in out if r.text in (None, "")}) == 1
    assert quality_classifier.quality_scores(docs, labels.limit(0)).filter("score = 0.5").count() == 7
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_text_counts():
    import re

    rng = np.random.default_rng(1)
    texts = ["", "a b c d e a b c d e f g", "# a #b\n\nx y\nx y\n x y\n\t\n\t\n", "é è ü é è ü é è ü é è ü", "a a a a a a a", "\n\n", *["".join(rng.choice(list("ab \n#!A\té"), size=60)) for _ in range(40)]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "stratum": ["x"] * len(texts), "text": texts})
    for text, row in zip(texts, pa.Table.from_batches(list(quality_rules._counts(iter([batch])))).to_pylist(), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        repeat = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        assert want == tuple(row[c] for c in quality_rules.COUNTS[:5])


def test_binomial_tail_and_levels():
    for n, p in ((50, 0.05), (300, 0.1), (1000, 0.05)):
        for k in (0, 1, 5, 20, 49):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
            assert abs(quality_rules.binomial_tail(k, n, p) - exact) < 1e-9
    assert quality_rules.chosen_level([0, 1, 90, 1], 1000, 0.05, 0.01) == 1
    assert quality_rules.chosen_level([0], 10, 0.05, 0.01) == -1


def test_quality_rules_limit_false_rejections(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    good = [(i, "en", " ".join(word() for _ in range(60))) for i in range(900)]
    bad = [(2000 + i, "en", " ".join(word() + "###" for _ in range(60))) for i in range(100)]
    odd = [(5000, None, None), (5001, "xx", ""), (5002, "xx", " ".join(word() for _ in range(60)))]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, stratum string, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert sum(kept[i] for i, _, _ in good) > 850 and not any(kept[i] for i, _, _ in bad)
    assert not kept[5000] and not kept[5001] and kept[5002]
    assert quality_rules.quality_rules(docs, labels.limit(0)).filter("kept").count() == 1001
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    texts = {"mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
             "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."}
    rows = [(i, mark + ("\n" + mark).join(textwrap.wrap(t, width)), f) for i, (f, t, width, mark) in enumerate((f, t, w, m) for f, t in texts.items() for w in (70, 80) for m in ("", "# "))]
    rows += [(900, "The rights under copyright stay with us;\nno warranty whatever comes with the licence of this thing.", licences.UNKNOWN)]
    plain = [(1000 + i, "the plain words of an old story about a house and a river", "") for i in range(40)]
    docs = spark.createDataFrame(rows + plain, "doc_id long, text string, family string")
    got = {r.doc_id: r.families for r in licences.licence_scan(docs).collect()}
    assert {i: got[i] for i, *_ in rows} == {i: [f] for i, _, f in rows}
    assert not any(got[i] for i, *_ in plain)


def test_licences(spark):
    notices = [(i, f"Some plain text before.\n{t}\nand after it more words", f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    plain = [(1000 + i, t, None) for i, t in enumerate(["The license plate of the car was red.", "word " * 5000, None, ""])]
    other = [(2000, "Licensed under the Foo Public License v9", licences.UNKNOWN), (2001, "filler text " * 4000 + "Released under the MIT License.", "mit")]
    docs = spark.createDataFrame([r[:2] for r in notices + plain + other], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    right = sum(got[i].families == [f] for i, _, f in notices)
    assert right >= 0.9 * len(notices)
    assert all(got[i].families == [] for i, _, _ in plain) and got[2000].families == [licences.UNKNOWN] and "mit" in got[2001].families
    assert licences.licence_scan(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns, name
        texts[name] = out.select("doc_id", "text").toPandas()
        docs = out
    assert texts["exact dedup"].text.is_unique
    near = texts["n-gram Jaccard join"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in near.text)]
    for i in range(len(sets)):
        for j in range(i):
            assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    assert sorted(texts["mixing to target weights"].doc_id) == sorted(near.doc_id)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == set(near.doc_id)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = texts["quality classifier"].doc_id
    assert labels.reindex(kept).dropna().mean() > labels.mean()


def test_registered_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF).toPandas()
        want = connection.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None))), name
