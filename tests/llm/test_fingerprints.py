"""Different texts that simple polynomial hashes can't tell apart, against every operator that compares by fingerprint."""

import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join, substring_dedup, suffix_dedup
from tidemark.llm.suffix_dedup import Substrings
from tidemark.llm.textops import Chunk, Hasher


def thue_morse(size: int, one: str = "a", two: str = "b") -> tuple[str, str]:
    """Two sequences whose polynomial hashes modulo a power of two agree, whatever the base."""
    bits = [0]
    while len(bits) < size:
        bits += [1 - x for x in bits]
    return "".join((one, two)[x] for x in bits), "".join((two, one)[x] for x in bits)


@pytest.mark.parametrize("size", [64, 1024, 4096, 65536])
def test_words_windows_and_ranges_differ(size):
    u, v = (x.encode() for x in thue_morse(size))
    for seed in range(1, 6):
        words = Hasher(seed).words(Chunk([u, v]))
        assert words[0] != words[1]
        x, y = (s.encode() for s in thue_morse(size, "x ", "y "))
        chunk = Chunk([x, y])
        hasher = Hasher(seed)
        words = hasher.words(chunk)
        windows = hasher.windows(words, size)
        assert windows[0] != windows[size]
        at = Substrings(seed).read(np.frombuffer(u + v, np.uint8)).at(np.array([0, size]), size)
        assert at[0] != at[1]


def test_equal_ranges_agree():
    data = np.random.default_rng(0).bytes(500)
    hashes = Substrings(3).read(np.frombuffer(data * 3, np.uint8))
    for size in (1, 32, 200, 499):
        at = hashes.at(np.array([7, 507, 8]), size)
        assert at[0] == at[1] and at[0] != at[2]


@pytest.mark.parametrize("size", [1024, 4096])
def test_operators_tell_long_words_apart(spark, size):
    words = [thue_morse(size, a, b) for a, b in zip("abcdefgh", "ijklmnop", strict=True)]
    one, two = (" ".join(w[i] for w in words * 6) for i in (0, 1))
    rows = [(1, one), (2, two), (3, "other words " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.repeated_words(docs).collect()}
    want = {}
    for doc, text in rows:  # windows of one text repeat within it, never in the other
        split = text.split()
        seen = [tuple(split[i : i + 35]) for i in range(len(split) - 34)]
        want[doc] = len({j for i, w in enumerate(seen) if seen.count(w) > 1 for j in range(i, i + 35)})
    assert removed == want
    members, links = jaccard_join.near_duplicates(docs)
    assert {r.doc_id: r.component_id for r in members.collect()} == {1: 1, 2: 2, 3: 3} and links.count() == 0
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.repeated_bytes(spark.createDataFrame([(1, thue_morse(size)[0]), (2, thue_morse(size)[1])], "doc_id long, text string")).collect()}
    for doc, text in zip((1, 2), thue_morse(size), strict=True):
        every = [t[i : i + 200] for t in thue_morse(size) for i in range(size - 199)]
        gone = np.zeros(size, bool)
        for i in range(size - 199):
            if every.count(text[i : i + 200]) > 1:
                gone[i : i + 200] = True
        assert got[doc] == hashlib.sha256("".join(c for c, g in zip(text, gone, strict=True) if not g).encode()).hexdigest()


def test_exact_shingles():
    rng = np.random.default_rng(1)
    texts = ["", "  ", "A b", "a B c d", "a b c d e", *[" ".join(rng.choice(list("abcé"), size=int(rng.integers(1, 9)))) for _ in range(60)]]
    for k in (1, 2, 4):
        values, sizes = jaccard_join.exact_shingles([t.encode() for t in texts], k)
        sets, at = [], 0
        for n in sizes:
            sets.append(set(values[at : at + n].tolist()))
            at += n
        words = [re.findall(r"\S+", t.lower().replace("É", "é")) for t in texts]
        brute = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
        for i in range(len(texts)):
            assert len(sets[i]) == len(brute[i])
            for j in range(i):
                assert len(sets[i] & sets[j]) == len(brute[i] & brute[j])
