"""The linking queries over all years of a table, against brute force."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tidemark import queries as q
from tidemark.operators import filters
from tidemark.sources import views

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def pool(spark):
    rows = filters.accepted_pool(views.incidents(spark, SF)).collect()
    assert min(r.event_time.year for r in rows) == 1995
    return {r.incident_id: r for r in rows}


@pytest.fixture(scope="module")
def pairs(pool):
    """``(low, high): (shared, gap, link)`` by comparing every incident with every other one."""
    found = {}
    for x, y in combinations(sorted(pool), 2):
        a, b = pool[x], pool[y]
        gap = abs(int((a.event_time - b.event_time).total_seconds()))
        types = a.incident_type == b.incident_type and a.incident_type not in ("unresolved", "other", "unknown")
        shared = types + sum(getattr(a, c) == getattr(b, c) is not None for c in ("category", "taluk", "person"))
        if gap <= 7 * 86400 and shared and a.record_id != b.record_id:
            found[x, y] = shared, gap, "LNK-" + sha(f"{x}|{y}")
    ends = defaultdict(list)
    for pair, (shared, gap, link) in found.items():
        for end in pair:
            ends[end].append((-shared, gap, link, pair))
    best = {pair for own in ends.values() for *_, pair in sorted(own)[:5]}
    return {pair: found[pair] for pair in best}


@pytest.fixture(scope="module")
def events(pool, pairs):
    root = {x: x for x in pool}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, y), (shared, *_) in pairs.items():
        if shared >= 2 and pool[x].taluk == pool[y].taluk:
            low, high = sorted((top(x), top(y)))
            root[high] = low
    members = defaultdict(list)
    for x in sorted(pool):
        members[top(x)].append(x)
    return members


def test_candidate_pairs_of_all_years(spark, pool, pairs):
    got = {(r.low_id, r.high_id): (r.shared, r.gap_seconds, r.link_id) for r in q.candidate_pairs(spark, SF).collect()}
    assert got == pairs
    assert {pool[low].event_time.year for low, _ in got} == set(range(1995, 2002))


def test_conflicts_of_all_years(spark, pool, pairs):
    def words(a, b):
        kinds = a.incident_type != b.incident_type and "unresolved" not in (a.incident_type, b.incident_type)
        tests = {"day": a.event_time.date() != b.event_time.date(), "place": a.taluk != b.taluk, "type": kinds}
        return "|".join(w for w, holds in tests.items() if holds)

    want = {link: words(pool[x], pool[y]) for (x, y), (*_, link) in pairs.items()}
    assert {r.link_id: r.conflicts for r in q.pair_conflicts(spark, SF).collect()} == want


def test_events_of_all_years(spark, pool, events):
    got = Counter(map(tuple, q.event_components(spark, SF).select("incident_id", "root", "event_id", "size", "review").collect()))
    assert got == Counter((x, root, "EVT-" + sha("|".join(own)), len(own), "accepted") for root, own in events.items() for x in own)
    assert len(pool) == sum(got.values())
    text = lambda own, c: "|".join(sorted({getattr(pool[x], c) for x in own} - {None}))
    units = {("EVT-" + sha("|".join(own)), min(pool[x].event_time.date() for x in own), len(own), text(own, "category"), text(own, "taluk")) for own in events.values()}
    assert {tuple(r) for r in q.event_units(spark, SF).select("event_id", "day", "incidents", "categories", "taluks").collect()} == units
