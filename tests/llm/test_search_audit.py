"""Ranked search and the divergence audit against DuckDB's plain versions, and their parts against loops."""

import random

import duckdb
import numpy as np
import pytest

from moraine.llm import divergence, ranked_search
from moraine.llm.divergence import Trie, probability

WORDS = ["ice", "lake", "moraine", "dam", "flood", "river", "valley", "ñandú", "straße", "東京", "a1", "x"]


def _told(sql: str, **tables) -> list[tuple]:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=str)


def _rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def _drawn(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) * rng.choice([1, 1, 1, 2]) for _ in range(n)).title()


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(21)
    rows = [(i, _drawn(rng, rng.randrange(0, 40)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ö", "", None])) for i in range(600)]
    rows += [(i, "ice lake flood", "en", "hot") for i in range(600, 900)] + [(600, "ice lake flood", "en", "hot")] * 3
    rows += [(None, "moraine dam", None, None), (901, None, "en", "quiet"), (902, "", "xx", "only"), (903, "one two", "xx", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(22)
    rows = [(i, _drawn(rng, rng.randrange(1, 15))) for i in range(40)]
    rows += [(None, "ice dam"), (7, "ice ICE, ice"), (7, "ice ICE, ice"), (8, None), (9, ""), (10, "nowhere found"), (11, "?!")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("top", [1, 3, 20, 2000])
def test_search_equals_scoring_everything(spark, many, items, top):
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(spark, many, items, top).collect()]
    assert sorted(got, key=str) == _told(ranked_search.oracle(top), documents=many, benchmark=items)


def test_search_without_broadcasts(spark, many, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "SENT_TERMS", 0)
    monkeypatch.setattr(ranked_search, "SENT_LISTS", 0)
    monkeypatch.setattr(ranked_search, "SENT_ROWS", 0)
    assert _rows(ranked_search.search(spark, many, items, 5)) == _told(ranked_search.oracle(5), documents=many, benchmark=items)


def test_search_of_awkward_tables(spark, docs, nothing):
    items = docs.selectExpr("doc_id as item_id", "text", "lang", "score", "lang as term", "n_chars as n")
    assert _rows(ranked_search.search(spark, docs, items)) == _told(ranked_search.oracle(), documents=docs, benchmark=items)
    assert ranked_search.search(spark, nothing, items).count() == 0
    assert ranked_search.search(spark, docs, items.limit(0)).count() == 0


def test_the_thresholds_leave_lists_unread(spark, many, items):
    """A full index has every term; the best of each block comes first."""
    n, length = ranked_search.collection(many)
    full = ranked_search.index(many, n, length)
    want = {w.decode() for r in many.collect() for w in ranked_search.terms_of(r.text)} - {""}
    assert {r.term for r in full.select("term").distinct().collect()} == want


@pytest.mark.parametrize(("least", "top"), [(1, 3), (5, 50), (30, 50), (10_000, 50)])
def test_audit_equals_counting_everything(spark, many, least, top):
    assert _rows(divergence.audit(spark, many, least, top)) == _told(divergence.oracle(least, top), documents=many)


def test_audit_in_small_tries_and_blocks(spark, many, monkeypatch):
    want = _told(divergence.oracle(2, 4), documents=many)
    for name, value in (("LEAVES", 10), ("RUN", 500), ("COUNTED", 20), ("BLOCK", 3), ("CELLS", 8)):
        monkeypatch.setattr(divergence, name, value)
    assert _rows(divergence.audit(spark, many, 2, 4)) == want


def test_audit_of_awkward_tables(spark, docs, nothing):
    clashing = docs.withColumn("part", docs.lang).withColumn("term", docs.lang).withColumn("block", docs.shard)
    assert _rows(divergence.audit(spark, clashing, 1)) == _told(divergence.oracle(1), documents=clashing)
    assert divergence.audit(spark, nothing).count() == 0


def test_tries_merge_and_walk_in_order():
    rng = random.Random(23)
    one, two, want = Trie(), Trie(), {}
    for _ in range(3000):
        term = "".join(rng.choice("abñ東😀") for _ in range(rng.randrange(1, 7))).encode()
        source, n = rng.choice("xyz"), rng.randrange(1, 4)
        rng.choice([one, two]).add(term, 1, {source: n})
        docs, counts = want.setdefault(term, (0, {}))
        counts[source] = counts.get(source, 0) + n
        want[term] = (docs + 1, counts)
    one.merge(two)
    assert [(t, d, c) for t, d, c in one.walk()] == [(t, *want[t]) for t in sorted(want)]
    assert len(one.known) == len(want)


def test_tries_branch_where_containers_are_large(monkeypatch):
    """Terms that end inside others' edges, zero bytes and long shared beginnings, in containers of any size."""
    rng = random.Random(25)
    terms = {b"p" * 300 + bytes(rng.choice(b"\x00ab\xf0") for _ in range(rng.randrange(9))) for _ in range(900)} | {b"p" * k for k in range(0, 300, 7)}
    for burst in (1, 3, 1024):
        monkeypatch.setattr(divergence, "BURST", burst)
        trie = Trie()
        for term in terms:
            trie.add(term, 1, {"x": 2})
        assert list(trie.walk()) == [(t, 1, {"x": 2}) for t in sorted(terms)]


def test_tries_are_sent_on_when_their_counts_are_many(spark, monkeypatch):
    """One term of many sources is bounded like many terms are."""
    monkeypatch.setattr(divergence, "RUN", 1)
    monkeypatch.setattr(divergence, "COUNTED", 10)
    docs = spark.createDataFrame([("ice ice", "en", f"source {k}") for k in range(100)], "text string, lang string, source string").coalesce(1)
    leaves = [(len(r.sources), sum(r.counts)) for r in divergence.partial_leaves(docs).collect()]
    assert sum(n for n, _ in leaves) == 100 and sum(n for _, n in leaves) == 200
    assert max(n for n, _ in leaves) <= 11


def test_probability_is_exact_where_products_overflow():
    rng = random.Random(24)
    for _ in range(500):
        whole, terms = rng.randrange(10**15), rng.randrange(1, 10**9)
        count = rng.randrange(whole + 1)
        assert int(probability(np.array([count]), np.array([whole]), terms)[0]) == 1 + 10**9 * (count + 5) // (whole + 5 * terms)
