"""Operators on pairs and passages, against brute force."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from moraine.llm import bpe, common, components, decontaminate, line_dedup, mpeg_audio, simhash, suffix_dedup, toxicity


def closure(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 5), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(spark, df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 5}
    assert components.connected_components(spark, df.limit(0)).count() == 0


def fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, rows, nothing):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    fps = [fingerprint(t) for _, t, *_ in rows]
    roots = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert got == sorted(((i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(rows, fps, roots)), key=str)
    assert simhash.near_duplicates(spark, nothing).count() == 0


def test_keep_one(spark, docs, rows):
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, docs).collect() if r.doc_id is not None}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(set(ids)) == sorted({c for c in found.values()})


def test_keep_one_tells_rows_of_one_id_apart(spark, docs, rows):
    def texts(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    fps = [fingerprint(t) for _, t, *_ in rows]
    roots = closure(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    groups = {r: {(i is None, i or 0) for (i, *_), q in zip(rows, roots) if q == r} for r in roots}
    got = texts(simhash.keep_one(spark, docs))
    of = {(i, t): r for (i, t, *_), r in zip(rows, roots)}
    assert sorted(of[g] for g in got) == sorted(groups)
    assert all((i is None, i or 0) == min(groups[of[i, t]]) for i, t in got)

    clashing = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("spare_id", "row", "row of the id", "digest", "least", "n", "kept", "root")))
    assert sorted(of[r.doc_id, r.text] for r in simhash.keep_one(spark, clashing).collect()) == sorted(groups)

    base, other, third = (" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma"))
    some = [(1, base), (5, base), (5, other), (None, base), (None, third), (None, third), (7, other), (8, "x"), (8, "x")]
    got = texts(simhash.keep_one(spark, spark.createDataFrame(some, "doc_id long, text string")))
    assert got == sorted([(1, base), (5, other), (None, third), (8, "x")], key=str)


def test_vantage_trees_find_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres, *[centres ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3, 40)).astype(np.uint64)) for _ in range(50)], rng.integers(0, 2**63, 2000, dtype=np.uint64)]))
    a, b = simhash.shard_links(fps, fps[:0])
    mine = {int(x): int(y) for x, y in zip(a, b)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    roots = closure(len(fps), lambda i, j: bool(near[i, j]))
    groups = {}
    for f, r in zip(fps.tolist(), roots):
        groups.setdefault(r, set()).add(f)
    got = {}
    for f in fps.tolist():
        got.setdefault(mine.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("limit", [simhash.SHARD_LIMIT, 40])
def test_regions_and_their_visitors_find_all_pairs(spark, monkeypatch, limit):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "SHARD_AIM", 4)
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)  # beyond it members and visitors are dealt in parts
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for flips in (1, 2, 3, 4):
        fps = np.append(fps, [f ^ np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, flips, replace=False).astype(np.uint64)) for f in fps[:150]])
    fps = np.unique(np.append(fps, rng.integers(0, 2**63, 1500, dtype=np.uint64)))
    links = simhash.near_links(spark, spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"))
    got = {r.node: r.component for r in components.connected_components(spark, links).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    roots = closure(len(fps), lambda i, j: bool(near[i, j]))
    groups, mine = {}, {}
    for f, r in zip(fps.view(np.int64).tolist(), roots):
        groups.setdefault(r, set()).add(f)
        mine.setdefault(got.get(f, f), set()).add(f)
    assert len(groups) < len(fps) - 500 and sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_ids_beyond_doubles_stay_whole(spark):
    text = "some words that stand in both of these rows and in no other one at all"
    df = spark.createDataFrame([(2**60 + 1, text), (None, text), (2**60 + 3, None)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (mpeg_audio.media_features(df), mpeg_audio.store_media(df), simhash.near_duplicates(spark, df), bpe.encode_documents(df, bpe.default_path()),
                bpe.encode_digests(df, bpe.default_path()), toxicity.score_documents(df, labels), simhash.keep_one(spark, df.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))))):
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {2**60 + 1, None, 2**60 + 3} and 2**60 + 1 in ids, out.columns
    items = spark.createDataFrame([(2**60 + 5, text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, df, items).collect()} == {(2**60 + 1, 2**60 + 5), (None, 2**60 + 5)}


def test_large_shards_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 7)
    monkeypatch.setattr(simhash, "SHARD_AIM", 10)
    fps = [5 ^ (1 << k) for k in range(40)] + [0x0F0F0F0F0F0F0F0, 0x0F0F0F0F0F0F0F1]
    links = simhash.near_links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = components.connected_components(spark, links).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [2, 40]


def key(text):
    """The name that a text's lines go by: Spark's xxhash64, 42 for null."""
    return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


def brute_lines(occurrences):
    """(doc_id, text_key, line_no) of the lines that another one stands for."""
    texts = sorted({o[3] for o in occurrences})

    def grams(x):
        x = x.lower()
        return {x[k : k + 8] for k in range(len(x) - 7)} or {x}

    sets = [grams(t) for t in texts]
    root = dict(zip(texts, closure(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))))
    first = {}
    for i, k, n, line in occurrences:
        at = (i is not None, i or 0, n, k)
        first[root[line]] = min(first.get(root[line], at), at)
    return {(i, k, n) for i, k, n, line in occurrences if first[root[line]] != (i is not None, i or 0, n, k)}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefghij "), 400))

    def changed(text, n, where):
        out = list(text)
        for k in rng.choice(where, n, replace=False):
            out[k] = "#"
        return "".join(out)

    # near copies of one line, and others that reach them only through a line between
    lines = [changed(base, 1, 400) for _ in range(60)]
    between = changed(base, 3, 60)
    lines += [between, changed(between, 3, range(340, 400)), *(changed(base, 5, 400) for _ in range(30)), *("".join(rng.choice(list("klmno "), 90)) for _ in range(9))]
    docs = spark.createDataFrame([(i, f"{x}\nhead {i}") for i, x in enumerate(lines)], "doc_id long, text string")
    want = brute_lines([(i, key(f"{x}\nhead {i}"), n, y) for i, x in enumerate(lines) for n, y in enumerate((x, f"head {i}"))])
    for limit in (4, 1024):
        monkeypatch.setattr(line_dedup, "BUCKET_LIMIT", limit)
        assert {tuple(r) for r in line_dedup.dropped_lines(spark, docs).collect()} == want


def _shuffled(spark):
    """Bytes that this session's executors have written for shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_lines_without_a_partner_send_their_keys_only(spark):
    rng = np.random.default_rng(10)
    lines = ["".join(rng.choice(list("abcdefghijklmnop "), 40)) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 20])) for i in range(0, len(lines), 20)], "doc_id long, text string")
    before = _shuffled(spark)
    assert line_dedup.dropped_lines(spark, docs).count() == 0
    each = (_shuffled(spark) - before) / len(lines)
    assert each < 195, each


def test_candidates_that_stand_in_many_tasks_send_their_texts_once(spark, monkeypatch):
    """Also when some bucket is large: its lines alone are read again."""
    monkeypatch.setattr(line_dedup, "BUCKET_LIMIT", 16)
    rng = np.random.default_rng(12)
    long = ["".join(rng.choice(list("abcdefghijklmnop "), 4000)) for _ in range(40)]
    short = "".join(rng.choice(list("abcdefghij "), 300))
    lines = [y for x in long for y in (x, x + "changed")] + [f"{short[:k]}#{short[k:]}" for k in range(5, 295, 10)]
    docs = spark.sparkContext.parallelize([(i, "\n".join(lines)) for i in range(64)], 16).toDF("doc_id long, text string")
    before = _shuffled(spark)
    got = line_dedup.dropped_lines(spark, docs).count()
    sent = _shuffled(spark) - before
    assert got == 64 * len(lines) - 41
    assert sent < 2_500_000, sent  # once by digest and once by bucket, 0.32 MB each, and the keys


def test_lines_keep_clashing_columns_and_texts_of_one_id(spark):
    line = "a line of some length that stands in two texts, word for word"
    rows = [(2**60 + 1, f"{line}\nfirst", 1, "a", "b", "c", "d", "e", "f"), (None, f"{line}\nsecond", 2, "a", "b", "c", "d", "e", "f"), (None, f"{line}\nthird", 3, "a", "b", "c", "d", "e", "f"),
            (7, None, 4, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped int, dropped_id string, rest string, of string, text_key string, line string, part string").coalesce(1)
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == docs.columns
    got = {r.dropped: (r.doc_id, r.text) for r in out.collect()}
    keeper = min((2, 3), key=lambda d: key(rows[d - 1][1]))
    assert got[1] == (2**60 + 1, "first") and got[4] == (7, None)
    assert {d: got[d][1] for d in (2, 3)} == {d: rows[d - 1][1] if d == keeper else rows[d - 1][1].split("\n")[1] for d in (2, 3)}


def test_lines_of_the_query(spark, tmp_path):
    line = "a line of some length that stands in two texts, word for word"
    rows = [(1, f"{line}\n\nx"), (2, f"y\n{line}\n{line}"), (3, None), (4, ""), (4, ""), (None, line)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 3, 1, [0]), (2, 3, 2, [1, 2]), (3, 0, 0, []), (4, 1, 0, []), (4, 1, 0, []), (None, 1, 0, [])], key=str)


def test_bands_find_the_pairs_of_real_lines(spark):
    """Measured recall of the bands over every pair of lines at 0.8 in a table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    lines = sorted({x for (t,) in rows for _, x in line_dedup._lines_of(t)})
    sets = line_dedup.line_sets(lines)
    where = {}
    for k, s in enumerate(sets):
        for x in s.tolist():
            where.setdefault(x, []).append(k)
    pairs = set()
    for k, s in enumerate(sets):
        near = Counter(j for x in s.tolist() for j in where[x] if j < k)
        pairs |= {(j, k) for j, c in near.items() if c >= 0.8 * (len(s) + len(sets[j]) - c)}
    bands = line_dedup.band_keys(lines)
    found = sum(bool((bands[j] == bands[k]).any()) for j, k in pairs)
    assert len(pairs) > 50 and found >= 0.97 * len(pairs), (found, len(pairs))


def test_lines(spark, docs, rows, nothing):
    occurrences = [(i, key(t), n, line) for i, t, *_ in rows for n, line in enumerate((t or "").split("\n")) if line.strip()]
    got = {(r.doc_id, r.text_key, r.line_no) for r in line_dedup.dropped_lines(spark, docs).collect()}
    assert got == brute_lines(occurrences)
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id == 11}
    assert kept == {11: "line one here it is\nline two\n\nx"}
    assert out.where("doc_id = 2").count() == 0 and out.where("doc_id in (4, 5, 6)").count() == 3
    assert line_dedup.dedup_lines(spark, nothing).count() == 0


def brute_repeats(rows, span=50):
    out = []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    seen = {}
    for i, t in order:
        x = (t or "").encode()
        for p in range(len(x) - span + 1):
            seen[x[p : p + span]] = min(seen.get(x[p : p + span], i), i)
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - span + 1):
            if i is not None and seen[x[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(x, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, docs, rows, nothing):
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark, docs).collect()), key=str)
    assert got == brute_repeats([r[:2] for r in rows])
    assert suffix_dedup.remove_repeats(spark, nothing).count() == 0


def test_heavy_anchors_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    phrase = "this notice may be copied by anyone who keeps it"  # shorter than SPAN, longer than CORE
    rows = [(i, f"{rng.bytes(30).hex()} {phrase}{'.;!'[i % 3]} {'-' * 70} {rng.bytes(20 + i % 3).hex()}") for i in range(60)]
    rows += [(i, f"{'same ' * 9} {phrase}. {'-' * 80} the end of what stands in many") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(spark, docs).collect()), key=str) == want
    monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", 2)
    for part in (16, 10**9):
        monkeypatch.setattr(suffix_dedup, "HEAVY_PART", part)
        met = suffix_dedup.shared_anchors(docs, 8)
        assert met.where("anchor is not null").count() > 0
        assert sorted(map(tuple, suffix_dedup.remove_repeats(spark, docs).collect()), key=str) == want


def test_superseded_tables_are_removed(spark, docs):
    first = common.materialize(spark, docs, "first")
    path = first.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.discard(spark, first)
    assert not os.path.exists(path)


def test_suffix_sort_orders_deep_groups():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(0, 2, 400, dtype=np.uint8), np.zeros(200, np.uint8), rng.integers(0, 2, 400, dtype=np.uint8)])
    data = np.concatenate([data, data[100:300]])
    starts = np.arange(len(data) - suffix_dedup.SPAN + 1)
    order, run = suffix_dedup.sort_suffixes(data, starts)
    strings = [data[s : s + suffix_dedup.SPAN].tobytes() for s in starts]
    assert [strings[k] for k in order] == sorted(strings)
    for a in range(1, len(order)):
        assert (run[a] == run[a - 1]) == (strings[order[a]] == strings[order[a - 1]])


def test_leaks(spark, nothing, monkeypatch):
    items = spark.createDataFrame(
        [(1, "If Anna buys 12 apples and Bob buys 7 apples, how many apples do they have after 3 days?", 1.0),
         (2, "Short one here", 1.0), (3, None, 1.0), (4, "", 1.0), (5, "The boiling point of water at sea level is given in which unit of heat?", 1.0)],
        "item_id long, text string, share double",
    )
    docs = spark.createDataFrame(
        [(1, "so: If Carl buys 15 apples and Dora buys 9 apples, how many apples do they have after 4 days? ok"),
         (2, "IF ANNA BUYS 12 APPLES AND BOB BUYS 7 APPLES, HOW MANY APPLES DO THEY HAVE AFTER 3 DAYS?"),
         (3, "they have short one here indeed"), (4, None), (5, ""), (6, "12 7 3 12 7 3"), (7, "The boiling point of water is not given"),
         (1, "so: If Carl buys 15 apples and Dora buys 9 apples, how many apples do they have after 4 days? ok"), (None, "short one here")],
        "doc_id long, text string",
    )
    for rows in (decontaminate.BROADCAST_ROWS, 1):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        got = decontaminate.leaks(spark, docs, items)
        assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 2), (None, 2)], key=str)
        assert sorted(r.doc_id for r in decontaminate.keep_clean(spark, docs, items).collect()) == [4, 5, 6, 7]
    assert decontaminate.leaks(spark, nothing, items).count() == 0
    assert decontaminate.leaks(spark, docs, items.limit(0)).count() == 0


def test_typographic_marks_stand_between_words(spark):
    item = 'He said "Anna has 12 apples" - and then, after 3 days, she gave them all to the old man.'
    texts = ["He said “Anna has 12\u00a0apples” — and then, after 3\u202fdays, she gave them all to the old man…", "He said «Carl has 5 apples» – and then, after 9 days, she gave them all to the old man.",
             "Er sagte „anna has 12 apples‟ and\u200bthen nothing of the kind was ever heard of again in the old town"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.share for r in decontaminate.leaks(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: 1.0, 1: 1.0}
    words = decontaminate.tokens_of(["naïve “café”—3€ ½ 東京、大阪"])
    assert [words.filler(k) for k in range(len(words.start))] == ["naïve", "café", "3", "½", "東京", "大阪"]


def shares_of(spark, item, texts):
    """The share of one item's windows that each text holds, as a count of its ``n`` windows."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(item.split()) - 4
    got = decontaminate.leaks(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.01)
    found = {r.doc_id: round(r.share * n) for r in got.collect()}
    return [found.get(k, 0) for k in range(len(texts))]


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 12 away from 40 and then take 12 away from 9 again please"
    texts = ["take 5 away from 70 and then take 5 away from 3 again please", "take 5 away from 70 and then take 6 away from 3 again please"]
    whole, torn = shares_of(spark, item, texts)
    assert whole == 10 and torn < 0.8 * 10
    # Anna would stand for two names
    names = "at noon Anna met old friends and later Bob met them too"
    kept, renamed, merged, one = shares_of(spark, names, [names, names.replace("Anna", "Carl").replace("Bob", "Dora"), names.replace("Bob", "Anna"), names.replace("Anna", "Carl").replace("Bob", "Carl")])
    assert (kept, renamed) == (8, 8) and merged < 0.8 * 8 and one < 0.8 * 8


def test_conflicting_slots_leave_out_their_windows_only(spark):
    words = [f"word{k}" for k in range(80)]
    words[10] = words[60] = "12"
    words[30] = "9"
    changes = [{}, {10: "13", 60: "13", 30: "4"}, {60: "13"}, {10: "13", 60: "14"}, {10: "7", 30: "7"}]
    # 12 stands against 12 and 13 in the third: the windows of the changed one go
    assert shares_of(spark, " ".join(words), [" ".join(c.get(k, w) for k, w in enumerate(words)) for c in changes]) == [76, 76, 71, 66, 66]
    words[10] = words[60] = "The"
    renamed = [*words]
    renamed[10], renamed[60] = "Every", "Some"
    assert shares_of(spark, " ".join(words), [" ".join(renamed)]) == [66]


def brute_share(text, item):
    """Share of the item's windows that a text holds, by the definition, over every diagonal."""
    units = set(decontaminate.UNITS)

    def tokens(x):
        out = []
        for m in re.finditer("[0-9A-Za-z]+", x):
            w = m.group()
            if w[0].isdigit():
                if out and out[-1][0] == "#":
                    out[-1] = ("#", "#", x[out[-1][3] : m.end()].lower(), out[-1][3])
                else:
                    out.append(("#", "#", w.lower(), m.start()))
                continue
            number = out and out[-1][0] == "#"
            kind = "unit" if number and w.lower() in units else w.lower()
            name = "name" if w[0].isupper() and not w[1:2].isupper() and kind != "unit" and sum(c.isupper() for c in w) == 1 else kind
            out.append((kind, name, w.lower(), m.start()))
        return out

    a, b = tokens(item), tokens(text)
    size = min(5, len(a))
    if not size:
        return 0.0
    good = set()
    for d in range(1 - len(a), len(b)):
        js = [j for j in range(len(a) - size + 1) if 0 <= j + d <= len(b) - size and any([t[c] for t in a[j : j + size]] == [t[c] for t in b[j + d : j + d + size]] for c in (0, 1))]
        places = sorted({j + k for j in js for k in range(size)})
        pairs = {t: (a[t][2], b[t + d][2]) for t in places if a[t][0] in ("#", "unit") or a[t][1] == "name" or a[t][2] != b[t + d][2]}
        ok, left, right = set(), set(), set()
        for n in sorted(set(Counter(pairs.values()).values()), reverse=True):
            tier = [p for p, k in Counter(pairs.values()).items() if k == n and p[0] not in left and p[1] not in right]
            sole = [p for p in tier if sum(q[0] == p[0] for q in tier) == 1 == sum(q[1] == p[1] for q in tier)]
            ok.update(sole)
            left.update(p[0] for p in sole)
            right.update(p[1] for p in sole)
        bad = {t for t, p in pairs.items() if p[0] != p[1] and p not in ok}
        good |= {j for j in js if not bad & set(range(j, j + size))}
    return len(good) / (len(a) - size + 1)


def test_leaks_equal_the_definition(spark):
    rng = np.random.default_rng(11)
    pool = ["the", "of", "Anna", "Bob", "Carl", "buys", "12", "7", "40", "km", "hours", "is", "and", "How", "many", "apples", "3"]
    draw = lambda n: [str(w) for w in rng.choice(pool, n)]
    items = [(k, " ".join(draw(rng.integers(2, 16)))) for k in range(25)]
    docs = []
    for k in range(160):
        words = draw(rng.integers(0, 30))
        if k % 2:
            part = items[int(rng.integers(len(items)))][1].split()
            swap = {a: b for a, b in zip(["Anna", "Bob", "12", "7"], rng.permutation(["Dora", "Emil", "55", "8"]).tolist() if k % 4 == 1 else ["Carl", "Anna", "7", "3"])}
            words += [swap.get(w, w) for w in part] + draw(3)
        docs.append((k, " ".join(words)))
    want = {(d, i): s for d, t in docs for i, x in items if (s := brute_share(t, x)) >= 0.8}
    got = decontaminate.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id): round(r.share, 9) for r in got} == {k: round(s, 9) for k, s in want.items()}


def test_leaks_awkward(spark, docs, rows, nothing):
    items = spark.createDataFrame([(2**60 + 1, rows[7][1], 1), (None, "another text of the same id", 2), (3, None, 3), (4, rows[9][1], 4)], "item_id long, text string, row int")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, items).collect()), key=str)
    assert got == sorted([(8, 2**60 + 1), (10, 4), (10, 4), (10, None)], key=str)
    clean = decontaminate.keep_clean(spark, docs.withColumnRenamed("source", "row").withColumnRenamed("lang", "doc"), items)
    assert clean.count() == docs.count() - 4 and {"row", "doc"} <= set(clean.columns)
    assert decontaminate.keep_clean(spark, nothing, items).count() == 0
    assert decontaminate.keep_clean(spark, docs, items.limit(0)).count() == docs.count()
