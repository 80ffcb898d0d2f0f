"""SimHash near-duplicates through vantage-point trees on Hamming distance.

Fingerprints that differ in at most ``RADIUS`` of 64 bits differ in at most
``NEAR`` of one of three blocks of bits. For each block a global tree is fitted on
a bounded sample: every level has one vantage point and a radius that halves the
sample, and a fingerprint's region is the path of its distances, inside or outside
at each level. Distances are taken within the block: over all 64 bits most
fingerprints lie within ``RADIUS`` of any boundary, so each would have to visit a
fixed share of all regions.

A fingerprint is a member of its region and is sent as a visitor to the regions
beyond the boundaries that it is within ``NEAR`` of, in one direction of each pair
of regions. A region is searched by a local vantage-point tree over all 64 bits: a
node parts its fingerprints at the median distance, and by the triangle inequality
only those within ``RADIUS`` of the boundary are compared across it. Levels grow
with the count of fingerprints, so regions keep their size and a fingerprint visits
no more than its block has bits. A region beyond ``SHARD_LIMIT`` members is dealt as
parts, so no task holds it whole. Regions return links to a root for each local
component, never all pairs, and links become components by star rounds.

Equal fingerprints are one node, so copies cost one comparison, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import batch_of, discard, materialize, table
from moraine.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
LEAF = 192
SHARD_LIMIT = 8192
#: Members that a region should have on average; trees have more levels beyond.
SHARD_AIM = 512
#: Fingerprints that the trees are fitted on, those of least hash, and vantage points tried a level.
SAMPLE, TRIED = 4096, 48
#: Row digests sent to all tasks at most; beyond, a shuffle join does it.
BROADCAST_IDS = 400_000
#: First bits of the blocks, and the end.
BLOCKS = (0, 21, 42, 64)
#: Levels of a tree at most: regions are then about as many as a block's values.
LEVELS = 20

#: Each byte's bits, a bit a byte lane.
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of every shingle of a text."""
    norm = b" ".join((text or "").encode().lower().split())
    if not norm:
        return []
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < SHINGLE:
        return [digest(norm, SEED)]
    return [digest(norm[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: bits set in over half of a run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    runs = np.cumsum(n) - n
    parts = -(-n // 255)  # lanes of a byte hold up to 255
    first = np.cumsum(parts) - parts
    at = np.repeat(runs, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[(hashes >> np.uint64(8 * byte)).astype(np.uint8)], at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * counts > n[:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[full] |= bits.sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with fp long, the 64-bit fingerprint of every whole text, in the text's place."""
    names = docs.drop("text").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                hashes = [shingle_hashes(t) for t in texts[at : at + 256]]
                sizes = np.array([len(h) for h in hashes], np.int64)
                flat = np.array([x for h in hashes for x in h], np.uint64)
                own = {c: b.column(c).slice(at, len(hashes)) for c in names}
                yield batch_of(**own, fp=pa.array(majority(flat, sizes).view(np.int64)))

    return docs.mapInArrow(run, docs.drop("text").schema.add("fp", "long"))


class _Roots:
    """Components of a region's fingerprints, by place."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, near: np.ndarray, of: np.ndarray, to: np.ndarray) -> None:
        """Join each of ``of`` with those of ``to`` that its row of ``near`` marks."""
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            found = self.label[to[near[row]]]
            own = self.label[of[row]]
            if (found != own).any():
                met = np.unique(np.append(found, own))
                self.label[np.isin(self.label, met)] = met[0]


def _far(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, roots: _Roots, radius: int) -> None:
    """All of ``a`` against all of ``b``, in blocks of rows."""
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        roots.link(np.bitwise_count(fps[rows][:, None] ^ fps[b][None, :]) <= radius, rows, b)


def tree_self(fps: np.ndarray, idx: np.ndarray, roots: _Roots, radius: int = RADIUS) -> None:
    """Link all near pairs within ``idx`` through a vantage-point tree."""
    while len(idx) > LEAF:
        d = _far(fps[idx], fps[idx[0]])
        roots.link((d <= radius)[None, :], idx[:1], idx)  # members of the vantage point's ball
        middle = int(np.median(d))
        inside = d <= middle
        if inside.all():
            inside = d < middle
            middle -= 1
        if not inside.any() or inside.all():
            break
        tree_cross(fps, idx[inside & (d > middle - radius)], idx[~inside & (d <= middle + radius)], roots, radius)
        tree_self(fps, idx[inside], roots, radius)
        idx = idx[~inside]
    _compare(fps, idx, idx, roots, radius)


def tree_cross(fps: np.ndarray, a: np.ndarray, b: np.ndarray, roots: _Roots, radius: int = RADIUS) -> None:
    """Link all near pairs between ``a`` and ``b``, pruning by distances to a vantage point."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= 16 * LEAF * LEAF:
        _compare(fps, a, b, roots, radius)
        return
    point = fps[a[0]] if len(a) > len(b) else fps[b[0]]
    da, db = _far(fps[a], point), _far(fps[b], point)
    middle = int(np.median(np.concatenate([da, db])))
    low, high = (a[da <= middle], b[db <= middle + radius]), (a[da > middle], b[db > middle - radius])
    if (len(low[0]), len(low[1])) == (len(a), len(b)) or (len(high[0]), len(high[1])) == (len(a), len(b)):
        _compare(fps, a, b, roots, radius)
        return
    tree_cross(fps, *low, roots, radius)
    tree_cross(fps, *high, roots, radius)


def shard_links(members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for each fingerprint of a region that is linked to another one.

    Members are compared with each other, if asked, and with the visitors, which are not
    compared among themselves.
    """
    fps = np.concatenate([members, visitors])
    roots = _Roots(len(fps))
    home, away = np.arange(len(members)), np.arange(len(members), len(fps))
    if among:
        tree_self(fps, home, roots, radius)
    tree_cross(fps, home, away, roots, radius)
    linked = np.flatnonzero(roots.label != np.arange(len(fps)))
    return fps[linked], fps[roots.label[linked]]


def fit_tree(sample: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """(vantage point, radius) of each level, so that the paths part the ``sample`` of block values most evenly."""
    tree: list[tuple[int, int]] = []
    path = np.zeros(len(sample), np.int64)
    rng = np.random.default_rng(7)
    for _ in range(levels):
        best = None
        for point in rng.choice(sample, min(TRIED, len(sample)), replace=False):
            d = _far(sample, point)
            radius = int(np.median(d))
            for r in (radius - 1, radius):
                uneven = (np.unique(path * 2 + (d <= r), return_counts=True)[1].astype(float) ** 2).sum()
                if best is None or uneven < best[0]:
                    best = (uneven, int(point), r)
        tree.append(best[1:])
        path = np.unique(path * 2 + (_far(sample, np.uint64(best[1])) <= best[2]), return_inverse=True)[1]
    return tree


def regions(values: np.ndarray, tree: list[tuple[int, int]]) -> np.ndarray:
    """The path of each block value: a bit a level, 1 inside the radius."""
    out = np.zeros(values.shape, np.int32)
    for point, radius in tree:
        out = out * 2 + (_far(values, np.uint64(point)) <= radius)
    return out


def placed(distinct: DataFrame, trees: list[list[tuple[int, int]]], near: int) -> DataFrame:
    """(fp, block, region, visits) of every fingerprint: its own region and those that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for block, tree in enumerate(trees):
                width = BLOCKS[block + 1] - BLOCKS[block]
                values = fps >> np.uint64(BLOCKS[block]) & np.uint64((1 << width) - 1)
                # every value within ``near`` bits of a block value
                masks = [0]
                for _ in range(near):
                    masks = sorted({m ^ 1 << k for m in masks for k in range(width)} | set(masks))
                home = regions(values, tree)
                around = np.sort(regions(values[:, None] ^ np.array(masks, np.uint64), tree), axis=1)
                go = around < home[:, None]
                go[:, 1:] &= around[:, 1:] != around[:, :-1]
                who, where = np.nonzero(go)
                fp = np.concatenate([fps, fps[who]]).view(np.int64)
                yield batch_of(
                    fp=pa.array(fp), block=pa.array(np.full(len(fp), block, np.int32)), region=pa.array(np.concatenate([home, around[who, where]]).astype(np.int32)),
                    visits=pa.array(np.arange(len(fp)) >= len(fps)),
                )

    return distinct.select("fp").mapInArrow(run, "fp long, block int, region int, visits boolean")


def near_links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct(fp)`` to links (a, b) whose components are those of all near pairs."""
    levels = min(LEVELS, (distinct.count() // SHARD_AIM).bit_length())
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    ends = list(zip(BLOCKS, BLOCKS[1:], strict=False))
    trees = [fit_tree(sample >> np.uint64(a) & np.uint64((1 << b - a) - 1), levels) for a, b in ends]
    rows = materialize(spark, placed(distinct, trees, radius // len(ends)), "regions")
    sizes = rows.groupBy("block", "region").agg(F.count_if(~F.col("visits")).alias("n"), F.count_if("visits").alias("v")).where("n > 0")
    parts, away = F.ceil(F.col("n") / SHARD_LIMIT).cast("int"), F.ceil(F.col("v") / SHARD_LIMIT).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("visits"), away).otherwise(parts)).cast("int")
    every, split = F.sequence(F.lit(0), parts - 1), away > 1
    at = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))
    # Members' parts meet each other as a triangle. The visitors of a region that has few come along to each part;
    # many are dealt in parts of their own, each of which meets each part of the members once.
    among = F.transform(every, lambda o: at(F.least(F.col("mine"), o), F.greatest(F.col("mine"), o), F.lit(-1)))
    asked = F.when(split, F.transform(F.sequence(F.lit(0), away - 1), lambda w: at(F.col("mine"), F.col("mine"), w))).otherwise(F.array().cast("array<struct<i:int,j:int,k:int>>"))
    visiting = F.transform(every, lambda o: at(o, o, F.when(split, F.col("mine")).otherwise(-1)))
    meets = F.when(F.col("visits"), visiting).otherwise(F.concat(among, asked))
    dealt = rows.join(sizes, ["block", "region"]).withColumn("mine", mine).select("fp", "block", "region", "visits", F.explode(meets).alias("p"))
    dealt = dealt.select("fp", "block", "region", "visits", "p.i", "p.j", "p.k")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, visits = pdf["fp"].to_numpy().view(np.uint64), pdf["visits"].to_numpy()
        a, b = shard_links(np.sort(fps[~visits]), np.sort(fps[visits]), radius, pdf["k"].iloc[0] < 0)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = materialize(spark, dealt.groupBy("block", "region", "i", "j", "k").applyInPandas(links, "a long, b long"), "links")
    discard(spark, rows)
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a document: fingerprint and the least doc_id reachable over near pairs.

    A null or empty text has fingerprint 0 and is linked like any other. Repeated
    rows each give a row; a null doc_id never names a component unless all its
    members are null. Extra columns are ignored. Empty input, empty result.
    """
    marked = materialize(spark, fingerprints(docs.select("doc_id", "text")), "fingerprints")
    nodes = _rooted(spark, marked, F.min("doc_id").alias("least"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    out = marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = materialize(spark, out, "named")
    discard(spark, marked, nodes)
    return out


def _rooted(spark: SparkSession, marked: DataFrame, least: Column) -> DataFrame:
    """(fp, ``least`` of its rows, root): the components, named by fingerprints."""
    distinct = materialize(spark, marked.select("fp").distinct(), "distinct")
    links = near_links(spark, distinct)
    found = connected_components(spark, links)
    nodes = marked.groupBy("fp").agg(least).join(found.withColumnRenamed("node", "fp"), "fp", "left")
    nodes = materialize(spark, nodes.select("fp", "least", F.coalesce("component", "fp").alias("root")), "nodes")
    discard(spark, distinct, links, found)
    return nodes


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, all columns, whatever their names, with one row of each component.

    It is the row of least doc_id, nulls last, then of least digest. Rows are told
    apart by the digest of all their columns, so equal ids of different texts are
    decided apart; of equal rows one stays. Null and empty texts have fingerprint 0
    and are one component. An empty table stays empty.
    """
    columns = F.struct(*[F.md5(c).alias(c) if c == "text" else F.col(c) for c in docs.columns])
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(F.to_json(columns))).alias("digest"), "doc_id", "text")
    marked = materialize(spark, fingerprints(keyed.select("digest", "doc_id", "text")), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col("digest").alias("row"))).alias("least")
    nodes = _rooted(spark, marked, least)
    keepers = nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("digest"))
    rows = marked.groupBy("digest").agg(F.count("*").alias("n")).join(keepers.withColumn("kept", F.lit(True)), "digest", "left")
    rows = materialize(spark, rows.where("kept is null or n > 1").select("digest", "kept"), "rows")
    discard(spark, marked, nodes)
    kept = keyed.join(_sent(rows.where("kept is null").select("digest")), "digest", "left_anti")
    again = rows.where("kept").select("digest")
    if again.isEmpty():
        return kept.select("row.*")
    again = _sent(again)
    once = kept.join(again, "digest", "left_semi").dropDuplicates(["digest"])
    return kept.join(again, "digest", "left_anti").unionByName(once).select("row.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
