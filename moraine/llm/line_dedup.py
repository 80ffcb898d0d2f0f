"""Fuzzy line deduplication by MinHash.

Every line's lower-cased character shingles give a MinHash signature, banded so
that a pair of similarity ``SIMILARITY`` shares a band with probability 0.997 (three
values a band, eight bands). Lines that share a band are compared by exact Jaccard
similarity of their shingles; links of at least ``SIMILARITY`` become components by
distributed union-find, and the first line of a component, by doc_id and line
number, is the one kept. A changed letter changes up to eight shingles, so a line
with one in its middle is linked from 79 characters on.

Equal lines are one node, keyed by digest, so a line that stands in a third of all
documents costs its rows once. To find candidates the band keys alone are sent, 32
bits each, dealt by their other bits, and those that several lines have go into a
bitmap; only lines with such a key travel with their digests. The bitmap may pass
others: what a bucket holds is counted on whole keys. Of each candidate one place
is read again, so its text is sent once however often it stands.

Small buckets with the same least line are compared as one, larger ones with the
same members once. A bucket beyond ``BUCKET_LIMIT`` lines is dealt twice. First in
parts, each with the bucket's least line as a common centre: that connects a group
of near copies at one comparison a line. Then only lines that are still apart from
the centre meet the others of their bucket, part against part, so no link is lost
and no group is compared pair by pair because it is large.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import batch_of, bitmap, discard, materialize, may_hold, parallelism, table, type_of
from moraine.llm.components import connected_components

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
BUCKET_LIMIT = 1024
TASK_LINES = 4000
#: Characters signed at once.
CHUNK = 200_000
#: Keys that are counted together, and lines whose keys are sent together.
PART_KEYS, SENT_LINES = 1 << 20, 1 << 16
#: Bits of a line's place that hold its number; the others name the row. A number beyond them only filters less.
NO_BITS = 12
#: Columns of a line's keys, one a band.
KEYS = [f"band_{b}" for b in range(BANDS)]
#: A key with more than this part of all rows is looked up without a shuffle; there are fewer such keys than that.
HOT_PART = 1000

_rng = np.random.default_rng(3)
_A = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
_M1, _M2, _M4, _K = (np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 4, dtype=np.uint64))


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``SHINGLE`` characters from each position on."""
    p = codes.astype(np.uint64) + np.uint64(1)
    for step, m in ((1, _M1), (2, _M2), (4, _M4)):
        p = p * m + np.append(p[step:], np.zeros(step, np.uint64))
    p ^= p >> np.uint64(29)
    return p * _K


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line, hashed; a shorter line is one shingle."""
    low = [x.lower() for x in lines]
    h = shingle_hashes(np.frombuffer("".join(low).encode("utf-32-le"), np.uint32))
    out, at = [], 0
    for x in low:
        n = len(x) - SHINGLE + 1
        if n < 1:
            out.append(np.array([zlib.crc32(x.encode())], np.uint64))
        else:
            own = h[at : at + n]
            own.sort()
            new = own[1:] != own[:-1]
            out.append(own if new.all() else np.concatenate([own[:1], own[1:][new]]))
        at += len(x)
    return out


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of lines that are not blank."""
    low = [x.lower() for x in lines]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in low])
    ends = np.cumsum(sizes)
    x = (shingle_hashes(codes) >> np.uint64(32)).astype(np.uint32)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    valid = left >= SHINGLE
    for k in np.flatnonzero(sizes < SHINGLE):
        x[ends[k] - sizes[k]] = zlib.crc32(low[k].encode())
        valid[ends[k] - sizes[k]] = True
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    x, at = x[valid], np.cumsum(counts) - counts
    keys, mixed = np.empty((len(lines), BANDS), np.uint64), np.empty_like(x)
    for b in range(BANDS):
        key = np.full(len(lines), _SALT[b])
        for r in range(b * ROWS, (b + 1) * ROWS):
            np.multiply(x, _A[r], out=mixed)
            np.add(mixed, _B[r], out=mixed)
            key = (key ^ np.minimum.reduceat(mixed, at)) * _K
            key ^= key >> np.uint64(32)
        keys[:, b] = key
    return keys


def _lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """Lines that are not blank, with their numbers."""
    return ((no, line) for no, line in enumerate((text or "").split("\n")) if line and not line.isspace())


def _keyed(docs: DataFrame, *also: Column) -> DataFrame:
    """``docs`` with the name of a text's lines: rows of one doc_id may differ in text."""
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"), *also)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, digest, band_0, ...) of every line that is not blank."""

    def signed(b: pa.RecordBatch, of: list[int], nos: list[int], lines: list[str]) -> pa.RecordBatch:
        keys, rows = band_keys(lines).view(np.int64), pa.array(of, pa.int64())
        return batch_of(
            doc_id=b.column("doc_id").take(rows), text_key=b.column("text_key").take(rows), line_no=pa.array(nos, pa.int32()),
            digest=pa.array([hashlib.md5(x.encode()).digest() for x in lines], pa.binary()),
            **{c: pa.array(keys[:, k]) for k, c in enumerate(KEYS)},
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, nos, lines, size = [], [], [], 0
            for k, text in enumerate(b.column("text").to_pylist()):
                for no, line in _lines_of(text):
                    of.append(k)
                    nos.append(no)
                    lines.append(line)
                    size += len(line)
                if size >= CHUNK:
                    yield signed(b, of, nos, lines)
                    of, nos, lines, size = [], [], [], 0
            if lines:
                yield signed(b, of, nos, lines)

    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key long, line_no int, digest binary, {', '.join(f'{c} long' for c in KEYS)}"
    return _keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` stand in the sorted ``b``."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def jaccard_links(digests: list[bytes], sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[bytes, bytes]]:
    """Links that connect what pairs of similarity ``least`` connect.

    Each line in turn is compared with the later ones that are not yet connected to
    it, so a group that one line connects costs one comparison a line.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(n)
    links = []
    for p in range(n - 1):
        others = p + 1 + np.flatnonzero(root[p + 1 :] != root[p])
        # sizes alone rule out most lines of other lengths
        others = others[(np.minimum(sizes[others], sizes[p]) >= least * np.maximum(sizes[others], sizes[p]))]
        if not len(others):
            continue
        flat = np.concatenate([sets[q] for q in others.tolist()]) if len(others) > 1 else sets[int(others[0])]
        common = np.add.reduceat(_common(flat, sets[p]), np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        for q in others[common >= least * (sizes[others] + sizes[p] - common)].tolist():
            if root[q] != root[p]:
                links.append((digests[p], digests[q]))
                root[root == root[q]] = root[p]
    return links


def _place(line_no: Column) -> Column:
    """A long that names one line of a row and, by its upper bits, the row."""
    most = (1 << NO_BITS) - 1
    return F.xxhash64("doc_id", "text_key").bitwiseAND(~most).bitwiseOR(line_no.cast("long").bitwiseAND(most))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, line) of the lines at the places ``wanted(place)``, and of few others."""
    sc, row = docs.sparkSession.sparkContext, F.shiftrightunsigned("place", NO_BITS)
    number = F.shiftleft(F.col("place").bitwiseAND((1 << NO_BITS) - 1), 16)
    of_rows = sc.broadcast(bitmap(wanted.select(row.alias("row"))))
    of_lines = sc.broadcast(bitmap(wanted.select(row.bitwiseXOR(number).alias("line")), wanted.count()))

    def chosen(lines: list[str], rows: list[int], counts: list[int]) -> pa.RecordBatch:
        n = np.array(counts)
        no = (np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) & np.uint64((1 << NO_BITS) - 1)
        may = may_hold(of_lines.value, np.repeat(np.array(rows, np.uint64), n) ^ no << np.uint64(16))
        found = {hashlib.md5(lines[k].encode()).digest(): lines[k] for k in np.flatnonzero(may).tolist()}
        return batch_of(digest=pa.array(list(found), pa.binary()), line=pa.array(list(found.values()), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("place").to_numpy().view(np.uint64) >> np.uint64(NO_BITS)
            may = may_hold(of_rows.value, row)
            texts = b.column("text").filter(pa.array(may)).to_pylist()
            lines, rows, counts, size = [], [], [], 0
            for of, text in zip(row[may].tolist(), texts, strict=True):
                own = text.split("\n")
                lines += own
                rows.append(of)
                counts.append(len(own))
                size += len(text)
                if size >= CHUNK:
                    yield chosen(lines, rows, counts)
                    lines, rows, counts, size = [], [], [], 0
            if lines:
                yield chosen(lines, rows, counts)

    rows = _keyed(docs.where(F.col("text").isNotNull())).select("text", _place(F.lit(0)).alias("place"))
    return rows.mapInArrow(run, "digest binary, line string")


def _linked(dealt: DataFrame) -> DataFrame:
    """``dealt(group, key, part, digest, line)`` to links (a, b) between similar lines of one part of a bucket."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "part", "digest"], ignore_index=True)
        digests, lines = list(pdf["digest"]), list(pdf["line"])
        text = dict(zip(digests, lines, strict=True))
        sets = dict(zip(text, line_sets(list(text.values())), strict=True))
        parts = pdf[["key", "part"]].to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]).any(axis=1))), len(pdf)).tolist()
        found: list[tuple[bytes, bytes]] = []
        for a, b in zip(edge, edge[1:], strict=False):
            of = sorted(set(digests[a:b]))  # the centre may be dealt to its own part
            found += jaccard_links(of, [sets[d] for d in of])
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return dealt.groupBy("group").applyInPandas(links, "a binary, b binary")


def _grouped(dealt: DataFrame, rows: int) -> DataFrame:
    """Parts travel together, ``TASK_LINES`` lines or so to a group."""
    return dealt.withColumn("group", F.pmod(F.xxhash64("key", "part"), F.lit(max(1, rows // TASK_LINES))))


def repeated_lines(marked: DataFrame) -> DataFrame:
    """(digest, n) of the lines that stand more than once."""
    return marked.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


def shared_keys(spark: SparkSession, marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key) of the low 32 bits of the band keys that several different lines have, and of few others.

    Keys are dealt by their upper bits. Those of a line that may stand more than once bring
    its hash along, so its occurrences count as one line.
    """
    sent = spark.sparkContext.broadcast(bitmap(repeated.select(F.xxhash64("digest")), repeated.count()))
    parts = max(parallelism(spark), len(KEYS) * marked.count() // PART_KEYS)

    def dealt(keys: np.ndarray, line: np.ndarray | None) -> pa.RecordBatch:
        of = (keys >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(of.astype(np.uint32), kind="stable")
        part, at = np.unique(of[order], return_index=True)
        ends = pa.array(np.append(at, len(of)).astype(np.int32))
        low = keys[order].astype(np.uint32).view(np.int32)
        lines = pa.nulls(len(part), pa.list_(pa.int64())) if line is None else pa.ListArray.from_arrays(ends, pa.array(line[order].view(np.int64)))
        return batch_of(part=pa.array(part.astype(np.int32)), low=pa.ListArray.from_arrays(ends, pa.array(low)), line=lines)

    def both(once: list[np.ndarray], again: list[np.ndarray], lines: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, once)):
            yield dealt(np.concatenate(once).ravel(), None)
        if sum(map(len, lines)):
            line, at = np.unique(np.concatenate(lines), return_index=True)
            yield dealt(np.concatenate(again)[at].ravel(), np.repeat(line, len(KEYS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again, lines, n = [], [], [], 0
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().view(np.uint64) for c in KEYS], axis=1)
            line = b.column("line").to_numpy().view(np.uint64)
            may = may_hold(sent.value, line)
            once.append(keys[~may])
            again.append(keys[may])
            lines.append(line[may])
            n += len(line)
            if n >= SENT_LINES:
                yield from both(once, again, lines)
                once, again, lines, n = [], [], [], 0
        yield from both(once, again, lines)

    def several(part: pa.Table) -> pa.Table:
        alone = part.column("line").is_null()
        low = part.column("low").filter(alone).combine_chunks().flatten().to_numpy().view(np.uint32)
        rest = part.filter(part.column("line").is_valid())
        pairs = np.stack([c.combine_chunks().flatten().to_numpy().astype(np.int64).view(np.uint64) for c in (rest.column("low"), rest.column("line"))])
        pairs = pairs[:, np.lexsort(pairs)]
        first = np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))[: pairs.shape[1]]
        low = np.sort(np.concatenate([low, pairs[0, first].astype(np.uint32)]))
        return pa.table({"key": pa.array(np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64))})

    rows = marked.select(F.xxhash64("digest").alias("line"), *KEYS).mapInArrow(run, "part int, low array<int>, line array<long>")
    return rows.groupBy("part").applyInArrow(several, "key long")


def bucket_members(spark: SparkSession, marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, digest, place, n, centre) of the lines that share a band key with another line.

    ``n`` and ``centre`` are those of buckets beyond ``BUCKET_LIMIT``, else null: its lines and
    the least hash of a digest. Buckets that small that their unions stay below it are united
    by their least line, others with the same members fall together.
    """
    met = materialize(spark, shared_keys(spark, marked, repeated), "met")
    sent = spark.sparkContext.broadcast(bitmap(met, met.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # equal lines of a batch are one
            b = b.take(pa.array(np.unique(b.column("line").to_numpy(), return_index=True)[1]))
            for c in KEYS:
                may = pa.array(may_hold(sent.value, b.column(c).to_numpy().view(np.uint64)))
                yield batch_of(key=b.column(c).filter(may), digest=b.column("digest").filter(may), place=b.column("place").filter(may))

    line = F.xxhash64("digest")
    rows = marked.select("digest", line.alias("line"), _place(F.col("line_no")).alias("place"), *KEYS).mapInArrow(run, "key long, digest binary, place long")
    rows = materialize(spark, rows.groupBy("key", "digest").agg(F.min("place").alias("place")), "keyed")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(line).alias("x"), F.min(line).alias("centre")).where("n > 1")
    small = F.col("n") * BANDS <= BUCKET_LIMIT  # the least line has a bucket a band
    named = F.when(small, F.xxhash64("centre")).otherwise(F.xxhash64("n", "x", "centre"))
    large = F.col("n") > BUCKET_LIMIT
    buckets = buckets.select("key", named.alias("bucket"), *(F.when(large, F.col(c)).alias(c) for c in ("n", "centre")))
    members = rows.join(buckets, "key").select(F.col("bucket").alias("key"), "digest", "place", "n", "centre").distinct()
    members = materialize(spark, members, "buckets")
    discard(spark, met, rows)
    return members


def line_components(spark: SparkSession, docs: DataFrame, marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, component) of the digests of lines that are similar to another one."""
    members = bucket_members(spark, marked, repeated)
    total = members.count()
    large = members.where("n is not null")
    count = F.ceil(F.col("n") / BUCKET_LIMIT).cast("int")
    part = F.pmod(F.xxhash64("digest"), F.coalesce(count, F.lit(1))).cast("int")
    dealt = members.select("key", "digest", part.alias("part"))
    is_centre = F.xxhash64("digest") == F.col("centre")
    if has_large := not large.isEmpty():
        dealt = dealt.unionByName(large.where(is_centre).select("key", "digest", F.explode(F.sequence(F.lit(0), count - 1)).alias("part")))
    dealt = dealt.join(_texts(docs, members.select("place").distinct()), "digest")
    found = connected_components(spark, _linked(_grouped(dealt, total)))
    if not has_large:
        discard(spark, members)
        return found

    # of a large bucket, what the centre's component does not hold yet meets everything
    root = found.withColumnRenamed("node", "digest")
    held = large.join(root, "digest", "left").select("key", "digest", is_centre.alias("centre"), F.coalesce("component", "digest").alias("component"))
    held = written = materialize(spark, held, "held")
    of_centre = held.where("centre").select("key", F.col("component").alias("main"))
    held = held.join(of_centre, "key").select("key", "digest", (F.col("component") != F.col("main")).alias("apart"))
    sizes = held.groupBy("key").agg(F.count_if("apart").alias("n_apart"), F.count_if(~F.col("apart")).alias("n_main")).where("n_apart > 0")
    parts_apart, parts_main = (F.ceil(F.col(c) / (BUCKET_LIMIT // 2)).cast("int") for c in ("n_apart", "n_main"))
    mine = F.pmod(F.xxhash64("digest"), F.when(F.col("apart"), parts_apart).otherwise(parts_main)).cast("int")
    # parts 0, 1, ... of the lines apart, then those of the centre's component, as a triangle
    with_apart = F.transform(F.sequence(F.lit(0), parts_apart - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), parts_main - 1), lambda o: F.struct(F.col("mine").alias("i"), (parts_apart + o).alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), parts_apart - 1), lambda o: F.struct(o.alias("i"), (parts_apart + F.col("mine")).alias("j")))
    meets = F.when(F.col("apart"), F.concat(with_apart, with_main)).otherwise(from_main)
    again = held.join(sizes, "key").withColumn("mine", mine).select("key", "digest", F.explode(meets).alias("p"))
    again = again.select("key", "digest", F.struct("p.i", "p.j").alias("p")).withColumn("part", F.xxhash64("p")).drop("p")
    again = again.join(_texts(docs, large.select("place").distinct()), "digest")
    links = _linked(_grouped(again, total))
    # components are the nodes now: what the further links join
    for end in ("a", "b"):
        named = found.select(F.col("node").alias(end), F.col("component").alias("named"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("named", end)).drop("named")
    joined = connected_components(spark, links)
    discard(spark, members, written)
    if joined.isEmpty():
        discard(spark, joined)
        return found
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("further"))
    known = found.join(renamed, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    out = materialize(spark, known.unionByName(joined.join(found.select("node"), "node", "left_anti")), "known")
    discard(spark, found, joined)
    return out


def _looked_up(rows: DataFrame, keyed: DataFrame, key: str, thinned: bool = False) -> DataFrame:
    """``rows`` joined with ``keyed(key, n, ...)``, where ``n`` says how many rows have the key.

    ``thinned`` leaves out, before the shuffle, rows whose key the table does not hold.
    """
    hot = F.col("n") > rows.count() // HOT_PART  # fewer than HOT_PART rows
    few, others = F.broadcast(keyed.where(hot).drop("n")), keyed.where(~hot).drop("n")
    cold = _thinned(rows, others, key) if thinned else rows.join(few.select(key), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(others, key))


def _thinned(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``keyed`` holds, and few others."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(keyed.select(F.xxhash64(key)), keyed.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = may_hold(sent.value, b.column("line").to_numpy().view(np.uint64))
            yield b.filter(pa.array(may)).drop_columns(["line"])

    return rows.select("*", F.xxhash64(key).alias("line")).mapInArrow(run, rows.schema)


def _dropped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, dropped): the numbers of a text's lines that other lines stand for."""
    marked = materialize(spark, signatures(docs), "signatures")
    repeated = materialize(spark, repeated_lines(marked), "repeated")
    found = line_components(spark, docs, marked, repeated)
    # lines that stand once and are like no other take no further part
    named = repeated.join(found.withColumnRenamed("node", "digest"), "digest", "full")
    named = named.select("digest", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("component", "digest").alias("component"))
    named = materialize(spark, named, "named")
    rows = _looked_up(marked.select("digest", "doc_id", "line_no", "text_key"), named, "digest", thinned=True)
    rows = materialize(spark, rows.select("component", "doc_id", "line_no", "text_key"), "repeats")
    at = F.struct("doc_id", "line_no", "text_key")
    kept = materialize(spark, rows.groupBy("component").agg(F.count("*").alias("n"), F.min(at).alias("kept")), "kept")
    gone = _looked_up(rows, kept, "component").where(~at.eqNullSafe(F.col("kept")))
    out = materialize(spark, gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("dropped")), "dropped")
    discard(spark, marked, repeated, found, named, rows, kept)
    return out


def dropped_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no) of every line that another one stands for.

    Blank lines and null or empty texts have none. Rows that repeat a doc_id and its
    text have the same decisions and count as one; texts of one doc_id, or without
    one, are told apart. A null doc_id comes before others. Extra columns are
    ignored. An empty table has no lines.
    """
    return _dropped(spark, docs).select("doc_id", "text_key", F.explode("dropped").alias("line_no"))


def _with_dropped(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """``keyed(doc_id, text_key, ...)`` with its array of dropped lines, null where there are none."""
    gone = gone.select(F.struct("doc_id", "text_key").alias("of"), "dropped")
    return keyed.join(gone, F.struct("doc_id", "text_key").eqNullSafe(F.col("of")), "left").drop("of")


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts.

    All columns stay, whatever their names; a null text stays null, a text without
    dropped lines stays as it is, repeated rows stay alike, and a document that
    loses all its lines is left out. An empty table stays empty.
    """
    keyed = _keyed(docs, F.struct(*(c for c in docs.columns if c != "text")).alias("rest"))
    joined = _with_dropped(keyed, _dropped(spark, docs)).select("rest", "text", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, stays = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
            gone = b.column("dropped")
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                out = set(gone[k].as_py())
                texts[k] = "\n".join(line for no, line in enumerate(texts[k].split("\n")) if no not in out)
                stays[k] = bool(texts[k].strip())
            yield batch_of(rest=b.column("rest"), text=pa.array(texts, pa.string())).filter(pa.array(stays))

    left = joined.mapInArrow(run, joined.drop("dropped").schema)
    return left.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines that fuzzy deduplication removes; a null text has no lines."""
    docs = table(spark, sf_dir, "documents")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines")
    joined = _with_dropped(_keyed(docs, n).drop("text"), _dropped(spark, docs))
    removed = F.array_sort(F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))
