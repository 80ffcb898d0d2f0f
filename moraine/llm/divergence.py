"""Source divergence audit on mergeable radix tries.

Each task counts its documents' terms in one burst trie of bytes a language: an edge holds a run of bytes,
a leaf a term's documents and its occurrences by source; terms are counted where they are hashed and
branch when the trie is walked. A trie that has grown
large is sent on and begun anew, so tasks keep bounded memory. The tries' leaves are dealt by
ranges of (language, prefix), where equal leaves of all tries meet and are merged; a
term has one leaf a trie, whatever its share of all words. Merged leaves lie in UTF-8
order, and one traversal of each range adds up the pairs of sources and streams each
group's best terms, equal values in that order.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, batch_of, runs, table

#: Documents of a language that a term must stand in.
LEAST_DOCS = 30
#: Terms that a group's report lists.
TOP = 50
#: Leaves of a task's tries; they are sent on beyond that.
LEAVES = 250_000
#: Counts by source at the leaves of a task's tries; they are sent on beyond that too, so tasks keep bounded memory with any number of sources.
COUNTED = 1_000_000
#: Terms of a trie's container that branch no further.
BURST = 1024
#: Characters that are split before the tries' sizes are looked at again.
RUN = 2_000_000
#: Terms that a group of one traversal holds.
BLOCK = 20_000
#: Counts that a traversal spreads out at once, terms times sources.
CELLS = 1 << 20
#: Fixed values of a term's probability: whole, and what is added to a count.
WHOLE, ADDED = 1_000_000_000, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes as terms have them: A to Z lowered, letters and bytes of other letters kept, all else a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))

LEAF = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Trie:
    """Terms as paths of bytes, with documents and occurrences by source at their ends.

    A burst trie: terms are counted in one hash container for their documents and one a source, and
    branch by their bytes when the trie is walked, down to containers that are small enough to be sorted.
    """

    def __init__(self) -> None:
        self.known: Counter[bytes] = Counter()
        self.times: dict[str, Counter[bytes]] = defaultdict(Counter)

    def document(self, source: str, words: list[bytes]) -> None:
        """Add a document."""
        self.times[source].update(words)
        self.known.update(set(words))

    def add(self, term: bytes, docs: int, counts: dict[str, int]) -> None:
        """Add to a term's leaf."""
        self.known[term] += docs
        for source, n in counts.items():
            self.times[source][term] += n

    def merge(self, other: Trie) -> None:
        """Take in all leaves of another trie."""
        for term, docs, counts in other.walk():
            self.add(term, docs, counts)

    def size(self) -> int:
        """The counts by source at the leaves."""
        return sum(map(len, self.times.values()))

    def terms(self) -> Iterator[bytes]:
        """Terms in the order of bytes, which is that of UTF-8."""
        todo: list[tuple[int, list[bytes]]] = [(0, list(self.known))]
        while todo:
            depth, held = todo.pop()
            if len(held) <= BURST:
                yield from sorted(held)
                continue
            # An edge has all bytes that the least and the greatest term share; a term that ends there comes first.
            low, high = min(held), max(held)
            while low[depth : depth + 1] == high[depth : depth + 1]:
                depth += 1
            edges: dict[bytes, list[bytes]] = defaultdict(list)
            for term in held:
                edges[term[depth : depth + 1]].append(term)
            todo += [(depth + 1, edges[b]) for b in sorted(edges, reverse=True)]

    def columns(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Terms in order, their documents, where each one's counts begin and end, and of these the source's place in a list, the list, the count."""
        terms, sources = list(self.terms()), list(self.times)
        place = dict(zip(terms, range(len(terms)), strict=True))
        docs = np.fromiter(map(self.known.__getitem__, terms), np.int64, len(terms))
        where = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.times.values())])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(c.values(), np.int64, len(c)) for c in self.times.values())])
        of = np.repeat(np.arange(len(sources)), [len(c) for c in self.times.values()])
        order = np.argsort(where, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(where, minlength=len(terms))))
        return terms, docs, ends, of[order], sources, counts[order]

    def walk(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """(term, documents, occurrences by source) in the order of bytes."""
        terms, docs, ends, of, sources, counts = self.columns()
        named, ends = [sources[k] for k in of.tolist()], ends.tolist()
        counts = counts.tolist()
        for k, (term, n) in enumerate(zip(terms, docs.tolist(), strict=True)):
            at = slice(ends[k], ends[k + 1])
            yield term, n, dict(zip(named[at], counts[at], strict=True))


def _sent(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    for lang, trie in tries.items():
        terms, docs, ends, of, sources, counts = trie.columns()
        names = pa.array(sources, pa.string())
        for at in range(0, len(terms), BLOCK):
            part = terms[at : at + BLOCK]
            own = ends[at : at + len(part) + 1]
            rows, offsets = slice(own[0], own[-1]), pa.array(own - own[0], pa.int32())
            yield batch_of(
                lang=pa.repeat(pa.scalar(lang, pa.string()), len(part)), term=pa.array(part, pa.binary()).cast(pa.string()), docs=pa.array(docs[at : at + len(part)]),
                sources=pa.ListArray.from_arrays(offsets, names.take(pa.array(of[rows]))), counts=pa.ListArray.from_arrays(offsets, pa.array(counts[rows])),
            )


def partial_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of every task's tries, a term once a trie: (lang, term, docs, sources, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = defaultdict(Trie)
        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for first, texts in runs(b.column("text").to_pylist(), RUN):
                for i, text in enumerate(texts, first):
                    tries[langs[i]].document(sources[i], text.encode().translate(BYTES).split())
                if sum(len(t.known) for t in tries.values()) > LEAVES or sum(t.size() for t in tries.values()) > COUNTED:
                    yield from _sent(tries)
                    tries.clear()
        yield from _sent(tries)

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text).mapInArrow(run, LEAF)


def _same(column: pa.Array) -> np.ndarray:
    """Which rows equal the row before them."""
    return np.append(False, pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False))


def merged(leaves: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Neighbouring leaves of one term as one leaf, of terms that stand in ``least`` documents."""
    start = np.flatnonzero(~(_same(leaves.column("lang")) & _same(leaves.column("term"))))
    size = np.diff(np.append(start, leaves.num_rows))
    good = np.add.reduceat(leaves.column("docs").to_numpy(), start) >= least
    kept = leaves.take(pa.array(np.flatnonzero(np.repeat(good, size))))
    each = np.repeat(np.arange(good.sum()), size[good])
    leaf = np.repeat(each, pc.list_value_length(kept.column("sources")).to_numpy())
    names = pc.list_flatten(kept.column("sources")).dictionary_encode()
    many = max(1, len(names.dictionary))
    place, where = np.unique(leaf * many + names.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    counts = np.zeros(len(place), np.int64)
    np.add.at(counts, where, pc.list_flatten(kept.column("counts")).to_numpy())
    ends = pa.array(np.searchsorted(place // many, np.arange(good.sum() + 1)), pa.int32())
    heads = pa.array(start[good])
    return batch_of(
        lang=leaves.column("lang").take(heads), term=leaves.column("term").take(heads),
        sources=pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(place % many)).cast(pa.string())), counts=pa.ListArray.from_arrays(ends, pa.array(counts)),
    )


def merged_leaves(leaves: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """One leaf a term that stands in ``least`` documents of its language, in UTF-8 order, with the range (part) and the block in it that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in chain((b for b in batches if b.num_rows), [None]):
            if b is not None and held is not None:
                b = pa.concat_batches([held, b])
            if b is None:
                done, held = held, None
            else:
                # The last term may go on in the next batch.
                last = int(np.flatnonzero(~(_same(b.column("lang")) & _same(b.column("term"))))[-1])
                done, held = b.slice(0, last), b.slice(last)
            if done is not None and done.num_rows:
                out = merged(done, least)
                yield batch_of(**{c: out.column(c) for c in out.schema.names}, block=pa.array((n + np.arange(out.num_rows)) // BLOCK, pa.int32()))
                n += out.num_rows

    ordered = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    rows = ordered.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>, block int")
    return rows.withColumn("part", F.spark_partition_id())


def probability(count: np.ndarray, whole: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (whole + ADDED * terms)), exact to 9 * 10**15 occurrences: three digits of long division at a time."""
    base = np.asarray(whole + ADDED * terms, np.int64)
    left = count.astype(np.int64) + ADDED
    out = np.zeros(np.broadcast_shapes(left.shape, base.shape), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // base
        left = left % base
    return out + 1


def traverse(leaves: pd.DataFrame, groups: pd.DataFrame, top: int = TOP) -> Iterator[tuple[str, str, str, str, int]]:
    """(lang, source, part, item, value) of one block of leaves in order: sums over its terms for each pair, and each group's best terms."""
    lang, terms = groups["lang"].iat[0], int(groups["terms"].iat[0])
    groups = groups.sort_values("source")
    sources, wholes = groups["source"].tolist(), groups["n"].to_numpy(np.int64)
    place = {s: k for k, s in enumerate(sources)}
    whole = int(groups["lang_n"].iat[0])
    size = len(sources)
    pairs = np.zeros((size, size), np.int64)
    best: list[list[tuple[int, int, str]]] = [[] for _ in sources]
    step = max(1, CELLS // size)
    for at in range(0, len(leaves), step):
        block = leaves.iloc[at : at + step]
        counts = np.zeros((len(block), size), np.int64)
        rows = np.repeat(np.arange(len(block)), block["counts"].map(len))
        counts[rows, [place[s] for found in block["sources"] for s in found]] = np.concatenate(block["counts"].to_list())
        p = probability(counts, wholes[None, :], terms)
        gain = p - probability(counts.sum(1), np.int64(whole), terms)[:, None]
        for k in range(size):
            pairs[k] += np.abs(p - p[:, k : k + 1]).sum(0)
        names = block["term"].to_list()
        for k in range(size):
            listed = np.flatnonzero((counts[:, k] > 0) & (gain[:, k] > 0))
            # The heap's least entry is the smallest value, and of those the last in order.
            for i in listed[np.argsort(-gain[listed, k], kind="stable")[:top]].tolist():
                entry = (int(gain[i, k]), -(at + i), names[i])
                if len(best[k]) < top:
                    heapq.heappush(best[k], entry)
                elif entry > best[k][0]:
                    heapq.heapreplace(best[k], entry)
    for k, source in enumerate(sources):
        yield from ((lang, source, "pair", other, int(pairs[k, j])) for j, other in enumerate(sources) if j != k)
        yield from ((lang, source, "term", name, value) for value, _, name in best[k])


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source's terms differ from the other sources' and from its language's.

    Null text, language and source read as ''. A document that repeats counts each
    time. A group without terms is compared too; a language that keeps no term
    has pairs of value 0 and no terms. Equal values rank by item in UTF-8 order. Extra columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    there = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    partial = scratch.table(partial_leaves(docs), "partial")
    leaves = scratch.table(merged_leaves(partial, least), "leaves")
    counted = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source"))
    kept = leaves.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = there.join(counted.agg(F.sum("c.counts").alias("n")), ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["n", "terms"])
    groups = scratch.table(groups.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang"))), "groups")

    # Each block of leaves meets the groups of its language; a language without leaves meets none.
    blocks = leaves.select("lang", F.col("part").alias("in_part"), F.col("block").alias("in_block")).distinct()
    beside = groups.join(blocks, "lang")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = list(traverse(left.sort_values("term", key=lambda t: t.str.encode("utf-8")), right, top))
        return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])

    both = leaves.groupBy("lang", "part", "block").cogroup(beside.groupBy("lang", "in_part", "in_block"))
    walked = both.applyInPandas(run, "lang string, source string, part string, item string, value long")
    walked = scratch.table(walked, "walked")
    other = groups.select("lang", F.col("source").alias("item"))
    none = groups.where("terms = 0").select("lang", "source").join(other, "lang").where("source <> item")
    none = none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = walked.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    terms = walked.where("part = 'term'").select("*", rank).where(f"rank <= {top}")
    return scratch.result(pairs.unionByName(none).select("*", rank).unionByName(terms), "audit")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of ``documents`` differs."""
    return audit(spark, table(spark, sf_dir, "documents"))


def oracle(least: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL: every kept term for every group, with 128-bit integers."""
    p = f"1 + ({WHOLE}::HUGEINT * (count + {ADDED})) // (n + {ADDED} * v)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS count FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(f.count, 0) AS count FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)
),
group_p AS (
  SELECT lang, source, term, count, {p} AS p
  FROM (SELECT *, sum(count) OVER (PARTITION BY lang, source) AS n FROM every) JOIN size USING (lang)
),
lang_p AS (
  SELECT lang, term, {p} AS p FROM (
    SELECT *, sum(count) OVER (PARTITION BY lang) AS n FROM (SELECT lang, term, sum(count) AS count FROM every GROUP BY ALL)
  ) JOIN size USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM group_p a JOIN group_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM size)
),
terms AS (
  SELECT g.lang, g.source, 'term' AS part, g.term AS item, g.p - l.p AS value FROM group_p g JOIN lang_p l USING (lang, term) WHERE g.count > 0 AND g.p > l.p
),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""
