"""Ranked lexical search: TPUT over term-partitioned postings.

Postings are dealt by term, and a term's list is cut into blocks, so no list is one
task. Three phases, each over all items at once, find the exact best documents:

1. The heads of all lists give partial scores. The best of them are looked up, and an item's k-th score so far is a lower bound.
2. With m lists, a document that reaches the bound has at least bound / m in one of
   them, so every list is read down to that same threshold. What a document may still gain in lists
   that do not show it is less than the threshold in each; those that cannot reach the k-th sum so far go.
3. The scores of the candidates left are looked up in all their item's lists.

Nothing is cut off but what the bounds exclude, so ties at the last rank are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, batch_of, parallelism, runs, table, type_of

#: Documents that an item gets.
TOP = 20
#: The terms asked for filter postings as they are made, if they are no more than this; else they are joined.
SENT_TERMS = 300_000
#: The items' lists go to all tasks if they are no more rows than this; else they are joined by shuffling.
SENT_LISTS = 300_000
#: The documents to look up go to all tasks if they are no more than this; else they are joined by shuffling.
SENT_ROWS = 300_000
#: The heads' best documents, in multiples of those asked for, whose exact scores bound the result.
HEADS = 3
#: Characters whose terms are held at once.
RUN = 4_000_000
#: Fixed values of the score.
SCALE, STEEP, FLAT, SLOPE, WEIGHT = 1_000_000_000, 12, 75, 25, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes as terms have them: A to Z lowered, letters, digits and bytes of other letters kept, all else a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """A whole text's terms in order, as UTF-8."""
    return text.encode().translate(BYTES).split(b" ") if text else []


def _count(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


def collection(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if terms := sum(map(bool, terms_of(text))):
                    n, length = n + 1, length + terms
        yield batch_of(n=pa.array([n], pa.int64()), length=pa.array([length], pa.int64()))

    row = docs.select("text").mapInArrow(run, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return row.n or 0, row.length or 0


def term_rows(rows: DataFrame, key: str, only: frozenset[bytes] | None = None) -> DataFrame:
    """(row, key, term, tf, n): a row's terms, each once, and its length n.

    ``row`` tells rows of one id apart; it holds for one writing of the result.
    """
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            for first, texts in runs(b.column("text").to_pylist(), RUN):
                at, terms, times, lengths = [], [], [], []
                for i, text in enumerate(texts, first):
                    found = _count(text)
                    kept = found.keys() if wanted is None else found.keys() & wanted
                    at += [i] * len(kept)
                    terms += kept
                    times += [found[t] for t in kept]
                    lengths += [found.total()] * len(kept)
                where = pa.array(at, pa.int64())
                yield batch_of(
                    row=b.column("row").take(where), **{key: b.column(key).take(where)}, term=pa.array(terms, pa.binary()).cast(pa.string()),
                    tf=pa.array(times, pa.int64()), n=pa.array(lengths, pa.int64()),
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col("text"))
    return numbered.mapInArrow(run, f"row long, {key} {type_of(rows, key)}, term string, tf long, n long")


def index(docs: DataFrame, n: int, length: int, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, block, row, doc_id, gain), dealt by term and block, the best of a list's block first.

    ``n`` and ``length`` are of the ``collection``. ``terms(term)`` are those that will be asked for; without it all are indexed.
    ``gain`` is the part of a score that the document and the term's count settle. Documents without terms have no postings.
    """
    spark = docs.sparkSession
    only = None
    if terms is not None:
        few = terms.distinct().limit(SENT_TERMS + 1).toArrow()["term"].to_pylist()
        only = frozenset(t.encode() for t in few) if len(few) <= SENT_TERMS else None
    found = term_rows(docs, "doc_id", only)
    if terms is not None and only is None:
        found = found.join(terms.distinct(), "term", "left_semi")
    m = F.lit(FLAT) + F.expr(f"({SLOPE} * n * {n}L) div {max(length, 1)}L")
    gain = F.expr(f"({SCALE} * tf) div (1000 * tf + {STEEP} * m)")
    block = F.pmod(F.xxhash64("row"), F.lit(parallelism(spark))).cast("int")
    found = found.withColumn("m", m).select("term", block.alias("block"), "row", "doc_id", gain.alias("gain"))
    return found.repartition("term", "block").sortWithinPartitions("term", F.desc("gain"))


def _ranked(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def _looked_up(postings: DataFrame, sent: Callable[[DataFrame], DataFrame], lists: DataFrame, of: DataFrame) -> DataFrame:
    """(item, row, doc_id, score): exact scores of ``of(item, row)``.

    The postings of each row that is asked for are fetched once, by row, and its items are put to them there.
    """
    items = of.groupBy("row").agg(F.collect_set("item").alias("items"))
    few = F.broadcast(items.select("row")) if items.count() <= SENT_ROWS else items.select("row")
    found = postings.select("term", "row", "doc_id", "gain").join(few, "row", "left_semi").repartition("row").join(items, "row")
    each = found.select("row", "doc_id", "term", "gain", F.explode("items").alias("item")).join(sent(lists.select("item", "term", "w")), ["item", "term"])
    return each.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("gain")).alias("score"))


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents, equal scores by doc_id, null ids last.

    Null and empty texts have no terms: as documents they are not counted, as items
    they find nothing. Each row of either table is its own document or item, even
    if ids or whole rows repeat; ids may be null. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    asked = scratch.table(term_rows(items, "item_id").withColumnRenamed("row", "item"), "asked")
    n, length = collection(docs)
    postings = scratch.table(index(docs, n, length, asked.select("term")), "postings")
    weight = F.floor(F.lit(WEIGHT) * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1)))
    # A term of weight 0 adds nothing to any score.
    weights = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most")).withColumn("w", weight).where("w > 0")
    lists = asked.join(weights, "term").select("item", "item_id", "term", (F.col("tf") * F.col("w")).alias("w"), "most")
    lists = scratch.table(lists.withColumn("m", F.count("*").over(Window.partitionBy("item"))), "lists")
    sent = F.broadcast if lists.count() <= SENT_LISTS else (lambda df: df)

    best = _ranked("term", F.desc("gain"))
    heads = scratch.table(postings.withColumn("at", best).where(f"at <= {top}").select("term", "row", "gain"), "heads")
    partial = heads.join(sent(lists.select("item", "term", "w")), "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("gain")).alias("score"))
    first = partial.withColumn("at", _ranked("item", F.desc("score"))).where(f"at <= {HEADS * top}").select("item", "row")
    first = scratch.table(_looked_up(postings, sent, lists, scratch.table(first, "first")), "scored")
    bounds = first.withColumn("at", _ranked("item", F.desc("score"))).where(f"at = {top}").select("item", F.col("score").alias("bound"))

    # Unseen entries of a list are below the threshold, and no list gives more than its best entry.
    deep = lists.join(bounds, "item", "left").fillna(0, ["bound"]).withColumn("threshold", F.expr("bound div m"))
    deep = deep.withColumn("least", F.greatest(F.lit(1), F.expr("(threshold + w - 1) div w")))
    deep = deep.withColumn("unseen", F.least(F.greatest(F.col("threshold") - 1, F.lit(0)), F.col("w") * F.col("most")))
    deep = scratch.table(deep.withColumn("hidden", F.sum("unseen").over(Window.partitionBy("item"))), "deep")
    floors = deep.where("least <= most").groupBy("term").agg(F.min("least").alias("floor"))
    entries = postings.join(sent(floors), "term").where("gain >= floor").select("term", "row", "gain")
    # All entries of a row meet once; items are put to them there.
    entries = entries.repartition("row").join(sent(deep.select("item", "term", "w", "least", "unseen")), "term").where("gain >= least")
    seen = entries.groupBy("row", "item").agg(F.sum(F.col("w") * F.col("gain")).alias("score"), F.sum("unseen").alias("shown"))
    most = F.col("score") + F.col("hidden") - F.col("shown")
    seen = seen.join(sent(deep.select("item", "hidden", "bound").distinct()), "item").withColumn("most", most).where("most >= bound")
    seen = scratch.table(seen.select("item", "row", "score", "most"), "seen")
    kth = seen.withColumn("at", _ranked("item", F.desc("score"))).where(f"at = {top}").select("item", F.col("score").alias("kth"))
    left = seen.join(sent(kth), "item", "left").where("most >= coalesce(kth, 0)").select("item", "row")

    exact = _looked_up(postings, sent, lists, scratch.table(left, "left"))
    rank = _ranked("item", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    names = lists.select("item", "item_id").distinct()
    out = exact.withColumn("rank", rank).where(f"rank <= {top}").join(sent(names), "item")
    return scratch.result(out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that score best for each benchmark item."""
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(top: int = TOP) -> str:
    """DuckDB SQL: every document scored for every item."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
whole AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
each AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM each GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor({WEIGHT} * ln((2.0::DOUBLE * (SELECT n FROM whole) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY term
),
asked AS (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {terms} AS w FROM benchmark)),
queries AS (SELECT i, item_id, term, count(*) AS q FROM asked GROUP BY ALL),
gains AS (
  SELECT r, doc_id, term, ({SCALE} * tf) // (1000 * tf + {STEEP} * ({FLAT} + ({SLOPE} * n * (SELECT n FROM whole)) // (SELECT l FROM whole))) AS gain FROM tf
),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(q * w * gain) AS BIGINT) AS score
  FROM queries JOIN weight USING (term) JOIN gains USING (term) GROUP BY ALL HAVING sum(q * w * gain) > 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {top}"""
