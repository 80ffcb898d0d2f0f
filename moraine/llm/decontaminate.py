"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical tokens: words are case-folded, numbers
become one placeholder, a unit after a number another, and, in a second channel,
capitalised words a third. Windows of ``WINDOW`` tokens of items and documents are
hashed and meet in hash joins:

1. Document windows whose hash may be an item's, by a bitmap of fixed size, are the
   hits. They go by the digest of the text, so copies are decided once.
2. An item found has all but a fifth of its windows, so it has one of any fifth and
   one more. Those that stand in the fewest items are its probes, and only pairs of
   text and item that meet at a probe go on: a window that many items share is no
   product of both sides.
3. The pairs' hits join all windows of the item. Matches on one diagonal align its
   tokens with the document's. A window that matches word for word counts; the
   others count only as far as their slots are consistent: the same filler of the
   item always stands against the same filler of the document, and the reverse.
   Windows with the rarer of conflicting fillers are left out, with all where none
   is rarer.

An item is found if the windows that count are ``SHARE`` of its windows at least, so
re-parameterised questions are caught and chance matches are not.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.llm.common import batch_of, bitmap, discard, materialize, may_hold, table

WINDOW = 5
SHARE = 0.8
#: Rows of a join's side that are sent to all tasks at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Kinds of marks in one text that are replaced one after another; more are in one pass.
FEW = 8
#: Bytes of text canonicalised at once.
CHUNK = 2_000_000
#: Words that are units after a number.
UNITS = """mm cm m km in ft yd mi g kg mg lb oz t l ml s ms min h hr hour hours minute minutes second seconds
day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents
metre metres meter meters mile miles kilometre kilometres kilometer kilometers gram grams kilogram
kilograms litre litres liter liters degree degrees c f k v w kw j n pa hz mph""".split()

_rng = np.random.default_rng(20)
_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_TURN = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_SALT = {c: _rng.integers(1, 2**63, WINDOW + 1, dtype=np.uint64) for c in ("folded", "named")}
NUMBER, UNIT, NAME = np.uint64(11), np.uint64(13), np.uint64(17)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Tokens:
    """Canonical tokens of some texts: both channels, their texts and places."""

    folded: np.ndarray  # words folded, numbers and units typed
    named: np.ndarray  # and capitalised words typed
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: bytes

    def filler(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].decode().lower()


def _fold(text: str) -> str:
    """Lower case of the same number of UTF-8 bytes."""
    low = text.lower()
    if len(low.encode()) == len(text.encode()):
        return low
    return "".join(c if len(c.lower().encode()) != len(c.encode()) else c.lower() for c in text)


def _spaced(text: str) -> str:
    """The text with spaces for what stands between words beyond ASCII: quotes, dashes, spaces, symbols; of as many UTF-8 bytes."""
    if text.isascii():
        return text
    odd = {c: " " * len(c.encode()) for c in set(text) if c > "\x7f" and unicodedata.category(c)[0] not in "LMN"}
    if len(odd) > FEW:
        return text.translate(str.maketrans(odd))
    for c, spaces in odd.items():
        text = text.replace(c, spaces)
    return text


def tokens_of(texts: list[str]) -> Tokens:
    texts = [_spaced(t) for t in texts]
    raw = b"\0".join(t.encode() for t in texts) + b"\0"
    low = np.frombuffer(b"\0".join(_fold(t).encode() for t in texts) + b"\0", np.uint8)
    given = np.frombuffer(raw, np.uint8)
    inside = _IN_WORD[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # the last byte is outside
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(np.uint64), none.astype(np.uint64), none, none, none, raw)
    at = np.arange(len(low)) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(low))))
    h = np.add.reduceat(_MIX[low] * _PLACE[at & 63] * inside, start)
    h ^= h >> np.uint64(31)
    sizes = np.array([len(t.encode()) + 1 for t in texts])
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    number = (low[start] >= 0x30) & (low[start] <= 0x39)
    unit = np.isin(h, _UNIT_HASHES) & np.append(False, number[:-1])
    caps = (given[start] != low[start]) | ((given[start] >= 0xC3) & (given[np.minimum(start + 1, len(low) - 1)] != low[np.minimum(start + 1, len(low) - 1)]))
    shout = np.add.reduceat((given != low).astype(np.int32), start) > 1
    folded = np.where(number, NUMBER, np.where(unit, UNIT, h))
    named = np.where(caps & ~shout & ~number & ~unit, NAME, folded)
    fresh = ~(number & np.append(False, number[:-1]) & np.append(False, text[1:] == text[:-1]))
    # one placeholder for a run of numbers, which keeps the run's text
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return Tokens(folded[fresh], named[fresh], text[fresh], start[fresh], end[last], raw)


def _word_hash(word: str) -> np.uint64:
    low = np.frombuffer(word.encode(), np.uint8)
    h = (_MIX[low] * _PLACE[: len(low)]).sum(dtype=np.uint64)
    return h ^ (h >> np.uint64(31))


_UNIT_HASHES = np.array([_word_hash(u) for u in UNITS], np.uint64)


def windows(channel: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` tokens within one text, and their starts."""
    n = len(channel) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = reduce(np.add, (channel[k : k + n] * _TURN[k] for k in range(size)))
    start = np.flatnonzero(text[:n] == text[size - 1 :])
    return h[start], start


def keyed_windows(tokens: Tokens, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, starts) of each channel's windows of ``size`` tokens; keys differ by channel and size."""
    for channel, salt in _SALT.items():
        h, start = windows(getattr(tokens, channel), tokens.text, size)
        yield (h ^ salt[size]) * _MIX[size], start


def consistent(slots: dict[int, tuple[str, str]]) -> set[int]:
    """The places left when each filler stands against one other only, both ways.

    Of pairs that conflict, the one at most places stays; of equally many none does.
    """
    count = Counter(slots.values())
    kept, left, right = set(), set(), set()
    for n in sorted(set(count.values()), reverse=True):
        tier = [(a, b) for (a, b), k in count.items() if k == n and a not in left and b not in right]
        here, there = Counter(a for a, _ in tier), Counter(b for _, b in tier)
        sole = [(a, b) for a, b in tier if here[a] == 1 == there[b]]
        kept.update(sole)
        left.update(a for a, _ in sole)
        right.update(b for _, b in sole)
    return {t for t, pair in slots.items() if pair in kept}


def counted(met: dict[int, tuple[list[bool], list[str], list[str]]]) -> list[int]:
    """Of an item's windows met on one diagonal, by their starts, those that count.

    A window is given by its typed places, its fillers and the document's.
    """
    slots, changed = {}, set()
    for j, (typed, mine, theirs) in met.items():
        for k, (is_typed, a, b) in enumerate(zip(typed, mine, theirs, strict=True)):
            if is_typed or a != b:
                slots[j + k] = (a, b)
            if a != b:
                changed.add(j + k)
    wrong = changed - consistent(slots)
    return [j for j, (typed, _, _) in met.items() if not any(j + k in wrong for k in range(len(typed)))]


def _texts_of(df: DataFrame, name: str) -> DataFrame:
    """(name, text): texts by their digest; null texts are none."""
    return df.where("text is not null").select(F.unhex(F.md5("text")).alias(name), "text")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, n, size, key, j, typed, fillers) of every window of every distinct text.

    A text shorter than a window is one window; a text without a token has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = tokens_of(b.column("text").to_pylist())
            lengths = np.bincount(tokens.text, minlength=b.num_rows)
            first, sizes = np.cumsum(lengths) - lengths, np.minimum(lengths, WINDOW)
            typed = np.isin(tokens.folded, [NUMBER, UNIT]) | (tokens.named == NAME)
            for size in sorted(set(sizes.tolist()) - {0}):
                for key, start in keyed_windows(tokens, size):
                    mine = sizes[tokens.text[start]] == size
                    key, start = key[mine], start[mine]
                    text = tokens.text[start]
                    yield batch_of(
                        item=b.column("item").take(pa.array(text)), n=pa.array(lengths[text] - size + 1, pa.int32()),
                        size=pa.array(np.full(len(start), size), pa.int32()), key=pa.array(key.view(np.int64)),
                        j=pa.array(start - first[text], pa.int32()),
                        typed=pa.array([typed[s : s + size].tolist() for s in start.tolist()], pa.list_(pa.bool_())),
                        fillers=pa.array([[tokens.filler(t) for t in range(s, s + size)] for s in start.tolist()], pa.list_(pa.string())),
                    )

    schema = "item binary, n int, size int, key long, j int, typed array<boolean>, fillers array<string>"
    texts = _texts_of(benchmark, "item").groupBy("item").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, schema)


def document_hits(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, key, i, found): the windows of each text whose key may be among ``keys(key)``."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(keys, keys.count()))

    def hits(texts: list[str], digests: pa.Array) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(texts)
        first = np.searchsorted(tokens.text, np.arange(len(texts)))
        for size in sizes:
            for key, start in keyed_windows(tokens, size):
                maybe = may_hold(sent.value, key)
                key, start = key[maybe], start[maybe]
                text = tokens.text[start]
                yield batch_of(
                    doc=digests.take(pa.array(text)), key=pa.array(key.view(np.int64)), i=pa.array(start - first[text], pa.int32()),
                    found=pa.array([[tokens.filler(t) for t in range(s, s + size)] for s in start.tolist()], pa.list_(pa.string())),
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            part = np.cumsum([len(t) for t in texts]) // CHUNK
            for c in np.unique(part):
                at = np.flatnonzero(part == c)
                yield from hits([texts[k] for k in at], b.column("doc").take(pa.array(at)))

    found = _texts_of(docs, "doc").mapInArrow(run, "doc binary, key long, i int, found array<string>")
    # copies of a text hit alike: each task sends theirs once
    return found.groupBy("doc", "key", "i").agg(F.first("found").alias("found"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shares(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc, item, share) of texts and items, by their digests, that ``share`` at least of an item's windows join."""
    items = materialize(spark, item_windows(benchmark), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # five at most
    hits = materialize(spark, document_hits(docs, items.select("key"), sizes), "hits")

    spread = items.groupBy("key").agg(F.count("*").alias("spread"))
    windows_ = items.join(spread, "key").groupBy("item", "n", "j").agg(F.max("spread").alias("spread"), F.collect_set("key").alias("keys"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("spread", "j"))
    most_missing = F.floor((1 - share) * F.col("n") + 1e-9)
    probes = windows_.withColumn("rank", rank).where(F.col("rank") <= most_missing + 1).select("item", F.explode("keys").alias("key")).distinct()
    pairs = materialize(spark, hits.select("doc", "key").join(_sent(probes), "key").select("doc", "item").distinct(), "pairs")

    of_pairs = hits.join(_sent(pairs), "doc")
    met = of_pairs.join(_sent(items.drop("size")), ["item", "key"])
    window = F.struct("j", "typed", "fillers", "found")
    aligned = met.groupBy("doc", "item", "n", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_set(window).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [counted({w["j"]: (w["typed"], w["fillers"], w["found"]) for w in met}) for met in b.column("met").to_pylist()]
            yield batch_of(doc=b.column("doc"), item=b.column("item"), n=b.column("n"), js=pa.array(good, pa.list_(pa.int32())))

    good = aligned.select("doc", "item", "n", "met").mapInArrow(run, "doc binary, item binary, n int, js array<int>")
    each = good.select("doc", "item", "n", F.explode("js").alias("j")).distinct()
    found = each.groupBy("doc", "item", "n").agg(F.count("*").alias("count")).select("doc", "item", (F.col("count") / F.col("n")).alias("share"))
    out = materialize(spark, found.where(F.col("share") >= share), "shares")
    discard(spark, items, hits, pairs)
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs``, all columns, whatever their names, without the rows that hold a benchmark item.

    Null and empty texts stay; repeated rows stay or go together; with an empty
    benchmark all rows stay.
    """
    foul = shares(spark, docs, benchmark, share).select("doc").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5("text")).alias("doc"))
    return rows.join(_sent(foul), "doc", "left_anti").select("row.*")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) of each benchmark item that a document holds.

    Null or empty texts, of documents or items, hold and are nothing. Repeated
    document rows give repeated results; an item repeated under one id counts as
    its best share. An item shorter than a window must stand whole. Null ids stay
    null. Extra columns are ignored. An empty table on either side gives no rows.
    """
    named = benchmark.where("text is not null").select("item_id", F.unhex(F.md5("text")).alias("item")).distinct()
    found = shares(spark, docs, benchmark, share)
    best = materialize(spark, found.join(named, "item").groupBy("doc", "item_id").agg(F.max("share").alias("share")), "best")
    discard(spark, found)
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("doc"))
    return rows.join(_sent(best), "doc").select("doc_id", "item_id", "share")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
