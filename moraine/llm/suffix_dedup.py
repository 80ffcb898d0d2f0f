"""Exact substring dedup by distributed deep-shallow suffix sorting.

A byte goes if a ``SPAN``-byte string covering it also starts in a document with a
smaller doc_id. Suffixes that may share ``SPAN`` bytes must meet, and no others
need to travel, so the work is dealt in three steps.

1. Every ``SPAN``-byte window names an anchor, the least hash of its ``K``-byte
   strings. Equal windows name equal anchors at equal offsets. Anchors go to
   buckets by hash, packed; a bucket keeps those that stand in two documents. An
   anchor met twice within one chunk of documents is kept there and sent once, so
   a passage of any share of the corpus costs each chunk one row.
2. Around kept anchors, segments of text are cut and sent by anchor hash; equal
   segments of a chunk are sent once, for the least doc_id, and the others are
   decided on the spot. An anchor that weighs heavily in its bucket is split by the
   bytes beside it: windows that hold it at neighbouring offsets share ``CORE``
   bytes, and each such part of a segment goes by the hash of those bytes.
3. A bucket makes equal segments one, and sorts the suffixes of those whose anchor
   stands in several, to ``SPAN`` bytes: a multikey
   quicksort on words of eight bytes orders them to ``SHALLOW`` words; groups that
   still tie go to blind tries, which branch on the first byte that differs in a
   group and compare no other. Equal suffixes are runs; all but those of a run's
   least doc_id are removed.

All arrays are a bucket's or a chunk's; runs reach the text by doc_id at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import discard, materialize, parallelism, table

SPAN, K = 50, 16
#: Anchors in a window.
ANCHORS = SPAN - K + 1
SHALLOW = 3
#: Bytes of text handled at once.
CHUNK = 1_500_000
#: Ids of documents that may be sent to all tasks to thin a scan; beyond, a shuffle join does it.
BROADCAST_IDS = 400_000
#: Buckets to a shuffle partition.
BUCKETS_EACH = 2
#: Finer buckets to each of those for segments, whose suffixes are sorted in memory.
SEGMENTS_EACH = 2
#: Places a task gathers before it sends them on.
PLACES_HELD = 2_000_000
#: An anchor with this part of its bucket's places, and so many at least, is split.
HEAVY_PART, HEAVY_LEAST = 16, 4096
#: Offsets of a split anchor that go together, and the bytes that their windows share.
WIDTH = 5
CORE = SPAN - WIDTH + 1

_rng = np.random.default_rng(5)
_MULT = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 5, dtype=np.uint64)]
_SMALL = [np.uint32(int(x) | 1) for x in _rng.integers(1, 2**32, 5, dtype=np.uint32)]


def _chunks(ids: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    run, of, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        run.append(t)
        of.append(i)
        size += len(t)
        if size >= CHUNK:
            yield np.array(of, np.int64), run
            run, of, size = [], [], 0
    if run:
        yield np.array(of, np.int64), run


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of the ``width`` values from each place on, fewer at the end."""
    have = 1
    while have < width:
        step = min(have, width - have)
        out = x.copy()
        pick(x[:-step], x[step:], out=out[:-step])
        x, have = out, have + step
    return x


class Anchors:
    """Anchors of a chunk's bytes, their identities and the windows that name each.

    A small hash orders the places; only anchors get the wide one that identifies
    their bytes.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(sizes) - sizes
        h = self.data.astype(np.uint32) + np.uint32(1)
        for step, m in ((1, _SMALL[0]), (2, _SMALL[1]), (4, _SMALL[2]), (K - 8, _SMALL[3])):
            nxt = h * m
            nxt[:-step] += h[step:]
            h = nxt
        h ^= h >> np.uint32(15)
        h *= _SMALL[4]
        self.order = (h ^ (h >> np.uint32(13))) | np.uint32(1)  # never 0
        window = np.zeros(len(self.data), np.uint32)
        for at, size in zip(self.start.tolist(), sizes.tolist(), strict=True):
            if size >= SPAN:
                window[at : at + size - SPAN + 1] = np.iinfo(np.uint32).max
        self.least = _slide(self.order, ANCHORS, np.minimum) & window
        # a place is an anchor if it is the least of some window over it
        self.at = np.flatnonzero(_slide(self.least[::-1], ANCHORS, np.maximum)[::-1] == self.order)
        self.text = np.searchsorted(self.start, self.at, side="right") - 1
        # empty texts share their start with the next: the last one of a start is the one with bytes
        self.within = self.at - self.start[self.text]

    def identity(self, at: np.ndarray, width: int = K) -> np.ndarray:
        """64-bit hashes of the ``width`` bytes at ``at``."""
        rows = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
        rows[:, :width] = self.data[at[:, None] + np.arange(width)]
        rows = rows.view(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for c in range(rows.shape[1]):
            h = (h ^ (rows[:, c] * _MULT[c % 3])) * _MULT[4]
            h ^= h >> np.uint64(31)
        return h * _MULT[3] ^ (h >> np.uint64(17))

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that name the anchors ``at``."""
        around = at[:, None] + np.arange(1 - ANCHORS, 1)
        named = (around >= 0) & (self.least[np.maximum(around, 0)] == self.order[at][:, None])
        first = at - (ANCHORS - 1) + named.argmax(axis=1)
        return first, at - named[:, ::-1].argmax(axis=1)

    def parts(self, at: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, place of the shared bytes, first and last window start) around the anchors ``at``.

        An anchor is one part, keyed by its bytes; a ``heavy`` one is a part for each
        ``WIDTH`` offsets that its windows have, keyed by the ``CORE`` bytes they share.
        Equal windows have equal offsets, so they meet under one key either way.
        """
        key = self.identity(at)
        first, last = self.spans(at)
        split = np.isin(key >> np.uint64(16), heavy)
        out = [(key[~split], at[~split], first[~split], last[~split])]
        at, first, last = at[split], first[split], last[split]
        for offset in range(0, ANCHORS if len(at) else 0, WIDTH):
            low, high = np.maximum(first, at - offset - WIDTH + 1), np.minimum(last, at - offset)
            some = low <= high
            core = at[some] - offset
            out.append((self.identity(core, CORE), core, low[some], high[some]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed."""
    raw = np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), "zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out, raw[at:]


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def anchor_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): a chunk's anchors of one bucket as hash, doc_id, place, count.

    Anchors that two documents of the chunk share come with bucket -1: they are
    known to be shared. Their least and greatest doc_id go to the bucket, so that
    other chunks learn of them, with the number of places they stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b.column("doc_id").to_pylist(), _texts(b)):
                a = Anchors(texts)
                if not len(a.at):
                    continue
                h, doc, at = a.identity(a.at), ids[a.text], a.within.astype(np.int32)
                order = np.lexsort((doc, h))
                h, doc, at = h[order], doc[order], at[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                size = np.diff(np.append(first, len(h)))
                last = first + size - 1
                shared = doc[first] != doc[last]
                known = np.repeat(shared, size)
                send = ~known
                send[first[shared]] = send[last[shared]] = True
                stands = np.ones(len(h), np.uint32)
                stands[first[shared]] = size[shared] - 1
                bucket = np.concatenate([(h[send] % np.uint64(buckets)).astype(np.int64), np.full(known.sum(), -1)])
                h, doc, at, stands = (np.concatenate([c[send], c[known]]) for c in (h, doc, at, stands))
                # documents in order pack best
                order = np.lexsort((at, doc, bucket))
                bucket, h, doc, at, stands = bucket[order], h[order], doc[order], at[order], stands[order]
                cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
                keys, blobs = [], []
                for i, j in zip(cut, cut[1:], strict=False):
                    keys.append(int(bucket[i]))
                    blobs.append(_pack((h[i:j] >> np.uint64(16)).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6], doc[i:j], at[i:j], stands[i:j]))
                yield _batch(bucket=pa.array(keys, pa.int32()), blob=pa.array(blobs, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, blob binary")


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, places, anchor): anchors of a document that stand in another one too.

    Rows with an ``anchor`` and no doc_id name the heavy ones by the 48 bits of their
    hash, ``HEAVY_PART`` a bucket at most.
    """
    dealt = _dealt(anchor_blobs(docs, buckets), buckets // BUCKETS_EACH)
    groups = parallelism(docs.sparkSession)

    def packed(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Places by group of documents, so that a document's meet in one task."""
        group = doc % groups
        order = np.lexsort((at, doc, group))
        group, doc, at = group[order], doc[order], at[order]
        cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist() if len(group) else [0]
        blobs = [_pack(doc[i:j], at[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        return _batch(to=pa.array(group[cut[:-1]], pa.int32()), heavy=pa.array([False] * len(blobs)), blob=pa.array(blobs, pa.binary()))

    def shared(blobs: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        parts = []
        for x in blobs:
            (h, doc, at, stands), _ = _unpack(x, "V6", "i8", "i4", "u4")
            wide = np.zeros((len(h), 8), np.uint8)
            wide[:, :6] = h.view(np.uint8).reshape(-1, 6)
            parts.append((wide.view(np.uint64).ravel(), doc, at, stands))
        h, doc, at, stands = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, at, stands = h[order], doc[order], at[order], stands[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        both = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(both, size)
        weight = np.add.reduceat(stands, first, dtype=np.int64)
        heavy = both & (weight >= HEAVY_LEAST) & (weight > weight.sum() // HEAVY_PART)
        return (doc[keep], at[keep]), h[first[heavy]]

    def named(heavy: np.ndarray) -> pa.RecordBatch:
        return _batch(to=pa.array([0], pa.int32()), heavy=pa.array([True]), blob=pa.array([_pack(heavy)], pa.binary()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if bucket < 0:
                    found.append(tuple(_unpack(blob, "V6", "i8", "i4")[0][1:]))
                    size += len(found[-1][0])
                else:
                    if bucket != now and held:
                        places, heavy = shared(held)
                        found.append(places)
                        size += len(places[0])
                        held = []
                        if len(heavy):
                            yield named(heavy)
                    now = bucket
                    held.append(blob)
                if size > PLACES_HELD:
                    yield packed(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    found, size = [], 0
        if held:
            places, heavy = shared(held)
            found.append(places)
            if len(heavy):
                yield named(heavy)
        if found:
            yield packed(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def by_document(blobs: list[bytes]) -> pa.RecordBatch:
        doc, at = (np.concatenate(c) for c in zip(*(_unpack(x, "i8", "i4")[0] for x in blobs), strict=True))
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
        doc, at = doc[fresh], at[fresh]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(first, len(doc)), pa.int32())
        return _batch(
            doc_id=pa.array(doc[first], pa.int64()), places=pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
            anchor=pa.nulls(len(first), pa.int64()),
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for to, heavy, blob in zip(*(b.column(c).to_pylist() for c in ("to", "heavy", "blob")), strict=True):
                if heavy:
                    (names,), _ = _unpack(blob, "i8")
                    none = len(names)
                    yield _batch(doc_id=pa.nulls(none, pa.int64()), places=pa.nulls(none, pa.list_(pa.int32())), anchor=pa.array(names, pa.int64()))
                    continue
                if to != now and held:
                    yield by_document(held)
                    held = []
                now = to
                held.append(blob)
        if held:
            yield by_document(held)

    met = dealt.mapInArrow(find, "to int, heavy boolean, blob binary").repartition(groups, "to").sortWithinPartitions("to")
    return met.mapInArrow(gather, "doc_id long, places array<int>, anchor long")


def _thinned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with one of ``ids``; the scan is thinned where the ids are few."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs


def segments(placed: DataFrame, buckets: int, heavy: np.ndarray) -> DataFrame:
    """``placed(doc_id, text_key, text, places)`` to packed segments of a bucket.

    Bucket -1 has the spans that are already decided within the chunk.
    """
    split = placed.sparkSession.sparkContext.broadcast(heavy)  # HEAVY_PART hashes a bucket at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places = np.array(b.column("text_key").to_pylist(), np.int64), b.column("places").to_pylist()
            rows = np.array(b.column("doc_id").to_pylist(), np.int64)
            for numbers, texts in _chunks(list(range(b.num_rows)), _texts(b)):
                a = Anchors(texts)
                wanted = [a.start[k] + np.array(places[n], np.int64) for k, n in enumerate(numbers) if len(texts[k])]
                at = np.intersect1d(np.concatenate(wanted), a.at) if wanted else np.zeros(0, np.int64)
                if not len(at):
                    continue
                key_of, at, first, last = a.parts(at, split.value)
                text = np.searchsorted(a.start, at, side="right") - 1
                doc, key = rows[numbers[text]], keys[numbers[text]]
                begin, size = (first - a.start[text]).astype(np.int32), (last - first + SPAN).astype(np.int32)
                whole = a.data.tobytes()
                cut = [whole[f : f + s] for f, s in zip(first.tolist(), size.tolist(), strict=True)]
                # of equal segments of a chunk the least doc_id's goes on; those of greater ids are decided
                least: dict[bytes, int] = {}
                for k in np.lexsort((key, doc)).tolist():
                    least.setdefault(cut[k], k)
                head = np.array([least[c] for c in cut])
                gone = doc > doc[head]
                stays = ~gone
                if gone.any():
                    yield _batch(
                        bucket=pa.array([-1], pa.int32()),
                        blob=pa.array([_pack(doc[gone], key[gone], begin[gone], begin[gone] + size[gone])], pa.binary()),
                    )
                chosen = np.flatnonzero(stays)
                bucket = (key_of[chosen] >> np.uint64(8)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                chosen, bucket = chosen[order], bucket[order]
                edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
                to, blobs = [], []
                for i, j in zip(edge, edge[1:], strict=False):
                    c = chosen[i:j]
                    head_ = (doc[c], key[c], begin[c], size[c], (at[c] - first[c]).astype(np.uint8))
                    raw = np.frombuffer(b"".join(cut[k] for k in c.tolist()), np.uint8)
                    fixed = np.int64(len(c)).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in head_) + raw.tobytes()
                    to.append(int(bucket[i]))
                    blobs.append(np.int64(len(fixed)).tobytes() + pa.compress(fixed, "zstd", asbytes=True))
                if to:
                    yield _batch(bucket=pa.array(to, pa.int32()), blob=pa.array(blobs, pa.binary()))

    return placed.select("doc_id", "text_key", "text", "places").mapInArrow(run, "bucket int, blob binary")


def words_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(suffixes, words) of ``SPAN`` bytes as big-endian words, the last padded with zeros."""
    count = -(-SPAN // 8)
    padded = np.append(data, np.zeros(8 * count, np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * count)[starts]
    out = rows.copy()
    out[:, SPAN:] = 0
    return out.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` words, and the tie groups.

    One word at a time: only members of tied groups are ordered by the next word.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="quicksort")
    group = np.cumsum(np.append(0, words[order[1:], 0] != words[order[:-1], 0])) if n else np.zeros(0, np.int64)
    for d in range(1, depth):
        tied = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1) if n else np.zeros(0, np.int64)
        if not len(tied):
            break
        sub = tied[np.lexsort((words[order[tied], d], group[tied]))]
        order[tied] = order[sub]
        w = words[order, d]
        fresh = np.append(True, (group[1:] != group[:-1]) | ((w[1:] != w[:-1]) & (np.bincount(group, minlength=n)[group][1:] > 1)))
        group = np.cumsum(fresh) - 1
    return order, group


def blind_tries(words: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order the members of each tied group by a blind trie over their deep bytes.

    All tries grow together, a level at a time. A node's members are compared with
    its first member; the least common prefix is the node's depth, and its members
    part by the byte there, the only one that is read. Nodes whose members agree to
    the end are leaves.
    """
    order = order.copy()
    group = group.copy()
    n = len(order)
    live = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1) if n else np.zeros(0, np.int64)
    names = int(group[-1]) + 1 if n else 0
    sort_key: list[np.ndarray] = []
    node = group[live].copy()
    while len(live):
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        mine, head = words[order[live]], words[order[live[np.repeat(first, size)]]]
        differs = mine[:, depth:] ^ head[:, depth:]
        word = (differs != 0).argmax(axis=1)
        x = differs[np.arange(len(live)), word]
        high = np.frexp(np.maximum(x >> np.uint64(11), 1).astype(np.float64))[1] + 11
        high = np.where(x >> np.uint64(11) == 0, np.frexp(np.maximum(x, 1).astype(np.float64))[1], high)
        common = np.where(x == 0, SPAN, 8 * (word + depth) + (64 - high) // 8)
        branch = np.minimum.reduceat(common, first)
        going = np.repeat(branch < SPAN, size)
        if not going.any():
            break
        at = np.repeat(branch, size)[going]
        live, node, mine = live[going], node[going], mine[going]
        byte = (mine[np.arange(len(live)), at // 8] >> (56 - 8 * (at % 8)).astype(np.uint64)) & np.uint64(0xFF)
        sub = np.lexsort((byte, node))
        order[live] = order[live[sub]]
        byte = byte[sub]
        fresh = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))
        child = np.cumsum(fresh) - 1 + names
        names = int(child[-1]) + 1
        group[live] = child
        keep = np.bincount(child - child[0])[child - child[0]] > 1
        live, node = live[keep], child[keep]
    return order, group


def sort_suffixes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order of the suffixes at ``starts`` and their runs of equal ``SPAN`` bytes."""
    words = words_at(data, starts)
    order, group = multikey_quicksort(words, SHALLOW)
    order, group = blind_tries(words, order, group, SHALLOW)
    run = np.cumsum(np.append(0, group[1:] != group[:-1])) if len(group) else group
    return order, run


def removed_spans(doc: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the byte runs removed, in the segments' places."""
    suffixes = size - SPAN + 1
    offset = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(size)), suffixes)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    order, run = sort_suffixes(data, offset[seg] + step)
    gone = np.zeros(len(seg), bool)
    if len(seg):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        least = np.minimum.reduceat(doc[seg[order]], first)
        gone[order] = doc[seg[order]] > least[run]
    hit = np.flatnonzero(gone)
    if not len(hit):
        return hit, hit, hit
    fresh = np.append(True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]]))
    a, b = hit[np.flatnonzero(fresh)], hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
    return seg[a], step[a], step[b] + SPAN


def decide(doc: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, data: bytes) -> tuple[np.ndarray, ...]:
    """(doc, key, start, end) of the runs removed from a bucket's segments.

    Equal segments are one: those of greater doc_ids go whole. Only segments whose
    anchor's bytes stand in another, different segment are sorted.
    """
    offset = np.cumsum(size, dtype=np.int64) - size
    cut = [data[o : o + n] for o, n in zip(offset.tolist(), size.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for k in np.lexsort((key, doc)).tolist():
        least.setdefault(cut[k], k)
    head = np.array([least[c] for c in cut], np.int64)
    gone = doc > doc[head]
    out = [(doc[gone], key[gone], begin[gone], begin[gone] + size[gone])]
    heads = np.unique(head)
    names: dict[bytes, int] = {}
    anchor = np.array([names.setdefault(cut[h][p : p + K], len(names)) for h, p in zip(heads.tolist(), place[heads].tolist(), strict=True)], np.int64)
    chosen = heads[np.bincount(anchor)[anchor] > 1]
    seg, start, end = removed_spans(doc[chosen], size[chosen].astype(np.int64), np.frombuffer(b"".join(cut[h] for h in chosen.tolist()), np.uint8))
    if len(seg):
        # a head's runs hold for its equals in the same document too
        of = chosen[seg]
        rank = np.argsort(head[~gone], kind="stable")
        alike = np.flatnonzero(~gone)[rank]
        lo, hi = np.searchsorted(head[alike], of, "left"), np.searchsorted(head[alike], of, "right")
        run = np.repeat(np.arange(len(of)), hi - lo)
        member = alike[np.repeat(lo, hi - lo) + np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        out.append((doc[member], key[member], begin[member] + start[run], begin[member] + end[run]))
    doc, key, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
    return doc, key, start.astype(np.int32), end.astype(np.int32)


SPANS = "doc_id long, text_key long, start int, end int"


def _span_batch(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return _batch(doc_id=pa.array(doc, pa.int64()), text_key=pa.array(key, pa.int64()), start=pa.array(start, pa.int32()), end=pa.array(end, pa.int32()))


def _dealt(blobs: DataFrame, partitions: int) -> DataFrame:
    """(bucket, blob) in order of buckets; those of bucket -1 go anywhere."""
    to = F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.col("bucket"))
    return blobs.withColumn("to", to).repartition(partitions, "to").sortWithinPartitions("bucket").select("bucket", "blob")


def spans(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, start, end) of removed byte runs, which may overlap; and the table it reads."""
    buckets = BUCKETS_EACH * parallelism(spark)
    met = materialize(spark, shared_anchors(docs.where("doc_id is not null"), buckets), "places")
    heavy = np.array([r.anchor for r in met.where("anchor is not null").select("anchor").collect()], np.uint64)
    places = met.where("doc_id is not null").select("doc_id", "places")
    near = _thinned(docs, places.select("doc_id"))
    placed = near.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(places, "doc_id")

    def bucket_spans(blobs: list[bytes]) -> pa.RecordBatch:
        parts, tails = [], []
        for x in blobs:
            columns, tail = _unpack(x, "i8", "i8", "i4", "i4", "u1")
            parts.append(columns)
            tails.append(tail)
        doc, key, begin, size, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        return _span_batch(*decide(doc, key, begin, size, place, b"".join(tails)))

    def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if bucket < 0:
                    yield _span_batch(*_unpack(blob, "i8", "i8", "i4", "i4")[0])
                    continue
                if bucket != now and held:
                    yield bucket_spans(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield bucket_spans(held)

    cut = _dealt(segments(placed, SEGMENTS_EACH * buckets, heavy), parallelism(spark))
    return cut.mapInArrow(sorted_buckets, SPANS), met


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(text: bytes, runs: list[dict]) -> tuple[int, bytes]:
    """Maximal runs and what is left of a text."""
    kept, at, n = [], 0, 0
    for start, end in sorted((r["start"], r["end"]) for r in runs):
        if start > at or n == 0:
            kept.append(text[at:start])
            n += 1
        at = max(at, end)
    kept.append(text[at:])
    return n, b"".join(kept)


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row a document: what removing repeated ``SPAN``-byte strings leaves.

    A null or empty text has no bytes. Repeated rows share a doc_id, so they remove
    nothing from each other and have equal results. A null doc_id is not smaller
    than any, and none is smaller than it: such rows lose nothing. Extra columns
    are ignored. Empty input, empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone, met = spans(spark, docs)
    found = materialize(spark, gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "runs")
    discard(spark, met)
    hit = found.select("doc_id").distinct()
    near = _thinned(docs, hit)
    touched = near.withColumn("text_key", F.xxhash64("text")).join(found, ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(_texts(b), b.column("runs").to_pylist(), strict=True):
                n, kept = _cut(text, runs)
                rows.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield _batch(doc_id=b.column("doc_id"), n_bytes=pa.array(cols[0], pa.int64()), n_removed=pa.array(cols[1], pa.int64()), n_spans=pa.array(cols[2], pa.int64()), kept_sha256=pa.array(cols[3], pa.string()))

    changed = touched.select("doc_id", "text", "runs").mapInArrow(run, f"doc_id long, {RESULT}")
    whole = F.coalesce("text", F.lit(""))
    same = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.octet_length(whole).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"),
    )
    same = same.join(found.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_anti").drop("text_key")
    return same.unionByName(changed)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated spans removed."""
    return remove_repeats(spark, table(spark, sf_dir, "documents"))
