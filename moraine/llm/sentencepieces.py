"""SentencePiece encoding and decoding through a table of distinct chunks.

White space is written as a marker, and a text is cut before each run of markers. Where no
piece of the model holds a marker behind another letter, no merge can cross such a
cut. So each distinct chunk (a word with its markers) is segmented once, by exact merging, and decoded
once from its ids; a text's ids and decoded text are joined from the table by position. A model
with a piece across markers has whole texts as chunks, and stays exact.

The model file is a parameter: a BPE model with the identity normaliser, with or without
byte fallback. Others are an error, not an approximation.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from moraine.llm.common import batch_of, runs, table, type_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks kept with their ids in a task; the table is emptied beyond that.
CHUNKS_KEPT = 300_000
#: Longer chunks are segmented anew each time they appear, not kept.
LONGEST_KEPT = 200
#: Characters whose rows are held at once.
RUN = 2_000_000
#: Chunks of so few symbols are merged by looking at all pairs, longer ones with a heap.
FEW = 40
#: The file's field numbers, piece kinds and the BPE model's number.
PIECES, TRAINER, NORMALIZER, MODEL_TYPE = 1, 2, 3, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
BYTE_FALLBACK, SUFFIX_MARK, UNKNOWN_SURFACE = 35, 24, 44
NORMALIZER_NAME, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 1, 3, 4, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Encoder and decoder of one model file, with its table of distinct chunks."""

    def __init__(self, data: bytes, kept: int = CHUNKS_KEPT) -> None:
        self.kept = kept
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == PIECES:
                pieces.append(dict(_fields(value)))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        self.texts = [p[1].decode() for p in pieces]
        plain = trainer.get(MODEL_TYPE, 1) == BPE and not trainer.get(SUFFIX_MARK, 0) and USER_DEFINED not in kinds and UNUSED not in kinds
        if not plain or normalizer.get(NORMALIZER_NAME) != b"identity" or normalizer.get(REMOVE_EXTRA, 1) or not normalizer.get(ESCAPE, 1):
            raise ValueError("only BPE models of normal pieces with the identity normaliser and marked white space")
        self.prefix = MARK if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.unknown_surface = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode()).decode()
        self.unknown = kinds.index(UNKNOWN)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        # The best piece has the greatest score; equal scores are one rank, and the leftmost of them goes first.
        scores = {t: struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0 for t, i in self.ids.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {t: rank[s] for t, s in scores.items()}
        self.bytes = {int(self.texts[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.begin, self.end = self.texts.index("<s>"), self.texts.index("</s>")
        self.crosses = any(MARK in t.lstrip(MARK) for t in self.ids)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[bytes, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The marked text, cut before each run of markers."""
        if not text:
            return []
        if self.crosses:
            return [self.prefix + text.replace(" ", MARK)]
        if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        return self.cut.findall(self.prefix + text.replace(" ", MARK))

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact BPE: always the leftmost of the best pairs."""
        if len(symbols) > FEW:
            return self._merged_long(symbols)
        rank = self.rank.get
        worst = len(self.rank)
        ranks = [rank(a + b, worst) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < worst:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], worst)
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], worst)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same in n log n: a heap of pairs over linked symbols; pairs that changed meanwhile are passed over."""
        rank, n = self.rank.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, at, a + b) for at, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, piece = heapq.heappop(heap)
            right = after[at]
            if right >= n or not symbols[at] or symbols[at] + symbols[right] != piece:
                continue
            symbols[at], symbols[right] = piece, ""
            after[at] = following = after[right]
            if following < n:
                before[following] = at
                if (r := rank(piece + symbols[following])) is not None:
                    heapq.heappush(heap, (r, at, piece + symbols[following]))
            if (left := before[at]) >= 0 and (r := rank(symbols[left] + piece)) is not None:
                heapq.heappush(heap, (r, left, symbols[left] + piece))
        return [s for s in symbols if s]

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk; letters without a piece become their bytes, or unknown."""
        if (whole := self.ids.get(chunk)) is not None and len(chunk) == 1:
            return [whole]
        out: list[int] = []
        for piece in self.merged(list(chunk)):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def spelled(self, ids: list[int]) -> str:
        """Text of ids with spaces for markers: bytes that are no UTF-8 are replaced one by one, control ids are silent."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if (byte := self.byte_of.get(i)) is not None:
                run.append(byte)
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_letter(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i >= 0 and i not in self.silent:
                out.append(self.unknown_surface if i == self.unknown else self.texts[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, without the marker that encoding puts first."""
        first = next((i for i in ids if i not in self.silent), self.unknown)
        marked = self.prefix and first not in self.byte_of and self.texts[first].startswith(MARK)
        return self.spelled(ids)[1 if marked else 0 :]

    def looked_up(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text, joined from the table of the batch's distinct chunks."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
        known, once = self.known, {}
        for c in set().union(*cut).difference(known):
            ids = self.segment(c)
            row = (struct.pack(f"<{len(ids)}I", *ids), self.spelled(ids))
            (known if len(c) <= LONGEST_KEPT else once)[c] = row
        found = {**known, **once} if once else known
        first, last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        for chunks in cut:
            rows = [found[c] for c in chunks]
            yield b"".join([first, *[r[0] for r in rows], last]), "".join([r[1] for r in rows])[len(self.prefix) :]


def _is_letter(run: bytearray) -> bool:
    try:
        return len(run.decode()) == 1
    except UnicodeDecodeError:
        return False


def read_model(path: str) -> bytes:
    """A model file's bytes, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, kept: int = CHUNKS_KEPT) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string): whole texts, there and back.

    Ids begin and end with the model's own. A null or empty text has these two alone and
    decodes to empty text. Rows are independent: repeated rows each give a row, null ids stay null, extra columns are ignored, an empty
    table gives an empty one. A task keeps at most ``kept`` chunks and a run's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Model(sent.value, kept)
        for b in batches:
            for at, texts in runs(b.column("text").to_pylist(), RUN // 4):
                rows = list(codec.looked_up(texts))
                sizes = [len(ids) // 4 for ids, _ in rows]
                flat = np.frombuffer(b"".join([ids for ids, _ in rows]), "<u4").astype(np.int32)
                yield batch_of(
                    doc_id=b.column("doc_id").slice(at, len(texts)), n_tokens=pa.array(sizes, pa.int64()),
                    ids=pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32())),
                    decoded=pa.array([text for _, text in rows], pa.string()),
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_tokens long, ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, decoded) of rows of (doc_id, ids): any ids of the model; null ids decode to empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Model(sent.value)
        for b in batches:
            decoded = [codec.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield batch_of(doc_id=b.column("doc_id"), decoded=pa.array(decoded, pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {type_of(encoded, 'doc_id')}, decoded string")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """One row a document: count and digests of its ids and of the text decoded from them; odd rows as in ``encode_documents``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Model(sent.value)
        sha = hashlib.sha256
        for b in batches:
            for at, texts in runs(b.column("text").to_pylist(), RUN):
                rows = [(len(ids) // 4, sha(ids).hexdigest(), sha(text.encode()).hexdigest()) for ids, text in codec.looked_up(texts)]
                counts, of_ids, of_text = zip(*rows, strict=True)
                yield batch_of(
                    doc_id=b.column("doc_id").slice(at, len(texts)), n_tokens=pa.array(counts, pa.int64()),
                    ids_sha256=pa.array(of_ids), decoded_sha256=pa.array(of_text),
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded with the piece model."""
    return encode_digests(table(spark, sf_dir, "documents"), read_model(default_path()))
