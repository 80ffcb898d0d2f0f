"""BPE encoding and decoding by speculation and verification.

A word's greedy longest-match tokens are its exact BPE tokens if and only if every
adjacent pair of them is: encoding the two tokens' joined text gives the pair
back. So each batch's distinct words are segmented greedily, all their adjacent
pairs are tested at once against the pairs known to hold, the few unknown pairs
are settled by merging, and only words with a failing pair are merged exactly.

The vocabulary file is a parameter. Its special strings are taken out of a text
first; the rest is composed (NFC), white space becomes single spaces, and letters
are lowered one by one, as the file's normaliser says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from moraine.llm.common import batch_of, table, type_of

VOCABULARY = "word_bpe_49k.json"
#: Words kept with their tokens in a task; the memory is emptied beyond that.
WORDS_KEPT = 400_000
#: Pairs known to hold or to fail; both are emptied beyond that.
PAIRS_KEPT = 1_000_000
#: Words of so few symbols are merged by looking at all ranks, longer ones with a heap.
FEW = 64
#: Characters whose ids are held at once.
RUN = 1_000_000
#: And where digests alone are kept.
DIGEST_RUN = 4_000_000
#: The characters with Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pieces of a chunk, with the letters and numbers of ``classes`` put in.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^ {L}{N}]+"
#: Letters and numbers that Unicode 16 added to 15.1, as first and last code point.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
#: Marks younger than Unicode 9, by whose tables the library composes: it neither orders nor joins them.
MARKS_AFTER_9 = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF),
]
#: Lower case that Unicode 16 and 17 added; the library lowers by 17.
LOWER_17 = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
END = "</w>"
NO_RANK = 1 << 30
#: Marks a special string among chunks, which hold no white space.
SPECIAL = " "
#: Characters that Python takes for white space and Unicode does not.
NOT_SPACE = re.compile("[\\x1c-\\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


def composed(text: str) -> str:
    """NFC by Unicode 9: younger marks stand where they are, and text is composed between them."""
    return "".join(unicodedata.normalize("NFC", part) for part in YOUNGER.split(text))


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


YOUNGER = re.compile(f"([{_class(MARKS_AFTER_9)}])")
#: Characters that need more than Python's own composition and lower case.
RARE = re.compile(f"[Σ{_class(MARKS_AFTER_9)}{_class([(c, c) for c in LOWER_17])}]")


@cache
def classes() -> dict[str, str]:
    """Letters (L) and numbers (N) of Unicode 16, which the library knows, as ranges of a pattern's class.

    A pattern module's own classes follow its version, so they are not used.
    """
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    out = {}
    for kind, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
        inside = kinds == ord(kind)
        for first, last in added:
            inside[first : last + 1] = True
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        out[kind] = _class(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


def vocabulary(path: str) -> tuple[bytes, dict[str, str]]:
    """What an encoder is made of: a vocabulary file's bytes, and the letters and numbers."""
    with open(path, "rb") as f:
        return f.read(), classes()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, made_of: tuple[bytes, dict[str, str]], kept: int = WORDS_KEPT) -> None:
        self.kept = kept
        spec = json.loads(made_of[0])
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.spelled = np.full(max(self.tokens, default=-1) + 1, None, dtype=object)
        self.spelled[list(self.tokens)] = list(self.tokens.values())
        self.longest = max(len(t) - (len(END) if t.endswith(END) else 0) for t in self.ids)
        self.letters = byte_letters()
        self.table = {i: c for i, c in enumerate(self.letters)}
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in self.ids.items() if t.endswith(END)}
        self.good: set[int] = set()
        self.bad: set[int] = set()
        self.words: dict[str, tuple[int, str]] = {}
        self.chunk: dict[str, tuple[int, str]] = {}
        self.split_special = regex.compile(f"({'|'.join(map(regex.escape, self.special))})") if self.special else None
        self.space = regex.compile(f"[{SPACE}]+")
        self.pieces = re.compile(PIECES.format(**made_of[1]))

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        if not text.isascii():
            if RARE.search(text):
                text = composed(text).replace("Σ", "σ").translate(LOWER_17)
            else:
                text = unicodedata.normalize("NFC", text)
        if NOT_SPACE.search(text):
            return [c for c in self.space.split(text.lower()) if c]
        return text.lower().split()

    def segments(self, text: str) -> list[str]:
        """Special strings, and the chunks between them."""
        if not self.split_special or not self.split_special.search(text):
            return self.chunks(text)
        out = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [SPECIAL + part] if k % 2 else self.chunks(part)
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact BPE: always the first of the lowest-ranked pairs."""
        if len(symbols) > FEW:
            return self._merge_long(symbols)
        get = self.ranks.get
        ranks = [get(p, NO_RANK) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_RANK:
            at = ranks.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((symbols[at - 1], symbols[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = get((symbols[at], symbols[at + 1]), NO_RANK)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same in n log n: a heap of ranks and places over linked symbols; what changed meanwhile is passed over."""
        get, n = self.ranks.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, at) for at, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            if (right := after[at]) >= n or get((symbols[at], symbols[right])) != rank:
                continue
            symbols[at] += symbols[right]
            symbols[right] = ""
            after[at] = further = after[right]
            if further < n:
                before[further] = at
                if (r := get((symbols[at], symbols[further]))) is not None:
                    heapq.heappush(heap, (r, at))
            if (left := before[at]) >= 0 and (r := get((symbols[left], symbols[at]))) is not None:
                heapq.heappush(heap, (r, left))
        return [s for s in symbols if s]

    def exact(self, word: str) -> list[int]:
        """Ids of a word of byte letters, by merging; symbols without an id go."""
        found = self.merge([*word[:-1], word[-1] + END])
        return [self.ids[t] for t in found if t in self.ids]

    def greedy(self, word: str) -> list[int] | None:
        """Longest tokens from the left; None where no token matches."""
        out, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            if n - at <= longest and (rest := final.get(word[at:])) is not None:
                out.append(rest)
                return out
            for end in range(min(n - 1, at + longest), at, -1):
                if (i := inner.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return None
        return out

    def holds(self, left: int, right: int) -> bool:
        """Whether the pair's joined text is encoded as the pair."""
        a, b = self.tokens[left], self.tokens[right]
        symbols = [*a, *(b[: -len(END)] if b.endswith(END) else b)]
        if b.endswith(END):
            symbols[-1] += END
        return self.merge(symbols) == [a, b]

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words into ``self.words``."""
        letters = [w.encode().decode("latin-1").translate(self.table) for w in words]
        proposed = [self.greedy(w) for w in letters]
        flat = np.array([i for p in proposed if p for i in p], dtype=np.int64)
        sizes = np.array([len(p) if p else 0 for p in proposed], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        pairs = (flat[:-1] << 20 | flat[1:])[owner[:-1] == owner[1:]] if len(flat) else flat
        of = owner[:-1][owner[:-1] == owner[1:]] if len(flat) else owner
        distinct, where = np.unique(pairs, return_inverse=True)
        for p in distinct.tolist():
            if p not in self.good and p not in self.bad:
                (self.good if self.holds(p >> 20, p & 0xFFFFF) else self.bad).add(p)
        fails = np.array([p in self.bad for p in distinct.tolist()], dtype=bool)
        failing = set(of[fails[where]].tolist()) if len(distinct) else set()
        for k, (word, spelled, ids) in enumerate(zip(words, letters, proposed, strict=True)):
            if ids is None or k in failing:
                ids = self.exact(spelled)
            self.words[word] = (len(ids), " ".join(map(str, ids)))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Split a batch's texts and encode their new chunks together."""
        split = [self.segments(t) for t in texts]
        if len(self.chunk) > self.kept:
            self.chunk.clear()
            self.words.clear()
        if len(self.good) + len(self.bad) > PAIRS_KEPT:
            self.good.clear()
            self.bad.clear()
        fresh = set().union(*split).difference(self.chunk)
        pieces = {c: self.pieces.findall(c) for c in fresh if c[0] != SPECIAL}
        if new := set().union(*pieces.values()).difference(self.words):
            self.learn(list(new))
        for c in fresh:
            if c[0] == SPECIAL:
                self.chunk[c] = (1, str(self.special[c[1:]]))
            elif len(pieces[c]) == 1:
                self.chunk[c] = self.words[c]
            else:
                counts, ids = zip(*map(self.words.__getitem__, pieces[c]), strict=True)
                self.chunk[c] = (sum(counts), " ".join(filter(None, ids)))
        return split

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str]]:
        """(count, ids) of each text; ids joined by spaces."""
        known, out = self.chunk, []
        for s in self.prepare(texts):
            if s:
                counts, ids = zip(*map(known.__getitem__, s), strict=True)
                out.append((sum(counts), " ".join(filter(None, ids) if 0 in counts else ids)))
            else:
                out.append((0, ""))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Tokens joined by spaces, special ones too, as the file has no decoder."""
        return " ".join(self.spelled[np.asarray(ids, np.int64)].tolist())


def _array(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32)


def _runs(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``most`` characters, each with its first place."""
    run, size, at = [], 0, 0
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield at, run
            run, size, at = [], 0, k + 1
    if run:
        yield at, run


def _sent(docs: DataFrame, path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # one file of a few MB


def encode_documents(docs: DataFrame, path: str, kept: int = WORDS_KEPT) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string): whole texts, there and back.

    The text is decoded from the ids. A null or empty text has no tokens and decodes
    to empty text. Rows are independent, so repeated rows each give a row; null ids
    stay null; extra columns are ignored; an empty table gives an empty one. A task
    keeps at most ``kept`` words and a run's. The vocabulary is read on the driver.
    """
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, kept)
        for b in batches:
            for at, texts in _runs(b.column("text").to_pylist(), RUN):
                rows = codec.encode_batch(texts)
                ids = [_array(r[1]) for r in rows]
                ends = np.cumsum([0, *map(len, ids)])
                yield batch_of(
                    doc_id=b.column("doc_id").slice(at, len(texts)), n_tokens=pa.array([r[0] for r in rows], pa.int64()),
                    ids=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())),
                    decoded=pa.array([codec.decode(i) for i in ids], pa.string()),
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: token count and digests of its ids and of the text decoded from them.

    A null or empty text has no tokens; its digests are those of empty text.
    Repeated rows each give a row, null ids stay null, extra columns are ignored; an
    empty table gives an empty one. Rows are independent; a task keeps at most
    ``WORDS_KEPT`` words and a run's.
    """
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        sha = hashlib.sha256
        for b in batches:
            for at, texts in _runs(b.column("text").to_pylist(), DIGEST_RUN):
                rows = codec.encode_batch(texts)
                yield batch_of(
                    doc_id=b.column("doc_id").slice(at, len(texts)), n_tokens=pa.array([n for n, _ in rows], pa.int64()),
                    ids_sha256=pa.array([sha(ids.encode()).hexdigest() for _, ids in rows]),
                    decoded_sha256=pa.array([sha(codec.decode(_array(ids)).encode()).hexdigest() for _, ids in rows]),
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded with the word vocabulary."""
    return encode_digests(table(spark, sf_dir, "documents"), default_path())
