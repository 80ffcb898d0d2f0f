"""Toxicity by Levenshtein automata over a learned lexicon trie.

Learning: among a bounded sample of labelled training rows, a word prefix (or a
whole word) is a term if it stands in enough toxic documents and in almost no
others. Of the prefixes along a trie path, the longest that keeps the support of
the shortest is the term, so an inflected stem stays a stem and a fixed word
becomes a whole word.

Scanning: the trie is intersected with the Levenshtein automaton of one edit into
one lazily determinised automaton; a word is read letter by letter and most words
die within a few letters. A term's window of words decides whether it is quoted:
inside quotation marks, or shortly after a word of reporting. Plain and quoted,
exact and misspelled terms are separate features of a logistic model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import batch_of, discard, materialize, table, type_of

FOLDS = 5
#: Labelled training rows used, at most: those of least hash.
FIT_ROWS = 16_000
#: A term stands in this share of the toxic training rows at least, and in MIN_TERM_ROWS.
MIN_SHARE, MIN_TERM_ROWS = 0.02, 5
#: Of the rows with a term, this share at least is toxic.
MIN_PRECISION = 0.97
#: Letters of the prefixes considered.
PREFIXES = range(3, 13)
#: A deeper prefix with this share of the support replaces the shallower one.
KEEP_SUPPORT = 0.9
#: Only terms of this length may be misspelled, by one edit.
FUZZY_LENGTH = 5
#: Words before a term searched for reporting words.
WINDOW = 4
END = "$"
#: Marks of quotation, and words of reporting in English, French, German and Spanish.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
REPORTING = {
    "said", "says", "say", "called", "quoted", "wrote", "writes", "word", "term", "phrase", "reported", "titled",
    "dit", "disait", "appelé", "appelée", "cité", "écrit", "écrivait", "mot", "terme", "intitulé",
    "sagte", "sagt", "nannte", "genannt", "zitierte", "schrieb", "schreibt", "wort", "begriff", "ausdruck",
    "dijo", "dice", "llamó", "llamado", "citó", "escribió", "escribe", "palabra", "término", "titulado",
}
WORD = regex.compile(r"\w+|[\"“”«»„]")
FEATURES = ("exact", "fuzzy", "quoted", "distinct")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Automaton:
    """Trie of terms intersected with up to one edit; states are made on demand.

    A state is a set of (trie node, edits used, exact prefix); a term ending in
    ``END`` matches whole words only, others match any word they begin.
    """

    terms: dict[str, float]
    edges: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, str] = field(default_factory=dict)
    far: list[bool] = field(default_factory=lambda: [False])

    def __post_init__(self) -> None:
        for term in sorted(self.terms):
            at = 0
            for c in term:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    self.far.append(False)
                at = nxt
                self.far[at] |= len(term.rstrip(END)) >= FUZZY_LENGTH
            self.ends[at] = term
        self.far[0] = any(self.far)
        self.start = self._close({(0, 0)})
        self.memo: dict[tuple[frozenset, str], frozenset] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """Letters of the term that the word leaves out."""
        out = set(states)
        for node, used in states:
            if not used:
                out |= {(n, 1) for c, n in self.edges[node].items() if c != END and self.far[n] and node}
        return frozenset(out)

    def step(self, state: frozenset, letter: str) -> frozenset:
        key = (state, letter)
        if key in self.memo:
            return self.memo[key]
        out: set[tuple[int, int]] = set()
        for node, used in state:
            if (nxt := self.edges[node].get(letter)) is not None:
                out.add((nxt, used))
            if not used and self.far[node] and node:  # the first letter must be right
                out.add((node, 1))
                out |= {(n, 1) for c, n in self.edges[node].items() if c != END and self.far[n]}
        self.memo[key] = found = self._close(out)
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the word is or begins with, and the edits; fewest first."""
        best: tuple[int, str] | None = None
        state = self.start
        for at, letter in enumerate(word + END, 1):
            state = self.step(state, letter)
            if not state:
                break
            for node, used in state:
                term = self.ends.get(node)
                # a misspelled stem must be the whole word
                if term and (letter == END if term.endswith(END) else not used or at == len(word)) and (best is None or (used, term) < best):
                    best = (used, term)
            if best and best[0] == 0:
                break
        return (best[1], best[0]) if best else None


def _terms(text: str | None) -> set[str]:
    """A text's distinct words, marked as whole, and their prefixes."""
    words = set(words_of(text))
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n} | {w + END for w in words if len(w) > 2}


def term_counts(texts: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """``texts(text)`` to (term, n): rows with each term, of all or of ``only``."""

    def flush(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(_terms(text) if only is None else only & _terms(text))
                if len(counts) >= 50_000:
                    yield flush(counts)
        yield flush(counts)

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose_terms(counts: list[tuple[str, int, int]], toxic_rows: int) -> dict[str, float]:
    """Terms with their support, along each trie path the longest of full support."""
    least = max(MIN_TERM_ROWS, math.ceil(MIN_SHARE * toxic_rows))
    good = {t: n1 for t, n1, n0 in counts if n1 >= least and n1 >= MIN_PRECISION * (n1 + n0)}
    chosen: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        if any(term.startswith(c.rstrip(END)) for c in chosen):
            continue
        while deeper := [t for t in good if len(t) == len(term) + 1 and t.startswith(term) and good[t] >= KEEP_SUPPORT * good[term]]:
            term = min(deeper)
        chosen[term] = float(good[term])
    return chosen


def features(text: str | None, automaton: Automaton) -> tuple[int, int, int, int]:
    """Counts of exact, misspelled and quoted terms, and distinct plain ones."""
    if not automaton.terms:
        return 0, 0, 0, 0
    words = words_of(text)
    known = {w: m for w in set(words) if (m := automaton.match(w))}
    if not known:
        return 0, 0, 0, 0
    exact = fuzzy = quoted = 0
    plain: set[str] = set()
    closing = None
    for at, w in enumerate(words):
        if closing:
            closing = None if w == closing else closing
        elif w in QUOTES and QUOTES[w] in words[at + 1 : at + 60]:
            closing = QUOTES[w]
        if w in known:
            term, edits = known[w]
            if closing or REPORTING.intersection(words[max(0, at - WINDOW) : at]):
                quoted += 1
            else:
                exact, fuzzy = exact + (not edits), fuzzy + bool(edits)
                plain.add(term)
    return exact, fuzzy, quoted, len(plain)


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.minimum(x[:, 0], 1), np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2]), np.log1p(x[:, 3])])


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; without both classes, weights of 0 but the bias."""
    d = _design(x.astype(float))
    w = np.zeros(d.shape[1])
    if len(set(y.tolist())) < 2:
        w[0] = -5.0
        return w
    penalty = np.full(d.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, ``most`` at most."""
    key = F.col("doc_id").cast("string")
    labels = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(key.cast("binary")) % FOLDS != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most ``most`` rows are broadcast


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Automaton, np.ndarray]:
    """Lexicon and weights from the training rows."""
    rows = materialize(docs.sparkSession, training_rows(docs, labels), "training")
    toxic = rows.where("toxic = 1").count()
    least = max(MIN_TERM_ROWS, math.ceil(MIN_SHARE * toxic))
    # a term kept stands in MIN_SHARE of the toxic rows, so these are at most a row's terms / MIN_SHARE
    bad = {r.term: r.n for r in term_counts(rows.where("toxic = 1")).where(F.col("n") >= least).collect()}
    fine = {r.term: r.n for r in term_counts(rows.where("toxic = 0"), frozenset(bad)).collect()}
    automaton = Automaton(choose_terms([(t, n, fine.get(t, 0)) for t, n in bad.items()], toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, automaton) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(FEATURES))
            yield batch_of(**{f: pa.array(x[:, k]) for k, f in enumerate(FEATURES)}, toxic=b.column("toxic"))

    found = rows.mapInArrow(run, ", ".join(f"{f} long" for f in FEATURES) + ", toxic int").groupBy(*FEATURES, "toxic").count().collect()
    discard(docs.sparkSession, rows)
    x = np.array([[r[f] for f in FEATURES] for r in found for _ in range(r["count"])]).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] for r in found for _ in range(r["count"])])
    return automaton, fit_weights(x, y)


def _scores(texts: list[str | None], automaton: Automaton, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([features(t, automaton) for t in texts], float).reshape(-1, len(FEATURES))
    return x, 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows predicted to be toxic.

    Null and empty texts have the score of a text without terms; repeated rows stay
    or go together. Without labels of both classes all rows stay.
    """
    automaton, weights = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, score = _scores(b.column("text").to_pylist(), automaton, weights)
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document with its held-out flag, score and prediction.

    A null or empty text has the score of a text without terms. Repeated rows each
    give a row; a null doc_id is not held out. Without labels of both classes
    every score is low. Extra columns are ignored.
    """
    automaton, weights = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, score = _scores(b.column("text").to_pylist(), automaton, weights)
            counts = {f"n_{f}": pa.array(np.ascontiguousarray(x[:, k], np.int64)) for k, f in enumerate(FEATURES)}
            yield batch_of(doc_id=b.column("doc_id"), **counts, score=pa.array(score))

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, " + ", ".join(f"n_{f} long" for f in FEATURES) + ", score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[f"n_{f}" for f in FEATURES]
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
