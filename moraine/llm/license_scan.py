"""Licence scan by a positional rare-token index, in DataFrame functions only.

A template is a whole notice with its label; the key phrases in it, at fixed word
offsets, are mandatory. A place is a word position at which every key phrase of the
template stands; its score is the share of the notice's words that stand in place. Of a template's words,
the ``ANCHORS`` with the highest inverse document frequency over all documents
are its postings ``(word, offset)``. A file's occurrences of those words, shifted
by their offsets and intersected, leave the positions at which the template may
stand; its key phrases are then verified there. Since anchors are words of the key
phrases, every place survives the intersection, whatever the frequencies are.

One narrow pass counts the documents of each template word: the vocabulary is
fixed by ``TEMPLATES``, so its counts are the only rows the driver sees. The scan
itself is row by row and shuffles nothing, so hot sources and copies cost what
their bytes cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import table

ANCHORS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Evidence of a base phrase alone, of 1.
PHRASE_SCORE = 0.5

#: Short licence phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, word by word; [...] marks mandatory phrases and (...) a word of any kind.
NOTICES = {
    "apache-2.0": """[licensed under the apache license version 2 0] the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or
        agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions
        of any kind either express or implied see the license for the specific language governing permissions and limitations under
        the license""",
    "mit": """[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind""",
    "bsd": """[redistribution and use in source and binary forms with or without modification are permitted] provided that the following
        conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution""",
    "isc": """[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl-2.0": """this source code form is [subject to the terms of the mozilla public license] v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public
        license] as published by the free software foundation either version (...) (...) of the license or at your option any later
        version""",
    "agpl": """this program is free software you can redistribute it and or modify it under the terms of the [gnu affero general public
        license] as published by the free software foundation either version 3 of the license or at your option any later version""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it [under the terms of the gnu general public
        license] as published by the free software foundation either version (...) of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "cc-by-sa": "this work is licensed under a [creative commons attribution] (...) (...) (...) [sharealike] (...) (...) license",
    "cc-license": "this work is licensed under a [creative commons attribution] (...) (...) international license",
    "cc0": """to the extent possible under law (...) (...) has waived all copyright and related or neighboring rights to this work
        [no rights reserved]""",
    "unlicense": """this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means""",
    "public-domain": "[released into the public domain]",
    "no-warranty": "the software is [provided as is without warranty of any kind] express or implied",
    "zlib": """[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for
        any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely""",
    "copyright": "[copyright c] (...)",
    "spdx": "[spdx license identifier] (...)",
    "permission": "[used with permission]",
    "licensed-under": "[licensed under]",
}

GAP = "(...)"


def _phrases(notice: str) -> list[tuple[int, list[str]]]:
    """Mandatory phrases of a notice, as (offset, words)."""
    out: list[tuple[int, list[str]]] = []
    inside = False
    for at, word in enumerate(notice.split()):
        if word.startswith("["):
            inside = True
            out.append((at, []))
        if inside:
            out[-1][1].append(word.strip("[]"))
        inside &= not word.endswith("]")
    return out


#: (label, whether it is a base one, key phrases, words of the whole notice, None where any word stands)
TEMPLATES = [(label, True, [(0, text.split())], text.split()) for text, label in BASE.items()] + [
    (label, False, _phrases(text), [None if w == GAP else w.strip("[]") for w in text.split()]) for label, text in NOTICES.items()
]


def vocabulary() -> list[str]:
    """Every word of a key phrase, sorted."""
    return sorted({w for _, _, phrases, _ in TEMPLATES for _, words in phrases for w in words})


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """In how many documents each template word stands, over all documents."""
    vocab = vocabulary()
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocab)))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocab}


def postings(frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Of each template, its rarest words with their offsets."""
    out = []
    for _, _, phrases, _ in TEMPLATES:
        at = {w: off + i for off, words in reversed(phrases) for i, w in reversed(list(enumerate(words)))}
        out.append(sorted(at.items(), key=lambda x: (frequency[x[0]], x[1]))[:ANCHORS])
    return out


def _places(template: tuple, anchors: list[tuple[str, int]]) -> Column:
    """Starts of a template: anchor positions intersected, then verified.

    A notice that is cut off at its beginning starts before the text's first word.
    """

    def shifted(word: str, off: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == F.lit(word)), lambda h: h["at"] - F.lit(off))

    starts = [shifted(word, off) for word, off in anchors]
    common = reduce(F.array_intersect, starts) if len(starts) > 1 else F.array_distinct(starts[0])

    def stands(p: Column) -> Column:
        ok = p + template[2][0][0] >= 0
        for off, words in template[2]:
            ok = ok & (F.slice("words", F.greatest(p + off, F.lit(0)) + 1, len(words)) == F.array(*map(F.lit, words)))
        return ok

    return F.filter(common, stands)


def _share(place: str, template: tuple) -> Column:
    """The best share of a notice's words that stand in place at one of its starts."""
    words = template[3]
    n = sum(w is not None for w in words)
    notice = F.array(*[F.lit(w).cast("string") for w in words])
    in_place = lambda p: F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda k: (p + k >= 0) & (F.get("words", p + k) == F.get(notice, k)))
    return F.when(F.size(place) > 0, F.array_max(F.transform(place, lambda p: F.size(in_place(p)) / F.lit(float(n)))))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document with its licence places and labels.

    A null or empty text has no words, null positions, empty labels and score 0.
    A document may repeat; each row is scanned on its own. Extra columns of any
    name are ignored. Score: the greatest share of a notice's words that stand in
    place, ``PHRASE_SCORE`` at least with a base phrase, 0 with nothing.
    """
    anchors = postings(document_frequency(docs))
    index = sorted({w for a in anchors for w, _ in a})
    hit = F.transform("words", lambda w, i: F.when(w.isin(index), F.struct(w.alias("word"), i.alias("at"))))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("hits", F.array_compact(hit))
    names = [f"t{i}" for i in range(len(TEMPLATES))]
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        *[
            F.when(F.size("hits") > 0, _places(t, a)).otherwise(F.array().cast("array<int>")).alias(n)
            for n, t, a in zip(names, TEMPLATES, anchors, strict=True)
        ],
    )
    base = [(n, t[0]) for n, t in zip(names, TEMPLATES, strict=True) if t[1]]
    own = [(n, t[0]) for n, t in zip(names, TEMPLATES, strict=True) if not t[1]]
    all_base = F.concat(*[F.col(n) for n, _ in base])

    def labels(of: list[tuple[str, str]]) -> Column:
        found = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in of]))
        return F.array_join(F.array_sort(F.array_distinct(found)), ",")

    shares = [_share(n, t) for n, t in zip(names, TEMPLATES, strict=True) if not t[1]]
    return rows.select(
        "doc_id",
        "n_words",
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base + own).alias("labels"),
        F.coalesce(F.greatest(*shares, F.when(F.size(all_base) > 0, F.lit(PHRASE_SCORE))), F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL: every phrase tested at every word position."""

    def places(phrases: list[tuple[int, list[str]]]) -> str:
        first = phrases[0][0]
        tests = [f"w[i + {off - first + k + 1}] = '{word}'" for off, words in phrases for k, word in enumerate(words)]
        found = f"list_filter(range(len(w)), lambda i: {' AND '.join(tests)})"
        return f"list_transform({found}, lambda i: i - {first})" if first else found

    def share(place: str, words: list[str | None]) -> str:
        notice = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
        hit = f"len(list_filter(range({len(words)}), lambda k: p + k >= 0 AND w[p + k + 1] = ([{notice}])[k + 1]))"
        return f"list_max(list_transform({place}, lambda p: {hit} / {sum(x is not None for x in words)}.0::DOUBLE))"

    cols = ", ".join(f"{places(p)} AS t{i}" for i, (_, _, p, _) in enumerate(TEMPLATES))
    names = [(f"t{i}", t[0], t[1]) for i, t in enumerate(TEMPLATES)]
    base = "list_concat(" + "list_concat(t0, t1), t2)"

    def labels(of: list[tuple[str, str, bool]]) -> str:
        cases = ", ".join(f"CASE WHEN len({n}) > 0 THEN '{label}' END" for n, label, _ in of)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ','), '')"

    shares = ", ".join(share(f"t{i}", t[3]) for i, t in enumerate(TEMPLATES) if not t[1])
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), places AS (SELECT doc_id, w, len(w) AS n_words, {cols} FROM words),
base AS (SELECT *, {base} AS b FROM places)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base,
  CAST(list_min(b) AS BIGINT) AS first_word, CAST(list_max(b) AS BIGINT) AS last_word,
  {labels([n for n in names if n[2]])} AS base_labels, {labels(names)} AS labels,
  coalesce(greatest({shares}, CASE WHEN len(b) > 0 THEN {PHRASE_SCORE}::DOUBLE END), 0.0::DOUBLE) AS score
FROM base"""
