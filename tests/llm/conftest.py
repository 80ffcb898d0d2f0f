"""Awkward documents: nulls, empties, repeats, ties, long texts and clashing columns."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, digest string, "
    "key long, bands string, text_key long, bucket int, shard int"
)


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "er", "and", "ion", "tha", "ent", "wor", "lic", "öst", "ñan", "ing", "ou"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.replace("the", "teh", 1)
    shared = prose(rng, 30)
    long = "\n".join(prose(rng, 60) for _ in range(150))
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\n "), (7, "a"), (8, f"{prose(rng, 20)} {shared} {prose(rng, 9)}"),
        (9, f"{shared}\n{prose(rng, 25)}"), (10, long), (10, long), (10, "another text of the same id"), (None, base), (None, None),
        (11, "line one here it is\nline two\nline one here it is\nLINE ONE HERE IT IS!\n\nx"), (12, "All Rights Reserved. CC BY, general public license; cc-by"),
        (13, "😀 ñandú É ß   İ ſ <|endoftext|> don't 3.14"), (14, "x" * 70_000), (15, "abcd " * 3000), (2**40, prose(rng, 40)),
    ]
    return [(i, t, "en", "s", 0, 0.5, 1, "d", 2, "b", 3, 4, 5) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
