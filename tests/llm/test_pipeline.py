"""The whole pipeline against plain programs, a stage at a time."""

import random

import corpus_pipeline
from moraine.llm import bpe, toxicity
from pyspark.sql import functions as F
from test_pairs import brute_lines, brute_share, closure, fingerprint, key


def corpus(rng):
    """Documents with abuse, copies, near copies, shared lines, benchmark items, and odd rows."""
    pool = [f"{a}{b}" for a in ("mor", "tal", "sen", "vir", "lun", "dar") for b in ("an", "el", "is", "om", "ur", "et")]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, f"In year {1900 + k} Anna bought {k + 3} apples and Bob sold {k + 5} pears, so {prose(6)} was how many?") for k in range(4)]
    docs, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        lines = [prose(rng.randrange(6, 24)) for _ in range(rng.randrange(1, 6))]
        if bad:
            lines[0] += " you idiot " + prose(2) + " what a moron"
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(bad)))
    shared = "all of these words stand together as one line in very many of the documents here"
    docs += [(1000 + k, f"{shared}{'.' * k}\n{prose(20)}") for k in range(6)]
    docs += [(1100 + k, docs[1][1]) for k in range(3)]
    base = prose(400)
    docs += [(1200, base), (1201, f"{base} {pool[0]}"), (1202, f"{prose(30)}\n{items[2][1]}"), (1203, items[1][1].replace("Anna", "Dora").replace("1901", "1955"))]
    docs += [(1300, None), (1301, ""), (1302, "x"), (None, prose(9)), (None, None), (1302, "x"), (2**60 + 1, prose(15))]
    return docs, labels, items


def test_pipeline_equals_plain_programs(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = corpus(random.Random(14))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    frame = frame.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # abuse: rows that the scorer predicts, whose own tests are against edit distances and held-out labels
    scored = toxicity.score_documents(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert {i for i, bad in labels if bad} <= toxic | {None} and len(toxic) < 110
    left = [(i, t) for i, t in docs if i not in toxic]

    # lines: every line that another one stands for goes, and texts without any line left
    gone = brute_lines([(i, key(t), n, line) for i, t in left for n, line in enumerate((t or "").split("\n")) if line.strip()])
    out = []
    for i, t in left:
        mine = {n for a, k, n in gone if a == i and k == key(t)}
        kept = t if not mine else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in mine)
        if not mine or kept.strip():
            out.append((i, kept))
    assert len(out) < len(left) and gone

    # near copies: one row of each component, by id, nulls last
    fps = [fingerprint(t) for _, t in out]
    roots = closure(len(out), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    groups = {}
    for row, r in zip(out, roots):
        groups.setdefault(r, []).append(row)
    best = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    clean = [(i, t) for i, t in best if all(brute_share(t or "", x) < 0.8 for _, x in items)]
    assert len(clean) < len(best) < len(out)

    t = Tokenizer.from_file(bpe.default_path())
    want = sorted(((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in clean), key=str)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, tuple(r.ids)) for r in rows), key=str) == want
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
