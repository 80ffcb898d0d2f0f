"""Toxicity, the pipeline and the registry."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from moraine.llm import registry, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = {"idiot$": 1.0, "worthless$": 1.0, "scum$": 1.0, "lowei": 1.0}
    automaton = toxicity.Automaton(terms)
    words = ["idiot", "idiott", "idot", "idoit", "xdiot", "scums", "scum", "loweien", "lowex", "worthles", "worthlesss", "the", ""]
    for term in ("idiot", "worthless"):
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(["", "e", "s", "q"])
            words.append("".join(w))
    for w in words:
        want = None
        for t in terms:
            bare = t.rstrip("$")
            if t.endswith("$"):
                d = distance(w, bare)
                ok = d == 0 or (d == 1 and len(bare) >= toxicity.FUZZY_LENGTH and w[:1] == bare[0])
            else:
                d = 0 if w.startswith(bare) else distance(w, bare)
                ok = d == 0 or (d == 1 and len(bare) >= toxicity.FUZZY_LENGTH and w[:1] == bare[0])
            if ok and (want is None or d < want):
                want = d
        got = automaton.match(w)
        assert (got[1] if got else None) == want, w


def test_quotation_is_not_abuse():
    automaton = toxicity.Automaton({"idiot$": 1.0})
    assert toxicity.features("you idiot, you idiott", automaton) == (1, 1, 0, 1)
    assert toxicity.features('he wrote "what an idiot" and left', automaton) == (0, 0, 1, 0)
    assert toxicity.features("they called him idiot", automaton) == (0, 0, 1, 0)
    for said in ("elle a dit idiot", "er nannte ihn idiot", "me dijo idiot"):
        assert toxicity.features(said, automaton) == (0, 0, 1, 0)
    assert toxicity.features(None, automaton) == (0, 0, 0, 0)


def _labelled(spark, n=900):
    rng = random.Random(8)
    clean = ["the", "house", "near", "river", "stands", "under", "green", "hill", "and", "waits"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "vequest", "vequdor", "idiott"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.97


def test_toxicity_awkward(spark, docs, nothing):
    _, labels = _labelled(spark, 50)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_documents(nothing, labels).count() == 0
    alone = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in alone)
    assert toxicity.keep_clean(docs, labels.limit(0)).columns == docs.columns


def test_pipeline_stages(spark, tmp_path):
    docs, labels = _labelled(spark)
    extra = [(5000, "a passage that is asked of every model in the benchmark set at hand"), (5001, "x\nx"), (5002, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, extra[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r.doc_id for r in seen.collect()}
    assert 5000 not in ids and 5001 in ids and not ids & {i for i in range(0, 900, 5)}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == ids and all(r.n_tokens == len(r.ids) for r in final)


def test_registry_names():
    assert [f"op{n}_" for n in range(1, 11)] == [next(q for q in registry.QUERIES if q.startswith(f"op{n}_"))[: len(f"op{n}_")] for n in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5
