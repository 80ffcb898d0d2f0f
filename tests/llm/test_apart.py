"""Executors without this package, steps that are removed, and words without end."""

import os
import random
import subprocess
import sys
import time

import pytest

tokenizers = pytest.importorskip("tokenizers")

from moraine.llm import bpe  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.memory", "2g").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
def lacks(_):
    try:
        import moraine
    except ModuleNotFoundError:
        return [1]
    return [0]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == [1]
import __spark_entry__ as entry
small = {small!r}
for name in ("op3_line_dedup", "op6_simhash_near_dedup", "op9_benchmark_decontamination", "op11_sentencepiece_codec", "op12_ranked_search", "op13_source_divergence"):
    before = set(os.listdir({shared!r}))
    assert entry.queries()[name](spark, small).count() >= 0
    left = set(os.listdir({shared!r})) - before
    print(name, len(left))
spark.stop()
"""


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    for name in ("documents", "benchmark", "labels"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (table.limit(60) if name == "documents" else table).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def test_executors_without_the_package_and_steps_removed(small, tmp_path):
    """Closures and broadcasts travel by value; of each query at most the tables that its result reads are left, and none once the driver ends."""
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, shared=str(shared), small=small)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [int(line.split()[1]) <= 1 for line in run.stdout.splitlines() if line.startswith("op")] == [True] * 6, run.stdout
    until = time.monotonic() + 30  # the JVM ends a little later
    while (left := [x for x in os.listdir(shared) if x.startswith("moraine-")]) and time.monotonic() < until:
        time.sleep(0.5)
    assert left == [], left


def test_long_words_are_encoded_as_the_library_does_and_quickly():
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.vocabulary(bpe.default_path()))
    rng = random.Random(31)
    words = ["".join(rng.choice("acgt") for _ in range(2_000)), "ab" * 3_000, "the" * 2_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(40_000))]
    began = time.perf_counter()
    got = codec.encode_batch(words)
    assert time.perf_counter() - began < 3
    for word, (n, ids) in zip(words, got, strict=True):
        want = library.encode(word, add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want))


def test_both_ways_of_merging_agree():
    codec = bpe.Codec(bpe.vocabulary(bpe.default_path()))
    rng = random.Random(32)
    for _ in range(300):
        symbols = [rng.choice("aeinrstho") for _ in range(rng.randrange(2, bpe.FEW))]
        symbols[-1] += bpe.END
        assert codec._merge_long(symbols.copy()) == codec.merge(symbols.copy())
