"""The pipeline against a plain version of its stages."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_edges import lower, near_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    plain = [f"{a}{b}{c}" for a in ("th", "an", "er", "on", "st") for b in ("i", "e", "o") for c in ("ng", "d", "ly", "r", "sh", "l", "c", "m")]
    bad = ["vilexa", "vilexor", "vilexing"]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows, labels, kind = [], [], {}

    def add(text, what):
        kind[len(rows)] = what
        labels.append((len(rows), 1, int(what == "toxic")))
        rows.append((len(rows), text, "en", "s", len(text or "")))

    for n in range(300):
        words = [r.choice(plain) for _ in range(r.randint(30, 150))]
        if n % 9 == 0:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(bad)
            add(" ".join(words), "toxic")
            continue
        add(" ".join(words), "clean")
        if n % 7 == 1:
            add(" ".join(words).upper(), "copy")
        if n % 7 == 2:
            words[len(words) // 2] = "changed"
            add(" ".join(words), "near")
        if n % 11 == 3:
            add(" ".join([*words[:20], item.title(), *words[20:40]]), "leak")
    add(None, "empty")
    add("", "empty")
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", "short item never there")], "item_id string, text string").write.parquet(path + "/benchmark.parquet")
    return path, rows, kind, item


def test_stages(spark, folder):
    path, rows, kind, item = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    left = {i: t for i, t, *_ in rows}

    def step(n, docs, want):
        name, stage = corpus_pipeline.STAGES[n]
        got = stage(spark, docs, path)
        assert got.columns == docs.columns, name
        assert {r.doc_id: r.text for r in got.collect()} == want, name
        return got

    left = {i: t for i, t in left.items() if kind[i] != "toxic"}
    docs = step(0, docs, left)
    newest = {lower(t): i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if newest[lower(t)] == i}
    docs = step(1, docs, left)
    least = {i: c for i, _, c in near_brute(sorted(left.items()), 5)}
    left = {i: t for i, t in left.items() if least[i] == i}
    assert sum(kind[i] == "near" for i in left) < sum(k == "near" for k in kind.values()) / 2
    docs = step(2, docs, left)
    left = {i: t for i, t in left.items() if item not in lower(t)}
    docs = step(3, docs, left)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    done = corpus_pipeline.run(spark, path)
    assert {r.doc_id: tuple(r)[1:] for r in done.collect()} == want


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_extra_columns(spark, folder):
    """Rows that repeat whole, clashing column names and missing ids pass through every stage."""
    path = folder[0]
    docs = spark.read.parquet(path + "/documents.parquet")
    odd = docs.unionByName(docs.where("doc_id % 10 = 0")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({"label": F.lit("x"), "h": F.lit(1), "c": F.lit("y"), "kept": F.lit(True), "_id": F.lit(5)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, path)
    assert odd.columns == [*docs.columns, "label", "h", "c", "kept", "_id"]
    assert odd.groupBy("text").count().where("count > 1").count() == 0


def test_stages_send_small_batches_to_the_workers(spark):
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    try:
        for given, want in (("10000", 1000), ("0", 1000), ("200", 200)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
            corpus_pipeline.drop_copies(spark, docs, "")
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", setting)
