"""The corpus pipeline, stage by stage and whole."""

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as llm_queries
from tessera.llm.common import Scratch
from tessera.llm.packing import Encoder, tokenizer_path

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, out = Scratch(spark, "test"), [("start", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_stages(stages):
    assert [n for n, _ in stages[1:]] == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]
    frames = dict(stages)
    for name in ("language_id", "near_dedup", "personal_data", "mixing"):
        assert frames[name].columns == COLUMNS
    assert frames["language_id"].count() == 1000  # every document has letters
    ids = {r["doc_id"] for r in frames["near_dedup"].collect()}
    assert 0 < len(ids) < 1000 and frames["near_dedup"].count() == len(ids)
    clean = frames["personal_data"]
    assert clean.count() == len(ids) and clean.where("text rlike '[a-z0-9]@mail'").count() == 0 and clean.where("text like '%[email]%'").count() > 0
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in frames["mixing"].collect()} == ids
    assert frames["packing"].agg(F.sum("length")).first()[0] == _tokens(frames["mixing"])


def _tokens(docs):
    e = Encoder(tokenizer_path())
    return sum(len(e.encode(r["text"] or "")) // 4 + 1 for r in docs.select("text").collect())


def test_run_is_the_stages(spark, stages):
    whole = corpus_pipeline.run(spark, SF)
    want = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in stages[-1][1].collect()}
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole.collect()} == want


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "12 34", "en", "a", 5), (4, "the cat sat on the mat with it", "en", None, 9),
            (5, "the cat sat on the mat with it", None, "b", 9), (None, "der Hund und die Katze und er", "de", "b", 1), (7, "mail a@b.co and the hat of it", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    scratch = Scratch(spark, "test")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.keep(stage(spark, docs, SF))
        seen.append(docs.collect())
    assert {r["doc_id"] for r in seen[0]} == {4, 5, None, 7} and all(r["lang"] for r in seen[0])
    assert {r["doc_id"] for r in seen[1]} == {4, None, 7}
    assert {r["text"] for r in seen[2] if r["doc_id"] == 7} == {"mail [email] and the hat of it"}
    assert {r["doc_id"] for r in seen[3]} == {4, None, 7}


def test_language_rejects_unknown_scripts_and_junk(spark):
    rng = random.Random(5)
    scripts = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "".join(map(chr, range(0x430, 0x450))), "greek": "".join(map(chr, range(0x3B1, 0x3CA)))}
    words = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))
    rows = [(-1 - i, words(letters, n), None, name, n) for name, letters in scripts.items() for n in (30, 300) for i in range(10)]
    rows += [(-100, "да", None, "short", 2), (-101, "it", "en", "short", 2)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = docs.select(*COLUMNS).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = corpus_pipeline.language_id(spark, mixed, SF).select("doc_id", "source", "lang").collect()
    assert sum(r["doc_id"] >= 0 for r in got) == docs.count()
    assert {(r["doc_id"], r["source"], r["lang"]) for r in got if r["doc_id"] < 0} == {(-100, "short", "und"), (-101, "short", "en")}


def test_language_keeps_short_documents_whose_label_agrees(spark):
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").where("doc_id in (39133, 41458, 20021, 7339)").select(*COLUMNS)
    known = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    if docs.count() == 4:  # short, repetitive, full of numbers
        got = corpus_pipeline.language_id(spark, known.unionByName(docs.withColumn("doc_id", -F.col("doc_id"))), SF)
        assert got.where("doc_id < 0").count() == 4


def test_mixing_stage_keeps_own_columns(spark):
    rows = [(i, f"text {i}", "en", "ab"[i % 2], 1, -i, f"p{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int, Position string")
    got = corpus_pipeline.mixing(spark, docs, SF)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == set(rows)


def test_near_dedup_tells_rows_with_one_id_apart(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(3, a), (None, a), (None, b), (5, c), (5, d), (2, d), (6, e), (6, e), (None, f"{b} more"), (8, f"{e} more"), (9, ""), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", str(n), 1) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == COLUMNS
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum(i is None for i, _ in left) == 1 and {t for i, t in left if i is None} <= {b, f"{b} more"}
    assert sorted((x for x in left if x[0] is not None), key=repr) == sorted([(3, a), (5, c), (2, d), (6, e), (9, ""), (9, None), (10, "")], key=repr)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    scratch = Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF))
    assert docs.count() == 0


@pytest.mark.parametrize("name", list(llm_queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    got = llm_queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(llm_queries.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    both = [sorted(map(tuple, f[columns].astype(object).to_numpy().tolist())) for f in (got, want)]
    assert both[0] == both[1]
