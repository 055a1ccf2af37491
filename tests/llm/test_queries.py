"""Registered queries: against their SQL, held-out quality, and the pipeline by plain steps."""

import os

import plain
import public_tokenizers
import pytest
from compare import duck, duck_bag, schemas, spark_bag
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from dataroute.llm import toxicity
from dataroute.llm.queries import QUERIES
from dataroute.llm.sql_side import ORACLES
from dataroute.llm.tables import written

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
LARGER = "/root/testdata/sf0.1"


def test_all_are_registered():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()
    assert {int(x[2:].split("_")[0]) for x in QUERIES} == set(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    with duck(SF_DIR) as connection:
        ours, theirs = schemas(df, connection, ORACLES[name])
        expected = duck_bag(connection, ORACLES[name])
    assert ours == theirs
    assert spark_bag(df) == expected


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))
    row = got.join(docs, "doc_id").filter("held_out").agg(right.alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 1500 and row["right"] > 0.99


def test_toxicity_of_held_out_documents(spark):
    got = QUERIES["op8_toxicity"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hits = sum(x["toxic"] and x["predicted"] for x in rows)
    assert hits / sum(x["predicted"] for x in rows) > 0.8
    assert hits / sum(x["toxic"] for x in rows) > 0.8


def test_toxicity_of_each_language(spark):
    """Held-out toxic documents of the smaller languages too, by the query and in the pipeline."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    marked = docs.join(labels, "doc_id").filter(toxicity.held_out()).select("doc_id", "lang", "toxic")
    marked = {x["doc_id"]: (x["lang"], x["toxic"]) for x in marked.collect()}
    found = {x["doc_id"] for x in QUERIES["op8_toxicity"](spark, LARGER).filter("predicted = 1").collect()}
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    kept = {x["doc_id"] for x in stage(spark, docs, LARGER).select("doc_id").collect()}
    assert {lang for lang, _ in marked.values()} == {"de", "en", "es", "fr"}
    for lang in ("de", "en", "es", "fr"):
        toxic = {i for i, x in marked.items() if x == (lang, 1)}
        clean = {i for i, x in marked.items() if x == (lang, 0)}
        assert len(toxic & found) > 0.8 * len(toxic) and len(clean & found) < 0.05 * len(clean)
        assert not toxic & found & kept and clean - found <= kept


def test_offending_spans(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    texts = spark.createDataFrame([(1, "İ the IDIOT, and so on"), (2, "and so on")], "doc_id long, text string")
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"]] for x in toxicity.score(texts, model).collect()}
    assert got == {1: [(6, 11)], 2: []}


def test_pipeline(spark):
    """Each stage against a plain version of its operator, on what the stage before kept."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = written(stages[name](spark, docs, sf_dir), f"test-{name}")
        return out, {x["doc_id"]: x for x in out.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {x["doc_id"] for x in toxicity.score(docs, model).collect() if not x["predicted"]}
    docs, rows = step("toxicity", docs)
    assert rows.keys() == clean and docs.columns == columns

    kept = {x[0] for x in plain.copy_groups([(i, x["text"]) for i, x in rows.items()]) if x[3]}
    docs, rows = step("exact_dedup", docs)
    assert rows.keys() == kept and docs.columns == columns

    found = plain.near_duplicates([(i, x["text"]) for i, x in rows.items()], 5, 80)
    docs, rows = step("ngram_jaccard", docs)
    assert rows.keys() == {i for i, _, c in found if i == c} and docs.columns == columns

    before = rows
    docs, rows = step("secret_scan", docs)
    assert rows.keys() == before.keys() and docs.columns == columns
    for i, x in rows.items():
        assert x["n_chars"] == len(x["text"])
        assert (x["text"] == before[i]["text"]) == ("[secret]" not in x["text"])

    packed, _ = step("best_fit_packing", docs)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = plain.pieces([(i, x["text"]) for i, x in rows.items()], exact)
    got = packed.select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").count() == len(expected)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op4_bpe", "op10_substring_dedup"])
def test_documents_are_dealt_once(spark, name):
    """All rounds of a query read the same exchange of documents."""
    plan = _final_plan(QUERIES[name](spark, "/root/testdata/sf0.001")).partition("== Initial Plan ==")[0]
    dealt = plan.count("MapInArrow pack(")
    assert dealt == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
