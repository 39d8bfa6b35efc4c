"""Registered queries against DuckDB, the pipeline against a brute-force version of its stages."""

import collections
import math

import duckdb
import pytest

import corpus_pipeline
from hearthway.llm import queries

from .test_operators import brute_near

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    want = collections.Counter(tuple(plain(x) for x in r) for r in rel.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_op6_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: x for (i, _), x in zip(docs, brute_near(docs, 85), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op6_minhash_dedup"](spark, SF).collect()} == want


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = docs.collect()
    texts = {n: [(r.doc_id, r.text) for r in seen[n]] for n in list(seen)[:4]}
    first = dict(texts["toxicity"])
    largest = {t: max(i for i, u in first.items() if u == t) for t in set(first.values())}
    assert sorted(i for i, _ in texts["exact dedup"]) == sorted(largest.values())
    near = brute_near(texts["exact dedup"], 80)
    keep = sorted(i for (i, _), (n, c) in zip(texts["exact dedup"], near, strict=True) if i == c)
    assert sorted(i for i, _ in texts["minhash near-dedup"]) == keep
    assert {i for i, _ in texts["mixing to target weights"]} <= set(keep)
    pieces = seen["best-fit packing"]
    whole = collections.Counter(r.doc_id for r in pieces if r.piece == 0)
    assert whole == collections.Counter(i for i, _ in texts["mixing to target weights"])
    full = collections.Counter()
    for r in pieces:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Null texts and ids, repeated rows, more columns, and no rows at all."""
    odd = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "x y z", None, None, None), (2, "x y z", "en", "b", 5), (3, "", "en", "a", 0), (4, "one two three four five six " * 9, "en", "b", 5)] * 2
    for name, rows in (("odd", odd), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (9, 0, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in out} <= {1, 2, 3, 4, None} and bool(out) == bool(rows)
        stages = [spark.read.parquet(f"{folder}/documents.parquet")]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            stage(spark, stages[-1], folder).write.parquet(f"{folder}/{i}")
            stages.append(spark.read.parquet(f"{folder}/{i}"))
            assert stages[-1].columns == stages[0].columns
        # one null-or-empty text and the two others: each text once
        assert stages[2].count() == len({r[1] or "" for r in rows})


def test_held_out_toxicity_on_given_labels(spark):
    """Fitted on half of the labelled documents of sf0.1, judged on the other half."""
    from hearthway.llm import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.filter("toxic is not null").join(docs, "doc_id")
    half = known.filter("doc_id % 2 = 0")
    model = toxicity.fit_on(half.select("doc_id", "text"), labels, toxicity.severity())
    judged = toxicity.score(known.filter("doc_id % 2 = 1").select("doc_id", "text"), model).join(labels.select("doc_id", labels.toxic.alias("truth")), "doc_id").collect()
    bad = [r for r in judged if r.truth == 1]
    assert sum(r.grade > 0 for r in bad) >= 0.75 * len(bad)
    assert sum(r.grade > 0 for r in judged if r.truth == 0) <= 0.02 * (len(judged) - len(bad))
