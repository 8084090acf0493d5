from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import bpe, queries, quality, secret_scan, simhash

import __spark_entry__
import corpus_pipeline
from cloakframe.llm.common import table

from .conftest import EDGES, prose


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == [n for n in queries.QUERIES if n.startswith("op")]
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
    assert {"minhash_classes", "planted_secret_links"} <= set(names)


def test_stages(spark, sf_dir):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "secret", "mixing", "bpe"]
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    labels = table(spark, sf_dir, "labels")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir).cache()
    assert good.columns == columns
    assert 0 < good.count() < docs.count()
    assert good.count() == quality.score(docs, labels).where("score >= 0.7").count()
    single = corpus_pipeline.drop_near_copies(spark, good, sf_dir).cache()
    assert single.columns == columns
    assert single.count() == simhash.classes(good).select("component_id").distinct().count()
    clean = corpus_pipeline.redact_secrets(spark, single, sf_dir).cache()
    assert clean.columns == columns
    assert clean.count() == single.count()
    assert secret_scan.scan(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir).cache()
    assert mixed.columns == columns
    out = corpus_pipeline.encode(spark, mixed, sf_dir).cache()
    assert out.count() == mixed.count()
    assert out.where("not exact").count() == 0
    assert out.agg({"n_tokens": "sum"}).first()[0] == bpe.digests(mixed).agg({"n_tokens": "sum"}).first()[0]


@pytest.fixture
def labelled(spark, tmp_path):
    """A folder with labels: documents with an even id are good."""
    spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


#: Names of columns that the operators use or make themselves.
CLASHING = ("score", "found", "spans", "base", "size", "taken", "row", "tie", "fp", "_key", "_range", "root", "n", "ids_", "component_id")


def cases(make):
    """Good texts with an even id, bad ones with an odd one, and the odd cases of EDGES behind them; clashing columns."""
    plain = [prose(60, i) if i % 2 == 0 else "win! " * 60 + str(i) for i in range(60)]
    docs = make(*plain, *EDGES, EDGES[6], "password = hunter2222 " + prose(20, 99), ids=[*range(60), *[None] * 4, *range(100, 110)])
    return docs.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))


def kept_values(rows):
    """Every clashing column still has its own value."""
    return all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in CLASHING)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n.split()[0] for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(make, spark, labelled, stage):
    docs = cases(make)
    out = stage(spark, docs, labelled)
    assert out.columns == docs.columns
    rows = out.collect()
    assert kept_values(rows)
    assert rows
    assert stage(spark, docs.limit(0), labelled).count() == 0
    texts = [r["text"] for r in docs.collect()]
    if stage is corpus_pipeline.keep_good:
        assert {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 60} == set(range(0, 60, 2))
    elif stage is corpus_pipeline.drop_near_copies:
        # One of the two equal long texts, one of null, empty, blank; nothing else is alike.
        assert len([r for r in rows if r["text"] == EDGES[6]]) == 1
        assert len([r for r in rows if not (r["text"] or "").strip()]) == 1
        assert {r["text"] for r in rows if r["text"]} | {"", " \t\n"} >= {t for t in texts if t and "win!" not in t} - {EDGES[8]}
    elif stage is corpus_pipeline.redact_secrets:
        assert len(rows) == len(texts)
        assert [r["text"] for r in rows if "[SECRET]" in (r["text"] or "")] == ["[SECRET] " + prose(20, 99)]
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    else:
        assert all(r["text"] in texts for r in rows)


def test_last_stage_on_odd_rows(make, spark, labelled):
    docs = cases(make)
    rows = corpus_pipeline.encode(spark, docs, labelled).collect()
    assert len(rows) == docs.count()
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert corpus_pipeline.encode(spark, docs.limit(0), labelled).count() == 0


def test_run_equals_the_stages_one_after_another(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["exact"])
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
