"""Queries against their SQL on small tables of odd texts."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.functions import tokens
from cloakframe.operators import logs, ner
from cloakframe.plans import catalogue
from cloakframe.sources import files


def test_handles_of_names_with_a_sharp_s(spark, tmp_path):
    """A capital sharp s is one character in SQL: probes with two letters in its place moved every offset behind them."""
    texts = [(1, "Bernd Weiß\nwrites to berndweiß"), (2, "Erßung Iestst\nfirst"), (3, "Émile Ångström\nother"), (4, "no name, here")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "q10_derivatives_in_texts"
    got = {(r["doc_id"], r["s"], r["value"]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(f"SELECT doc_id, s, value FROM ({catalogue.ORACLES[name]})").fetchall())
    assert any("ẞ" in value for _, _, value in got)


def test_numbers_behind_letters_beyond_the_first_plane(spark, tmp_path):
    """A letter or digit of two UTF-16 units is a word character, and what begins behind it is no number of its own."""
    texts = ["𝐀555 123 4567", "𝟜555-123-4567", "𝟜5551234567", "𠀀+1 (743) 555-3824", "😀555 123 4567", "a 𝐀1 555 123 4567", "x\n𝐀 555 123 4567"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "<p>𝐀555 123 4567</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("q07_phone_numbers", "flagship_cleared_documents"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_handles_behind_letters_beyond_the_first_plane(spark):
    df = spark.createDataFrame([("𝐀annasmith 😀annasmith annasmith",)], "t string")
    found = df.select(T.derivative_findings(F.col("t"), F.array(F.lit("Anna Smith"))).alias("f")).first()["f"]
    assert [(f["start"], f["value"]) for f in found] == [(12, "annasmith"), (22, "annasmith")]


def test_texts_without_a_part_of_a_match_are_not_searched(spark):
    """What plain search leaves out has no match, in any case of the letters."""
    texts = ["see WWW.a.org", "wWw.b.org", "LinkedIn.cOM/in/x", "github.Com/y", "HTTPS://c.com", "now. from/to", "a@b.org", "@", "", None, "ſ https://d", "linKedin.com/z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for kind in T.HELD:
        got = df.select(T.matches(F.col("t"), kind).alias("a"), T.places(F.col("t"), T.PATTERNS[kind]).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
        assert any(r["a"] for r in got)


def test_header_behind_blank_lines(spark):
    texts = [" \n \n \tAnn Lee  \nx", "\n\n", "Ann Lee", "\x1cAnn Lee\r\nx", "x\nAnn Lee"]
    got = [r["f"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(T.header_findings(F.col("t")).alias("f")).collect()]
    assert [[(f["start"], f["value"]) for f in found] for found in got] == [[(6, "Ann Lee")], [], [(0, "Ann Lee")], [(1, "Ann Lee")], []]


def test_remnants_are_searched_once(spark):
    """The dear pattern stands once in the plan, and what was altered is still reported."""
    rows = spark.sql("select * from values ('see <<url_01>> and URL_02', map('<<URL_01>>', 'a', '<<URL_02>>', 'b')), ('see <<url_01>>', cast(map() as map<string,string>)) as x(t, r)")
    found = rows.select(tokens.altered_tokens(F.col("t"), F.col("r"), F.array().cast("array<string>")).alias("f"))
    assert found._jdf.queryExecution().analyzed().toString().count("⟪") == 1
    assert [[w.strip() for w in r["f"]] for r in found.collect()] == [["<<url_01>>", "URL_02"], []]


def test_verdicts_of_several_exchanges_are_one_pass(spark, sf_dir):
    plan = catalogue.q27_verdict(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_model_tier_passes_on_rows_before_a_batch_ends(spark, monkeypatch):
    """What a task holds is bounded by findings and bytes, and every row comes back with its own."""
    monkeypatch.setattr(ner, "PASSED", 3)
    real = ner.pa.array
    texts = ["ab", "a", None, "", "abab", "x", "aaaa", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    run = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, s: run.update(f=f) or self)
    ner.with_ner(df, lambda: lambda t: [(i, i + 1, "PERSON", 0.9) for i, c in enumerate(t) if c == "a"])
    batch = ner.pa.RecordBatch.from_arrays([real(list(range(8)), ner.pa.int64()), real(texts, ner.pa.string())], ["doc_id", "text"])
    made = list(run["f"](iter([batch])))
    sizes = [len(b) for b in made]
    assert len(sizes) > 1 and sum(sizes) == 8
    rows = [r for b in made for r in b.to_pylist()]
    assert [len(r["ner"]) for r in rows] == [1, 1, 0, 0, 2, 0, 4, 0] and [r["doc_id"] for r in rows] == list(range(8))


def test_pages_are_passed_on_before_a_batch_ends(spark, monkeypatch):
    monkeypatch.setattr(files, "PASSED_BYTES", 4)
    made = {}
    monkeypatch.setattr(files.F, "pandas_udf", lambda f, kind: made.update(f=f) or (lambda c: c))
    files.pdf_decoded(F.col("content"), lambda raw: ([(raw.decode(), [])], {}))
    out = list(made["f"](iter([pd.Series([b"abc", b"de", None, b"f"]), pd.Series([b"ghijk"])])))
    assert [len(x) for x in out] == [2, 2, 1]
    assert [p[0]["text"] if p else None for x in out for p in x["pages"]] == ["abc", "de", None, "f", "ghijk"]


def test_grams_of_messages_stay_with_their_message(spark):
    """Few different grams are brought to the messages, whatever Spark guesses of their size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        messages = spark.createDataFrame([("user 12 did view",), ("user 7 did buy",)], "message string")
        met = logs._met(messages, spark.createDataFrame([("user 7 did",), ("nobody",)], "value string"))
        assert "BroadcastHashJoin [gram" in met._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in met.collect()] == [("user 7 did buy", "user 7 did")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
