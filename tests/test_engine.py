from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.config import Options
from cloakframe.functions import model_api, tokens
from cloakframe.functions import text as T
from cloakframe.operators import detect, logs, metrics, ner, overlap, substitute, vault
from cloakframe.plans import catalogue, pipeline
from cloakframe.sources import files, model


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


PHONES = ["041102102", "(555) 123-4567", "+1 (743) 555-3824", "152.143.123.131", "555-123-4567.", "x555-123-4567", "٠١٢٣٤٥٦٧٨٩", "²555-123-4567", "😀 call 555 123 4567 😀 555 123 4568"]


def brute_phones(text):
    pattern = r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{1,4}\)[\s.\-]?|\d{1,4}[\s.\-])?\d{3}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?(?![\w.])"
    return [(m.start(), m[0]) for m in re.finditer(pattern, text) if sum(c.isdigit() for c in m[0]) >= 9]


def test_phones_and_offsets(spark):
    got = rows(spark, PHONES).select("doc_id", T.pattern_findings(F.col("text")).alias("f")).collect()
    for row in got:
        assert [(f["start"], f["value"]) for f in row["f"] if f["entity_type"] == "PHONE"] == brute_phones(PHONES[row["doc_id"]])


def test_urls(spark):
    text = "see https://a.com/x?y=1., (www.b.org/z) HTTP://C.com; linkedin.com/in/me: xwww.no.com github.com/ok)"
    found = one(spark, T.pattern_findings(F.col("t")), t=text)
    assert [f["value"] for f in found] == ["https://a.com/x?y=1", "www.b.org/z", "HTTP://C.com", "linkedin.com/in/me", "github.com/ok"]
    assert all(text[f["start"] : f["end"]] == f["value"] for f in found)


@pytest.mark.parametrize(
    ("text", "name"),
    [("\n  \n  Ann O’Brien-Lee \nx", "Ann O’Brien-Lee"), ("Ann", None), ("A B C D", "A B C D"), ("A B C D E", None), ("Ann, Lee", None), ("Ann L2", None), ("a@b c", None), ("Ann  Lee", None), ("", None), ("Ünal Ñu", "Ünal Ñu"), ("Ann L²", None)],
)
def test_header(spark, text, name):
    found = one(spark, T.header_findings(F.col("t")), t=text)
    assert [f["value"] for f in found] == ([name] if name else [])
    assert all(text[f["start"] : f["end"]] == name for f in found)


def test_derivatives(spark):
    assert one(spark, T.derivatives(F.col("t")), t="Johnny Q. Appleseed")[:2] == ["johnnyappleseed", "jappleseed"]
    assert one(spark, T.derivatives(F.col("t")), t="Al Wu") == []
    assert one(spark, T.derivatives(F.col("t")), t="O'Brien Pat") == []
    found = one(spark, T.derivative_findings(F.col("t"), F.array(F.lit("John Appleseed"))), t="JAppleseed .jappleseed jappleseeds github/johnappleseed")
    assert [f["value"] for f in found] == ["JAppleseed", "johnappleseed"]


def greedy(findings):
    kept = []
    for i in sorted(range(len(findings)), key=lambda i: (findings[i][0] - findings[i][1], findings[i][0], i)):
        if all(findings[i][1] <= k[0] or k[1] <= findings[i][0] for k in kept):
            kept.append(findings[i])
    return sorted(kept)


def test_overlap_equals_a_plain_loop(spark):
    r = random.Random(1)
    cases = [[(s := r.randrange(40), s + r.randint(1, 9)) for _ in range(r.randint(0, 14))] for _ in range(300)]
    df = spark.createDataFrame([(i, [(s, e, "X", str(j), "t", 1.0) for j, (s, e) in enumerate(c)]) for i, c in enumerate(cases)], f"id int, f {T.FINDINGS}")
    for row in df.select("id", overlap.resolved(F.col("f")).alias("f")).collect():
        assert [(f["start"], f["end"]) for f in row["f"]] == greedy(cases[row["id"]])


TEXTS = [
    "Jane Roe\njane.roe@x.org, 555-123-4567\nCATEGORY of jane.roe@x.org; janeroe1 at JaneRoe99",
    "no findings, here",
    None,
    "  \n ",
    "Amy Lee\n" + " ".join(f"u{i}@mail.com" for i in range(120)),
    "had <<PERSON_01>> before a@b.cc",
    "reserved  a@b.cc",
    r"Ann Bee" + "\nmail a.$b+c@d.ee or \\E x@y.zz",
    "Bob Cat\nbob.cat@x.org and again Bob Cat, xBob Cat",
]


def test_round_trip(spark):
    made = pipeline.anonymized(rows(spark, TEXTS)).cache()
    got = {r["doc_id"]: r for r in made.collect()}
    assert [got[i]["status"] for i in range(9)] == ["ok", "no_findings", "blank", "blank", "ok", "token_in_source", "reserved_character", "ok", "leak"]
    assert "<<EMAIL_120>>" in got[4]["anonymized"]
    assert got[0]["anonymized"].startswith("<<PERSON_01>>\n<<EMAIL_01>>, <<PHONE_01>>\nCATEGORY of <<EMAIL_01>>")
    assert got[0]["extra"] == 0
    cleared, blocked, private = pipeline.split(made)
    assert set(cleared.columns) == {"doc_id", "session_id", "text"}
    assert {r["doc_id"] for r in blocked.collect()} == {2, 3, 5, 6, 8}
    results, _ = pipeline.run(rows(spark, TEXTS), Options(), model.mock_transport("echo"))
    for r in results.collect():
        assert r["ok"]
        assert r["rehydrated"] == TEXTS[r["doc_id"]]
        assert r["dropped_tokens"] == []
    assert private.count() == sum(r["n_unique"] for r in got.values())


def test_many_values_substitute_alike(spark):
    r = random.Random(3)
    values = sorted({"".join(r.choice("abcAB.é😀") for _ in range(r.randint(1, 6))) for _ in range(150)})
    texts = [" ".join(r.choice(values) + r.choice(["", "x", "."]) for _ in range(60)) for _ in range(20)]
    by_length = sorted(values, key=len, reverse=True)
    word = r"[^\W]"
    guard = lambda v: (f"(?<!{word})" if re.match(word, v) else "") + re.escape(v) + (f"(?!{word})" if re.search(word + "$", v) else "")
    pattern = re.compile("|".join(map(guard, by_length)))
    df = rows(spark, texts).withColumn("v", F.array(*map(F.lit, values)))
    mapping = F.map_from_arrays("v", F.transform("v", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    for row in substitute.with_substitution(df, F.col("text"), F.col("v"), mapping).collect():
        assert row["_s"]["text"] == pattern.sub(lambda m: f"<{m[0]}>", texts[row["doc_id"]])


def test_long_runs_stay_linear(spark):
    """A megabyte without a blank, of blanks, or of openings ends in seconds."""
    runs = ["a" * 1_000_000, "a@" * 500_000, " " * 500_000 + "\t" * 500_000 + "x", "PERSON " + " " * 900_000, "http://x" + "." * 900_000 + "y", "Ann " + " " * 300_000 + "x"]
    began = time.monotonic()
    got = rows(spark, runs).select("doc_id", F.size(T.pattern_findings(F.col("text"))).alias("n"), F.length(T.normalise_columns(F.col("text"))).alias("l"), F.size(T.header_findings(F.col("text"))).alias("h"), F.size(F.regexp_extract_all("text", F.lit(tokens.MANGLED), F.lit(0))).alias("m")).collect()
    assert time.monotonic() - began < 60
    assert [r["n"] for r in sorted(got)] == [0, 0, 0, 0, 1, 0]
    assert one(spark, T.pattern_findings(F.col("t")), t="a@b.com1@c.org x@y.zz a@b@c.de")[1]["value"] == "1@c.org"


def test_leaks_of_many_labels(spark):
    r = random.Random(8)
    messages = ["".join(r.choice("abcd 😀") for _ in range(r.randint(0, 40))) for _ in range(200)]
    labels = ["".join(r.choice("abcd 😀") for _ in range(r.randint(2, 6))) for _ in range(120)] + ["😀😀😀😀", "zzzz"]
    known = spark.createDataFrame(list(enumerate(labels)), "label_id long, value string")
    said = spark.createDataFrame([(m,) for m in messages], "message string")
    want = {i for i, v in enumerate(labels) if len(v) >= 4 and any(v in m for m in messages)}
    for small in (1000, 5):
        assert {x["label_id"] for x in logs.leaked(said, known, small).collect()} == want


def test_missing_path(spark, tmp_path):
    (row,) = files.load(spark, f"{tmp_path}/none/x.txt").collect()
    assert (row["doc_id"], row["text"], row["error"]) == ("x", None, "no such file or folder")


def test_overlap_of_tables(spark):
    r = random.Random(2)
    cases = [[(s := r.randrange(60), s + r.randint(1, 9)) for _ in range(r.randint(0, 30))] for _ in range(60)]
    table = [(k, s, e, i) for k, c in enumerate(cases) for i, (s, e) in enumerate(c)]
    got: dict[int, list] = {}
    for row in overlap.resolved_rows(spark.createDataFrame(table, "k int, start int, end int, i int"), "k", "i").collect():
        got.setdefault(row["k"], []).append((row["start"], row["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(c) for k, c in enumerate(cases) if c}


def test_transports(spark):
    docs = rows(spark, TEXTS[:2])
    for kind, reason in (("native", None), ("missing-model", "missing model"), ("badauth", "authentication")):
        got = pipeline.run(docs, Options(), model.mock_transport(kind))[0].collect()
        assert {r["reason"] for r in got} == {reason}
    unset = pipeline.run(docs, Options(provider="openai"), model.mock_transport("echo"))[0].collect()
    assert {(r["sent"], r["reason"]) for r in unset} == {(False, "the endpoint needs a key")}


def test_mangled_and_dropped(spark):
    reverse = F.create_map(*(F.lit(x) for x in ("<<PERSON_01>>", "Ann", "<<EMAIL_01>>", "a@b.cc", "<<URL_01>>", "u")))
    got = one(spark, substitute.rehydrated(F.col("t"), reverse), t="<<PERSON_01>> <<person_01>> [[EMAIL_01]] <<OTHER_07>> <<OTHER_07>> EMAIL_01")
    assert got["text"].startswith("Ann ")
    assert [u.strip() for u in got["unmatched"]] == ["<<OTHER_07>>", "<<OTHER_07>>", "<<person_01>>", "[[EMAIL_01]]", "EMAIL_01"]
    assert got["dropped"] == ["<<URL_01>>"]
    mode = lambda response: one(spark, tokens.mangling(F.lit("<<PERSON_01>>"), F.col("t")), t=response)
    assert [mode(x) for x in ("PERSON_01", "person_01", "PERSON_1", "x")] == ["delimiters stripped/altered", "case changed", "number altered/dropped", "token absent entirely"]


def test_preservation(spark):
    df = spark.createDataFrame([(1, "<<A_01>> <<A_01>> <<B_01>>", "<<A_01>> b_01")], "k int, s string, r string")
    got = {(r["entity"], r["sent"], r["preserved"], r["mode"]) for r in metrics.preservation(df, "k", "s", "r").collect()}
    assert got == {("A", 2, 1, "delimiters stripped/altered"), ("B", 1, 0, "case changed")}


def test_value_types_and_numbering(spark):
    f = lambda s, t, v: (s, s + len(v), t, v, "x", 1.0)
    df = spark.createDataFrame([([f(0, "URL", "u"), f(5, "HANDLE", "u"), f(9, "URL", "v")],)], f"f {T.FINDINGS}")
    assert [(e["value"], e["token"]) for e in df.select(vault.entries(F.col("f")).alias("v")).first()["v"]] == [("u", "<<URL_01>>"), ("v", "<<URL_02>>")]


def test_sessions(spark):
    table = spark.createDataFrame([("a", "t", "v"), ("b", "t", "w")], "session_id string, token string, value string")
    asked = spark.createDataFrame([("a",), ("c",)], "session_id string")
    assert [r["session_id"] for r in vault.destroy(table, asked).collect()] == ["b"]
    assert [r["session_id"] for r in vault.missing(table, asked).collect()] == ["c"]
    assert vault.summary(table).columns == ["session_id", "token", "value_length"]


RESUME = {
    "basics": {"name": "Ada Byron", "image": "", "email": "ada@x.org", "location": {"city": "CA", "countryCode": "GB"}, "profiles": [{"username": "ada"}, {"username": "ada", "url": "http://x/ada"}]},
    "work": [{"name": "CATEGORY CA", "n": 3, "ok": True, "none": None, "empty": {}, "list": []}],
    "z": 'quote " newline \n é',
}


def test_json_source(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RESUME))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text('{"a": [null, true, {}]}')
    (tmp_path / "bad utf.txt").write_bytes(b"ok\nx\xff\xfey")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "x.doc").write_text("?")
    (tmp_path / "f.pdf").write_bytes(b"pdf")
    got = {r["doc_id"]: r for r in files.load(spark, str(tmp_path)).collect()}
    text = got["r"]["text"]
    assert text == json.dumps(RESUME, indent=2, ensure_ascii=False) + "\n"
    assert [text[s["start"] : s["end"]] for s in got["r"]["value_spans"] if s["path"].startswith("basics.location")] == ["CA", "GB"]
    assert [s["path"] for s in got["r"]["value_spans"]][-3:] == ["work[0].name", "work[0].n", "z"]
    assert "malformed" in got["bad"]["error"]
    assert got["none"]["error"] == "no data values"
    assert got["bad utf"]["text"].count("�") == 2
    assert "line 2" in got["bad utf"]["warnings"][0]
    assert got["blank"]["error"] == "empty file"
    assert "unsupported" in got["x"]["error"]
    assert "decoder" in got["f"]["error"]
    assert [r["filename"] for r in files.listing(files.read(spark, str(tmp_path))).collect()] == ["bad utf.txt", "bad.json", "blank.txt", "f.pdf", "none.json", "r.json"]
    assert files.find(files.read(spark, str(tmp_path)), "r").first()["filename"] == "r.json"
    made = pipeline.anonymized(files.load(spark, str(tmp_path / "r.json")), spans="value_spans").first()
    back = json.loads(made["anonymized"])
    assert back["basics"]["location"] == {"city": "<<LOCATION_01>>", "countryCode": "GB"}
    assert back["work"][0]["name"] == "CATEGORY <<LOCATION_01>>"
    assert [p["username"] for p in back["basics"]["profiles"]] == ["<<HANDLE_01>>", "<<HANDLE_01>>"]
    assert list(back) == list(RESUME)


def test_pdf_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    pages = [("*icon*Name      Right  side  \n\n\n\nend", [("ABC+FontAwesome", "*icon*")]), (ValueError("bad page"), []), ("  ", [])]
    got = files.load(spark, str(tmp_path), lambda raw: (pages, {"Author": " Ann ", "Title": ""})).first()
    assert got["text"] == "Name\nRight side\n\nend\n\n[PDF METADATA]\nAuthor: Ann"
    assert got["warnings"] == ["page 2: bad page", "page 1: 1 icon run(s) removed"]


def test_ner(spark):
    def analyzer():
        def run(text):
            if "fail" in text:
                raise RuntimeError
            return [(0, 3, "PERSON", 0.9), (4, 7, "LOCATION", 0.4), (0, 1, "ORG", 1.0)]

        return run

    got = ner.with_ner(rows(spark, ["Ann, xyz", "fail", ""]), analyzer)
    assert [r["ner_status"] for r in got.orderBy("doc_id").collect()] == ["ready", "failed", "ready"]
    made = {r["doc_id"]: r for r in pipeline.anonymized(got, ner="ner").collect()}
    assert made[0]["anonymized"] == "<<PERSON_01>>, xyz"
    assert made[1]["status"] == "ner_failed"
    none = ner.with_ner(rows(spark, ["Ann"]), None).first()
    assert none["ner_status"] == "unavailable"


def test_logs(spark):
    assert one(spark, logs.redacted(F.col("m"), F.array(F.lit("ab.c"), F.lit("ab.cd"))), m="x ab.cd abxc ab.c") == "x [REDACTED] abxc [REDACTED]"
    assert one(spark, logs.filename_secrets(F.col("f")), f="jane_roe-cv.txt") == ["jane_roe-cv", "jane roe cv"]
    assert one(spark, logs.secret(F.col("f")), f=" abc ") is None
    records = spark.range(1, 3001).withColumnRenamed("id", "seq")
    got = logs.since(records, 2990)
    assert sorted(r["seq"] for r in got.collect()) == list(range(2991, 3001))
    assert logs.newest(records).count() == 2000


def test_model_api(spark):
    url = lambda u: one(spark, model_api.completed_url(F.col("u")), u=u)
    assert [url(u) for u in ("http://h", "http://h/v1/", "http://h/v1/chat/completions?a=1", "https://h/x?token=t", "ftp://h")] == [
        "http://h/v1/chat/completions", "http://h/v1/chat/completions", "http://h/v1/chat/completions?a=1", "https://h/x/v1/chat/completions?token=t", None,
    ]
    assert one(spark, model_api.redacted_url(F.col("u")), u="http://h?a=1&Token=zz&key=q") == "http://h?a=1&Token=[REDACTED]&key=[REDACTED]"
    assert one(spark, model_api.response_text(F.col("u")), u='{"choices": [], "response": "r"}') == "r"
    assert one(spark, model_api.response_text(F.col("u")), u="oops") is None


def test_options():
    o = Options.from_env({"AI_PROVIDER": " groq ", "AI_PROVIDER_APIKEY": "k", "MODEL_TIMEOUT": ""})
    assert (o.unset(), o.seconds(), o.endpoint().local) == (None, 120.0, False)
    assert "k" not in str(o.described()["key_set"])
    assert Options(provider="mine").unset() == "no endpoint is configured"


def test_detection_confined_to_spans(spark):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(6).alias("end"), F.lit("a").alias("path")))
    assert one(spark, F.size(detect.detect(F.col("t"), spans)), t="a@b.cc d@e.ff") == 1


def test_derivatives_in_whole_texts(spark, tmp_path):
    """Handles that stand in the text itself, every form, and offsets behind a long text."""
    body = "Maria Schuster\n" + "plain words 😀 " * 3000 + "ask M.Schuster or schuster-x, mariaschuster. Not xmariaschuster\n"
    rows(spark, [body, "no name: 1", None]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["s"], r["value"]) for r in catalogue.QUERIES["q10_derivatives_in_texts"](spark, str(tmp_path)).collect()}
    assert {(body.index(v), v) for v in ("M.Schuster", "mariaschuster")} <= found
    forms = ["mariaschuster", "mschuster", "marias", "schustermaria", "maria.schuster", "maria_schuster", "maria-schuster", "m.schuster"]
    behind = [v for s, v in found if s > len(body)]
    assert sorted(behind) == sorted(v for f in forms if len(f) >= 8 for v in (f, f.upper()))
    assert len(found) == len(behind) + 2


def test_replaced_controls(spark, tmp_path):
    """Controls are held against the anonymized texts of their documents, whatever the ids are."""
    texts = ["Maria Schuster\nred Schuster met Maria Schuster. red, example", "no name, example 1\nred a@example.com red", "Red Rose\nred rose Rose", None]
    docs = rows(spark, texts).withColumn("doc_id", F.col("doc_id") + 5000)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    terms = [(1, "red example. Rose,"), (2, "rose Red Schuster")]
    spark.createDataFrame(terms, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["q31_replaced_controls"](spark, str(tmp_path)).collect()
    want = {5000: (3, 1, "Schuster"), 5001: (2, 0, ""), 5002: (4, 2, "Red,Rose"), 5003: (0, 0, "")}
    assert {r["doc_id"]: (r["n_controls"], r["n_replaced"], r["replaced"]) for r in got} == want


def test_negative_controls_of_label_files(spark, tmp_path):
    controls = {"a": ["Red Rose", "tea", ""], "b": ["a@example.com"]}
    for doc, values in controls.items():
        (tmp_path / f"{doc}_labels.json").write_text(json.dumps({"doc_id": doc, "negative_controls": [{"value": v, "note": ""} for v in values]}))
    made = [("a", "Red Rose\nlikes tea", "<<PERSON_01>>\nlikes tea"), ("b", "write a@example.com!", "write a@example.com!")]
    texts = spark.createDataFrame(made, "doc_id string, text string, anonymized string")
    got = metrics.controls_kept(files.negative_controls(files.label_files(spark, str(tmp_path))), texts).collect()
    assert {r["doc_id"]: (r["n_controls"], r["replaced"]) for r in got} == {"a": (3, ["Red Rose"]), "b": (1, [])}
