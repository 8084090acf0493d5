"""Many matches, many values, many spans: equal to plain versions, and linear."""

from __future__ import annotations

import http.server
import json
import random
import socket
import ssl
import threading
import time
import urllib.error
from http.client import BadStatusLine
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloakframe.config import Options
from cloakframe.functions import text as T
from cloakframe.functions.automaton import Matcher
from cloakframe.operators import detect, logs, ner, overlap, substitute, vault
from cloakframe.plans import pipeline
from cloakframe.sources import model, scratch


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def addresses(n: int) -> str:
    return " ".join(f"u{i}@ex.org" for i in range(n))


# --- offsets, overlaps, clipping ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_equals_a_loop(spark, n):
    items = F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>"))
    (row,) = spark.range(1).select(T.running(items, F.lit(0), lambda s, x: (s + x, s + x), "int").alias("x")).collect()
    assert row["x"] == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_between_cuts_anywhere(spark):
    r = random.Random(1)
    text = "".join(r.choice("ab😀é\n") for _ in range(3 * T.BLOCK + 17))
    cuts = [(0, 0), (0, len(text)), (T.BLOCK, T.BLOCK + 1), (T.BLOCK - 1, 2 * T.BLOCK), *(sorted((r.randrange(len(text)), r.randrange(len(text)))) for _ in range(40))]
    rows = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int").select("a", "b", T.between(T.blocks(F.col("t")), F.col("a"), F.col("b")).alias("x"))
    assert all(x["x"] == text[x["a"] : x["b"]] for x in rows.collect())


def test_many_matches_in_one_text_are_linear(spark):
    seconds(detect.with_findings(docs(spark, addresses(10)), F.col("text")))
    rows = docs(spark, addresses(32_000))
    assert seconds(rows.select(T.places(F.col("text"), T.EMAIL))) < 10  # a minute and more when an array grew at each match
    found = detect.with_findings(rows, F.col("text"))
    assert seconds(found) < 15
    (row,) = found.select(F.size("findings").alias("n"), F.col("findings")[31_999].alias("last")).collect()
    assert row["n"] == 32_000 and row["last"]["end"] == len(addresses(32_000))


def test_clipping_equals_every_span(spark):
    r = random.Random(2)
    cases = []
    for i in range(150):
        spans = [(s := r.randrange(80), s + r.randint(0, 15), "p") for _ in range(r.randint(0, 8))]
        found = [(s := r.randrange(80), s + r.randint(1, 9), "X", "v", "t", 1.0) for _ in range(r.randint(0, 10))]
        cases.append((i, spans, found))
    df = spark.createDataFrame(cases, "k long, spans array<struct<start:int,end:int,path:string>>, found array<struct<start:int,end:int,entity_type:string,value:string,tier:string,score:double>>")
    inside = lambda f, spans: any(s <= f[0] and f[1] <= e for s, e, _ in spans)
    want = {i: sorted((f[0], f[1]) for f in found if inside(f, spans)) for i, spans, found in cases}
    got = {x["k"]: [(f["start"], f["end"]) for f in x["c"]] for x in df.select("k", overlap.clipped(F.col("found"), F.col("spans")).alias("c")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == want
    by_rows = overlap.clipped_rows(df.select("k", F.explode("found").alias("f")).select("k", "f.start", "f.end"), df.select("k", F.explode("spans").alias("s")).select("k", "s.start", "s.end"), "k")
    out: dict[int, list] = {i: [] for i, _, _ in cases}
    for x in by_rows.collect():
        out[x["k"]].append((x["start"], x["end"]))
    assert {k: sorted(v) for k, v in out.items()} == want


def test_many_spans_are_linear(spark):
    n = 50_000
    spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 11).alias("start"), (i * 11 + 10).alias("end"), F.lit("p").alias("path")))
    text = docs(spark, " ".join(f"{i:010d}" for i in range(n)))
    found = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: T.finding(i * 11, i * 11 + F.when(i % 2 == 0, 10).otherwise(11), "X", F.lit("v"), "t"))
    rows = T.barrier(text, "kept", overlap.clipped(found, spans)).select(F.size("kept").alias("n"))
    began = time.perf_counter()
    assert rows.first()["n"] == n // 2
    assert time.perf_counter() - began < 20


def plain_greedy(rows: list[tuple[int, int, int]]) -> list[int]:
    kept: list[tuple[int, int, int]] = []
    for s, e, i in sorted(rows, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(not (s < b and a < e) for a, b, _ in kept):
            kept.append((s, e, i))
    return sorted(i for _, _, i in kept)


def test_overlap_of_tables_with_other_columns(spark):
    r = random.Random(5)
    table = [(k, s := r.randrange(40), s + r.randint(1, 12), i, "x") for k in (None, 1, 2) for i in range(60)]
    got = overlap.resolved_rows(spark.createDataFrame(table, "k int, start int, end int, i int, note string").repartition(4), "k", "i").collect()
    for k in (None, 1, 2):
        assert sorted(x["i"] for x in got if x["k"] == k) == plain_greedy([(s, e, i) for key, s, e, i, _ in table if key == k])
    assert {x["note"] for x in got} == {"x"}


def test_one_key_of_a_long_chain(spark):
    """A chain in which every row meets the next has one cluster; every other row stays."""
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 4).alias("end"), "id")
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + n))
    kept = overlap.resolved_rows(twice, "k", "id").agg(F.count("*").alias("n"), F.max("id").alias("last"), F.sum(F.col("id") % 2).alias("odd")).first()
    assert (kept["n"], kept["last"], kept["odd"]) == (n // 2, n - 2, 0)


# --- many values --------------------------------------------------------------------------------------------


def test_automaton_equals_the_alternation(spark):
    """Rows on both sides of MANY are substituted alike."""
    r = random.Random(3)
    letters = "ab1_ .-é😀"
    cases = []
    for i in range(120):
        values = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))})
        text = "".join(r.choice(letters + "c") for _ in range(r.randint(0, 60)))
        spans = None if i % 2 else [(s, min(s + 9, len(text)), "p") for s in range(0, len(text), 13)]
        cases.append((i, text, values, [f"<<V_{k + 10}>>" for k in range(len(values))], spans))
    df = spark.createDataFrame(cases, "k long, t string, v array<string>, tokens array<string>, spans array<struct<start:int,end:int,path:string>>")
    mapping = F.map_from_arrays("v", "tokens")

    def made(rows, spans):
        return {x["k"]: (x["_s"]["text"], x["_s"]["n"], x["_s"]["leaks"]) for x in substitute.with_substitution(rows, F.col("t"), F.col("v"), mapping, spans).collect()}

    for part, spans in ((df.where("spans is null"), None), (df.where("spans is not null"), F.col("spans"))):
        few = made(part, spans)
        most, substitute.MANY = substitute.MANY, 0
        try:
            many = made(part, spans)
        finally:
            substitute.MANY = most
        assert many == few and len(few) == 60


def test_four_thousand_values(spark):
    seconds(pipeline.anonymized(docs(spark, addresses(100))))
    made = pipeline.anonymized(docs(spark, addresses(4000)))
    assert seconds(made) < 8  # about 1 s; 18 s by an alternation
    row = made.first()
    assert row["status"] == "ok" and row["anonymized"].startswith("<<EMAIL_01>> <<EMAIL_02>> ") and row["anonymized"].endswith("<<EMAIL_4000>>") and row["n_replaced"] == 4000


def test_matcher():
    m = Matcher(["CA", "Cambridge", "+1 5", "a.b"])
    assert list(m.matches("CA CATEGORY xCA CA_ Cambridge,+1 5 +1 55 a.b")) == [(0, "CA"), (20, "Cambridge"), (30, "+1 5"), (41, "a.b")]
    assert not Matcher([]) and list(Matcher([""]).matches("x")) == [] and Matcher(["aa"], guarded=False).present("xaay") == {"aa"}
    assert Matcher(["a"]).replaced("a a", {"a": None}) == (None, 0)


def test_records_are_redacted_alike(spark):
    r = random.Random(4)
    messages = [None, "", *("".join(r.choice("abcd 😀") for _ in range(r.randint(0, 40))) for _ in range(150))]
    secrets = ["".join(r.choice("abcd 😀") for _ in range(r.randint(3, 6))) for _ in range(60)] + [" abc ", None, "abcd", "abcdab"]
    records = spark.createDataFrame([(i, m, "x") for i, m in enumerate(messages)], "seq long, message string, secret string")
    table = spark.createDataFrame([(s,) for s in secrets], "secret string")
    known = sorted({s.strip(" ") for s in secrets if s and len(s.strip(" ")) >= 4}, key=lambda s: -len(s))

    def plain(m: str | None) -> str | None:
        if m is None:
            return None
        out, i = [], 0
        while i < len(m):
            hit = next((s for s in known if m.startswith(s, i)), None)
            out.append("[REDACTED]" if hit else m[i])
            i += len(hit) if hit else 1
        return "".join(out)

    for small in (1000, 3):
        got = logs.redacted_records(records, table, small)
        assert got.columns == records.columns
        assert {x["seq"]: x["message"] for x in got.collect()} == {i: plain(m) for i, m in enumerate(messages)}


def test_a_part_that_every_message_has(spark, monkeypatch):
    monkeypatch.setattr(logs, "SHARE", 7)
    said = spark.createDataFrame([(f"user {i} said user",) for i in range(100)], "message string")
    known = spark.createDataFrame([(0, "user"), (1, "said user"), (2, "user 77 s"), (3, "user 177")], "label_id long, value string")
    assert {x["label_id"] for x in logs.leaked(said, known, 1).collect()} == {0, 1, 2}


# --- vaults, runs, the exchange --------------------------------------------------------------------------------


def test_vaults_grow(spark):
    rows = [("s", 1, 0, "a", "PERSON"), ("s", 1, 9, "b", "EMAIL"), ("s", 2, 0, "b", "PERSON"), ("s", 2, 5, "c", "PERSON"), ("t", 2, 1, "a", "EMAIL"), ("s", 3, 1, "d", "EMAIL"), ("s", 3, 2, "a", "EMAIL"), ("t", 3, 0, "z", "EMAIL")]
    found = spark.createDataFrame(rows, "session string, turn int, s int, value string, entity_type string")
    once = {tuple(r) for r in vault.numbered(found, "session", ["turn", "s"]).collect()}
    held = vault.numbered(found.where("turn = 1"), "session", ["turn", "s"])
    vault.save(held, "vault_of_test", "session", 4)
    for turn in (2, 3):
        grown = vault.extended(spark.table("vault_of_test"), found.where(f"turn = {turn}"), "session", ["turn", "s"])
        vault.save(scratch.written(grown, "grown"), "vault_of_test", "session", 4)
    assert {tuple(r) for r in spark.table("vault_of_test").collect()} == once
    empty = vault.extended(held.where("false"), found, "session", ["turn", "s"])
    assert {tuple(r) for r in empty.collect()} == once


def shared_files(spark) -> set[str]:
    top = Path(scratch.shared_dir(spark).removeprefix("file:"))
    return {str(p) for p in top.rglob("*.parquet")}


def test_run_leaves_no_vault(spark):
    texts = ["Ann Bee\nann.bee@x.org wrote", "nothing here", " ", "call 041 102 1021"]
    before = shared_files(spark)
    results, blocked = pipeline.run(docs(spark, *texts), Options(), model.mock_transport("echo"))
    left = shared_files(spark) - before
    assert left and {Path(p).parent.name.split("-")[0] for p in left} == {"results", "blocked"}
    assert {r["doc_id"]: r["rehydrated"] for r in results.collect()} == {0: texts[0], 1: texts[1], 3: texts[3]}
    assert [r["doc_id"] for r in blocked.collect()] == [2]

    def broken():
        raise RuntimeError("no transport")

    before = shared_files(spark)
    with pytest.raises(Exception, match="no transport"):
        pipeline.run(docs(spark, *texts), Options(), broken)
    assert not {p for p in shared_files(spark) - before if "/made-" in p}


def test_run_with_the_model_tier(spark):
    def factory():
        def analyze(text: str) -> list[tuple[int, int, str, float]]:
            if "boom" in text:
                raise ValueError
            return [(m, m + 4, "PERSON", 0.7) for m in [text.find("Zora")] if m >= 0] + [(m, m + 4, "PERSON", 0.55) for m in [text.find("Yann")] if m >= 0]

        return analyze

    texts = ["then, Zora met Yann.", "boom, said Zora."]
    run = lambda **o: pipeline.run(docs(spark, *texts), Options(**o), model.mock_transport("echo"), analyzer=factory)
    for options, cleared in (({"ner": True}, 1), ({"ner": True, "ner_lenient": True}, 2), ({}, 2)):
        results, blocked = run(**options)
        assert results.count() == cleared and {r["status"] for r in blocked.collect()} == ({"ner_failed"} if cleared == 1 else set())
    sent = lambda score: pipeline.anonymized(ner.with_ner(docs(spark, texts[0]), factory), ner="ner", least=score).first()["anonymized"]
    assert sent(0.5) == "then, <<PERSON_01>> met <<PERSON_02>>." and sent(0.6) == "then, <<PERSON_01>> met Yann."


def counting(folder: Path, fail_after: int | None = None):
    """A transport that notes each request in a file of its own, and dies once after some of them."""

    def make():
        import uuid

        def post(body: str) -> tuple[int, str]:
            seen = list(folder.glob("sent-*"))
            if fail_after is not None and len(seen) >= fail_after and not (folder / "died").exists():
                (folder / "died").touch()
                raise RuntimeError("the worker is lost")
            (folder / f"sent-{uuid.uuid4().hex}").write_text(body)
            user = json.loads(body)["messages"][1]["content"]
            return 200, json.dumps({"choices": [{"message": {"content": user}}]})

        return post

    return make


def test_no_text_is_sent_twice(spark, tmp_path):
    """A task that dies half way is tried again by hand, as a local master tries no task again, under the same ledger."""
    sent, ledger = tmp_path / "sent", str(tmp_path / "ledger")
    sent.mkdir()
    cleared = spark.createDataFrame([(i, f"text {i % 30}") for i in range(90)], "doc_id long, text string")
    ask = lambda fail: model.exchange(cleared, "doc_id", "text", Options(), counting(sent, fail), ledger, batch=2, threads=1)
    with pytest.raises(Exception, match="the worker is lost"):
        ask(11)
    once = len(list(sent.glob("sent-*")))
    assert 0 < once < 30
    got = ask(None).collect()
    bodies = [p.read_text() for p in sent.glob("sent-*")]
    assert len(got) == 90 and all(r["text"] == f"text {r['doc_id'] % 30}" and r["reason"] is None for r in got)
    # What stood in an unfinished file of two is all that may be asked again.
    assert len(set(bodies)) == 30 and len(bodies) <= 30 + 8
    more = model.exchange(cleared.where("doc_id < 5"), "doc_id", "text", Options(), counting(sent), ledger).collect()
    assert len(more) == 5 and len(list(sent.glob("sent-*"))) == len(bodies)


def test_what_may_pass_is_tried_again(spark, tmp_path):
    def flaky():
        calls = []

        def post(_body: str) -> tuple[int, str]:
            calls.append(1)
            if len(calls) == 1:
                raise TimeoutError
            return (503, "busy") if len(calls) == 2 else (200, '{"response": "fine"}')

        return post

    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert model.exchange(one, "doc_id", "text", Options(), flaky, wait=0.01).first()["text"] == "fine"
    assert model.exchange(one, "doc_id", "text", Options(), flaky, wait=0.01, tries=1).first()["reason"] == "timeout"
    odd = model.exchange(one, "doc_id", "text", Options(), lambda: lambda _b: (200, "<html>")).first()
    assert odd["text"] is None and odd["reason"] == "no text in the response: <html>"


class _Odd(http.server.BaseHTTPRequestHandler):
    def do_POST(self) -> None:  # noqa: N802
        self.rfile.read(int(self.headers["Content-Length"]))
        if self.path == "/slow":
            time.sleep(1.5)
        elif self.path == "/cut":
            self.wfile.write(b"garbage\r\n\r\n")
        else:
            self.send_error(404, "model not found")

    def log_message(self, *_: object) -> None:
        pass


def test_causes_of_failures():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Odd)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        closed = f"http://127.0.0.1:{s.getsockname()[1]}"

    def cause(url: str) -> str:
        try:
            return str(model.http_transport(url, "", 0.5)()("{}")[0])
        except Exception as e:  # noqa: BLE001
            return model.failure(e)

    try:
        assert [cause(at + "/slow"), cause(at + "/cut"), cause(at + "/x"), cause(closed)] == ["timeout", "broken response", "404", "nothing listens there"]
        assert cause(at.replace("http:", "https:")) == "TLS"
    finally:
        server.shutdown()
    assert model.failure(urllib.error.URLError(socket.gaierror(8, "x"))) == "unknown host"
    assert model.failure(urllib.error.URLError(ssl.SSLCertVerificationError("x"))) == "TLS"
    assert model.failure(BadStatusLine("x")) == "broken response" and model.failure(OSError(5, "x")).startswith("unreachable")


def test_known_endpoints():
    unset = {n: Options.from_env({"AI_PROVIDER": f" {n} ", "MODEL_TIMEOUT": " "}).unset() for n in ("ollama", "openai", "mine")}
    assert unset == {"ollama": None, "openai": "the endpoint needs a key", "mine": "no endpoint is configured"}
    assert Options.from_env({"NER_LENIENT": "yes", "NER_SCORE_THRESHOLD": "0.7"}) == Options(ner_lenient=True, ner_score=0.7)


def test_files_are_read_once(spark, tmp_path):
    for name in ("a.txt", "b.json", "c.csv"):
        (tmp_path / name).write_text('{"a": "x"}')
    from cloakframe.sources import files

    df = files.load(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("binaryFile") == 1
    assert {r["doc_id"]: r["source_format"] for r in df.collect()} == {"a": "text", "b": "json", "c": "unsupported"}


def test_a_path_is_held_against_each_rule_once(spark):
    """In finding fields; and values are cut from their place in the first block as in later ones."""
    n = T.BLOCK
    text = "x" * (n - 3) + "Maria 👍 Stone" + "y" * n
    spans = [(n - 3, n + 10, "basics.name"), (0, 4, "work[0].name"), (0, 4, "basics.phone"), (3, n, "basics.email"), (5, 5, "basics.url"), (0, 1, None)]
    rows = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,path:string>>").select(T.field_findings(F.col("t"), F.col("s")).alias("f"))
    assert [(f["start"], f["end"], f["entity_type"], f["value"]) for f in rows.first()["f"]] == [(s, e, k, text[s:e]) for s, e, k in ((n - 3, n + 10, "PERSON"), (0, 4, "PHONE"), (3, n, "EMAIL"))]
    assert rows._jdf.queryExecution().analyzed().toString().count(r"^basics\.name$") == 1
