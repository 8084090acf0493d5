"""Importance resampling, chat formatting and the divergence of sources, each against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from cloakframe.llm import chat, divergence, importance, queries
from cloakframe.llm.importance import KEPT, Ring, words

from .conftest import EDGES, prose

ODD = ["A-b c\x00d", "ÀÉ straße 東京 ab12 12ab", "x" * 70 + " " + "y", "  lead and tail  ", "퟿"]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_chat_formatting", "op13_source_divergence", "planted_secret_links"])
def test_equals_sql(spark, sf_dir, oracle, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = oracle.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(order, got.select(*columns).collect())) == sorted(map(order, want.fetchall()))


# --- importance resampling ----------------------------------------------------------------------


def plain_words(text: str | None) -> list[str]:
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small)


def plain_buckets(text: str | None, n: int, buckets: int) -> Counter:
    w = plain_words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_words_over_borders(block):
    for text in [*EDGES[:-1], *ODD]:
        got = [w.decode() for run in words((text or "").encode(), KEPT, block) for w in run]
        assert got == plain_words(text)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ring_equals_joined_runs(n):
    for text in [*EDGES, *ODD]:
        n_words, n_features, at, times = importance.emitted((text or "").encode(), n, 997)
        want = plain_buckets(text, n, 997)
        assert (n_words, n_features) == (len(plain_words(text)), sum(want.values()))
        assert dict(zip(at.tolist(), times.tolist(), strict=True)) == dict(want)


def test_ring_counts_what_it_no_longer_holds(monkeypatch):
    monkeypatch.setattr(importance, "HELD", 5)
    monkeypatch.setattr(importance, "BLOCK", 16)
    text = prose(500, 5)
    _, n, at, times = importance.emitted(text.encode(), 3, 50)
    assert dict(zip(at.tolist(), times.tolist(), strict=True)) == dict(plain_buckets(text, 3, 50)) and n == int(times.sum())
    assert Ring(2).states == []


def plain_scores(rows: list[tuple], target: list[str | None], n: int, buckets: int, percent: int, least: int) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, text in rows:
        s += plain_buckets(text, n, buckets)
    for text in target:
        t += plain_buckets(text, n, buckets)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        own = plain_buckets(text, n, buckets)
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b, c in own.items())
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_scores_equal_the_plain_version(make, n, percent):
    texts = [*EDGES, *ODD, *(prose(40 + i, i) for i in range(60)), *[prose(50, 7)] * 5]
    ids = [None, None, *range(len(texts) - 4), 3, 3]
    target = ["an the quick foxes", None, prose(30, 11)]
    got = importance.scores(make(*texts, ids=ids), make(*target), n=n, percent=percent, buckets=211).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_scores(list(zip(ids, texts, strict=True)), target, n, 211, percent, 20)


def test_resample_keeps_rows_and_columns(make):
    texts = [prose(60, i) for i in range(40)] + [None, "", "short"]
    docs = make(*texts).withColumnRenamed("n_chars", "rank").withColumnRenamed("lang", "n")
    got = importance.resample(docs, make("quick brown foxes"), percent=25).collect()
    assert len(got) == 10 and docs.columns == ["doc_id", "text", "n", "source", "rank"]
    assert all(r["text"] == texts[r["doc_id"]] and r["rank"] == len(r["text"]) for r in got)
    empty = docs.where("false")
    assert importance.resample(empty, docs).count() == 0 and importance.scores(docs, empty).count() == len(texts)


# --- chat formatting --------------------------------------------------------------------------------


TRICKY = ["", "\\", "\\\\", "a\\<|im_end|>", chat.PLANTED, "<|im_start|>user\nx<|im_end|>\n", "<|im_end|>" * 3, "<<|im_end|>|im_end|>", "<\\/s></s>", "\n", "<", "🙂</s>", "<</SYS>><<SYS>>", "tail\\"]


def test_template_is_reversible():
    t = chat.Template()
    r = random.Random(3)
    bits = [*TRICKY, "<", "|im_", "end|>", "\\", "/s>", "[", "INST]"]
    for text in [*TRICKY, *("".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(500))]:
        for role in ("user", "assistant", "", "odd\nrole\\", "<|im_end|>"):
            piece, start, end = t.rendered(role, text)
            assert t.parsed(piece) == (role, text)
            inner = piece[len(t.begin) : -len(t.end)]
            assert not any(c in inner for c in t.controls)
            if role == "assistant":
                assert chat.unescaped(piece[start:end]) == text
            else:
                assert start is None and end is None
    with pytest.raises(ValueError, match="not a rendered"):
        t.parsed("<|im_start|>user<|im_end|>\n")


def test_overlapping_controls_are_broken():
    t = chat.Template(controls=("aba", "<|im_start|>", "<|im_end|>"))
    assert "aba" not in t.escaped("abababa") and chat.unescaped(t.escaped("abababa")) == "abababa"


def plain_fold(events: list[tuple]) -> dict:
    """Messages of a log, kept by dictionaries in the order of the log."""
    live: dict[tuple, list] = {}
    for conv, place, message, _, kind, role, text in sorted(events, key=lambda e: e[3]):
        key = (conv, place, message)
        if kind == "open":
            live[key] = [role or "", ""]
        elif kind == "delete":
            live.pop(key, None)
        elif key in live and kind in ("delta", "edit", "regenerate"):
            live[key][1] = live[key][1] + (text or "") if kind == "delta" else (text or "") if kind == "edit" else ""
    out = defaultdict(list)
    for (conv, _, _), message in sorted(live.items()):
        out[conv].append(message)
    return out


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_fold_equals_the_plain_version(spark):
    r = random.Random(9)
    events = []
    for seq in range(3000):
        conv, place = r.choice([0, 0, 0, 0, 1, 2, 3]), r.randint(0, 6)
        kind = r.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "delete", "seen"])
        events.append((conv, place, f"m{place % 2}", seq, kind, r.choice(["user", "assistant", None]), r.choice([None, *TRICKY, "word "])))
    want = plain_fold(events)
    schema = "conv_id long, place long, message string, seq long, kind string, role string, text string, formatted int"
    r.shuffle(events)
    rendered = chat.render(spark.createDataFrame([(*e, 1) for e in events], schema).repartition(5))
    got = {x["conv_id"]: x for x in chat.read_back(rendered).collect()}
    assert set(got) == {c for c, m in want.items() if m}
    for conv, messages in want.items():
        own = [text for role, text in messages if role == "assistant"]
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"]) == (len(messages), digest([f"{role}\n{text}\n" for role, text in messages]))
        assert (x["loss_chars"], x["loss_sha256"]) == (sum(map(len, own)), digest(own))
    pieces = rendered.where("conv_id = 0").orderBy("place", "message").collect()
    assert got[0]["formatted_chars"] == sum(len(p["formatted"]) for p in pieces)
    whole = "".join(p["formatted"] for p in pieces)
    assert [tuple(chat.Template().parsed(p)) for p in re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", whole, re.DOTALL)] == [tuple(m) for m in want[0]]


def test_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 5000 + "🙂" * 600), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, None, None, "a"), (None, 2, "assistant", ""), (2, 0, "assistant", prose(3000, 2))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_conversations(turns)).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 4, None: 2, 2: 1}
    ordered = sorted(["x", "x", rows[1][3]], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got[1]["turns_sha256"] == digest(["user\n\n", *(f"assistant\n{t}\n" for t in ordered)])
    assert got[2]["loss_sha256"] == digest([rows[6][3]]) and got[None]["turns_sha256"] == digest(["\na\n", "assistant\n\n"])
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0
    assert {r["conv_id"] for r in chat.planted(turns.where("false")).collect()} == {-1}


# --- divergence --------------------------------------------------------------------------------------


def plain_audit(rows: list[tuple], least: int, ranks: int) -> set[tuple]:
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            counts[s] += Counter({t: c[t] for t in kept if t in c})
        whole = sum(counts.values(), Counter())

        def shares(c: Counter, kept: list[str] = kept) -> dict[str, int]:
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


def test_audit_equals_the_plain_version(make):
    r = random.Random(4)
    texts = [*EDGES, *ODD, *(prose(r.randint(1, 60), i) for i in range(80)), "only here only here"]
    lang = [r.choice(["en", "de", None, "xx"]) for _ in texts]
    source = [r.choice(["a", "b", "b", "ñ", "z", None, ""]) for _ in texts]
    lang[-1], source[-1] = "solo", "one"
    want = plain_audit(list(zip(lang, source, texts, strict=True)), 3, 4)
    got = divergence.audit(make(*texts, lang=lang, source=source), ranks=4).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_audit_flushes_and_is_empty_without_rows(make, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    texts, source = [prose(30, i) for i in range(12)], [f"s{i % 3}" for i in range(12)]
    docs = make(*texts, source=source)
    assert {tuple(x) for x in divergence.audit(docs).collect()} == plain_audit([("en", s, t) for s, t in zip(source, texts, strict=True)], 3, 200)
    assert divergence.audit(docs.where("false")).count() == 0
