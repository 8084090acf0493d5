from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cloakframe.llm import column_bwt, common, exact_substrings, minhash, simhash

from .conftest import EDGES, prose


def brute_removed(docs: list[tuple[int, bytes]], width: int = 100) -> dict[int, tuple[int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for doc_id, raw in sorted(docs):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = True
            seen.add(window)
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[doc_id] = (int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def planted(n: int, seed: int) -> list[str]:
    """Texts that share passages, with edits, in periods and within themselves."""
    r = random.Random(seed)
    pool = [prose(r.randint(5, 60), 100 + i) for i in range(8)] + ["ab" * 90, "abc" * 50, "z" * 130]
    out = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < 0.6 else prose(r.randint(1, 40), seed * 1000 + i) for _ in range(r.randint(1, 6))]
        text = " ".join(parts)
        if r.random() < 0.5 and text:
            at = r.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        out.append(text)
    return out


@pytest.mark.parametrize(("hot", "collection"), [(exact_substrings.HOT, exact_substrings.COLLECTION), (3, 5)])
def test_substrings_equal_brute_force(make, hot, collection):
    texts = [*EDGES[:-1], *planted(60, 1)]
    got = {r["doc_id"]: r for r in exact_substrings.remove(make(*texts), hot, collection).collect()}
    want = brute_removed([(i, (t or "").encode()) for i, t in enumerate(texts)])
    assert len(got) == len(texts)
    for i, (removed, spans, sha) in want.items():
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (removed, spans, sha), i
        assert hashlib.sha256(got[i]["kept"]).hexdigest() == sha


def test_substrings_frequent_anchors(make, monkeypatch):
    """Frequent anchors are dealt apart; results are the same."""
    passage = prose(60, 77)
    texts = [f"{i} " + passage + f" {'xyz'[i % 3]}{i // 9} " + prose(i % 7, i) for i in range(90)]
    docs = make(*texts)
    want = brute_removed([(i, t.encode()) for i, t in enumerate(texts)])
    monkeypatch.setattr(exact_substrings, "SHOWN", 1)
    numbered = docs.withColumn("k", docs["doc_id"])
    often = exact_substrings.frequent(numbered)
    assert len(often) > 0
    rows = exact_substrings.anchored(numbered, often)
    assert rows.where("hot").count() > 10
    got = {r["doc_id"]: r for r in exact_substrings.remove(docs).collect()}
    assert {i: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_substrings_repeated_and_null_ids(make):
    a, b = prose(60, 5), prose(60, 6)
    rows = exact_substrings.remove(make(a, a, b, a, b, ids=[7, 7, 7, None, 9])).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_bytes"] == len(a.encode()), r["n_removed"] > 0) for r in rows)
    assert len(a.encode()) != len(b.encode())
    # Texts of one id are in the order of their hash: rows that repeat id and text are one document.
    assert got == [(7, False, False), (7, True, False), (7, True, False), (9, False, True), (99, True, True)]


def test_substrings_long_parts(make, monkeypatch):
    text = prose(3000, 9)
    data = np.frombuffer((text + text[:700]).encode(), np.uint8)
    monkeypatch.setattr(exact_substrings, "PART", 1000)
    seen = []
    for _, ahead, part, offsets in exact_substrings.parts(data, np.array([0, len(data)])):
        _, begin, end, _, _ = exact_substrings.pieces(part, offsets, exact_substrings.GRAM)
        for a, b in zip(begin + ahead, end + ahead, strict=True):
            seen += range(a, b - exact_substrings.WIDTH + 1)
    assert sorted(seen) == list(range(len(data) - exact_substrings.WIDTH + 1))


def test_substrings_do_not_trust_hashes(monkeypatch):
    r = random.Random(8)
    shared = [bytes(r.choice(b"abcd") for _ in range(130)) for _ in range(3)]
    strings = [s[: r.randint(101, 130)] for s in shared for _ in range(4)] + [bytes(r.choice(b"abcd") for _ in range(130)) for _ in range(4)]
    k, start = np.arange(len(strings)), np.zeros(len(strings), np.int64)

    def gone():
        marks = set()
        for own, a, b in zip(*exact_substrings.repeated(k, start, strings), strict=True):
            marks.update((int(own), i) for i in range(a, b))
        return marks

    want, seen = set(), set()
    for i, text in enumerate(strings):
        for at in range(len(text) - exact_substrings.WIDTH + 1):
            window = text[at : at + exact_substrings.WIDTH]
            if window in seen:
                want.update((i, at + j) for j in range(exact_substrings.WIDTH))
            seen.add(window)
    assert gone() == want
    monkeypatch.setattr(exact_substrings.common, "span_hash", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    assert gone() == want


def test_substrings_keyed_digests():
    raw, begin, end = b"abcabc", np.array([0, 3, 1]), np.array([3, 6, 4])
    one, other = (exact_substrings.digests(raw, begin, end, key) for key in (b"1", b"2"))
    assert (one[0] == one[1]).all()
    assert (one[0] != one[2]).any()
    assert (one != other).any()
    assert exact_substrings.digests(raw, begin[:0], end[:0], b"1").shape == (0, 2)


def test_empty_tables(make, spark):
    none = make("x").limit(0)
    assert exact_substrings.remove(none).count() == 0
    assert simhash.classes(none).count() == 0
    assert minhash.edits(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd"])
def test_transform_and_prefixes(alphabet, tmp_path):
    r = random.Random(3)
    for _ in range(15):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(20)]
        rows = column_bwt.construct(strings)
        again = column_bwt.construct(strings, str(tmp_path))
        assert all((rows[x] == again[x]).all() for x in rows)
        suffixes = sorted(((list(s[len(s) - n :]) + [i - 1000], i, n) for i, s in enumerate(strings) for n in range(len(s) + 1)), key=lambda x: x[0])
        assert list(zip(rows["owner"].tolist(), rows["length"].tolist(), strict=True)) == [(i, n) for _, i, n in suffixes]
        before = [column_bwt.END if n == len(strings[i]) else strings[i][len(strings[i]) - n - 1] for _, i, n in suffixes]
        assert rows["bwt"].tolist() == before
        common = [0]
        for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False):
            common.append(next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))
        assert rows["lcp"].tolist() == common


def brute_simhash(text: str) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i, _ in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash_equals_brute_force(make, spark, hot):
    base = prose(200, 4)
    r = random.Random(8)
    near = []
    for _ in range(25):
        words = base.split(" ")
        words[r.randrange(len(words))] = "edit"
        near.append(" ".join(words))
    texts = [*EDGES[:-1], base.upper(), *near, *planted(40, 2)]
    got = {r["doc_id"]: r for r in simhash.classes(make(*texts), hot).collect()}
    fps = [(i, brute_simhash(t or "")) for i, t in enumerate(texts)]
    for i, fp in fps:
        assert got[i]["fingerprint"] == f"{fp:016x}"
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)
    kept = [r["doc_id"] for r in simhash.deduplicate(make(*texts), hot).collect()]
    assert sorted(kept) == sorted(set(brute_components(fps).values()))


def test_simhash_keeps_one_row_of_repeated_and_null_ids(make):
    one, two = prose(40, 1), prose(40, 2)
    docs = make(one, one, two, two, one, None, "", ids=[4, 4, None, None, None, None, 9]).withColumnRenamed("lang", "row").withColumnRenamed("source", "tie")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["row"], r["tie"]) for r in kept.collect()) == sorted([("4", one, "en", "s0"), ("None", two, "en", "s0"), ("9", "", "en", "s0")])
    assert {r["component_id"] for r in simhash.classes(docs).where("doc_id is null").collect()} == {4, 9, None}


@pytest.mark.parametrize("limit", [None, 1])
def test_components(spark, monkeypatch, limit):
    if limit:  # every key is dealt over several tasks
        monkeypatch.setattr(common, "SHARE", limit)
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 440)] + [(990, i) for i in range(940, 980)] + [(i, i + 1) for i in range(500, 540)]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    want = common.local_roots(1000, *(np.array([e[i] for e in edges]) for i in (0, 1)))
    assert {x: got.get(x, x) for x in nodes} == {x: int(want[x]) for x in nodes}


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash_links_at_the_limit(spark, hot):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for flips in (1, 2, 3, 4):
            x = b
            for bit in r.sample(range(64), flips):
                x ^= 1 << bit
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    roots = {row["node"]: row["root"] for row in simhash.roots(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    want = brute_components([(x, x & (1 << 64) - 1) for x in signed])
    assert {x: roots.get(x, x) for x in signed} == want


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 500, np.uint64), r.integers(0, 1 << 63, 500, np.uint64)
    counts = lambda x: np.array([[(int(v) >> 2 * i & 3).bit_count() for i in range(32)] for v in x])
    want = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (simhash.manhattan(a, b) == want).all()
    assert (want <= simhash.ones(a ^ b)).all()


def test_fingerprint_edits(make):
    texts = [*EDGES, "a b c d e f g h", "i j k l m n o p"]
    rows = {r["doc_id"]: r for r in minhash.edits(make(*texts)).collect()}
    assert len(rows) == len(texts)
    by_text: dict[str, set] = {}
    for i, text in enumerate(texts):
        text, following = text or "", (texts[i - 1] if i else texts[-1]) or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(rows[i]["fingerprint"])
        by_text.setdefault(edited, set()).add(rows[i]["edited_fingerprint"])
        assert 0 <= rows[i]["near_edited"] <= 1
        assert 0 <= rows[i]["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert rows[7]["near_next"] == 1.0


def test_fingerprint_estimates_jaccard():
    r = random.Random(5)
    for share in (0.0, 0.3, 0.7, 1.0):
        words = [f"w{r.random()}" for _ in range(800)]
        other = words[: int(800 * share)] + [f"v{r.random()}" for _ in range(800 - int(800 * share))]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        true = len(grams(words) & grams(other)) / len(grams(words) | grams(other))
        sign = minhash.signatures(*minhash.block([" ".join(words).encode(), " ".join(other).encode()]))
        assert abs(float(minhash.likeness(sign[:1], sign[1:])[0]) - true) < 0.13


def test_fingerprint_repeated_ids(make, monkeypatch):
    rows = minhash.edits(make("aa bb", "aa bb", "cc dd", None, ids=[3, 3, None, 1])).collect()
    assert len(rows) == 4
    # Null and equal ids of many rows are cut into several parts; every row is edited with the one that follows it.
    monkeypatch.setattr(common, "SHARE", 2)
    texts = [prose(6, i) for i in range(90)]
    docs = make(*texts, ids=[None] * 40 + [5] * 40 + list(range(10)))
    ordered = minhash.in_order(docs)
    assert ordered.where("doc_id is null").select("part").distinct().count() > 2
    rows = [{"doc_id": r["doc_id"], "h": r["h"], "text": minhash.expanded(bytes(r["z"])).decode()} for r in ordered.where("not tail").collect()]
    line = sorted(rows, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["h"]), reverse=True)
    want = {(r["doc_id"], r["text"][: len(r["text"]) - len(r["text"]) // 2] + f["text"][: len(r["text"]) // 2]) for r, f in zip(line, [*line[1:], line[0]], strict=True)}
    got = {(r["doc_id"], r["edited_sha256"]) for r in minhash.edits(docs).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want}


def test_sort_keys():
    values = [-(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 40, (1 << 63) - 1]
    pairs = [(a, b) for a in values for b in values]
    keys = minhash.sort_keys(*(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))
    assert [pairs[i] for i in np.argsort(keys, kind="stable")] == sorted(pairs)


def shingles(text: str | None) -> set[tuple]:
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_classes(texts: list[str | None]) -> list[int]:
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            either = sets[i] | sets[j]
            if (len(sets[i] & sets[j]) / len(either) if either else 1) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("hot", [2048, 3])
def test_near_duplicates(make, hot):
    r = random.Random(17)
    texts = [*EDGES[:-1], prose(400, 12)]
    for family in range(4):  # chains: neighbours are alike, ends aren't
        words = prose(300, 20 + family).split()
        for _ in range(12):
            texts.append(" ".join(words))
            at = r.randrange(0, 270)
            words[at : at + 22] = [w + "x" for w in words[at : at + 22]]
    texts += texts[14:18]
    found = {row["doc_id"]: row["class_id"] for row in minhash.near_duplicates(make(*texts), hot=hot).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)
    some = make(*texts[:20])
    links = minhash.near_links(minhash.distinct_texts(minhash.signed(some)), some, hot=hot)
    assert links.columns == ["a", "b", "jaccard"]
    assert links.where("jaccard < 0.8").count() == 0


def test_compatible_loses_no_pair():
    """Of two sets in one order, the place of the first common element bounds what they share."""
    r = random.Random(6)
    for _ in range(3000):
        pool = range(r.choice((6, 12, 40)))
        a, b = (sorted(r.sample(pool, r.randint(1, len(pool)))) for _ in range(2))
        both = sorted(set(a) & set(b))
        if both and len(both) / len(set(a) | set(b)) >= 0.8:
            at = [np.array([float(x)]) for x in (len(a), a.index(both[0]), len(b), b.index(both[0]))]
            assert minhash.compatible(*at, 0.8).all()
            assert a.index(both[0]) < len(a) - -(-8 * len(a) // 10) + 1
    for _ in range(300):
        a, b = (np.array(r.sample(range(-900, 900), r.randint(0, 400)), np.int64) for _ in range(2))
        bits = np.frombuffer(minhash.bitmap(a), np.uint64) ^ np.frombuffer(minhash.bitmap(b), np.uint64)
        assert np.bitwise_count(bits).sum() <= len(set(a) ^ set(b))


@pytest.mark.parametrize("limit", [1 << 16, 50])
def test_many_small_buckets_are_searched_together(monkeypatch, limit):
    r = np.random.default_rng(8)
    bucket = np.sort(r.integers(-700, 700, 4000))
    n = len(bucket)
    two, sets = r.integers(0, 2, n), [np.concatenate([np.arange(40), r.integers(100, 400, k)]) + 500 * g for g, k in zip(r.integers(0, 2, n), r.integers(0, 16, n), strict=True)]
    rows = {"bucket": bucket, "root": r.integers(0, 40, n), "tid": np.arange(n), "side": np.where(bucket % 5 == 0, two, 7), "size": r.integers(60, 90, n), "place": r.integers(0, 12, n)}
    bits = [np.frombuffer(minhash.bitmap(s), np.uint64) for s in sets]
    some = pa.table({**rows, "bits": pa.array([b.tobytes() for b in bits], pa.binary())})
    want: set[tuple[int, int]] = set()
    apart = {}
    for i in range(n):
        for j in range(i + 1, int(np.searchsorted(bucket, bucket[i], "right"))):
            if rows["root"][i] == rows["root"][j] or (bucket[i] % 5 == 0 and two[i] == two[j] and len(set(two[bucket == bucket[i]])) == 2):
                continue
            x, y = ([np.array([float(rows[c][k])]) for c in ("size", "place")] for k in (i, j))
            apart[i, j] = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            if minhash.compatible(*x, *y, 0.8).all() and apart[i, j] <= 0.2 / 1.8 * (rows["size"][i] + rows["size"][j]) + 1e-6:
                want.add((i, j))
    calls = []
    compatible = minhash.compatible
    monkeypatch.setattr(minhash, "compatible", lambda *a: calls.append(1) or compatible(*a))
    monkeypatch.setattr(minhash, "PAIRS", limit)
    found = lambda best: [(int(i), int(j)) for a, b in minhash.near_pairs(some, 0.8, best) for i, j in zip(a, b, strict=True)]
    got = found(False)
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) > 50
    assert len(calls) < len(set(bucket.tolist())) // (1 if limit == 50 else 500)  # the number of passes isn't that of the buckets
    nearest: dict[int, int] = {}
    for pair in want:
        for row in pair:
            nearest[row] = min(nearest.get(row, 1 << 20), apart[pair])
    best = set(found(True))
    assert best <= want
    for pair in best:
        assert apart[pair] in (nearest[pair[0]], nearest[pair[1]])
    for row, least in nearest.items():
        assert any(row in pair and apart[pair] == least for pair in best)
