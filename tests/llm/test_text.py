from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import bpe, flac, language, media, mixing, quality, secret_scan, token_counts

from .conftest import EDGES, prose

# --- BPE ------------------------------------------------------------------------------------

ODD = ["a<|endoftext|>b", "<|endoftext|>", "<|endof", "it's we'll I'm  two   spaces \n\n end ", " x y", "12345 67,89", "x y" * 4000, "é ‍ 👩‍👩‍👧", "\x00\x01 a", "tail space ", " lead", "\n", "a b" + " " * 3000 + "c"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(make, library):
    texts = [*EDGES, *ODD]
    got = {r["doc_id"]: r for r in bpe.encode(make(*texts)).collect()}
    digest = {r["doc_id"]: r for r in bpe.digests(make(*texts)).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i]["ids"] == want, text
        assert got[i]["decoded"] == decoded
        assert digest[i]["n_tokens"] == len(want)
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_cuts_anywhere_and_reuses_chunks(library):
    use = bpe.Codec(bpe.default_vocabulary())
    r = random.Random(1)
    for text in [*EDGES, *ODD]:
        raw = (text or "")[:4000].encode()
        borders = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        for _ in range(5):
            cuts = sorted(r.sample(borders, min(len(borders), r.randint(0, 12))))
            ids = [int(i) for entry in use.entries(raw, cuts) for i in entry[0]]
            assert ids == library.encode(raw.decode(), add_special_tokens=False).ids
            assert use.decode(np.array(ids, np.int64)) == raw.decode()
    shared = prose(5000, 1)
    for text in (shared, "another beginning " + shared):
        data = np.frombuffer(text.encode(), np.uint8)
        list(use.entries(text.encode(), next(bpe.cut_points(data, np.array([0, len(data)])))))
    assert use.hits > 10


@pytest.mark.parametrize("wrong", [lambda raw, ids: bpe.EDGE, lambda raw, ids: (raw, [0]), lambda raw, ids: (raw[:1], ids[:1])])
def test_bpe_widens_joins_until_they_agree(library, monkeypatch, wrong):
    """Words beside a join that don't come out as expected make the window wider, and the ids stay right."""
    use = bpe.Codec(bpe.default_vocabulary())
    r = random.Random(5)
    plain = use.guard
    monkeypatch.setattr(use, "guard", lambda raw, ids, at: wrong(raw, ids) if r.random() < 0.5 else plain(raw, ids, at))
    for text in [*EDGES[:-1], *ODD, prose(900, 4)]:
        raw = (text or "").encode()
        borders = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        cuts = sorted(r.sample(borders, min(len(borders), 15)))
        assert [int(i) for entry in use.entries(raw, cuts) for i in entry[0]] == library.encode(raw.decode(), add_special_tokens=False).ids
    assert use.widened > 5


# --- FLAC -----------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 575, 576, 577, 1152, 5000])
def test_flac_round_trip(size):
    r = np.random.default_rng(size)
    ramp = np.arange(size)
    payloads = [
        r.integers(0, 256, size, np.uint8).tobytes(),
        b"\xff" * size,
        (128 + 100 * np.sin(ramp / 9)).astype(np.uint8).tobytes(),
        (ramp % 251).astype(np.uint8).tobytes(),
        prose(size, 3).encode()[:size],
    ]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for p, s in zip(payloads, streams, strict=True):
        for start, count in ((0, 5), (size // 2, 700), (max(size - 32, 0), 32), (size - 1, 10)):
            assert flac.read_samples(s, start, count) == p[start : start + count]


def test_flac_detects_damage():
    stream = flac.encode([prose(2000, 1).encode()])[0]
    for at in (len(stream) - 1, len(stream) // 2, 30):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def plain_decode(stream: bytes) -> bytes:
    """A decoder bit by bit, of what this encoder writes: no table, no group of frames."""
    bits = "".join(f"{b:08b}" for b in stream)
    at = 8 * 4
    while True:
        last, size = bits[at] == "1", int(bits[at + 8 : at + 32], 2)
        at += 32 + 8 * size
        if last:
            break

    def take(n: int, signed: bool = False) -> int:
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    out: list[int] = []
    while at < len(bits):
        assert take(16) == 0xFFF8
        code, _ = take(4), take(4)
        take(8)
        first = take(8)
        more = len(f"{first:08b}".split("0")[0]) if first & 0x80 else 0
        take(8 * max(more - 1, 0))
        n = 576 if code == 2 else take(16) + 1
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [take(8, True) for _ in range(order)]
            precision, shift = (take(4) + 1, take(5)) if kind >= 32 else (0, 0)
            q = [take(precision, True) for _ in range(order)] if kind >= 32 else [[], [1], [2, -1]][order]
            assert take(2) == 0
            assert take(4) == 0
            k = take(4)
            while len(x) < n:
                high = 0
                while not take(1):
                    high += 1
                v = high << k | take(k)
                x.append((v >> 1 ^ -(v & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(q)) >> shift))
        out += x
        at += -at % 8 + 16
    return bytes((v + 128) & 255 for v in out)


def test_flac_equals_a_plain_decoder():
    r = np.random.default_rng(4)
    t = np.arange(1500)
    for payload in (prose(250, 8).encode(), (128 + 100 * np.sin(t / 9)).astype(np.uint8).tobytes(), r.integers(0, 256, 700, np.uint8).tobytes(), b"\xff" * 600, bytes(range(256)) * 5):
        assert plain_decode(flac.encode([payload])[0]) == payload


def test_media_of_damaged_streams(make, spark):
    stored = media.store(make(*EDGES[:8])).collect()
    rows = [(x["doc_id"], x["n_bytes"], None if x["doc_id"] == 2 else bytes(x["media"][:-1]) + b"\0" if x["doc_id"] == 6 else b"no" if x["doc_id"] == 3 else bytes(x["media"])) for x in stored]
    broken = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {x["doc_id"]: x for x in media.read_back(broken).collect()}
    assert {i for i, x in got.items() if x["error"]} == {2, 3, 6}
    assert got[6]["payload_sha256"] is None
    assert got[7]["payload_sha256"] is not None
    assert {x["doc_id"] for x in media.pcm_blocks(broken).where("error is null").collect()} == {0, 1, 4, 5, 7}
    parts = {x["doc_id"]: x for x in media.samples_at(broken, 0, 20).collect()}
    assert {i for i, x in parts.items() if x["error"]} == {2, 3} or {i for i, x in parts.items() if x["error"]} == {2, 3, 6}
    assert bytes(parts[7]["part"]) == media.payload((EDGES[7] or "").encode())[:20]


def test_flac_reads_predictors_of_several_widths(monkeypatch):
    wave = [(128 + 90 * np.sin(np.arange(576 * 3) / n)).astype(np.uint8).tobytes() for n in (7, 11)]
    streams = flac.encode(wave[:1])
    monkeypatch.setattr(flac, "PRECISION", 11)
    streams += flac.encode(wave[1:])
    assert flac.decode(streams) == wave


def test_flac_uses_predictors():
    wave = (128 + 90 * np.sin(np.arange(576 * 8) / 20)).astype(np.uint8).tobytes()
    assert len(flac.encode([wave])[0]) < len(wave) * 0.6


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20, (1 << 26) + 5, (1 << 31) - 1):
        assert flac.read_number(flac.coded_number(n), 0) == (n, len(flac.coded_number(n)))
    assert all(flac.coded_number(n) == chr(n).encode() for n in (65, 200, 3000, 70000))


def test_media(make):
    stored = media.store(make(*EDGES))
    rows = {r["doc_id"]: r for r in media.read_back(stored).collect()}
    streams = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for i, text in enumerate(EDGES):
        raw = (text or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        row = rows[i]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(padded))
        assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(padded[-32:])
        assert (row["media_bytes"], row["media_sha256"]) == (len(streams[i]), hashlib.sha256(streams[i]).hexdigest())
    assert rows[6]["feature"] == rows[7]["feature"]
    blocks = media.pcm_blocks(stored, 1000).where("doc_id = 11").orderBy("sample_offset").collect()
    joined = b"".join(bytes(b["pcm"]) for b in blocks)
    assert bytes(x ^ 0x80 for x in joined) == media.payload(EDGES[11].encode())
    assert {r["doc_id"]: bytes(r["part"]) for r in media.samples_at(stored, 100, 50).collect()}[6] == EDGES[6].encode()[100:150]
    for size in (media.BLOCK, 1000):
        for start, count in ((0, 10), (570, 900), (999, 2), (1 << 30, 5)):
            want = {i: part for i, text in enumerate(EDGES) if (part := media.payload((text or "").encode())[start : start + count])}
            assert {r["doc_id"]: bytes(r["part"]) for r in media.seek(media.pcm_blocks(stored, size), start, count).collect()} == want
    written = media.read_back(stored).blocks
    assert {r["doc_id"]: r["n"] for r in written.groupBy("doc_id").agg({"pcm": "count"}).withColumnRenamed("count(pcm)", "n").collect()} == {i: r["pcm_blocks"] for i, r in rows.items()}


# --- token counts ----------------------------------------------------------------------------


def test_token_counts(make, library):
    texts = [*EDGES, "a<|endoftext|>b"]
    rows = {r["doc_id"]: r for r in token_counts.count_documents(make(*texts)).collect()}
    library.encode_special_tokens = True
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    library.encode_special_tokens = False
    assert {i: r["n_tokens"] for i, r in rows.items()} == want


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_scan_stitches_blocks(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    r = random.Random(4)
    want = set()
    for name in ("a", "b", "c", "d"):
        sizes = [r.choice([0, 0, 1, 3, 50]) for _ in range(r.randint(0, 40))]
        flat: list[int] = []
        for i, n in enumerate(sizes):
            want.add((name, i, len(flat), n, True))
            flat += [1] * n + [9]
        if name != "d":
            want.add((name, len(sizes), len(flat), 4, False))
            flat += [2] * 4
        (tmp_path / name).write_bytes(np.array(flat, "<u2").tobytes())
    found = token_counts.files(spark, str(tmp_path))
    got = {(r["file"].rsplit("/", 1)[-1], r["ordinal"], r["token_start"], r["n_tokens"], r["closed"]) for r in token_counts.scan(found, 9, block_tokens=7).collect()}
    assert got == want


def test_files_are_read_by_ranges(spark, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "a").write_bytes(np.array([5, 9, 9, 7, 7, 7, 9], "<u4").tobytes())
    got = token_counts.scan(token_counts.files(spark, str(folder)), 9, 4, 2).orderBy("ordinal").collect()
    assert [(r["token_start"], r["n_tokens"]) for r in got] == [(0, 1), (2, 0), (3, 3)]
    (folder / "b").write_bytes(b"123")
    with pytest.raises(Exception, match="ends inside an id"):
        token_counts.scan(token_counts.files(spark, str(folder)), 9).collect()


def test_token_files_are_flat(make, tmp_path, library):
    texts = ["one two", "", "three", "one two"]
    rows = token_counts.token_files(make(*texts, ids=[1, 2, 3, 1]).coalesce(1), f"file:{tmp_path}/x").collect()
    (file,) = {r["file"] for r in rows}
    ids = [i for r in sorted(rows, key=lambda r: r["ordinal"]) for i in [*library.encode(texts[[1, 2, 3].index(r["doc_id"])]).ids, 50256]]
    assert np.frombuffer((tmp_path / "x" / file).read_bytes(), "<u2").tolist() == ids


# --- classifiers -------------------------------------------------------------------------------


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(make, spark):
    r = random.Random(6)
    texts = [prose(r.randint(30, 120), i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60, i).split()) for i in range(400)]
    texts += [None, "", "x"]
    docs = make(*texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert all(0 <= s <= 1 for s in rows.values())
    fair = [i for i in range(400) if held_out(i)]
    assert np.mean([(rows[i] >= 0.7) == (i % 3 > 0) for i in fair]) > 0.97
    kept = {r["doc_id"] for r in quality.filter_good(docs, labels).collect()}
    assert kept == {i for i, s in rows.items() if s >= 0.7}


def test_quality_cases(make, spark, monkeypatch):
    texts = [prose(40, i) if i % 2 else "spam! " * 30 for i in range(40)] + ["spam! " * 30_000, prose(20_000, 3), None, "", prose(40, 1)]
    docs = make(*texts, ids=[*range(44), 1]).withColumnRenamed("lang", "score").withColumnRenamed("source", "__row")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.filter_good(docs, labels)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {(r["score"], r["__row"]) for r in rows} == {("en", "s0")}
    assert {r["doc_id"] for r in rows} - {42, 43} == {i for i in range(40) if i % 2} | {41}
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    assert 0 < quality.training_rows(docs, labels).count() <= 7
    monkeypatch.setattr(quality, "SAMPLE", 3)
    assert quality.training_rows(docs, labels).count() == 3


def test_quality_features_are_of_characters():
    for text in ("", "a", "né", "東京 タワー", "né né 東京", "🙂ab"):
        raw = text.encode()
        found = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = text.split()
        assert [len(f) for f, _ in found] == [max(len(text) - 2, 0), max(len(text) - 3, 0), len(words), max(len(words) - 1, 0)]
    texts = ["né né 東京", "", "x", "b c b c"]
    raw = [t.encode() for t in texts]
    block = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, one in enumerate(raw):
        alone = quality.features(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
        assert all((f[at[i] : at[i + 1]] == g).all() for (f, at), (g, _) in zip(block, alone, strict=True))


def test_quality_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(make("a", None), none).collect()} == {0.5}
    assert quality.score(make("a").limit(0), none).count() == 0


def test_language_on_held_out_rows(make):
    tongues = {"aa": "kala mata runo sipa teko".split(), "bb": "grum drax fnor blick zorf".split(), "cc": "élan óvni ñame über ça".split()}
    r = random.Random(2)
    lang = [r.choice(list(tongues)) for _ in range(300)]
    texts = [" ".join(r.choice(tongues[x]) for _ in range(40)) for x in lang]
    docs = make(*texts, None, "", "123 ...", lang=[*lang, "aa", None, "bb"])
    rows = {x["doc_id"]: x for x in language.predict(docs).collect()}
    assert all(rows[i]["held_out"] == held_out(i) for i in range(300))
    fair = [i for i in range(300) if held_out(i)]
    assert np.mean([rows[i]["lang_pred"] == lang[i] for i in fair]) > 0.98
    assert [rows[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3
    assert {x["lang_pred"] for x in language.predict(make("abc", lang=[None])).collect()} == {"und"}


def test_language_cases(make, monkeypatch):
    learned = [*(prose(30, i) for i in range(8)), *("zu " * 20 + str(i) for i in range(8))]
    odd = ["abc", "Ж", "the quick brown foxes jump " * 20_000, "zu zu zu zu", "zu zu zu zu", "🙂 1"]
    lang = [*["aa"] * 8, *["bb"] * 8, *[None] * 6]
    rows = {x["doc_id"]: x for x in language.predict(make(*learned, *odd, lang=lang)).collect()}
    assert [rows[16 + i]["lang_pred"] for i in range(6)] == ["aa", "aa", "aa", "bb", "bb", "und"]
    assert [rows[16 + i]["score"] for i in (0, 1, 5)] == [0.0] * 3
    assert rows[19]["score"] == rows[20]["score"]
    same = make(*["one text"] * 50, ids=[None] * 50, lang=["aa"] * 50)
    monkeypatch.setattr(language, "SAMPLE", 7)
    assert language.sample(make(*learned, *odd, lang=lang)).groupBy("lang").count().where("count > 7").count() == 0
    assert language.sample(same).count() == 7
    monkeypatch.setattr(language, "SAMPLE_BYTES", 20)
    assert language.sample(same).count() == 3
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.sample(make("a b", "c d", lang=["aa", "bb"], ids=[0, 1]))


def test_language_masks():
    held = {f"l{i}": np.array([i + 1, 1000], np.uint64) for i in range(70)}
    names, planes, rates = language.build(held)
    first, second = language.slots(np.array([1000, 66], np.uint64))
    masks = [[int(p[a] & p[b]) for p in planes] for a, b in zip(first, second, strict=True)]
    assert masks[0] == [(1 << 64) - 1, (1 << 6) - 1]
    assert masks[1][names.index("l65") // 64] >> names.index("l65") % 64 & 1
    assert len(planes) == 2


# --- secrets -----------------------------------------------------------------------------------

LONG_KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
SECRETS = [
    "password = 'hunter22' and Token:abc123 but secret=x",
    "secret=token=abcdef api-key: no apiKEY \"\" : zzz passwd\":\"qwerty==",
    "AKIA" + "A1" * 8 + " AKIA" + "B" * 15 + " xAKIA" + "C" * 30,
    "0123456789abcdef01234567 ABCDEF" + "a" * 23 + " " + "f" * 60,
    "🙂🙂 token=🙂 token=abcdef " + "🙂" * 3 + "ab" * 12,
    "access AKIA" + "Z9" * 8 + "\n  key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12",
    "alone wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12",
    "client_id: abc1234 " + "." * 300 + " wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12",
    "client_id: abc1234 " + "." * 100 + " wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12",
    "tokentokentoken=tokentoken=",
]


def brute_base(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(make):
    texts = [*EDGES, *SECRETS]
    rows = {r["doc_id"]: r for r in secret_scan.scan(make(*texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = brute_base(text or "")
        listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(k == x[1] for x in base) for k in range(3)]
        assert set(listed.split(",")) - {""} <= set(rows[i]["spans"].split(","))


def brute_spans(text: str, scope: int = secret_scan.SCOPE) -> list[tuple[int, int, int]]:
    """All spans by comparing every part with every other."""
    hits = brute_base(text)
    for k, pattern in enumerate((secret_scan.IDENTIFIER, secret_scan.ENDPOINT), 3):
        hits += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII)]
    for m in re.finditer(r"[A-Za-z0-9+/_-]+(=*)", text):
        run = m[0].rstrip("=")
        free = len(m[1]) <= 2 and not re.match("[A-Za-z0-9+/_-]", text[m.end() : m.end() + 1])
        if len(run) >= 20 and free and re.search("[0-9]", run) and re.search("[A-Z]", run) and not run.startswith("AKIA"):
            hits.append((m.start(), 5, m.end()))
    near = lambda a, b: max(a[0], b[0]) - min(a[2], b[2]) <= scope and (a[2] <= b[0] or b[2] <= a[0])
    side = lambda k: k in (1, 3, 4)
    return sorted(a for a in hits if a[1] < 3 or any(side(a[1]) != side(b[1]) and near(a, b) for b in hits))


def test_links_equal_brute_force(make):
    r = random.Random(12)
    some = ["AKIA" + "Q7" * 8, "user=abc12", "login: x1.y", "https://api.example.com/v1", "host = db-1", LONG_KEY, LONG_KEY * 60 + "==", "token=abcdef9", "ab12" * 9, "word", "\n", "🙂", "." * 200, " " * 90, "s3.amazonaws.com", "KEY=" + LONG_KEY]
    texts = [*EDGES, *SECRETS, *("".join(r.choice(some) + r.choice([" ", "", "\n", ", "]) for _ in range(r.randint(1, 25))) for _ in range(150))]
    rows = {x["doc_id"]: x for x in secret_scan.scan(make(*texts, *texts[-20:])).collect()}
    linked = 0
    for i, text in enumerate([*texts, *texts[-20:]]):
        want = brute_spans(text or "")
        linked += sum(k >= 3 for _, k, _ in want)
        assert rows[i]["spans"] == ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want), text
    assert linked > 100


def test_redaction(make):
    texts = [*EDGES, *SECRETS]
    rows = {r["doc_id"]: r for r in secret_scan.redact(make(*texts)).collect()}
    for i, text in enumerate(texts):
        if not brute_base(text or "") and i < len(EDGES):
            assert rows[i]["text"] == text
    assert rows[len(EDGES)]["text"] == "[SECRET]' and [SECRET] but secret=x"
    assert rows[len(EDGES)]["n_chars"] == len(rows[len(EDGES)]["text"])
    docs = make(*texts).withColumnRenamed("lang", "found").withColumnRenamed("source", "spans")
    kept = secret_scan.redact(docs).collect()
    assert secret_scan.redact(docs).columns == docs.columns
    assert {(x["found"], x["spans"]) for x in kept} == {("en", "s0")}
    assert {x["text"] for x in kept} == {x["text"] for x in rows.values()}
    assert "wJalr" not in rows[len(EDGES) + 5]["text"]


ASSIGNED = {
    f"AWS_ACCESS_KEY_ID=AKIA{'Q7' * 8}\nAWS_SECRET_ACCESS_KEY={LONG_KEY}\n": LONG_KEY,
    f"export S3_USER_LOGIN='abc1'\nexport S3_REGION_2_STORE_KEY={LONG_KEY}": LONG_KEY,
    f"Endpoint=sb://ns.example.net/;SharedAccessKeyName=Root;SharedAccessKey={LONG_KEY}123=;": LONG_KEY + "123=",
    f"AccountName=abc;AccountKey={LONG_KEY}==;EndpointSuffix=example.net": LONG_KEY + "==",
    f"https://api.example.com/v1?user=abc&sig={LONG_KEY}&x=1": LONG_KEY,
}


def linked_values(make, texts):
    rows = {r["doc_id"]: r["found"] for r in secret_scan.scan(make(*texts)).collect()}
    return [[t[x["s"] : x["e"]] for x in rows[i] if x["k"] == 5] for i, t in enumerate(texts)]


def test_linked_values_after_an_equals_sign(make):
    texts = [*ASSIGNED, f"STORE_KEY={LONG_KEY}", f"user=abc S3_REGION_2_STORE_KEYNAME={'x' * 30}"]
    assert linked_values(make, texts) == [[v] for v in ASSIGNED.values()] + [[], []]
    assert not any(LONG_KEY in r["text"] for r in secret_scan.redact(make(*ASSIGNED)).collect())


def test_linked_values_of_any_length(make):
    account, access, part, run = "aB3/" * 21 + "xY==", "T0ken-" * 15, "eyJhbGciOiJ1" * 9, "Zz9" * 30_000
    late = "a" * 70 + "B" + "c" * 70 + "4"
    texts = {
        f"AccountName: abc AccountKey={account};": [account],
        f"client_id: abc1234 access {access}": [access],
        f"https://api.example.com bearer {part}.{part}1.{part}": [part, part + "1", part],
        f"login: abc {run}": [run],
        f"login: abc {late}": [late],
        f"login: abc {'a' * 200}1": [],
        f"alone {account}": [],
    }
    assert linked_values(make, list(texts)) == list(texts.values())


# --- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_mixing(make, spark):
    r = random.Random(3)
    texts = [*EDGES, *(prose(r.randint(1, 200), i) for i in range(300))]
    source = [r.choice(["a", "b", "c", "", "z", "hot", "hot", "hot", None]) for _ in texts]
    docs = make(*texts, source=source).withColumnRenamed("n_chars", "size")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    rows = [x.asDict() for x in mixing.mix(docs, labels).collect()]
    again = [x.asDict() for x in mixing.mix(docs.repartition(7), labels).collect()]
    assert sorted((x["doc_id"], x["taken"]) for x in rows) == sorted((x["doc_id"], x["taken"]) for x in again)
    sizes: dict[str | None, int] = {}
    taken: dict[str | None, int] = {}
    for i, text in enumerate(texts):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        row = next(x for x in rows if x["doc_id"] == i)
        assert row["size"] == n
        assert 0 <= row["taken"] <= 2 * n
        sizes[source[i]] = sizes.get(source[i], 0) + n
        taken[source[i]] = taken.get(source[i], 0) + row["taken"]
    want = brute_targets(sizes)
    for row in rows:
        assert row["source_size"] == sizes[row["source"]]
        assert abs(row["target"] - want[row["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {(x["doc_id"], x["taken"]) for x in mixing.takings(docs, labels).collect()} == {(x["doc_id"], x["taken"]) for x in rows}
    made = mixing.materialise(make(*texts, source=source), labels).collect()
    words: dict[str | None, int] = {}
    times: dict[int, int] = {}
    for row in made:
        words[row["source"]] = words.get(row["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", row["text"]))
        times[row["doc_id"]] = times.get(row["doc_id"], 0) + 1
        assert row["text"] == texts[row["doc_id"]]
    assert max(times.values()) <= 2
    cut = {s: max((r["size"] for r in rows if r["source"] == s and r["size"] and r["taken"] % r["size"]), default=0) for s in sizes}
    assert all(abs(words.get(s, 0) - taken[s]) <= cut[s] / 2 for s in sizes)
    for row in rows:
        if row["size"] and row["taken"] % row["size"] == 0:
            assert times.get(row["doc_id"], 0) == row["taken"] // row["size"]


def test_mixing_of_null_and_repeated_ids(make, spark):
    texts = [prose(30, i % 40) for i in range(120)]
    docs = make(*texts, ids=[None] * 60 + [7] * 60).withColumnRenamed("lang", "_key").withColumnRenamed("n_chars", "_range")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == [*docs.columns, *mixing.RESULT]
    rows = mixed.collect()
    assert len(rows) == 120
    assert {r["_key"] for r in rows} == {"en"}
    assert sum(r["taken"] for r in rows) == round(rows[0]["target"])
    again = mixing.mix(docs.repartition(5), labels).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["text"], r["taken"]) for r in again)


def test_empty_tables(make, spark):
    none = make("x").limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix(none, labels).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert bpe.digests(none).count() == 0
    assert media.read_back(media.store(none)).count() == 0
    assert token_counts.count_documents(none).count() == 0
    assert language.predict(none).count() == 0


def test_secret_scan_of_many_matches_is_linear(make):
    """32,000 hash values in one text: found and taken out at a cost in proportion to their number."""
    import time

    secret_scan.redact(make("x " + "0a" * 16)).collect()
    docs = make(" ".join(f"{i:024x}" for i in range(32_000)))
    began = time.perf_counter()
    (row,) = secret_scan.scan(docs, keep_text=False).collect()
    assert row["n_hex"] == 32_000 and row["found"][-1]["e"] == 32_000 * 25 - 1
    (row,) = secret_scan.redact(docs).collect()
    assert row["text"] == " ".join(["[SECRET]"] * 32_000)
    assert time.perf_counter() - began < 40  # two minutes when an array grew at each match


def test_a_pattern_is_searched_once_and_marks_move_nothing(make, monkeypatch):
    """One scan a pattern; and a text that holds the mark itself, or a character outside the basic plane, has its spans where they are."""
    mark = secret_scan.MARK
    texts = [f"{mark}password{mark} {mark}👍 Token = {mark}a, token: abcdef{mark}", f"AKIA{'Z' * 16}{mark}AKIA{'Q' * 16}AKIA{'A' * 16}", f"{'0a' * 12}{mark}{'b1' * 12}"]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(make(*texts)).collect()}
    assert [rows[i] for i in range(3)] == ["assign:26:39", "access:0:20,access:21:61", "hex:0:24,hex:25:49"]
    monkeypatch.setattr(secret_scan.common, "written", lambda df, label: df)
    plan = secret_scan.searched(make(*texts)).select(secret_scan.ALL)._jdf.queryExecution().analyzed().toString()
    assert [plan.count(p) for p in (r"[0-9a-f]{24,}", r"\.amazonaws\.com")] == [1, 1]
