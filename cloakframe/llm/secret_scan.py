"""Secret scans with multipart credential linking.

Base findings are three patterns. Weak parts (identifiers, endpoints, opaque values) count for nothing alone: an
interval join reports an identifier or endpoint only within one scope of a secret (an assigned, hexadecimal
or opaque value), and an opaque value only within one scope of an identifier, an access key or an endpoint. No
part has a longest length. The parts meet on grid cells of a scope's width, by row and cell, so a text that
many rows share and a text of any length are spread alike.

Only DataFrame functions: matches and their code-point offsets come from one scan a pattern, which puts
marks around them, and the pieces that split() then leaves. The texts are searched once; what
was found is written, and the join works on slim rows.

Defined cases: a null text counts as empty; a text without matches has counts of 0, the digest of
the empty string and spans ''; repeated rows are each reported; an empty table gives an empty table; a very long
text is one row of the search and many rows of the join; columns that are not asked for are kept, but scan() replaces
those named as in RESULT, `base` and `found`. redact() keeps every column and only changes text and n_chars.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import barrier, between, blocks, let, running
from cloakframe.llm import common
from cloakframe.plans import oracle

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
#: An identifier names an account, an endpoint a service.
IDENTIFIER = r"""(?i:client_?id|user(?:name)?|login|account(?:_?name)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""://[A-Za-z0-9._~%:@-]{3,}|\.amazonaws\.com|(?i:end_?point|host(?:_?name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._~%:@-]{3,}"""
#: An opaque value may be a key: it has a digit and a capital, and may follow '=', as in KEY=VALUE; a name before '='
#: and a value is none. It starts at one place of a run only and gives nothing back, so the cost is linear.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?!AKIA)(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
#: Kinds in the order of listing; the first three are the base.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "id": IDENTIFIER, "endpoint": ENDPOINT, "opaque": OPAQUE}
KINDS = tuple(PATTERNS)
#: What the first two characters of a match must be: looked at first, it spares most places the words of the pattern.
STARTS = {"assign": "(?=[pPsStTaA][aAeEoOpP])", "access": "", "hex": "", "id": "(?=[cCuUlLaA][lLsSoOcC])", "endpoint": "(?=[:.eEhHsS][/anNoOeE])", "opaque": ""}
#: What every match holds, where plain search can look for it.
HELD = {"access": "AKIA"}
#: A private character, around matches.
MARK = "\ue000"
BASE = 3
SECRETS, PARTNERS = (0, 2, 5), (1, 3, 4)
#: Kinds that redact() takes out: identifiers and endpoints are reported, but are no secrets.
REDACTED = (0, 1, 2, 5)
#: Code points between two parts that may still belong to one credential.
SCOPE = 240
RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")

SPANS = "array<struct<s:int,k:int,e:int>>"
#: Columns of this module's own tables.
ROW, ALL, OPEN, LINKS, NEW = "__secret_row", "__secret_all", "__secret_open", "__secret_links", "__secret_new"


def unmarked(text: Column) -> Column:
    """The text without MARK, which no pattern matches: another character in its place leaves all matches where they are."""
    return F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("\ufffd"))).otherwise(text)


def found(text: Column, kind: int) -> Column:
    """Matches of a kind's pattern in an unmarked() text as array<struct<s, k, e>>, offsets in code points, end exclusive.

    One scan puts marks around the matches; the pieces between marks are in turn a gap and a match."""
    name = KINDS[kind]
    marked = F.regexp_replace(text, f"{STARTS[name]}(?:{PATTERNS[name]})", f"{MARK}$0{MARK}")
    if name in HELD:
        marked = F.when(F.contains(text, F.lit(HELD[name])), marked).otherwise("")

    def matches(parts: Column) -> Column:
        one = lambda i: F.struct(F.length(F.get(parts, i - 1)).alias("p"), F.get(parts, i).alias("v"))
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, one)

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        s = end + x["p"]
        e = s + F.length(x["v"])
        n = F.length(F.regexp_extract(x["v"], ASSIGN, 2)) if kind == 0 else F.lit(LEAST_VALUE)
        return e, F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), n.alias("n"))

    every = running(let(F.split(marked, MARK, -1), matches), F.lit(0), step, "struct<s:int,k:int,e:int,n:int>")
    return F.transform(F.filter(every, lambda x: x["n"] >= LEAST_VALUE), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def searched(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with ROW, ALL (base findings and parts) and OPEN (whether the join may add to the base), written."""
    every = let(unmarked(common.whole_text()), lambda text: F.array_sort(F.concat(*(found(text, k) for k in range(len(KINDS))))))
    rows = docs.select("*", F.monotonically_increasing_id().alias(ROW), every.alias(ALL))
    has = lambda kinds: F.exists(ALL, lambda x: x["k"].isin(*kinds))
    rows = rows.withColumn(OPEN, has(range(BASE, len(KINDS))) & has(SECRETS) & has(PARTNERS))
    return common.written(rows if keep_text else rows.drop("text"), "secrets")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of parts (ROW, s, k, e): the weak ones with a complementary part within `scope`.

    Every part lies in the cells that it and half a scope on either side touch; two parts within
    a scope share a cell, and the distance decides. Cells hold few parts, as those of a kind don't overlap."""
    cell = F.explode(F.sequence(F.floor((F.col("s") - scope // 2 - 1) / scope), F.floor((F.col("e") + scope // 2 + 1) / scope)))
    placed = parts.withColumn("cell", cell)

    def beside(kinds: tuple[int, ...], partners: tuple[int, ...]) -> DataFrame:
        other = placed.where(F.col("k").isin(*partners)).select(F.col(ROW).alias("r2"), F.col("cell").alias("c2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
        near = (F.col("s2") - F.col("e") <= scope) & (F.col("s") - F.col("e2") <= scope) & ((F.col("e2") <= F.col("s")) | (F.col("s2") >= F.col("e")))
        return placed.where(F.col("k").isin(*kinds)).join(other, (F.col(ROW) == F.col("r2")) & (F.col("cell") == F.col("c2")) & near, "left_semi")

    weak = range(BASE, len(KINDS))
    both = beside(tuple(k for k in SECRETS if k in weak), PARTNERS).unionByName(beside(tuple(k for k in PARTNERS if k in weak), SECRETS))
    return both.select(ROW, "s", "k", "e").distinct()


def with_links(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows of searched() with LINKS: only rows that may have one pass through the join."""
    open_ = rows.where(OPEN)
    parts = open_.select(ROW, F.explode(ALL).alias("p")).select(ROW, "p.*")
    links = linked(parts, scope).groupBy(ROW).agg(F.collect_list(F.struct("s", "k", "e")).alias(LINKS))
    joined = open_.join(links.hint("merge"), ROW, "left").withColumn(LINKS, F.coalesce(LINKS, F.array().cast(SPANS)))
    return joined.unionByName(rows.where(~F.col(OPEN)).withColumn(LINKS, F.array().cast(SPANS)))


def _base() -> Column:
    return F.filter(ALL, lambda x: x["k"] < BASE)


def _found() -> Column:
    return F.array_sort(F.concat(_base(), LINKS))


def scan(docs: DataFrame, scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """docs with base and linked findings: RESULT, `base` and `found` (arrays of s, k, e)."""
    rows = with_links(searched(docs.drop(*RESULT, "base", "found"), keep_text), scope)
    own = [c for c in rows.columns if c not in (ROW, ALL, OPEN, LINKS)]
    rows = rows.select(*own, _base().alias("base"), _found().alias("found"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("*", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced by `mark`; overlapping spans become one mark. Identifiers and
    endpoints stay, as they are harmless without their secret."""
    rows = with_links(searched(docs))
    cut = F.filter(_found(), lambda x: x["k"].isin(*REDACTED))
    text = F.col("text")
    # Each span with where the ones before it end: it begins a mark, or goes on with one.
    step = lambda at, x: (F.greatest(at, x["e"]), F.struct(at.alias("a"), x["s"].alias("b")))
    marks = F.filter(running(cut, F.lit(0), step, "struct<a:int,b:int>"), lambda x: x["b"] >= x["a"])
    end = F.array_max(F.transform(cut, lambda x: x["e"]))
    walked = let(blocks(text), lambda parts: F.concat(F.array_join(F.transform(marks, lambda x: F.concat(between(parts, x["a"], x["b"]), F.lit(mark))), ""), between(parts, end, F.length(text))))
    # Evaluated once, behind a generator: both columns that it changes read the result.
    rows = barrier(rows, NEW, F.when(F.size(cut) > 0, walked))
    new = {"text": F.coalesce(NEW, "text"), "n_chars": F.coalesce(F.length(NEW).cast("long"), "n_chars") if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def _hits(kind: int, pattern: str) -> str:
    keep = f"length(regexp_extract(value, {oracle.text(pattern)}, 2)) >= {LEAST_VALUE}" if kind == 0 else "true"
    plain = re.sub(r"\((?!\?)", "(?:", pattern)
    return f"SELECT doc_id, {kind} AS k, s, s + length(value) AS e FROM ({oracle.places('whole', 'doc_id', 'text', plain)}) WHERE {keep}"


def sql(source: str) -> str:
    """DuckDB SQL for scan() of rows (doc_id, text). It has no look-around: an opaque value is a run whose neighbours are tested apart."""
    return f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
runs AS (
  SELECT doc_id, list_sum(list_transform(parts[1:(i - 1)], lambda x: length(x)))::BIGINT AS s, parts[i] AS value, regexp_replace(parts[i], '=+$', '') AS run, regexp_matches(parts[i + 1], '^[A-Za-z0-9+/_-]') OR (parts[i + 1] = '' AND i + 1 < len(parts)) AS goes_on
  FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM (SELECT doc_id, string_split(replace({oracle.marked("text", "[A-Za-z0-9+/_-]{20,}=*")}, {oracle.CLOSE}, {oracle.OPEN}), {oracle.OPEN}) AS parts FROM whole))),
hits AS (
  {" UNION ALL ".join(_hits(k, p) for k, p in enumerate(PATTERNS.values()) if p != OPAQUE)}
  UNION ALL SELECT doc_id, 5, s, s + length(value) FROM runs WHERE regexp_matches(run, '[0-9]') AND regexp_matches(run, '[A-Z]') AND NOT starts_with(run, 'AKIA') AND length(value) - length(run) <= 2 AND NOT goes_on),
near AS (
  SELECT a.doc_id, a.k AS k1, a.s AS s1, a.e AS e1, b.k AS k2, b.s AS s2, b.e AS e2 FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.k IN (0, 2, 5) AND b.k IN (1, 3, 4)
    AND b.s - a.e <= {SCOPE} AND a.s - b.e <= {SCOPE} AND (b.e <= a.s OR b.s >= a.e)),
every AS (
  SELECT * FROM hits WHERE k < 3 UNION SELECT doc_id, k1, s1, e1 FROM near WHERE k1 >= 3 UNION SELECT doc_id, k2, s2, e2 FROM near WHERE k2 >= 3),
listed AS (SELECT *, [{", ".join(f"'{k}'" for k in KINDS)}][(k + 1)::INT] || ':' || s || ':' || e AS one FROM every)
SELECT w.doc_id, count(*) FILTER (k = 0)::BIGINT AS n_assign, count(*) FILTER (k = 1)::BIGINT AS n_access, count(*) FILTER (k = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(one, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(one, ',' ORDER BY s, k), '') AS spans
FROM whole w LEFT JOIN listed l USING (doc_id) GROUP BY w.doc_id
"""


ORACLE = sql("documents")


#: What planted() appends: parts that belong together, single ones, and some that stand too far apart. {0} is the value.
PLANTS = ("login: user{1} KEY={0}", "login: user{1}, nothing else", "https://store{1}.example.org " + "." * (SCOPE + 40) + " {0}", "host = db{1}.example.org\nlogin: user{1}\npassphrase {0}")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with parts of credentials behind every text: the test tables hold no linked ones."""
    value = F.concat(F.lit("K3"), F.upper(F.md5(F.col("doc_id").cast("string").cast("binary"))))
    pieces = lambda plant: [x for part in re.split(r"(\{\d\})", plant) for x in [value if part == "{0}" else F.col("doc_id").cast("string") if part == "{1}" else F.lit(part)]]
    chosen = F.element_at(F.array(*(F.concat(*pieces(p)) for p in PLANTS)), (F.pmod("doc_id", F.lit(len(PLANTS))) + 1).cast("int"))
    return docs.withColumn("text", F.concat(common.whole_text(), F.lit("\n"), chosen))


_PLANTS = ", ".join("'" + p.replace("{0}", "' || 'K3' || upper(md5(doc_id::VARCHAR)) || '").replace("{1}", "' || doc_id || '").replace("\n", "' || chr(10) || '") + "'" for p in PLANTS)
PLANTED_ORACLE = sql(f"(SELECT doc_id, coalesce(text, '') || chr(10) || [{_PLANTS}][(doc_id % {len(PLANTS)} + 1)::INT] AS text FROM documents)")
