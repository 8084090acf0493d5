"""The query catalogue: every query runs over whole tables; its SQL is beside it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.config import Options
from cloakframe.functions import model_api, tokens
from cloakframe.functions import text as T
from cloakframe.operators import detect, logs, metrics, ner, overlap, substitute, vault
from cloakframe.plans import oracle as O  # noqa: N812
from cloakframe.plans import pipeline
from cloakframe.sources import files, model, scratch
from cloakframe.streaming import log_source, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores is dealt out once, as pattern search is bound by the
    processor and one file may be one task; tables of many files, as large ones are, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): documents and pages in one table."""
    pages = spread(read(spark, sf_dir, "pages")).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return docs.unionByName(pages)


BOTH = "(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id AS id, html AS text FROM pages)"


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def exploded(df: DataFrame, key: str, findings: Column) -> DataFrame:
    rows = df.select(key, F.explode(findings).alias("f"))
    return rows.select(key, "f.entity_type", long("f.start").alias("s"), long("f.end").alias("e"), "f.value", "f.tier")


# --- detection ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(text)::BIGINT AS char_count, regexp_matches(text, '^{O.SPACE}*$') AS blank FROM documents")
def q01_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", long(F.length("text")).alias("char_count"), F.col("text").rlike(rf"^[{T.S}]*$").alias("blank"))


_BLANKS = r"[\t\x0b\x0c\r \x1c-\x1f\x{85}\p{Z}]"


@query(
    f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' {{6,}}', chr(10), 'g'), ' {{2,5}}', ' ', 'g'),
    '{_BLANKS}+(\\n|\\z)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+\\z', '') AS text FROM {BOTH}"""
)
def q02_column_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("id", T.normalise_columns(F.col("text")).alias("text"))


_FIELDS = {
    "basics.name": ("c_name", "c_name"),
    "basics.phone": ("cast(c_custkey * 7919 as string)", "(c_custkey * 7919)::VARCHAR"),
    "basics.location.region": ("n_name", "n_name"),
    "basics.location.countryCode": ("substring(n_name, 1, 2)", "substr(n_name, 1, 2)"),
    "basics.profiles[0].username": ("lower(c_name)", "lower(c_name)"),
    "basics.profiles[0].network": ("c_mktsegment", "c_mktsegment"),
    "work[0].name": ("c_mktsegment", "c_mktsegment"),
    "basics.image": ("'  '", "'  '"),
}


@query(
    "WITH rows AS ("
    + " UNION ALL ".join(f"SELECT c_custkey, '{path}' AS path, {sql} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey" for path, (_, sql) in _FIELDS.items())
    + r"""), typed AS (SELECT *, CASE WHEN path = 'basics.name' THEN 'PERSON' WHEN path = 'basics.email' THEN 'EMAIL' WHEN path = 'basics.phone' THEN 'PHONE' WHEN path IN ('basics.url', 'basics.website') THEN 'URL'
    WHEN path = 'basics.image' THEN 'IDENTIFIER' WHEN path = 'basics.location.address' THEN 'ADDRESS' WHEN path = 'basics.location.postalCode' THEN 'POSTAL'
    WHEN path IN ('basics.location.city', 'basics.location.region') THEN 'LOCATION' WHEN regexp_matches(path, '^basics\.profiles\[\d+\]\.username$') THEN 'HANDLE' WHEN regexp_matches(path, '^basics\.profiles\[\d+\]\.url$') THEN 'URL' END AS entity_type FROM rows)
    SELECT c_custkey, path, entity_type, value FROM typed WHERE entity_type IS NOT NULL AND trim(value) <> ''"""
)
def q03_field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    fields = F.array(*(F.struct(F.lit(path).alias("path"), F.expr(value).alias("value")) for path, (value, _) in _FIELDS.items()))
    rows = people.select("c_custkey", F.explode(fields).alias("f")).select("c_custkey", "f.path", T.field_type(F.col("f.path")).alias("entity_type"), "f.value")
    return rows.where(F.col("entity_type").isNotNull() & (F.trim("value") != ""))


_TURNS = "(SELECT 'c' || conv_id || ':' || turn AS id, text FROM conversations)"


@query(f"SELECT id, s, e, value FROM ({O.header(f'(SELECT * FROM {BOTH} UNION ALL SELECT * FROM {_TURNS})', 'id', 'text')})")
def q04_header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), "text")
    rows = both(spark, sf_dir).unionByName(turns)
    return exploded(rows, "id", T.header_findings(F.col("text"))).select("id", "s", "e", "value")


def _values(kind: str) -> str:
    return f"SELECT id, s, value FROM ({O.tier1(BOTH, 'id', 'text')}) WHERE entity_type = '{kind}'"


def _tier1(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    rows = exploded(both(spark, sf_dir), "id", T.pattern_findings(F.col("text"), *kinds))
    return rows.select("id", "s", "value") if kinds else rows.drop("tier")


@query(_values("EMAIL"))
def q05_email_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier1(spark, sf_dir, "EMAIL")


@query(_values("URL"))
def q06_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier1(spark, sf_dir, "URL")


@query(_values("PHONE"))
def q07_phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier1(spark, sf_dir, "PHONE")


@query(f"SELECT id, entity_type, s, e, value FROM ({O.tier1(BOTH, 'id', 'text')})")
def q08_tier1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier1(spark, sf_dir)


_FORMS = """list_filter(list_distinct([f || l, f[1] || l, f || l[1], l || f, f || '.' || l, f || '_' || l, f || '-' || l, f[1] || '.' || l]), lambda x: length(x) >= 8)"""
_NAMES = rf"""parts AS (SELECT doc_id, value, list_filter(regexp_split_to_array(value, '[\s\x1c-\x1f\x{{85}}\p{{Z}}.]+'), lambda x: regexp_matches(x, '^\p{{L}}+$')) AS w FROM ({O.header("documents", "doc_id", "text")})),
  names AS (SELECT doc_id, value, lower(w[1]) AS f, lower(w[-1]) AS l FROM parts WHERE len(w) >= 2)"""


@query(f"WITH {_NAMES} SELECT doc_id, unnest({_FORMS}) AS form FROM names")
def q09_name_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = exploded(documents(spark, sf_dir), "doc_id", T.header_findings(F.col("text")))
    return names.select("doc_id", F.explode(T.derivatives(F.col("value"))).alias("form"))


_PROBE = "'mail ' || upper({0}) || ', not x' || {0} || ' nor ' || {0} || 'x; see ' || {0}"


def _capitals(value: Column) -> Column:
    """Upper case character by character, as SQL's upper() has it: upper() in Spark makes two letters of a sharp s, and of others."""
    one = lambda c: T.let(F.upper(c), lambda u: F.when(F.length(u) == 1, u).otherwise(c))
    return F.array_join(F.transform(F.split(F.translate(value, "ß", "ẞ"), ""), one), "")


def _texts_with_handles(docs: DataFrame) -> DataFrame:
    """(doc_id, name, text): whole texts with a header name, and a probe of every handle made of it appended."""
    probe = lambda h: F.concat(F.lit("mail "), _capitals(h), F.lit(", not x"), h, F.lit(" nor "), h, F.lit("x; see "), h)
    named = T.barrier(docs, "name", F.get(T.header_findings(F.col("text")), F.lit(0))["value"]).where(F.col("name").isNotNull())
    named = T.barrier(named, "forms", F.array_sort(T.derivatives(F.col("name")))).where(F.size("forms") > 0)
    return named.select("doc_id", "name", F.concat_ws("\n", F.col("text"), F.array_join(F.transform("forms", probe), "\n")).alias("text"))


@query(
    rf"""WITH {_NAMES}, h AS (SELECT doc_id, list_sort({_FORMS}) AS forms FROM names), t AS (SELECT doc_id, forms, text || chr(10) || array_to_string(list_transform(forms, lambda h: {_PROBE.format("h")}), chr(10)) AS text FROM h JOIN documents USING (doc_id) WHERE len(forms) > 0),
    p AS (SELECT doc_id, text, form, string_split(lower(text), form) AS parts FROM (SELECT *, unnest(forms) AS form FROM t)),
    o AS (SELECT doc_id, text, form, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(form)))::BIGINT AS s FROM p)
    SELECT doc_id, s, text[s + 1:s + length(form)] AS value FROM o WHERE NOT regexp_matches(CASE WHEN s > 0 THEN text[s:s] ELSE '' END, '[\p{{L}}\p{{N}}_.]') AND NOT regexp_matches(text[s + length(form) + 1:s + length(form) + 1], '[\p{{L}}\p{{N}}_]')"""
)
def q10_derivatives_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts_with_handles(documents(spark, sf_dir))
    return exploded(rows, "doc_id", T.derivative_findings(F.col("text"), F.array("name"))).select("doc_id", "s", "value")


@query(
    f"""WITH f AS ({O.tier1("documents", "doc_id", "text")}) SELECT doc_id, entity_type, s, e, value FROM f JOIN (SELECT doc_id, length(text) AS n FROM documents) USING (doc_id)
    WHERE e <= n // 2 OR s >= n // 2 + 10"""
)
def q11_clip_to_value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("start"), half.alias("end"), F.lit("a").alias("path")), F.struct((half + 10).alias("start"), n.alias("end"), F.lit("b").alias("path")))
    docs = documents(spark, sf_dir)
    return exploded(docs, "doc_id", overlap.clipped(T.pattern_findings(F.col("text")), spans)).drop("tier")


@query(
    """WITH f AS (SELECT user_id, event_id, event_id * 13 % 211 AS s, event_id * 13 % 211 + 1 + event_id % 17 AS e FROM events),
    g AS (SELECT user_id, list_reduce(list_concat([[]], list_transform(list(struct_pack(event_id := event_id, s := s, e := e) ORDER BY e - s DESC, s, event_id), lambda x: [x])),
      lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM f GROUP BY user_id)
    SELECT user_id, k.event_id AS event_id, k.s AS s, k.e AS e FROM (SELECT user_id, unnest(kept) AS k FROM g)"""
)
def q12_greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("event_id") * 13) % 211
    rows = read(spark, sf_dir, "events").select("user_id", s.alias("start"), (s + 1 + F.col("event_id") % 17).alias("end"), "event_id")
    kept = overlap.resolved_rows(rows, "user_id", "event_id")
    return kept.select("user_id", "event_id", F.col("start").alias("s"), F.col("end").alias("e"))


@query(
    f"""WITH raw AS ({O.tier1(BOTH, "id", "text")}), f AS (SELECT id, s, e, entity_type, CASE entity_type WHEN 'EMAIL' THEN 1 WHEN 'URL' THEN 2 ELSE 3 END AS p, value FROM raw UNION ALL SELECT id, greatest(s - 3, 0), s + 2, 'EDGE', 4, value FROM raw),
    g AS (SELECT id, list_reduce(list_concat([[]], list_transform(list(struct_pack(s := s, e := e, entity_type := entity_type) ORDER BY e - s DESC, s, p), lambda x: [x])),
      lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM f GROUP BY id)
    SELECT id, k.s AS s, k.e AS e, k.entity_type AS entity_type FROM (SELECT id, unnest(kept) AS k FROM g)"""
)
def q12_overlap_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a text against others that touch their first characters."""

    def with_edges(found: Column) -> Column:
        edge = lambda f: T.finding(F.greatest(f["start"] - 3, F.lit(0)), f["start"] + 2, "EDGE", f["value"], "synthetic")
        return overlap.resolved(F.concat(found, F.transform(found, edge)))

    rows = both(spark, sf_dir).select("id", F.explode(T.let(T.pattern_findings(F.col("text")), with_edges)).alias("f"))
    return rows.select("id", long("f.start").alias("s"), long("f.end").alias("e"), "f.entity_type")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(documents(spark, sf_dir), "doc_id", detect.detect(F.col("text")))


@query(f"WITH {O.findings(BOTH, 'id')} SELECT substr(id, 1, 1) AS kind, tier, entity_type, count(*)::BIGINT AS n FROM found GROUP BY ALL")
def q13_tiers_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents and web pages by kind, tier and type."""
    found = exploded(both(spark, sf_dir), "id", detect.detect(F.col("text")))
    return found.groupBy(F.left("id", F.lit(1)).alias("kind"), "tier", "entity_type").agg(F.count("*").alias("n"))


@query(f"WITH {O.findings()} SELECT tier, count(*)::BIGINT AS n FROM found GROUP BY tier")
def q13_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tier_counts(_found(spark, sf_dir))


_SESSIONS = f"""WITH {O.findings("(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)")}, firsts AS (
      SELECT doc_id // 100000 AS session, value, min(doc_id * 1000000 + s) AS place, arg_min(entity_type, doc_id * 1000000 + s) AS entity_type FROM found GROUP BY ALL)
    SELECT session, value, entity_type, row_number() OVER (PARTITION BY session, entity_type ORDER BY place)::BIGINT AS ord, printf('<<%s_%02d>>', entity_type, row_number() OVER (PARTITION BY session, entity_type ORDER BY place)) AS token FROM firsts"""


@query(_SESSIONS)
def q14_session_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    found = exploded(turns, "k", detect.detect(F.col("text"))).select(F.col("k.conv_id").alias("session"), F.col("k.turn").alias("turn"), "s", "value", "entity_type")
    return vault.numbered(found, "session", ["turn", "s"]).withColumn("ord", long("ord"))


@query(_SESSIONS)
def q14_numbering_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault of conversations whose turns come in three runs: tokens of earlier ones stay."""
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    found = exploded(turns, "k", detect.detect(F.col("text"))).select(F.col("k.conv_id").alias("session"), F.col("k.turn").alias("turn"), "s", "value", "entity_type")
    found = scratch.written(found, "found")
    first = found.where("turn < 2")
    held = scratch.written(vault.numbered(first, "session", ["turn", "s"]).withColumn("ord", long("ord")), "vault")
    for part in ("turn >= 2 and turn < 4", "turn >= 4"):
        held = scratch.written(vault.extended(held, found.where(part), "session", ["turn", "s"]), "vault")
    return held


@query(f"WITH {O.findings()}, {O.vault()} SELECT doc_id, value, entity_type, ord, token FROM vault")
def q14_document_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir).select("doc_id", F.explode("vault").alias("v"))
    number = F.regexp_extract("v.token", r"_([0-9]+)>>$", 1).cast("long")
    return made.select("doc_id", "v.value", "v.entity_type", number.alias("ord"), "v.token")


@query(_SESSIONS)
def q14_numbering_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vault of a stream: turns arrive in three runs and out of order, and a last row moves the watermark beyond them."""
    folder = f"{scratch.shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", at.alias("ts"), F.col("turn").alias("seq"), "text")
    close = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"))
    for part in (2, 0, 1, None):
        (close if part is None else turns.where((F.col("conv_id") + F.col("seq")) % 3 == part)).write.mode("append").parquet(f"{folder}/in")
        stream = streams.number_stream(spark.readStream.schema(turns.schema).parquet(f"{folder}/in"), "conv_id", "1 hour", None)
        running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()
    return spark.read.parquet(f"{folder}/out").select(F.col("conv_id").alias("session"), "value", "entity_type", long("ord").alias("ord"), "token")


# --- substitution -------------------------------------------------------------------------------


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.anonymized(documents(spark, sf_dir))


@query(
    f"""WITH {O.findings()}, {O.vault()}, o AS (SELECT doc_id, list(value ORDER BY length(value) DESC, s) AS v FROM vault GROUP BY doc_id)
    SELECT doc_id, unnest(range(1, len(v) + 1))::BIGINT AS place, unnest(v) AS value,
      unnest(list_transform(v, lambda x: CASE WHEN regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]') THEN '(?<![\\p{{L}}\\p{{N}}_])' ELSE '' END || '\\Q' || x || '\\E' || CASE WHEN regexp_matches(x, '[\\p{{L}}\\p{{N}}_]$') THEN '(?![\\p{{L}}\\p{{N}}_])' ELSE '' END)) AS pattern FROM o"""
)
def q15_guarded_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = T.longest_first(F.transform("vault", lambda e: e["value"]))
    rows = _made(spark, sf_dir).select("doc_id", F.posexplode(values).alias("i", "value"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "value", substitute.guarded(F.col("value")).alias("pattern"))


@query(
    f"""{O.pipeline()} SELECT doc_id, out AS anonymized, n_findings, len(regexp_extract_all(out, '{O.TOKEN}'))::BIGINT AS n_replaced,
    greatest(len(regexp_extract_all(out, '{O.TOKEN}')) - n_findings, 0)::BIGINT AS extra, n_unique FROM anon"""
)
def q16_anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", "anonymized", long("n_findings").alias("n_findings"), long("n_replaced").alias("n_replaced"), long("extra").alias("extra"), long("n_unique").alias("n_unique"))


_ALL = f"{O.pipeline(BOTH, 'id')}, l AS (SELECT a.id, count(*) FILTER (contains(regexp_replace(a.out, '{O.TOKEN}', ' ', 'g'), v.value))::BIGINT AS leak_count FROM anon a LEFT JOIN vault v USING (id) GROUP BY a.id)"


@query(f"{_ALL} SELECT id, out AS anonymized, n_findings, n_unique, len(regexp_extract_all(out, '{O.TOKEN}'))::BIGINT AS n_replaced, leak_count FROM anon JOIN l USING (id)")
def q16_anonymized_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitution and leak check of documents and web pages, whose addresses are URLs for the most part."""
    made = pipeline.anonymized(both(spark, sf_dir), "id")
    return made.select("id", "anonymized", long("n_findings").alias("n_findings"), long("n_unique").alias("n_unique"), long("n_replaced").alias("n_replaced"), long(F.size("leaks")).alias("leak_count"))


@query(f"WITH {O.findings()}, {O.vault()} SELECT doc_id, f.s, f.value, f.entity_type, coalesce(token, '?') AS token, length(token)::BIGINT AS token_length FROM found f LEFT JOIN vault v USING (doc_id, value)")
def q17_findings_with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir)
    found = exploded(made, "doc_id", F.col("findings"))
    entries = made.select("doc_id", F.explode("vault").alias("v")).select("doc_id", "v.value", "v.token")
    joined = found.join(entries, ["doc_id", "value"], "left")
    return joined.select("doc_id", "s", "value", "entity_type", F.coalesce("token", F.lit("?")).alias("token"), long(F.length("token")).alias("token_length"))


@query(f"{O.pipeline()} SELECT v.doc_id, v.token, length(v.value)::BIGINT AS value_length FROM vault v")
def q17_vault_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _made(spark, sf_dir).select("doc_id", F.explode("vault").alias("v")).select(F.col("doc_id").alias("session_id"), "v.token", "v.value")
    return vault.summary(ids).select(F.col("session_id").alias("doc_id"), "token", long("value_length").alias("value_length"))


@query(f"{O.pipeline()} SELECT doc_id, len(regexp_extract_all(out, '{O.TOKEN}'))::BIGINT AS n_tokens FROM anon")
def q18_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", long("n_tokens").alias("n_tokens"))


@query(
    f"""{O.pipeline()}, l AS (SELECT a.doc_id, count(*) FILTER (contains(regexp_replace(a.out, '{O.TOKEN}', ' ', 'g'), v.value))::BIGINT AS leak_count FROM anon a LEFT JOIN vault v USING (doc_id) GROUP BY a.doc_id)
    SELECT doc_id, leak_count > 0 AS fired, leak_count FROM l"""
)
def q19_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", (F.size("leaks") > 0).alias("fired"), long(F.size("leaks")).alias("leak_count"))


@query(f"WITH {O.findings()} SELECT tier, count(*)::BIGINT AS n_findings, count(DISTINCT doc_id)::BIGINT AS n_documents, sum(e - s)::BIGINT AS chars FROM found GROUP BY ROLLUP (tier)")
def q19_findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).rollup("tier").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_documents"), F.sum(F.col("e") - F.col("s")).alias("chars"))


@query(f"{O.pipeline()}, back AS (SELECT a.doc_id, a.text, list_reduce(list_concat([a.out], coalesce(list(v.token || chr(1) || v.value) FILTER (v.token IS NOT NULL), [])), lambda x, t: replace(x, split_part(t, chr(1), 1), split_part(t, chr(1), 2))) AS rehydrated FROM anon a LEFT JOIN vault v USING (doc_id) GROUP BY a.doc_id, a.text, a.out) SELECT doc_id, rehydrated, rehydrated = text AS exact, len(regexp_extract_all(rehydrated, '{O.TOKEN}'))::BIGINT AS n_unmatched FROM back")
def q20_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _answered(spark, sf_dir, model.echo)
    return made.select("doc_id", F.col("o.text").alias("rehydrated"), substitute.restores(F.col("o.text"), F.col("text")).alias("exact"), long(F.size("o.unmatched")).alias("n_unmatched"))


def _answered(spark: SparkSession, sf_dir: str, transport: Callable[[Column], Column] = model.mangle) -> DataFrame:
    answered = T.barrier(_made(spark, sf_dir), "answer", transport(F.col("anonymized")))
    return T.barrier(answered, "o", T.let(vault.reverse(F.col("vault")), lambda r: substitute.rehydrated(F.col("answer"), r)))


_MANGLED = f"""{O.pipeline()}, sent AS (SELECT doc_id, out, {O.mangle("out")} AS answer FROM anon), t AS (SELECT *, regexp_extract_all(out, '{O.TOKEN}') AS tokens FROM sent)"""


@query(
    f"""{_MANGLED}, first AS (SELECT doc_id, tokens[1] AS token, lower(tokens[1]) AS remnant, answer FROM t WHERE len(tokens) >= 1
      UNION ALL SELECT doc_id, tokens[2], regexp_replace(tokens[2], '^<<|>>$', '', 'g'), answer FROM t WHERE len(tokens) >= 2 AND tokens[2] <> tokens[1]
      UNION ALL SELECT doc_id, tokens[2], regexp_replace(tokens[2], '^<<|>>$', '', 'g'), answer FROM t WHERE len(tokens) >= 2 AND tokens[2] = tokens[1])
    SELECT doc_id, remnant FROM first"""
)
def q21_altered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = F.transform("o.unmatched", lambda x: F.trim(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return _answered(spark, sf_dir).select("doc_id", F.explode(trimmed).alias("remnant"))


@query(
    f"""{_MANGLED}, seen AS (SELECT doc_id, list_distinct(tokens) AS minted, regexp_extract_all(answer, '{O.TOKEN}') AS back, tokens FROM t)
    SELECT doc_id, len(tokens[1:2])::BIGINT AS n_unmatched, len(tokens) = 0 AS ok FROM seen"""
)
def q22_unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("doc_id", long(F.size("o.unmatched")).alias("n_unmatched"), (F.size("o.unmatched") == 0).alias("ok"))


@query(f"{_MANGLED} SELECT doc_id, tokens[1] AS token FROM t WHERE len(tokens) > 0")
def q22_dropped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that never came back."""
    return _answered(spark, sf_dir, model.drop).select("doc_id", F.explode("o.dropped").alias("token"))


@query(f"{O.pipeline()} SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(out, '{O.TOKEN}')) AS token FROM anon) GROUP BY ALL")
def q23_token_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_multiset(_made(spark, sf_dir), "doc_id", "anonymized")


_PRESERVED = rf"""{_MANGLED}, s AS (SELECT doc_id, token, count(*) AS sent FROM (SELECT doc_id, unnest(tokens) AS token FROM t) GROUP BY ALL),
  b AS (SELECT doc_id, token, count(*) AS back FROM (SELECT doc_id, unnest(regexp_extract_all(answer, '{O.TOKEN}')) AS token FROM t) GROUP BY ALL),
  p AS (SELECT doc_id, token, regexp_extract(token, '^<<([A-Z_]+)_[0-9]{{2,}}>>$', 1) AS entity, sent, least(sent, coalesce(back, 0)) AS preserved, answer, token[3:-3] AS inside
    FROM s LEFT JOIN b USING (doc_id, token) JOIN (SELECT doc_id, answer FROM t) USING (doc_id)),
  m AS (SELECT *, sent - preserved AS lost, CASE WHEN contains(answer, inside) THEN 'delimiters stripped/altered' WHEN contains(lower(answer), lower(inside)) THEN 'case changed'
    WHEN contains(answer, regexp_replace(inside, '_[^_]*$', '')) THEN 'number altered/dropped' ELSE 'token absent entirely' END AS mode FROM p)"""


def _preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.preservation(_answered(spark, sf_dir), "doc_id", "anonymized", "answer")


@query(f"{_PRESERVED} SELECT entity, sum(sent)::BIGINT AS sent, sum(preserved)::BIGINT AS preserved FROM m GROUP BY entity")
def q24_preservation_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_entity(_preserved(spark, sf_dir))


@query(f"{_PRESERVED} SELECT mode, sum(lost)::BIGINT AS lost FROM m WHERE lost > 0 GROUP BY mode")
def q25_mangling_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_mode(_preserved(spark, sf_dir))


@query(f"{_PRESERVED} SELECT sum(sent)::BIGINT AS sent, sum(preserved)::BIGINT AS preserved, round(100.0::DOUBLE * sum(preserved) / sum(sent), 9) AS percent, (SELECT sum(len(tokens[1:2])) FROM t)::BIGINT AS unmatched FROM m")
def q26_preservation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answered(spark, sf_dir)
    rate = metrics.rate(metrics.preservation(answers, "doc_id", "anonymized", "answer"), answers.select(F.size("o.unmatched").alias("n")))
    return rate.withColumn("percent", F.round("percent", 9))


@query(f"{_MANGLED} SELECT CASE WHEN max(len(tokens)) > 0 THEN 1 ELSE 0 END::BIGINT AS mangled, 0::BIGINT AS echoed, CASE WHEN max(length(out)) >= 1000 THEN 2 WHEN max(len(tokens)) > 0 THEN 1 ELSE 0 END::BIGINT AS failed FROM t")
def q27_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of an exchange that alters, one that echoes, and one that refuses texts of 1000 characters or more."""

    sent = F.col("anonymized")
    answers = F.array(*(F.struct(F.lit(kind).alias("kind"), of(sent).alias("answer")) for kind, of in (("mangled", model.mangle), ("echoed", model.echo))))
    rows = T.barrier(_made(spark, sf_dir).select("anonymized", "vault", F.inline(answers)), "o", T.let(vault.reverse(F.col("vault")), lambda r: substitute.rehydrated(F.col("answer"), r)))
    lost = F.size(F.array_except(tokens.tokens(sent), tokens.tokens(F.col("answer"))))
    judged = rows.select("kind", lost.alias("lost"), F.size("o.unmatched").alias("unmatched"), F.when(F.length(sent) >= 1000, "too long").alias("refused"))
    fine = F.lit(None).cast("string")
    verdicts = (("mangled", "mangled", fine), ("echoed", "echoed", fine), ("failed", "mangled", F.col("refused")))
    return judged.agg(*(long(metrics.worst(error, F.col("kind") == kind)).alias(name) for name, kind, error in verdicts))


@query(f"{O.pipeline()} SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n_lines, len(string_split(text, chr(10))) = len(string_split(out, chr(10))) AS equal FROM anon")
def q28_line_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", long(F.regexp_count("text", F.lit("\n"))).alias("n_lines"), metrics.line_parity(F.col("text"), F.col("anonymized")).alias("equal"))


# --- labels, logs, model -------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from the findings themselves and from first words, which stay in clear."""
    found = _found(spark, sf_dir).select("doc_id", "value", F.lit(1).alias("phase"), F.col("entity_type").alias("type"), F.lit("structured").alias("context"), F.lit("candidate").alias("subject"), F.lit(1).alias("occurrence"))
    word = F.regexp_extract("text", r"([a-z]{4,})", 1)
    plain = documents(spark, sf_dir).where(word != "").select("doc_id", word.alias("value"), (F.col("doc_id") % 2 + 1).cast("int").alias("phase"), F.lit("ORG").alias("type"), F.lit("prose").alias("context"), F.lit("third_party").alias("subject"), F.lit(2).alias("occurrence"))
    return found.unionByName(plain)


_LABELS = """labels_ AS (SELECT doc_id, value, 1 AS phase, entity_type AS type, 'structured' AS context, 'candidate' AS subject, 1 AS occurrence FROM found
  UNION ALL SELECT doc_id, regexp_extract(text, '([a-z]{4,})', 1), (doc_id % 2 + 1)::INT, 'ORG', 'prose', 'third_party', 2 FROM documents WHERE regexp_extract(text, '([a-z]{4,})', 1) <> '')"""


@query(
    f"""{O.pipeline()}, {_LABELS} SELECT doc_id, count(*)::BIGINT AS total, (count(*) FILTER (contains(out, value)))::BIGINT AS missed,
    (count(*) - count(*) FILTER (contains(out, value)))::DOUBLE / count(*) AS recall FROM labels_ JOIN anon USING (doc_id) WHERE phase = 1 GROUP BY doc_id"""
)
def q29_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(_labels(spark, sf_dir), _made(spark, sf_dir).select("doc_id", F.col("anonymized").alias("text")))


@query(f"WITH {O.findings()}, {_LABELS} SELECT doc_id, value, type, len(string_split(text, value)) - 1 >= occurrence AS resolves, CASE WHEN len(string_split(text, value)) > occurrence THEN list_sum(list_transform(string_split(text, value)[1:occurrence], lambda x: length(x)))::BIGINT + (occurrence - 1) * length(value) END AS place FROM labels_ JOIN documents USING (doc_id)")
def q30_label_resolvability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.resolvability(_labels(spark, sf_dir), documents(spark, sf_dir)).select("doc_id", "value", "type", "resolves", long("place").alias("place"))


@query(f"WITH {O.findings()}, {_LABELS} SELECT phase, type, context, subject, count(*)::BIGINT AS n FROM labels_ GROUP BY GROUPING SETS ((phase, type), (phase, context), (phase, subject), (phase))")
def q31_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_counts(_labels(spark, sf_dir))


_FREE_WORDS = r"list_transform(list_filter(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '^\p{{L}}{{3,}}[.,;:!?]?$')), lambda x: regexp_replace(x, '[.,;:!?]$', ''))"


@query(
    f"""{O.pipeline()}, terms AS (SELECT DISTINCT unnest({_FREE_WORDS.format("text")}) AS w FROM benchmark),
    before AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_FREE_WORDS.format("text")}) AS w FROM anon) JOIN terms USING (w) GROUP BY ALL),
    after AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_FREE_WORDS.format("out")}) AS w FROM anon) JOIN terms USING (w) GROUP BY ALL),
    c AS (SELECT doc_id, w, b.n > coalesce(a.n, 0) AS lost FROM before b LEFT JOIN after a USING (doc_id, w))
    SELECT d.doc_id, count(w)::BIGINT AS n_controls, count(w) FILTER (lost)::BIGINT AS n_replaced, coalesce(string_agg(w, ',' ORDER BY w) FILTER (lost), '') AS replaced FROM anon d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id"""
)
def q31_replaced_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-detection: free words of each text that are terms of the benchmark, and which of them were replaced."""
    terms = read(spark, sf_dir, "benchmark").select(F.explode(metrics.free_words(F.col("text"))).alias("w"))
    made = _made(spark, sf_dir).select("doc_id", "text", "anonymized")
    return metrics.replaced_terms(made, terms).withColumn("replaced", F.array_join("replaced", ","))


_MESSAGE = "concat('user ', user_id, ' did ', event_type, ' ', props)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" "), F.coalesce("props", F.lit("")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.lit("INFO").alias("level"), F.col("event_type").alias("logger"), message.alias("message"))


@query(f"SELECT event_id AS seq, replace(replace({_MESSAGE}, 'purchase', '[REDACTED]'), 'click', '[REDACTED]') AS message FROM events")
def q32_redacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = F.array(*(logs.secret(F.lit(s)) for s in ("click ", "purchase", "abc")))
    return _records(spark, sf_dir).select("seq", logs.redacted(F.col("message"), secrets).alias("message"))


_LOG_SECRETS = "SELECT 'user ' || item_id || ' did' AS v FROM benchmark UNION ALL SELECT DISTINCT event_type FROM events"


@query(
    f"""WITH s AS (SELECT list(DISTINCT v ORDER BY length(v) DESC, v) AS vs FROM ({_LOG_SECRETS}) WHERE length(v) >= 4)
    SELECT event_id AS seq, list_reduce(list_concat([{_MESSAGE}], vs), lambda a, v: replace(a, v, '[REDACTED]')) AS message FROM events, s"""
)
def q32_redacted_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without any secret of a table: half of them by one automaton, the others by their rarest part."""
    records = _records(spark, sf_dir).select("seq", "message")
    users = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("user "), F.col("item_id").cast("string"), F.lit(" did")).alias("secret"))
    secrets = users.unionByName(read(spark, sf_dir, "events").select(F.col("event_type").alias("secret")).distinct())
    even = logs.redacted_records(records.where("seq % 2 = 0"), secrets)
    return even.unionByName(logs.redacted_records(records.where("seq % 2 = 1"), secrets, small=1))


@query(
    f"""SELECT item_id, v AS value FROM (SELECT item_id, 'user ' || item_id || ' did' AS v FROM benchmark UNION ALL SELECT item_id, 'nobody' FROM benchmark)
    WHERE EXISTS (SELECT 1 FROM events WHERE contains({_MESSAGE}, v))"""
)
def q33_label_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    own = items.select("item_id", F.concat(F.lit("user "), F.col("item_id").cast("string"), F.lit(" did")).alias("value"))
    return logs.leaked(_records(spark, sf_dir), own.unionByName(items.select("item_id", F.lit("nobody").alias("value"))))


_NEWEST = """SELECT seq, logger, latest FROM (SELECT event_id AS seq, event_type AS logger, max(event_id) OVER () AS latest, row_number() OVER (ORDER BY event_id DESC) AS r FROM events)
    WHERE r <= 2000 AND seq > latest - 500"""


@query(_NEWEST)
def q34_newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    held = logs.newest(records)
    top = held.agg(F.max("seq").alias("latest"))
    return held.join(F.broadcast(top)).where(F.col("seq") > F.col("latest") - 500).select("seq", "logger", "latest")


@query(_NEWEST)
def q34_newest_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a log that grows: it is read as a stream in two runs, and the second goes on at the number where the first ended."""
    folder = f"{scratch.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    records = _records(spark, sf_dir)
    half = records.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for part in (F.col("seq") <= half, F.col("seq") > half):
        log_source.append(records.where(part), f"{folder}/log")
        kept = log_source.keep_newest(log_source.read(spark, f"{folder}/log", -1), f"{folder}/held", f"{folder}/checkpoint")
    top = kept.agg(F.max("seq").alias("latest"))
    return kept.join(F.broadcast(top)).where(F.col("seq") > F.col("latest") - 500).select("seq", "logger", "latest")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS seq FROM events")
def q34_sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sequenced(read(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "seq")


_URLS = """(SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^(https?://[^/?#]*).*', '\\1') WHEN 1 THEN url || '/v1/' WHEN 2 THEN url || '/v1?token=abc' || page_id || '&x=1' WHEN 3 THEN url || '/chat/completions?API_KEY=k' WHEN 4 THEN 'ftp://x' END AS url FROM pages)"""


@query(
    rf"""WITH u AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, regexp_extract(url, '(\?[^#]*)', 1) AS q, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM {_URLS})
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN base || CASE WHEN p = '' THEN '/v1/chat/completions' WHEN p LIKE '%/chat/completions' THEN p WHEN p LIKE '%/v1' THEN p || '/chat/completions' ELSE p || '/v1/chat/completions' END || CASE WHEN length(q) > 1 THEN q ELSE '' END END AS endpoint,
    regexp_replace(url, '(?i)([?&](?:token|api_key|apikey|key|auth)=)[^&#]*', '\1[REDACTED]', 'g') AS shown, nullif(regexp_extract(url, '(?i)[?&](?:token|api_key|apikey|key|auth)=([^&#]+)', 1), '') AS bearer FROM u"""
)
def q35_endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, k = F.col("url"), F.col("page_id") % 5
    made = (
        F.when(k == 0, F.regexp_replace(url, r"^(https?://[^/?#]*).*", "$1"))
        .when(k == 1, F.concat(url, F.lit("/v1/")))
        .when(k == 2, F.concat(url, F.lit("/v1?token=abc"), F.col("page_id").cast("string"), F.lit("&x=1")))
        .when(k == 3, F.concat(url, F.lit("/chat/completions?API_KEY=k")))
        .otherwise("ftp://x")
    )
    rows = read(spark, sf_dir, "pages").select("page_id", made.alias("url"))
    return rows.select("page_id", model_api.completed_url(F.col("url")).alias("endpoint"), model_api.redacted_url(F.col("url")).alias("shown"), model_api.bearer(F.lit(""), F.col("url")).alias("bearer"))


@query("SELECT conv_id, turn, text AS sent, CASE (conv_id + turn) % 4 WHEN 3 THEN NULL ELSE text END AS received FROM conversations")
def q36_request_and_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", model_api.request_body(F.col("text"), "m").alias("request"))
    sent = F.get_json_object("request", "$.messages[1].content")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    message = F.struct(F.struct(sent.alias("content")).alias("message"))
    body = F.when(kind == 0, F.to_json(F.struct(F.array(message).alias("choices")))).when(kind == 1, F.to_json(F.struct(sent.alias("response")))).when(kind == 2, F.to_json(message)).otherwise('{"choices": []}')
    return rows.select("conv_id", "turn", sent.alias("sent"), model_api.response_text(body).alias("received"))


_CODES = (200, 401, 403, 404, 405, 429, 500)


@query(
    f"""WITH e AS (SELECT event_id, [{", ".join(map(str, _CODES))}][(event_id % 7 + 1)::INT] AS code, CASE event_id % 3 WHEN 0 THEN 'Model x' WHEN 1 THEN 'route Not Found' ELSE event_type END AS detail FROM events)
    SELECT event_id, code::BIGINT AS code, CASE WHEN code = 404 AND (contains(lower(detail), 'model') OR contains(lower(detail), 'not found')) THEN 'missing model' WHEN code IN (404, 405) THEN 'wrong path'
    WHEN code IN (401, 403) THEN 'authentication' WHEN code = 429 THEN 'rate limit' ELSE 'other' END AS cause FROM e"""
)
def q37_http_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 7 + 1).cast("int"))
    detail = F.when(F.col("event_id") % 3 == 0, "Model x").when(F.col("event_id") % 3 == 1, "route Not Found").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", long(code).alias("code"), model_api.http_cause(code, detail).alias("cause"))


@query(
    rf"""{O.pipeline()} SELECT doc_id, regexp_replace(replace(replace(replace(out, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(&lt;&lt;[A-Z_]+_[0-9]{{2,}}&gt;&gt;)', '<span class="tok">\1</span>', 'g') AS html FROM anon"""
)
def q38_highlighted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", tokens.highlighted(F.col("anonymized")).alias("html"))


# --- files, structured documents, sessions, the exchange -------------------------------------------

_SUFFIXES = (".txt", ".JSON", ".pdf", ".csv", "")
_FILE = f"'doc ' || {{0}} || [{', '.join(repr(x) for x in _SUFFIXES)}][({{0}} % 5 + 1)::INT]"


def _paths(key: Column, name: Column | None = None) -> Column:
    """Paths of files of all kinds, as a listing would have them."""
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (key % 5 + 1).cast("int"))
    return F.concat(F.lit("mem:/in/doc "), (key if name is None else name).cast("string"), suffix)


@query(f"SELECT 'doc ' || doc_id AS doc_id, {_FILE.format('doc_id')} AS filename, ['txt', 'json', 'pdf'][(doc_id % 5 + 1)::INT] AS format, strlen(text)::BIGINT AS bytes FROM documents WHERE doc_id % 5 < 3")
def q39_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(_paths(F.col("doc_id")).alias("path"), long(F.octet_length("text")).alias("length"))
    return files.listing(rows)


@query("SELECT 'doc ' || doc_id // 5 AS doc_id, min('doc ' || doc_id // 5 || ['.txt', '.JSON', '.pdf', '.csv', ''][(doc_id % 5 + 1)::INT]) AS filename FROM documents GROUP BY doc_id // 5")
def q39_first_files_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(_paths(F.col("doc_id"), F.floor(F.col("doc_id") / 5)).alias("path"))
    return files.by_stem(rows).select("doc_id", "filename")


_BAD = "�"


@query(
    rf"""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '{_BAD}' || chr(10) || 'end{_BAD}' ELSE ' ' || chr(10) END AS body, CASE doc_id % 4 WHEN 3 THEN 'csv' ELSE 'txt' END AS suffix FROM documents),
    g AS (SELECT *, CASE WHEN suffix = 'csv' THEN 'unsupported file type .csv; supported: .json, .pdf, .txt' WHEN regexp_matches(body, '^{O.SPACE}*$') THEN 'empty file' END AS error FROM f)
    SELECT 'd' || doc_id AS doc_id, CASE suffix WHEN 'txt' THEN 'text' ELSE 'unsupported' END AS source_format, CASE WHEN error IS NULL THEN body END AS text,
      CASE WHEN suffix = 'txt' AND doc_id % 3 = 1 THEN '2 undecodable sequence(s) replaced, the first on line ' || (length(body) - length(replace(body, chr(10), ''))) ELSE '' END AS warnings, error FROM g"""
)
def q40_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as files: as they are, with bytes that are no UTF-8, blank, or of a kind that isn't read."""
    raw = F.col("text").cast("binary")
    broken = F.concat(raw, F.lit(b"\xff\nend\xfe"))
    content = F.when(F.col("doc_id") % 3 == 0, raw).when(F.col("doc_id") % 3 == 1, broken).otherwise(F.lit(b" \n"))
    suffix = F.when(F.col("doc_id") % 4 == 3, ".csv").otherwise(".txt")
    rows = documents(spark, sf_dir).select(F.concat(F.lit("mem:/d"), F.col("doc_id").cast("string"), suffix).alias("path"), content.alias("content"))
    return files.documents(rows).select("doc_id", "source_format", "text", F.array_join("warnings", ";").alias("warnings"), "error")


_JSON_FIELDS = """'"' || c_name || '"'""", "(c_custkey * 7919)::VARCHAR", """'"' || n_name || '"'""", """'"' || lower(c_name) || '"'""", """'"' || c_mktsegment || '"'"""


def _json_text(name: str, phone: str, region: str, user: str, segment: str) -> str:
    """SQL for the text of a customer's document, with SQL for its values."""
    rows = (
        "{", '  "work": [', "    {", ('      "name": ', segment, ","), '      "n": 1.5,', '      "ok": true,', '      "none": null,', '      "list": [],', '      "more": {}', "    }", "  ],",
        '  "basics": {', ('    "name": ', name, ","), ('    "phone": ', phone, ","), '    "image": " ",', '    "location": {', ('      "region": ', region, ","), '      "countryCode": "N"', "    },",
        '    "profiles": [', "      {", ('        "username": ', user, ""), "      }", "    ]", "  }", "}",
    )
    return " || chr(10) || ".join(f"'{r}'" if isinstance(r, str) else f"'{r[0]}' || {r[1]} || '{r[2]}'" for r in rows) + " || chr(10)"


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each customer, keys in an order of their own."""
    people = spread(read(spark, sf_dir, "customer")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    body = F.format_string(
        '{"work":[{"name":"%s","n":1.5,"ok":true,"none":null,"list":[],"more":{}}],"basics":{"name":"%s","phone":%d,"image":" ","location":{"region":"%s","countryCode":"N"},"profiles":[{"username":"%s"}]}}',
        "c_mktsegment", "c_name", F.col("c_custkey") * 7919, "n_name", F.lower("c_name"),
    )
    return people.select(F.concat(F.lit("mem:/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), body.cast("binary").alias("content"))


@query(
    f"""SELECT c_custkey::VARCHAR AS doc_id, {_json_text(*_JSON_FIELDS)} AS text, '10' AS leaves, '8' AS values,
    'work[0].name=' || c_mktsegment || ';work[0].n=1.5;basics.name=' || c_name || ';basics.phone=' || c_custkey * 7919 || ';basics.image= ;basics.location.region=' || n_name || ';basics.location.countryCode=N;basics.profiles[0].username=' || lower(c_name) AS spans
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def q41_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.documents(_customer_files(spark, sf_dir))
    spans = F.transform("value_spans", lambda s: F.concat_ws("=", s["path"], F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return made.select("doc_id", "text", F.col("metadata")["leaves"].alias("leaves"), F.col("metadata")["values"].alias("values"), F.array_join(spans, ";").alias("spans"))


_JSON_TOKENS = "'\"<<PERSON_01>>\"'", "'<<PHONE_01>>'", "'\"<<LOCATION_01>>\"'", "'\"<<HANDLE_01>>\"'", _JSON_FIELDS[4]


@query(
    f"""SELECT c_custkey::VARCHAR AS doc_id, {_json_text(*_JSON_TOKENS)} AS anonymized, 'ok' AS status, 4::BIGINT AS n_findings, 4::BIGINT AS n_replaced, {_json_text(*_JSON_FIELDS)} AS rehydrated
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def q42_structured_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from JSON files: fields by path, findings within values only, values replaced span by span."""
    made = pipeline.anonymized(files.documents(_customer_files(spark, sf_dir)), spans="value_spans")
    back = T.barrier(made, "o", T.let(vault.reverse(F.col("vault")), lambda r: substitute.rehydrated(F.col("anonymized"), r)))
    return back.select("doc_id", "anonymized", "status", long("n_findings").alias("n_findings"), long("n_replaced").alias("n_replaced"), F.col("o.text").alias("rehydrated"))


def capitalised() -> ner.Analyzer:
    """An analyzer for the queries: capitalised words of four letters or more; it fails on texts with 77."""

    def analyze(text: str) -> list[tuple[int, int, str, float]]:
        if "77" in text:
            raise ValueError("77")
        return [(m.start(), m.end(), "PERSON" if m[0][0] < "K" else "LOCATION" if m[0][0] < "T" else "ORG", 0.9 if len(m[0]) % 2 else 0.4) for m in re.finditer("[A-Z][a-z]{3,}", text)]

    return analyze


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS w FROM documents WHERE NOT contains(text, '77')),
    n AS (SELECT doc_id, count(*) AS n_found, count(*) FILTER (w < 'T' AND length(w) % 2 = 1) AS n_accepted FROM w GROUP BY doc_id)
    SELECT doc_id, CASE WHEN contains(text, '77') THEN 'failed' ELSE 'ready' END AS ner_status, coalesce(n_found, 0)::BIGINT AS n_found, coalesce(n_accepted, 0)::BIGINT AS n_accepted, 'unavailable' AS without FROM documents LEFT JOIN n USING (doc_id)"""
)
def q43_model_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ner.with_ner(documents(spark, sf_dir), capitalised)
    counted = found.select("doc_id", "text", "ner_status", long(F.size("ner")).alias("n_found"), long(F.size(detect.accepted(F.col("ner")))).alias("n_accepted"))
    none = ner.with_ner(counted.withColumnRenamed("ner_status", "status"), None)
    return none.select("doc_id", F.col("status").alias("ner_status"), "n_found", "n_accepted", F.col("ner_status").alias("without"))


@query(
    f"""WITH {O.findings()}, raw_ner AS ({O.places("documents", "doc_id", "text", "[A-Z][a-z]{3,}")}),
    every AS (SELECT doc_id, s, e, CASE tier WHEN 'header' THEN 0 ELSE 1 END AS p, tier FROM (SELECT * FROM raw) UNION ALL SELECT doc_id, s, s + length(value), 2, 'ner' FROM raw_ner WHERE value < 'T' AND length(value) % 2 = 1),
    kept AS (SELECT doc_id, list_reduce(list_concat([[]], list_transform(list(struct_pack(s := s, e := e, tier := tier) ORDER BY e - s DESC, s, p), lambda x: [x])),
      lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END) AS k FROM every SEMI JOIN (SELECT doc_id FROM documents WHERE NOT contains(text, '77')) USING (doc_id) GROUP BY doc_id)
    SELECT tier, count(*)::BIGINT AS n FROM (SELECT unnest(k).tier AS tier FROM kept) GROUP BY tier"""
)
def q43_tiers_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all tiers by tier, in rows whose model tier did not fail."""
    docs = ner.with_ner(documents(spark, sf_dir), capitalised).where("ner_status = 'ready'")
    found = detect.with_findings(docs, F.col("text"), ner=F.col("ner"))
    return metrics.tier_counts(exploded(found, "doc_id", F.col("findings")).where("tier <> 'derivative'"))


@query(
    f"""WITH {O.findings("(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)")}, v AS (SELECT DISTINCT doc_id // 100000 AS session_id FROM found),
    asked AS (SELECT DISTINCT user_id AS session_id FROM events)
    SELECT session_id, session_id IN (SELECT session_id FROM v) AS removed, session_id NOT IN (SELECT session_id FROM v) AS missing, (SELECT count(*) FROM v)::BIGINT AS n_before, (SELECT count(*) FROM v WHERE session_id NOT IN (SELECT session_id FROM asked))::BIGINT AS n_after FROM asked"""
)
def q44_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are conversations; those whose number is a user's are destroyed."""
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    found = exploded(turns, "k", detect.detect(F.col("text"))).select(F.col("k.conv_id").alias("session_id"), F.col("k.turn").alias("turn"), "s", "value", "entity_type")
    table = vault.numbered(found, "session_id", ["turn", "s"])
    asked = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    lost = vault.missing(table, asked).withColumn("missing", F.lit(True))
    counts = vault.live(table).withColumnRenamed("n_sessions", "n_before").join(vault.live(vault.destroy(table, asked)).withColumnRenamed("n_sessions", "n_after"))
    rows = vault.destroyed(table, asked).join(lost, "session_id", "left")
    return rows.select("session_id", "removed", F.coalesce("missing", F.lit(False)).alias("missing")).join(F.broadcast(counts))


_ICON = ""


def two_pages(content: bytes) -> tuple[list, dict[str, str]]:
    """A decoder for the queries: a flag, an icon, and the text as the first page; the second page fails or is blank."""
    flag, body = content.decode()[0], content.decode()[1:]
    if flag == "x":
        raise ValueError("damaged")
    return [(body, [("ABCDEF+FontAwesome", _ICON), ("Times", body[:5])]), (ValueError("broken") if flag == "e" else "  ", [])], {"Author": " Ann Lee ", "Title": " ", "Other": "x"}


_CLEAN = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, ' {{{{6,}}}}', chr(10), 'g'), ' {{{{2,5}}}}', ' ', 'g'),
    '{_BLANKS.replace("{", "{{").replace("}", "}}")}+(\\n|\\z)', '\\1', 'g'), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^\\n+', ''), '\\n+\\z', '')"""


@query(
    f"""WITH f AS (SELECT doc_id, doc_id % 4 AS k, {_CLEAN.format("CASE WHEN doc_id % 3 = 0 THEN '" + _ICON + "' || text || '" + _ICON + "' ELSE text END")} AS body FROM documents)
    SELECT doc_id::VARCHAR AS doc_id, CASE WHEN k <> 3 THEN body || chr(10) || chr(10) || '[PDF METADATA]' || chr(10) || 'Author: Ann Lee' END AS text,
      CASE WHEN k = 3 THEN '' ELSE CASE WHEN k = 1 THEN 'page 2: broken;' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'page 1: 1 icon run(s) kept, as they stand elsewhere too' ELSE 'page 1: 1 icon run(s) removed' END END AS warnings,
      CASE WHEN k = 3 THEN 'damaged' END AS error FROM f"""
)
def q45_pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through a decoder: icons that stand once go, others are reported, a page or a file that fails is too."""
    flag = F.when(F.col("doc_id") % 4 == 3, "x").when(F.col("doc_id") % 4 == 1, "e").otherwise("p")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(_ICON), "text", F.lit(_ICON))).otherwise(F.concat(F.lit(_ICON), "text"))
    rows = documents(spark, sf_dir).select(F.concat(F.lit("mem:/"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), F.concat(flag, body).cast("binary").alias("content"))
    return files.documents(rows, two_pages).select("doc_id", "text", F.array_join("warnings", ";").alias("warnings"), "error")


@query(
    r"""WITH w AS (SELECT item_id, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM benchmark)
    SELECT item_id::VARCHAR AS doc_id, 'a' AS id, w AS value, 'label' AS kind FROM w WHERE w <> '' UNION ALL SELECT item_id::VARCHAR, '', upper(w), 'control' FROM w
    UNION ALL SELECT item_id::VARCHAR, 'doc ' || item_id || '.txt', '', 'file' FROM w JOIN documents ON doc_id = item_id AND doc_id % 5 = 0"""
)
def q46_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files made of the benchmark: their values, what must not be detected, and the files that they name."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    span = F.array(F.struct(F.lit("a").alias("id"), F.lit("ORG").alias("type"), word.alias("value"), F.lit(1).alias("phase")), F.struct(F.lit("b").alias("id"), F.lit("ORG").alias("type"), F.lit(" ").alias("value"), F.lit(2).alias("phase")))
    body = F.struct(F.col("item_id").cast("string").alias("doc_id"), F.concat(F.lit("doc "), F.col("item_id").cast("string"), F.lit(".txt")).alias("source_file"), span.alias("spans"), F.array(F.struct(F.upper(word).alias("value"))).alias("negative_controls"))
    rows = files.parsed_labels(read(spark, sf_dir, "benchmark").select(F.to_json(body).alias("body")))
    own = files.label_values(rows).select("doc_id", "id", "value", F.lit("label").alias("kind"))
    controls = files.negative_controls(rows).select("doc_id", F.lit("").alias("id"), "value", F.lit("control").alias("kind"))
    pairs = files.paired(documents(spark, sf_dir).select(_paths(F.col("doc_id")).alias("path")), rows).select("doc_id", F.col("filename").alias("id"), F.lit("").alias("value"), F.lit("file").alias("kind"))
    return own.unionByName(controls).unionByName(pairs)


@query(
    f"""{O.pipeline()} SELECT 'native' AS kind, doc_id, out AS text, true AS sent, NULL::VARCHAR AS reason FROM anon UNION ALL SELECT 'badauth', doc_id, NULL, true, 'authentication' FROM anon
    UNION ALL SELECT 'missing-model', doc_id, NULL, true, 'missing model' FROM anon UNION ALL SELECT 'unset', doc_id, NULL, false, 'the endpoint needs a key' FROM anon"""
)
def q47_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from a server that answers, refuses or lacks the model, and where none is configured."""
    cleared = pipeline.split(_made(spark, sf_dir))[0]

    def answers(kind: str, options: Options) -> DataFrame:
        return model.exchange(cleared, "doc_id", "text", options, model.mock_transport(kind)).select(F.lit(kind).alias("kind"), "doc_id", "text", "sent", "reason")

    out = answers("unset", Options(provider="openai"))
    for kind in ("native", "badauth", "missing-model"):
        out = out.unionByName(answers(kind, Options()))
    return out


@query(
    f"""{O.pipeline()}, names AS (SELECT 'doc_' || doc_id || '-v' AS n FROM documents)
    SELECT DISTINCT secret FROM (SELECT trim(value) AS secret FROM vault UNION ALL SELECT n FROM names UNION ALL SELECT replace(replace(n, '_', ' '), '-', ' ') FROM names) WHERE length(secret) >= 4"""
)
def q48_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What logs must not show: values of the vault, and names of files."""
    private = pipeline.split(_made(spark, sf_dir))[2]
    names = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("-v.txt")).alias("filename"))
    return logs.secrets_table(private, names)


_LABEL_KEYS = "SELECT item_id, 'user ' || item_id || ' did' AS v FROM benchmark UNION ALL SELECT event_id, 'x' || event_id || 'y' FROM events"


@query(f"SELECT item_id, v AS value FROM ({_LABEL_KEYS}) WHERE EXISTS (SELECT 1 FROM events WHERE contains({_MESSAGE}, v))")
def q33_many_label_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More labels than are broadcast meet the messages on their rarest part."""
    own = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("user "), F.col("item_id").cast("string"), F.lit(" did")).alias("value"))
    more = read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.concat(F.lit("x"), F.col("event_id").cast("string"), F.lit("y")).alias("value"))
    return logs.leaked(_records(spark, sf_dir), own.unionByName(more), small=100)


@query(f"{O.pipeline()} SELECT doc_id, true AS ok, length(text)::BIGINT AS char_count, len(regexp_extract_all(out, '{O.TOKEN}'))::BIGINT AS n_tokens, n_findings, false AS fired FROM anon")
def q49_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested results as JSON, and read back."""
    rows = pipeline.result_rows(_made(spark, sf_dir))
    line = rows.select("doc_id", F.to_json(F.struct("ok", "stages")).alias("j"))
    path = lambda p, kind: F.get_json_object("j", p).cast(kind)
    found = F.size(F.from_json(F.get_json_object("j", "$.stages.anonymized.findings"), "array<struct<token:string>>"))
    return line.select("doc_id", path("$.ok", "boolean").alias("ok"), path("$.stages.original.char_count", "long").alias("char_count"), path("$.stages.anonymized.n_tokens", "long").alias("n_tokens"), long(found).alias("n_findings"), path("$.stages.tripwire.fired", "boolean").alias("fired"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 5 THEN 404 ELSE 400 END::BIGINT AS code,
    CASE doc_id % 6 WHEN 1 THEN 'empty request' WHEN 2 THEN 'request too large' WHEN 3 THEN 'request is not JSON' WHEN 4 THEN 'doc_id is missing' WHEN 5 THEN 'no such document' END AS error FROM documents"""
)
def q50_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to run one document: as they should be, and with each fault."""
    kind = F.col("doc_id") % 6
    fine = F.concat(F.lit('{"doc_id": "'), F.col("doc_id").cast("string"), F.lit('"}'))
    body = F.when(kind == 1, "").when(kind == 2, F.repeat(F.lit("x"), F.lit(1_000_001))).when(kind == 3, "{oops").when(kind == 4, '{"id": 1}').otherwise(fine)
    rows = read(spark, sf_dir, "documents").select("doc_id", model_api.request_problem(body, kind != 5).alias("p"))
    return rows.select("doc_id", long("p.code").alias("code"), "p.error")


@query(
    f"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, text FROM documents), {O.findings("(SELECT * FROM d WHERE k = 3)")}
    SELECT doc_id, CASE k WHEN 0 THEN 'blank' WHEN 1 THEN 'token_in_source' WHEN 2 THEN 'reserved_character' ELSE CASE WHEN doc_id IN (SELECT doc_id FROM found) THEN 'ok' ELSE 'no_findings' END END AS status, k = 3 AS cleared FROM d"""
)
def q51_row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that must not leave: blank ones, and texts that hold what the engine uses itself."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, " \n").when(k == 1, F.concat("text", F.lit(" <<URL_07>>"))).when(k == 2, F.concat("text", F.lit(""))).otherwise(F.col("text"))
    made = pipeline.anonymized(documents(spark, sf_dir).withColumn("text", text))
    return made.select("doc_id", "status", F.col("status").isin("ok", "no_findings").alias("cleared"))


@query(f"{O.pipeline()} SELECT doc_id, out AS text, n_findings FROM anon")
def flagship_cleared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves the engine, with the number of findings behind it."""
    made = _made(spark, sf_dir)
    return made.where(F.col("status").isin("ok", "no_findings")).select("doc_id", F.col("anonymized").alias("text"), long("n_findings").alias("n_findings"))
