"""DuckDB SQL of the engine's building blocks, from which the catalogue's SQL is put together."""

from __future__ import annotations

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"""(?i)\b(?:https?://|www\.)[^\s\x1c-\x1f\x{85}\p{Z}<>"')\]]+|(?i)\b(?:linkedin\.com|github\.com)/[^\s\x1c-\x1f\x{85}\p{Z}<>"')\]]+"""
_S, _D = r"[\s\x1c-\x1f\x{85}\p{Z}.\-]", r"\p{Nd}"
PHONE = rf"(?:\+{_D}{{1,3}}{_S}?)?(?:\({_D}{{1,4}}\){_S}?|{_D}{{1,4}}{_S})?{_D}{{3}}{_S}?{_D}{{3,4}}(?:{_S}?{_D}{{2,4}})?"
HEADER = r"^[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'’\-.]*(?: [\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'’\-.]*){1,3}$"
TOKEN = r"<<[A-Z_]+_[0-9]{2,}>>"
OPEN, CLOSE = "chr(57344)", "chr(57345)"


def text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def trimmed(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def marked(column: str, pattern: str, guard: bool = False) -> str:
    edge = r"[^\p{L}\p{N}_.]"
    around = (f"(^|{edge})", f"({edge}|$)") if guard else ("()", "()")
    return f"regexp_replace({column}, {text(f'{around[0]}({pattern}){around[1]}')}, '\\1' || {OPEN} || '\\2' || {CLOSE} || '\\3', 'g')"


def places(source: str, key: str, column: str, pattern: str, guard: bool = False) -> str:
    """Rows (key, i, s, value): the i-th match and its offset."""
    return f"""SELECT {key}, i // 2 AS i, list_sum(list_transform(parts[1:(i - 1)], lambda x: length(x)))::BIGINT AS s, parts[i] AS value
    FROM (SELECT {key}, parts, unnest(range(2, len(parts) + 1, 2)) AS i
          FROM (SELECT {key}, string_split(replace({marked(column, pattern, guard)}, {CLOSE}, {OPEN}), {OPEN}) AS parts FROM {source}))"""


def tier1(source: str, key: str, column: str) -> str:
    """Rows (key, entity_type, s, e, value) of e-mail addresses, URLs and phone numbers."""
    kinds = (("EMAIL", EMAIL, False, "true"), ("URL", URL, False, "true"), ("PHONE", PHONE, True, r"length(regexp_replace(value, '[^\p{Nd}]', '', 'g')) >= 9"))
    return " UNION ALL ".join(
        f"SELECT {key}, '{kind}' AS entity_type, s, s + length(regexp_replace(value, '[.,;:)]+$', '')) AS e, regexp_replace(value, '[.,;:)]+$', '') AS value FROM ({places(source, key, column, pattern, guard)}) WHERE {keep}"
        for kind, pattern, guard, keep in kinds
    )


def header(source: str, key: str, column: str) -> str:
    """Rows (key, entity_type, s, e, value) of names in header lines."""
    return f"""SELECT {key}, 'PERSON' AS entity_type, s, s + length(name) AS e, name AS value FROM (
      SELECT {key}, {trimmed("line")} AS name, (coalesce(list_sum(list_transform(lines[1:(ln - 1)], lambda x: length(x) + 1)), 0) + length(line) - length(regexp_replace(line, '^{SPACE}+', '')))::BIGINT AS s
      FROM (SELECT {key}, lines, ln, lines[ln] AS line FROM (
        SELECT {key}, lines, list_position(list_transform(lines, lambda x: NOT regexp_matches(x, '^{SPACE}*$')), true) AS ln
        FROM (SELECT {key}, string_split({column}, chr(10)) AS lines FROM {source})) WHERE ln > 0))
      WHERE NOT regexp_matches(name, '[,@\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]') AND regexp_matches(name, {text(HEADER)})"""


def findings(source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTEs up to found (key, entity_type, s, e, value, tier): disjoint findings of plain texts.

    Longest first, ties by start and tier: a finding goes if one that stayed meets it. Rows that meet
    none, nearly all, pass at once; the others go through a fold."""
    return f"""raw AS (
      SELECT *, 'header' AS tier, 0 AS p FROM ({header(source, key, column)})
      UNION ALL SELECT *, 'regex', CASE entity_type WHEN 'EMAIL' THEN 1 WHEN 'URL' THEN 2 ELSE 3 END FROM ({tier1(source, key, column)})),
    folded AS (
      SELECT {key}, list_reduce(list_concat([[]], list_transform(list(struct_pack(s := s, e := e, entity_type := entity_type, value := value, tier := tier) ORDER BY e - s DESC, s, p), lambda x: [x])),
        lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE list_concat(a, b) END) AS kept
      FROM raw GROUP BY {key}),
    found AS (SELECT {key}, f.s AS s, f.e AS e, f.entity_type AS entity_type, f.value AS value, f.tier AS tier FROM (SELECT {key}, unnest(kept) AS f FROM folded))"""


def vault(key: str = "doc_id") -> str:
    """CTE vault (key, value, entity_type, ord, token) after findings()."""
    return f"""firsts AS (SELECT {key}, value, min(s) AS s, arg_min(entity_type, s) AS entity_type FROM found GROUP BY {key}, value),
    vault AS (SELECT {key}, value, entity_type, row_number() OVER (PARTITION BY {key}, entity_type ORDER BY s)::BIGINT AS ord,
      printf('<<%s_%02d>>', entity_type, row_number() OVER (PARTITION BY {key}, entity_type ORDER BY s)) AS token, s FROM firsts)"""


def guarded(value: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({value}, '^[A-Za-z0-9_]') THEN '\\b' ELSE '' END || '\\Q' || {value} || '\\E' || CASE WHEN regexp_matches({value}, '[A-Za-z0-9_]$') THEN '\\b' ELSE '' END)"
    )


def anonymized(source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTE anon (key, text, out, n_findings, n_unique) after vault(): values replaced, the longest first."""
    return f"""edits AS (SELECT {key}, list({guarded("value")} || chr(1) || token ORDER BY length(value) DESC, s) AS edits, count(*) AS n_unique FROM vault GROUP BY {key}),
    counts AS (SELECT {key}, count(*) AS n_findings FROM found GROUP BY {key}),
    anon AS (SELECT d.{key}, d.{column} AS text, coalesce(n_findings, 0)::BIGINT AS n_findings, coalesce(n_unique, 0)::BIGINT AS n_unique,
      list_reduce(list_concat([d.{column}], coalesce(edits, [])), lambda a, x: regexp_replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2), 'g')) AS out
      FROM {source} d LEFT JOIN edits USING ({key}) LEFT JOIN counts USING ({key}))"""


def pipeline(source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"WITH {findings(source, key, column)}, {vault(key)}, {anonymized(source, key, column)}"


def mangle(column: str) -> str:
    """Text with its first placeholder in lower case and its second without delimiters."""
    found = f"regexp_extract_all({column}, '{TOKEN}')"
    once = lambda t, what, by: f"CASE WHEN {what} IS NULL OR position({what} IN {t}) = 0 THEN {t} ELSE substr({t}, 1, position({what} IN {t}) - 1) || {by} || substr({t}, position({what} IN {t}) + length({what})) END"
    first = once(column, f"{found}[1]", f"lower({found}[1])")
    return once(f"({first})", f"{found}[2]", f"regexp_replace({found}[2], '^<<|>>$', '', 'g')")
