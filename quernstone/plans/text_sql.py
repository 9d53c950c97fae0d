"""DuckDB expressions for the text rules."""

from __future__ import annotations

from quernstone.functions.text import ENGLISH

S = "chr(1)"
TOKEN_SPLIT = r"'[^\p{L}\p{N}_]+'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')"


def normalize(x: str) -> str:
    x = f"replace({x}, chr(13) || chr(10), chr(10))"
    x = rf"regexp_replace({x}, '&(?:#\d+|[A-Za-z]+);', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


BOILERPLATE = (
    r"(?i)(partner\s+content|promoted|sponsored|advertisement|see\s+more|learn\s+more|click\s+here|read\s+more|skip\s+ad|please\s+wait|loading\.\.\."
    r"|all\s+rights\s+reserved|privacy\s+policy|terms\s+of\s+(use|service)|(pin|tweet|like|follow|share)\s+(us|on|this)"
    r"|(newsletter|subscribe|sign up)\s+(to|for|today|now)|cookies?\s+(banner|consent|notice|policy))"
)


def strip_boilerplate(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || {S}, 'g'), {S})"
    kept = f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '{BOILERPLATE}'))"
    joined = f"coalesce(array_to_string({kept}, ' '), '')"
    return strip(rf"regexp_replace(regexp_replace({joined}, 'https?://\S+', '', 'g'), '\b[-+.\w]+@[-\w]+\.[-.\w]+\b', '', 'g')")


def chunks(x: str, size: int) -> str:
    step = (
        f"lambda a, p: CASE WHEN length(a.cur) + length(p.cur) + 2 > {size} AND a.cur <> '' THEN {{'out': list_append(a.out, {strip('a.cur')}), 'cur': p.cur}} "
        "WHEN a.cur <> '' THEN {'out': a.out, 'cur': a.cur || chr(10) || chr(10) || p.cur} ELSE {'out': a.out, 'cur': p.cur} END"
    )
    items = f"list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {{'out': []::VARCHAR[], 'cur': p}})"
    return f"list_reduce({items}, {step}, {{'out': []::VARCHAR[], 'cur': ''}})"


def entropy(x: str) -> str:
    each = f"list_filter(list_transform(list_distinct(string_split({x}, '')), lambda c: (length({x}) - length(replace({x}, c, '')))::DOUBLE), lambda k: k > 0)"
    return f"(CASE WHEN length({x}) > 0 THEN log2(length({x})::DOUBLE) - list_sum(list_transform({each}, lambda k: k * log2(k))) / length({x}) ELSE 0 END)"


def syllables(w: str) -> str:
    runs = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return f"(CASE WHEN length({w}) <= 2 THEN 1 ELSE greatest(1, {runs} - CASE WHEN suffix({w}, 'e') AND {runs} > 1 THEN 1 ELSE 0 END) END)"


CODE_PATTERNS = [
    r"```[\s\S]*?```",
    r"`[^`\n]+`",
    r"(?m)^\s*(?:(?:class|const|def|from|function|import|let|var) |(?:for|if|while)\s*\()",
    r"(?m)^\s*[#/]\s*(?:define|include|pragma)",
    r"(?m)=>|->|;\s*$",
    r"(?m)^\s*\w+\s*=\s*\w+\s*\(",
]
CODE_LINE = r"^(?:\w+\s*=|(?:def|class|import|from) |\w+\([^\n]*\)\s*$)"


def code_ratio(x: str) -> str:
    matched = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '{p}'), lambda m: length(m))), 0)" for p in CODE_PATTERNS)
    lines = f"string_split({x}, chr(10))"
    like = f"len(list_filter({lines}, lambda l: regexp_matches({strip('l')}, '{CODE_LINE}')))"
    return f"greatest(least(1.0::DOUBLE, ({matched}) / greatest(length({x})::DOUBLE, 1.0)), {like}::DOUBLE / len({lines}))"


def language(x: str) -> str:
    listed = ", ".join(f"'{w}'" for w in ENGLISH)
    tokens = f"list_filter(regexp_split_to_array(lower({x}), {TOKEN_SPLIT}), lambda w: regexp_full_match(w, '[a-z]+'))[1:500]"
    return (
        f"CASE WHEN coalesce(length({x}), 0) = 0 THEN 'unknown' WHEN (length({x}) - length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')))::DOUBLE / length({x}) > 0.3 THEN 'non-ascii' "
        f"WHEN len({tokens}) > 0 AND len(list_filter({tokens}, lambda w: list_contains([{listed}], w)))::DOUBLE / len({tokens}) > 0.25 THEN 'en' ELSE 'unknown' END"
    )


def features(source: str, x: str = "clean") -> str:
    """CTEs that end in ``scored``: the rows of ``source`` with the features of column ``x`` and ``quality_score``."""
    return f"""
split_rows AS MATERIALIZED (SELECT *, {words(x)} AS tokens, {sentences(x)} AS pieces FROM {source}),
counted AS MATERIALIZED (
  SELECT *, length({x}) AS n_chars_clean, len(tokens) AS n_words, len(pieces) AS n_sentences,
    coalesce(list_sum(list_transform(tokens, lambda w: {syllables('lower(w)')})), 0)::INTEGER AS n_syllables,
    {entropy(x)} AS entropy, {code_ratio(x)} AS code FROM split_rows),
repeats AS (
  SELECT doc_id, max(n) AS most FROM (
    SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(tokens, lambda w: regexp_replace(lower(w), '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))) AS w FROM split_rows) GROUP BY doc_id, w) GROUP BY doc_id),
spammed AS (
  SELECT c.*, CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, (CASE WHEN most > n_words * 0.08::DOUBLE THEN 0.3::DOUBLE ELSE 0 END)
      + (CASE WHEN len(list_filter(tokens, lambda w: length(w) > 2)) > 0 AND len(list_filter(tokens, lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w)))::DOUBLE / len(list_filter(tokens, lambda w: length(w) > 2)) > 0.3::DOUBLE THEN 0.3::DOUBLE ELSE 0 END)
      + (CASE WHEN length({x}) - length(translate({x}, '!?', '')) > n_words * 0.05::DOUBLE THEN 0.2::DOUBLE ELSE 0 END)
      + (CASE WHEN n_sentences > 0 AND len(list_filter(pieces, lambda s: len({words('s')}) < 4))::DOUBLE / n_sentences > 0.5::DOUBLE THEN 0.2::DOUBLE ELSE 0 END)) ELSE 0 END AS spam,
    CASE WHEN n_words > 0 AND n_sentences > 0 THEN 0.39::DOUBLE * (n_words::DOUBLE / n_sentences) + 11.8::DOUBLE * (n_syllables::DOUBLE / n_words) - 15.59::DOUBLE ELSE 0 END AS grade
  FROM counted c LEFT JOIN repeats USING (doc_id)),
curves AS (
  SELECT *,
    CASE WHEN n_chars_clean < 200 THEN n_chars_clean / 200::DOUBLE * 0.5::DOUBLE WHEN n_chars_clean < 500 THEN 0.5::DOUBLE + (n_chars_clean - 200) / 300::DOUBLE * 0.3::DOUBLE WHEN n_chars_clean < 5000 THEN 0.8::DOUBLE + (n_chars_clean - 500) / 4500::DOUBLE * 0.2::DOUBLE ELSE 1 END AS c1,
    CASE WHEN n_sentences = 0 THEN 0 WHEN n_words::DOUBLE / n_sentences < 5 THEN n_words::DOUBLE / n_sentences / 5 * 0.5::DOUBLE WHEN n_words::DOUBLE / n_sentences > 40 THEN greatest(0.3::DOUBLE, 1 - (n_words::DOUBLE / n_sentences - 40) / 40) ELSE 0.7::DOUBLE + (n_words::DOUBLE / n_sentences - 5) / 35 * 0.3::DOUBLE END AS c2,
    CASE WHEN grade < 3 THEN 0.4::DOUBLE WHEN grade < 8 THEN 0.7::DOUBLE + (grade - 3) / 5 * 0.3::DOUBLE WHEN grade < 14 THEN 1 WHEN grade < 20 THEN greatest(0.5::DOUBLE, 1 - (grade - 14) / 6 * 0.5::DOUBLE) ELSE 0.3::DOUBLE END AS c3,
    CASE WHEN entropy < 3 THEN entropy / 3 * 0.5::DOUBLE WHEN entropy < 4.5::DOUBLE THEN 0.5::DOUBLE + (entropy - 3) / 1.5::DOUBLE * 0.5::DOUBLE ELSE 1 END AS c4
  FROM spammed),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN n_chars_clean >= 50 AND n_words > 0 AND n_sentences > 0 THEN
    round(greatest(0::DOUBLE, least(1::DOUBLE, c1 * 0.15::DOUBLE + c2 * 0.2::DOUBLE + c3 * 0.2::DOUBLE + c4 * 0.2::DOUBLE + (1 - least(1::DOUBLE, code * 1.5::DOUBLE)) * 0.15::DOUBLE + (1 - spam) * 0.1::DOUBLE)), 3) ELSE 0 END AS quality_score
  FROM curves)"""


CLEAN = f"(SELECT *, {strip_boilerplate(normalize('text'))} AS clean FROM documents)"


def decided(min_quality: float = 0.3, max_code: float = 0.4, min_length: int = 200, min_entropy: float = 3.0) -> str:
    """WITH clause that ends in ``decided`` (doc_id, ..., quality_score, drop_reason)."""
    return f"""WITH marked AS MATERIALIZED (
  SELECT *, CASE WHEN coalesce(length(text), 0) < {min_length} THEN 'short' WHEN ({language('text')}) <> 'en' THEN 'language' END AS early FROM documents),
cleaned AS MATERIALIZED (SELECT *, {strip_boilerplate(normalize('text'))} AS clean FROM marked WHERE early IS NULL),
{features('cleaned')},
decided AS (
  SELECT doc_id, lang, clean, quality_score, CASE WHEN n_chars_clean < {min_length} THEN 'short' WHEN code > {max_code}::DOUBLE THEN 'code' WHEN quality_score < {min_quality}::DOUBLE OR entropy < {min_entropy}::DOUBLE THEN 'quality' END AS drop_reason FROM scored
  UNION ALL SELECT doc_id, lang, NULL, NULL, early FROM marked WHERE early IS NOT NULL)"""
