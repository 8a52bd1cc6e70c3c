"""The same functions as DuckDB SQL, for the oracles. RE2 has no look-around; patterns are its own."""

from __future__ import annotations

from ..functions.text import ABBREV, SERVERS, STOPWORDS
from ..seed import TAGS, alias_rows, entry_rows
from ..seed import JOURNALS


def q(s: object) -> str:
    return "NULL" if s is None else str(s) if isinstance(s, (int, float)) else "'" + str(s).replace("'", "''") + "'"


def values(rows: list[tuple], names: str, alias: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) {alias}({names})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def words(x: str) -> str:
    folded = f"strip_accents(lower(coalesce({x}, '')))"
    return f"string_split(trim({sub(f'''replace({folded}, '&', ' and ')''', '[^a-z0-9]+', ' ')}), ' ')"


def _stops(ws: str) -> str:
    return f"list_filter({ws}, lambda t: t <> '' AND t NOT IN ({', '.join(map(q, STOPWORDS))}))"


def normalize_name(x: str) -> str:
    case = "CASE t " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ABBREV.items()) + " ELSE t END"
    return f"coalesce(array_to_string({_stops(f'list_transform({words(x)}, lambda t: {case})')}, ''), '')"


def tokens_of(x: str) -> str:
    return _stops(words(x))


_S = r"\s"
_PREFIX = r"in\s+(?:proceedings\s+of\s+the\s+)?|proceedings\s+(?:of\s+(?:the\s+)?)?|proc\.?\s+of\s+(?:the\s+)?|the\s+"
_LEAD = r"[A-Z][a-z0-9'&.-]*[A-Z][A-Za-z0-9'&.-]*\s+(?:19|20)[0-9]{2}\b\s*"
_WRAP = rf"^(?:(?i:{_PREFIX})|{_LEAD}|-\s*|(?:19|20)[0-9]{{2}}(?:\s*[-/]\s*(?:19|20)?[0-9]{{2}})?\s+|[0-9]{{1,3}}(?i:st|nd|rd|th)\s+)+"


def strip_wrappers(x: str) -> str:
    return f"trim({sub(f'trim({x})', _WRAP)})"


_NUMS = [r"[\s,;:]+$", r"[\s,]+\(?[0-9]+[0-9\s\-/]*\)?$", r"[\s,]+\(\s*[0-9]+[^()]*\)$", r"(?i)[\s,]+(?:vol|volume|no|issue|pp|p)\.?\s*[0-9]+.*$"]


def strip_trailing_numerics(x: str, passes: int = 16) -> str:
    """More passes than any sample has pieces."""
    out = f"trim({x})"
    for _ in range(passes):
        for rule in _NUMS:
            out = sub(out, rule)
        out = f"trim({out})"
    return out


def drop_parenthesis(x: str) -> str:
    return sub(x, r"\s*\([^()]*\)\s*$")


def has(x: str, ws: str) -> str:
    return f"regexp_matches({x}, {q(rf'(?i)\b(?:{ws})\b')})"


def classify(x: str) -> str:
    pre = r"arxiv|biorxiv|medrxiv|chemrxiv|ssrn|preprint|techrxiv|research\s*square|working\s+paper"
    thesis = f"({has(x, r'''phd\s+thesis|master'?s?\s+thesis|dissertation''')} OR regexp_matches({x}, '学位论文|博士论文|硕士论文'))"
    return f"CASE WHEN trim({x}) = '' THEN 'empty' WHEN {has(x, pre)} THEN 'preprint' WHEN {thesis} THEN 'thesis' WHEN {has(x, 'patent')} OR regexp_matches({x}, '专利') THEN 'patent' ELSE 'normal' END"


def preprint_source(x: str) -> str:
    names = {"research": r"research\s*square", "working": r"working\s+paper"}
    return "CASE " + " ".join(f"WHEN {has(x, next((v for k, v in names.items() if w.startswith(k)), w))} THEN {q(n)}" for w, n in SERVERS) + " ELSE '预印本' END"


def truncated(x: str) -> str:
    return rf"regexp_matches({x}, '…|\.\.\.')"


def strip_year(x: str) -> str:
    no_year = sub(x, r",?\s*(?:19|20)[0-9]{2}\s*$")
    return f"trim({sub(no_year, '[' + _S + r',]+$')})"


def candidates(raws: str) -> str:
    """CTEs cand (raw, kind, truncated), names (raw, pos, name), acronyms (raw, pos, abbr) over a relation with column raw."""
    clean = f"trim({sub(sub('raw', r'…|\.\.\.'), r'\s+', ' ')})"
    tidy = f"trim({sub('trim(v)', r'[\s,;:.\-]+$')})"
    acr = r"[A-Za-z][A-Za-z0-9'&-]{1,11}"
    is_acr = "regexp_matches(a, '^[A-Z]') AND regexp_matches(a, '[A-Z][^A-Z]*[A-Z]')"
    lead = rf"^([A-Za-z][A-Za-z0-9''&.-]{{1,13}})\s+(?:19|20)[0-9]{{2}}\b"
    return f"""
cand AS (SELECT DISTINCT raw, {classify('raw')} AS kind, {truncated('raw')} AS truncated, {clean} AS clean FROM {raws}),
parted AS (SELECT raw, list_filter(list_transform(string_split(clean, ','), lambda p: trim(p)), lambda p: p <> '') AS ps FROM cand WHERE kind = 'normal'),
prefixes AS (SELECT raw, len(ps) - n AS a, array_to_string(ps[1:n], ', ') AS prefix FROM (SELECT raw, ps, unnest(range(1, len(ps) + 1)) AS n FROM parted)),
bases AS (SELECT raw, a, 0 AS b, {strip_trailing_numerics('prefix')} AS base FROM prefixes UNION ALL SELECT raw, a, 1, prefix FROM prefixes),
variants AS (
  SELECT raw, a, b, 0 AS c, base AS v FROM bases WHERE base <> '' UNION ALL SELECT raw, a, b, 1, {drop_parenthesis('base')} FROM bases WHERE base <> ''
  UNION ALL SELECT raw, a, b, 2, {strip_wrappers('base')} FROM bases WHERE base <> '' UNION ALL SELECT raw, a, b, 3, {drop_parenthesis(strip_wrappers('base'))} FROM bases WHERE base <> ''),
named AS (SELECT raw, name, min(a * 8 + b * 4 + c) AS o FROM (SELECT raw, a, b, c, {tidy} AS name FROM variants) WHERE length(name) >= 3 GROUP BY raw, name),
names AS (SELECT raw, row_number() OVER (PARTITION BY raw ORDER BY o) - 1 AS pos, name, {normalize_name('name')} AS key FROM named),
bracketed AS (SELECT raw, u.a AS a, u.i AS i FROM (SELECT raw, regexp_extract_all(clean, '\\(({acr.replace("'", "''")})\\)', 1) AS l FROM cand WHERE kind = 'normal'), LATERAL (SELECT unnest(l) AS a, generate_subscripts(l, 1) AS i) u),
acr AS (
  SELECT raw, 0 AS g, i, upper(a) AS abbr FROM bracketed WHERE {is_acr}
  UNION ALL SELECT raw, 1, 0, upper(a) FROM (SELECT raw, regexp_extract(clean, '{lead}', 1) AS a FROM cand WHERE kind = 'normal') WHERE {is_acr}
  UNION ALL SELECT raw, 2, 0, upper(ps[1]) FROM parted WHERE regexp_matches(ps[1], '^{acr.replace("'", "''")}$')),
acronyms AS (SELECT raw, row_number() OVER (PARTITION BY raw ORDER BY o) - 1 AS pos, abbr FROM (SELECT raw, abbr, min(g * 1000 + i) AS o FROM acr WHERE length(abbr) BETWEEN 2 AND 12 GROUP BY raw, abbr))"""


def index() -> str:
    """CTEs entries, aliases, targets, keys, abbrs, tokens, journals over the seed."""
    jr = [(n, c, z, t, i, qu, w, e) for _, n, _, c, z, t, i, qu, e, w in JOURNALS]
    contain = "CASE WHEN least(len(x), len(y)) = 0 THEN -1 ELSE len(list_intersect(x, y)) / CAST(least(len(x), len(y)) AS DOUBLE) END"
    return f"""
entries AS (SELECT * FROM {values(entry_rows(), 'catalog, ord, abbr, name, rank, type, source, field, url', 'e')}),
aliases AS (SELECT * FROM {values(alias_rows(), 'kind, ord, src, target', 'a')}),
wanted AS (
  SELECT kind, ord AS alias_ord, src, target, 'ccf' AS catalog, upper(target) AS abbr FROM aliases WHERE kind IN ('names', 'acronyms')
  UNION ALL SELECT a.kind, a.ord, a.src, a.target, 'core', upper(coalesce(m.target, a.target)) FROM aliases a LEFT JOIN aliases m ON m.kind = 'ccf_to_core' AND m.src = a.target WHERE a.kind IN ('names', 'acronyms')
  UNION ALL SELECT kind, ord, src, target, 'core', upper(target) FROM aliases WHERE kind = 'core_names'),
scored AS (
  SELECT w.kind, w.catalog, w.alias_ord, w.src, w.target, e.ord, CASE WHEN w.kind = 'names' THEN {contain.replace('x', 'w.ts').replace('y', 'list_distinct(e.ts)')} ELSE 0 END AS s
  FROM (SELECT *, list_distinct({tokens_of('src')}) AS ts FROM wanted) w LEFT JOIN (SELECT *, {tokens_of('name')} AS ts FROM entries) e ON e.catalog = w.catalog AND upper(e.abbr) = w.abbr AND e.abbr <> ''),
targets AS (SELECT kind, catalog, alias_ord, src, target, ord FROM (SELECT *, row_number() OVER (PARTITION BY kind, catalog, alias_ord ORDER BY s DESC, ord) AS r FROM scored) WHERE r = 1),
spelt AS (
  SELECT catalog, ord, 0 AS step, name AS s FROM entries UNION ALL SELECT catalog, ord, 1, {drop_parenthesis('name')} FROM entries UNION ALL SELECT catalog, ord, 2, abbr FROM entries),
key_rows AS (
  SELECT catalog, {normalize_name('s')} AS key, ord, 2 AS p, ord AS a, step AS b FROM spelt
  UNION ALL SELECT catalog, {normalize_name('src')}, ord, CASE kind WHEN 'names' THEN 1 ELSE 0 END, -alias_ord, 0 FROM targets WHERE ord IS NOT NULL AND kind <> 'acronyms'),
keys AS (SELECT catalog, key, ord FROM (SELECT *, row_number() OVER (PARTITION BY catalog, key ORDER BY p, a, b) AS r FROM key_rows WHERE key <> '' AND (p < 2 OR length(key) >= 4)) WHERE r = 1),
own_abbrs AS (SELECT catalog, upper(abbr) AS abbr, min(ord) AS ord FROM entries WHERE abbr <> '' GROUP BY 1, 2),
abbrs AS (SELECT * FROM own_abbrs UNION ALL SELECT catalog, upper(src), ord FROM targets t WHERE kind = 'acronyms' AND ord IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own_abbrs o WHERE o.catalog = t.catalog AND o.abbr = upper(t.src))),
tokens AS (SELECT catalog, ord, list_distinct(ts) AS ts FROM (SELECT catalog, ord, {tokens_of('name')} AS ts FROM entries) WHERE len(ts) >= 4),
journals AS (SELECT {normalize_name('n')} AS key, * FROM {values(jr, 'n, cat, zone, top, impact, quartile, warn, ei', 'j')}),
all_keys AS (SELECT catalog, key, CAST(ord AS VARCHAR) AS ref FROM keys UNION ALL SELECT 'journal', key, key FROM journals)"""


def matching() -> str:
    """CTEs t1 to t4 and best (raw, catalog, ref, tier, score, pos, via)."""
    return f"""
t1 AS (SELECT n.raw, k.catalog, k.ref, 1 AS tier, 1.0::DOUBLE AS score, n.pos, '全称精确匹配' AS via FROM names n JOIN all_keys k ON n.key = k.key WHERE length(n.key) >= 5),
t2 AS (SELECT a.raw, b.catalog, CAST(b.ord AS VARCHAR) AS ref, 2 AS tier, 1.0::DOUBLE AS score, a.pos, '简称 ' || a.abbr AS via FROM acronyms a JOIN abbrs b ON a.abbr = b.abbr),
t3 AS (SELECT n.raw, k.catalog, min(k.ref) AS ref, 3 AS tier, 1.0::DOUBLE AS score, n.pos, '截断前缀匹配' AS via FROM names n JOIN cand c ON c.raw = n.raw AND c.truncated JOIN all_keys k ON length(n.key) >= 14 AND length(k.key) > length(n.key) AND starts_with(k.key, n.key) GROUP BY n.raw, k.catalog, n.pos HAVING count(DISTINCT k.ref) = 1),
t123 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
fuzzy AS (SELECT n.raw, k.catalog, CAST(k.ord AS VARCHAR) AS ref, len(list_intersect(n.ts, k.ts)) / CAST(least(len(n.ts), len(k.ts)) AS DOUBLE) AS score, n.pos
  FROM (SELECT raw, pos, list_distinct({tokens_of('name')}) AS ts FROM names WHERE pos < 6) n, tokens k
  WHERE len(n.ts) >= 4 AND NOT EXISTS (SELECT 1 FROM t123 t WHERE t.raw = n.raw AND t.catalog = k.catalog)),
t4 AS (SELECT raw, catalog, ref, 4 AS tier, score, pos, '全称模糊匹配' AS via FROM fuzzy WHERE score >= 0.85),
best AS (SELECT raw, catalog, ref, tier, score, pos, via FROM (SELECT *, row_number() OVER (PARTITION BY raw, catalog ORDER BY tier, score DESC, pos, CASE WHEN catalog = 'journal' THEN 0 ELSE TRY_CAST(ref AS INT) END, ref) AS r FROM (SELECT * FROM t123 UNION ALL SELECT * FROM t4)) WHERE r = 1)"""


def tags() -> str:
    """CTEs members and tagged (raw, tag_ord)."""
    rows = [(o, kind, v.upper() if kind != "name" else v) for o, _, _, _, _, ccf, core, names in TAGS for kind, vs in (("ccf", ccf), ("core", core), ("name", names)) for v in vs]
    return f"""
members AS (SELECT DISTINCT tag_ord, kind, CASE WHEN kind = 'name' THEN {normalize_name('v')} ELSE v END AS value FROM {values(rows, 'tag_ord, kind, v', 'm')}),
tagged AS (SELECT DISTINCT raw, tag_ord FROM (SELECT b.raw, b.catalog AS kind, upper(e.abbr) AS value FROM best b JOIN entries e ON e.catalog = b.catalog AND CAST(e.ord AS VARCHAR) = b.ref UNION ALL SELECT raw, 'name', key FROM names) JOIN members USING (kind, value))"""
