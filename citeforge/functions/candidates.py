"""Ordered candidate names and acronyms of a venue string, as SQL text."""

from __future__ import annotations

from .text import LEAD, S, WS, classify, drop_parenthesis, is_acronym, pat, preprint_source, squeeze, strip_trailing_numerics, strip_wrappers, strip_year, sub, text, trim, truncated

_ACRONYM = r"[A-Za-z][A-Za-z0-9\x27&-]{1,11}"


def let(value: str, var: str, body: str) -> str:
    """body with var bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def clean_text(x: str) -> str:
    return squeeze(sub(text(x), r"…|\.\.\."))


def _parts(cleaned: str) -> str:
    return f"filter(transform(split({cleaned}, ','), p -> {trim('p')}), p -> p <> '')"


def candidate_names(x: str) -> str:
    """Names, the most trusted first: comma prefixes from long to short, each bare and unwrapped."""
    prefixes = "transform(if(size(ps) > 0, sequence(size(ps), 1, -1), array()), n -> array_join(slice(ps, 1, n), ', '))"
    variants = let(strip_wrappers("b"), "u", f"array(b, {drop_parenthesis('b')}, u, {drop_parenthesis('u')})")
    of_prefix = f"flatten(transform(filter(array({strip_trailing_numerics('p')}, p), b -> b <> ''), b -> {variants}))"
    tidy = trim(sub(trim("v"), rf"[{WS},;:.\-]+\z"))
    names = f"array_distinct(filter(transform(flatten(transform({prefixes}, p -> {of_prefix})), v -> {tidy}), v -> length(v) >= 3))"
    return let(_parts(clean_text(x)), "ps", names)


def candidate_acronyms(x: str) -> str:
    """Acronyms in upper case: those in parentheses, the leading one with a year, the first part if it is a single word."""
    bracketed = f"filter(regexp_extract_all(c, {pat(rf'\(({_ACRONYM})\)')}, 1), a -> {is_acronym('a')})"
    lead = f"array(regexp_extract(c, {pat(rf'^(?=(?:{LEAD}))([A-Za-z][A-Za-z0-9\x27&.-]{{1,13}}){S}')}, 1))"
    first = let(f"coalesce(get({_parts('c')}, 0), '')", "f", f"if(f rlike {pat(rf'^{_ACRONYM}\z')}, array(f), array())")
    found = f"transform(concat({bracketed}, {lead}, {first}), a -> upper(a))"
    return let(clean_text(x), "c", f"array_distinct(filter({found}, a -> length(a) between 2 and 12))")


def venue_candidates(x: str) -> str:
    """struct(kind, truncated, preprint_name, names, acronyms); only kind 'normal' has candidates."""
    none = "cast(array() as array<string>)"
    return let(classify(x), "k", f"named_struct('kind', k, 'truncated', {truncated(x)}, 'preprint_name', if(k = 'preprint', {preprint_source(x)}, null), 'names', if(k = 'normal', {candidate_names(x)}, {none}), 'acronyms', if(k = 'normal', {candidate_acronyms(x)}, {none}))")


_SITE = rf"(?i)^(?:https?://)?[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+(?:/[^{WS}]*)?\z"


def venues_from_byline(x: str) -> str:
    """Candidate venues of 'authors - venue, year - site': the joined body first, then each part."""
    parts = f"filter(transform(split({sub(text(x), r'\u00A0', ' ')}, {pat(f'{S}+-{S}+')}), p -> {trim('p')}), p -> p <> '')"
    body = f"filter(slice(ps, 2, greatest(size(ps) - 1, 0)), p -> not (p rlike {pat(_SITE)}))"
    pushed = f"array_distinct(filter(transform(concat(array(array_join(b, ' - ')), b), v -> {strip_year('v')}), v -> length(v) >= 3))"
    return let(parts, "ps", f"if(size(ps) < 2, cast(array() as array<string>), {let(body, 'b', f'if(size(b) = 0, cast(array() as array<string>), {pushed})')})")

