"""String functions. Each takes SQL text for its argument and returns SQL text.

One definition serves DataFrame code (F.expr), SQL queries and CREATE TEMPORARY FUNCTION, so the
key of a catalog row and the key of a looked-up string can never drift apart. Everything is built
from codegen-friendly or higher-order built-ins; nothing leaves the JVM.

Null counts as the empty string throughout.
"""

from __future__ import annotations

import unicodedata

#: White space of the source strings: wider than Java's \s, without U+0085.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S, NOT_S = f"[{WS}]", f"[^{WS}]"
#: ASCII word boundaries; Java's \b takes CJK letters for word characters.
LB, RB = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Abbreviation and what it stands for.
ABBREV = {
    "trans": "transactions", "tran": "transactions", "j": "journal", "jnl": "journal", "int": "international", "intl": "international",
    "natl": "national", "proc": "proceedings", "conf": "conference", "symp": "symposium", "sci": "science", "tech": "technology",
    "technol": "technology", "comput": "computer", "eng": "engineering", "res": "research", "lett": "letters", "rev": "review",
    "appl": "applied", "ann": "annals", "arch": "archives", "bull": "bulletin", "med": "medicine", "biol": "biology", "chem": "chemistry",
    "phys": "physics", "math": "mathematics", "syst": "systems", "sys": "systems", "mag": "magazine", "assoc": "association",
}
#: Words without weight in a name.
STOPWORDS = ("the", "of", "a", "an", "and", "for", "on", "in")


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pat(p: str) -> str:
    """A regex as a raw SQL literal."""
    if '"' in p:
        raise ValueError("write a double quote as \\x22")
    return f'r"{p}"'


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {pat(pattern)}, {lit(by)})"


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def trim(x: str) -> str:
    return sub(x, rf"^{S}+|{S}+\z")


def squeeze(x: str) -> str:
    """White space runs to one blank, ends trimmed."""
    return f"trim({sub(x, f'{S}+', ' ')})"


def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without marks: all of the Latin and sign ranges, and every character whose form holds ASCII letters or digits.

    What is left out (Arabic and Hangul forms and the like) folds to other letters than ASCII, so no key can tell.
    """
    one, many = {}, {}
    near = {p for first, last in ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)) for p in range(first, last + 1)}
    for point in range(0xA0, 0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if d != c and d and (point in near or any(x.isascii() and x.isalnum() for x in d)):
            (one if len(d) == 1 else many)[c] = d
    for points, to in ((range(0x2018, 0x201C), "'"), (range(0x201C, 0x2020), '"'), ([*range(0x2010, 0x2016), 0x2212], "-")):
        one.update(dict.fromkeys(map(chr, points), to))
    marks = "".join(map(chr, range(0x300, 0x370)))  # no counterpart: dropped
    return "".join(one) + marks, "".join(one.values()), many


_FROM, _TO, _MANY = _folding()


def deburr(x: str) -> str:
    """Accents, compatibility forms, curly quotes and dashes to plain characters."""
    forms = "map(" + ", ".join(f"{lit(c)}, {lit(d)}" for c, d in _MANY.items()) + ")"
    spelt = f"array_join(transform(split({x}, ''), c -> coalesce(try_element_at({forms}, c), c)), '')"
    # hardly a text holds one; a translation looks each character up in a hash table, a class of them would be tried one by one
    full = f"if(translate({x}, {lit(''.join(_MANY))}, '') <> {x}, {spelt}, {x})"
    return f"if({x} rlike {pat('[^ -~]')}, translate({full}, {lit(_FROM)}, {lit(_TO)}), {x})"


def _words(x: str) -> str:
    plain = f"replace(lower({deburr(text(x))}), '&', ' and ')"
    return f"split(trim({sub(plain, '[^a-z0-9]+', ' ')}), ' ')"


def _no_stops(words: str) -> str:
    return f"filter({words}, t -> t <> '' and t not in ({', '.join(map(lit, STOPWORDS))}))"


def normalize_name(x: str) -> str:
    """The key of a name: plain lower-case words, abbreviations spelt out, weightless words gone, run together."""
    table = "map(" + ", ".join(f"{lit(a)}, {lit(b)}" for a, b in ABBREV.items()) + ")"
    full = f"transform({_words(x)}, t -> coalesce(try_element_at({table}, t), t))"
    return f"array_join({_no_stops(full)}, '')"


def tokens_of(x: str) -> str:
    """Words of a name without weightless ones; abbreviations stay as they are."""
    return _no_stops(_words(x))


_PREFIX = rf"in{S}+(?:proceedings{S}+of{S}+the{S}+)?|proceedings{S}+(?:of{S}+(?:the{S}+)?)?|proc\.?{S}+of{S}+(?:the{S}+)?|the{S}+"
#: An acronym (two capitals) with a year.
LEAD = rf"(?-i:(?=[A-Z][a-z0-9\x27&.-]*[A-Z]))[A-Za-z][A-Za-z0-9\x27&.-]{{1,13}}{S}+(?:19|20)[0-9]{{2}}{RB}{S}*"
_YEAR = rf"(?:19|20)[0-9]{{2}}(?:{S}*[-/]{S}*(?:19|20)?[0-9]{{2}})?{S}+"
_WRAPPER = rf"(?i)^(?:{_PREFIX}|{LEAD}|-{S}*|{_YEAR}|[0-9]{{1,3}}(?:st|nd|rd|th){S}+)++"


def strip_wrappers(x: str) -> str:
    """Leading 'Proceedings of the', acronym with year, year, dash and ordinal go, however many stand in a row."""
    return trim(sub(trim(text(x)), _WRAPPER))


#: What a pass takes off the end, in this order: marks, numbers, a parenthesis that begins with one, a labelled number.
_NUMERICS = [rf"[{WS},;:]+\z", rf"[{WS},]+\(?[0-9]+[0-9{WS}\-/]*\)?\z", rf"[{WS},]+\({S}*[0-9]+[^()]*\)\z", rf"(?i)[{WS},]+(?:vol|volume|no|issue|pp|p)\.?{S}*[0-9]+[^\n]*\z"]


def strip_trailing_numerics(x: str) -> str:
    """Trailing volume, issue and pages go, until nothing changes: a pass that changes something takes a separator, so there are no more passes than those."""
    once = "s"
    for rule in _NUMERICS:
        once = sub(once, rule)
    passes = f"sequence(0, regexp_count({text(x)}, {pat(f'[{WS},;:]+')}))"
    return f"aggregate({passes}, {trim(text(x))}, (s, i) -> {trim(once)})"


def drop_parenthesis(x: str) -> str:
    return sub(x, rf"{S}*\([^()]*\){S}*\z")


def strip_year(x: str) -> str:
    return trim(sub(sub(x, rf",?{S}*(?:19|20)[0-9]{{2}}{S}*\z"), rf"[{WS},]+\z"))


def is_acronym(x: str) -> str:
    return f"({x} rlike '^[A-Z]' and {x} rlike '[A-Z][^A-Z]*[A-Z]')"


def truncated(x: str) -> str:
    return f"({text(x)} rlike {pat(r'…|\.{3}')})"


def _has(x: str, words: str) -> str:
    return f"{x} rlike {pat(f'(?i){LB}(?:{words}){RB}')}"


#: Words of a preprint, and the servers in the order they are tried.
PREPRINT = rf"arxiv|biorxiv|medrxiv|chemrxiv|ssrn|preprint|techrxiv|research{S}*square|working{S}+paper"
SERVERS = [("biorxiv", "bioRxiv"), ("medrxiv", "medRxiv"), ("chemrxiv", "ChemRxiv"), ("techrxiv", "TechRxiv"), ("arxiv", "arXiv"), ("ssrn", "SSRN"), (rf"research{S}*square", "Research Square"), ("osf", "OSF Preprints"), (rf"working{S}+paper", "工作论文")]
NO_SERVER = "预印本"


def preprint_source(x: str) -> str:
    whens = " ".join(f"when {_has(text(x), w)} then {lit(n)}" for w, n in SERVERS)
    return f"case {whens} else {lit(NO_SERVER)} end"


def classify(x: str) -> str:
    """empty, preprint, thesis, patent or normal; the first that holds."""
    t = text(x)
    thesis = f"({_has(t, rf'phd{S}+thesis|master\x27?s?{S}+thesis|dissertation')} or {t} rlike '学位论文|博士论文|硕士论文')"
    patent = f"({_has(t, 'patent')} or {t} rlike '专利')"
    return f"case when {trim(t)} = '' then 'empty' when {_has(t, PREPRINT)} then 'preprint' when {thesis} then 'thesis' when {patent} then 'patent' else 'normal' end"


def decode_entities(x: str) -> str:
    """Tags out, entities decoded in this order (so a doubly escaped one decodes twice), white space squeezed."""
    out = sub(text(x), "<[^>]+>")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return squeeze(out)


def chinese_tail(x: str) -> str:
    """Trailing run that begins with a CJK character."""
    return f"regexp_extract({trim(text(x))}, {pat(r'([一-龥][一-龥A-Za-z0-9：:·\-（）()]*)\z')}, 1)"


def clean_issn(x: str) -> str:
    v = f"upper({trim(text(x))})"
    return f"if({v} rlike {pat(r'^[0-9]{4}-[0-9]{3}[0-9X]\z')}, {v}, '')"


def rank_text(x: str) -> str:
    """Free-text rank to one of nine."""
    s = squeeze(text(x))
    whens = " ".join(f"when {s} rlike {pat(f'(?i)^{p}')} then {r}" for p, r in ((r"a\*\z", "'A*'"), (r"a\z", "'A'"), (r"b\z", "'B'"), (r"c\z", "'C'"), (r"australasian *[abc]\z", f"concat('Australasian ', upper(right({s}, 1)))"), ("national", "'National'"), ("regional", "'Regional'"), ("(?:unranked|journal published|multiconference)", "'Unranked'")))
    return f"case {whens} else 'Other' end"


def zone_of(x: str) -> str:
    """Leading 1 to 4 as int, else 0."""
    return f"coalesce(try_cast(regexp_extract({text(x)}, {pat(rf'^{S}*([1-4]){RB}')}, 1) as int), 0)"


def leading_number(x: str) -> str:
    """The number a text begins with, as double; null if none."""
    return f"try_cast(regexp_extract({text(x)}, {pat(rf'^{S}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)')}, 1) as double)"


def number_text(x: str) -> str:
    """A double without a trailing .0."""
    return f"regexp_replace(cast({x} as string), {pat(r'\.0\z')}, '')"


def containment(a: str, b: str) -> str:
    """Share of the smaller token set that the other holds; null if one is empty. a, b: SQL arrays."""
    return f"try_divide(cast(size(array_intersect({a}, {b})) as double), least(size(array_distinct({a})), size(array_distinct({b}))))"


def font_size(scale: str) -> str:
    """Badge font size in px, or null where the scale is missing or 100."""
    return f"case when {scale} is not null and {scale} not in (0, 100) then concat(format_number(11 * {scale} / 100, '0.0'), 'px') end"


#: Themes that can be chosen; the first is the default.
THEMES = ("soft", "outline", "solid", "minimal", "square", "mono")


def theme_class(x: str) -> str:
    return f"concat('sr-theme-', if({x} in ({', '.join(map(lit, THEMES))}), {x}, {lit(THEMES[0])}))"


#: Hosts of the result pages.
HOSTS = (
    "scholar.google.com", "scholar.google.com.hk", "scholar.google.com.tw", "scholar.google.com.sg", "scholar.google.com.au", "scholar.google.com.br", "scholar.google.co.uk", "scholar.google.co.jp",
    "scholar.google.co.kr", "scholar.google.co.in", "scholar.google.ca", "scholar.google.de", "scholar.google.fr", "scholar.google.it", "scholar.google.es", "scholar.google.nl", "scholar.google.ru",
    "scholar.google.ch", "scholar.google.se", "scholar.google.pl", "scholar.google.cn", "xueshu.lanfanshu.cn", "scholar.lanfanshu.cn", "sc.panda985.com",
)


def host_allowed(url: str, hosts: tuple[str, ...] = HOSTS) -> str:
    """Whether the url is an https page of one of the hosts; '*.name' allows the name and all hosts under it."""
    host = f"lower(try_parse_url({url}, 'HOST'))"
    whole = [h.lower() for h in hosts if not h.startswith("*.")]
    under = [h[2:].lower() for h in hosts if h.startswith("*.")]
    tests = ([f"{host} in ({', '.join(map(lit, whole))})"] if whole else []) + [f"({host} = {lit(h)} or endswith({host}, {lit('.' + h)}))" for h in under]
    return f"coalesce(try_parse_url({url}, 'PROTOCOL') = 'https' and ({' or '.join(tests)}), false)"


def megabytes(n_bytes: str) -> str:
    """A size in bytes as text with two decimals, in MB."""
    return f"concat(format_number({n_bytes} / 1048576, '0.00'), ' MB')"
