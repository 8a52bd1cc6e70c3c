"""Personal data: exact patterns, and a linear-chain CRF over word shapes for what they miss.

Base kinds (email, ip, card, phone) are found by scans that equal the leftmost non-overlapping
matches of their patterns and are linear in the length of any text. The CRF labels words by
features of their shape and of their neighbours; it is trained on a small labelled table (training_table)
by gradient ascent on the exact log-likelihood, once on the driver, and broadcast. It adds spans of kinds
of its own: secret (keys, tokens, passwords), id (national and account numbers), contact (addresses
written out with at and dot) and person (names after a title or a label, or a given name with what follows it).

Every word of every text is decoded: the labels are the Viterbi path of the whole text. Words at which
each best path is provably O (see Crf.open_words) cut the chain exactly, so the position-by-position step
runs in numpy over many short chains, and memory stays bounded for a text of any length.

Null text counts as empty: no spans; an empty table gives no row. Repeated rows give repeated rows. Columns
besides doc_id and text are not read unless carried, and a carried one keeps its values as carry_<name>.
Equal paths: the lower state wins (O first). Spans are in code points, end exclusive; a CRF span that
touches a base span is dropped, base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
CRF_KINDS = ("contact", "id", "person", "secret")
KINDS = BASE_KINDS + CRF_KINDS
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit after a digit never begins the leftmost match, so the look-behind only saves rescans
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern, each @ looked at once."""
    found, free, at = [], 0, text.find("@")
    last = -1
    while at >= 0:
        part = text[max(free, last + 1) : at]
        local = len(part) - len(part.rstrip(_LOCAL))
        if local and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", at - local, m.end()))
            free = m.end()
        last, at = at, text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start."""
    found = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


#: Common given names.
GIVEN = frozenset("""
Aisha Alice Amanda Andrea Andrew Angela Anna Anthony Antonio Barbara Benjamin Brian Carlos Carmen Catherine Charles
Charlotte Christian Christine Claudia Daniel David Deborah Diego Dorothy Edward Elena Elizabeth Emily Emma Eric Fatima
Fernando Francesco Frank Franz Gabriel George Giulia Greta Hannah Heather Heinrich Helen Henry Ibrahim Ingrid Isabella
Ivan Jack Jacob James Jane Jason Javier Jean Jennifer Jessica Joanna Johann John Jonathan Jorge Joseph Joshua Juan Julia
Karen Katarina Katherine Kenji Kevin Klaus Laura Lars Leila Linda Lisa Louis Lucia Luis Manuel Marco Margaret Maria
Marie Mark Martin Mary Matthew Mehmet Michael Michelle Miguel Mohammed Monica Natalie Nathan Nicole Nikolai Noah Olga
Oliver Olivia Omar Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Priya Rachel Rafael Rebecca Ricardo Richard
Robert Rosa Ruth Ryan Samuel Sandra Sarah Scott Sebastian Sergei Sofia Sophie Stefan Stephanie Stephen Steven Susan
Svetlana Teresa Thomas Timothy Ursula Victoria Vincent Virginia Walter William Yuki Yusuf Zoe
""".split())
#: Words that announce what follows.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "key"),
    "id": ("ssn", "iban", "passport", "security"),
    "person": ("mr", "mrs", "ms", "dr", "prof", "name", "herr", "frau", "mme", "monsieur", "señor", "señora"),
    "at": ("at", "[at]", "(at)"),
    "dot": ("dot", "[dot]", "(dot)"),
}
#: Words that stand in running text and in no address.
LINKERS = frozenset("the a an this that it is was and of in on by to der die das und la le el de que et y".split())
#: Ends of host names.
TLDS = frozenset("com org net edu gov info io eu de fr es uk".split())
#: How issued keys begin.
_KEYLIKE = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|[rs]k_live_|xox[abp]-|eyJ)[\w.-]{12,}")
_SSN, _IBAN, _IBAN_HEAD = re.compile(r"\d{3}-\d\d-\d{4}"), re.compile(r"[A-Z]{2}\d\d[A-Z0-9]{10,30}"), re.compile(r"[A-Z]{2}\d\d")
_CUE = {w: i for i, ws in enumerate(CUES.values(), 1) for w in ws}
_AT, _DOT = _CUE["at"], _CUE["dot"]
_EDGE = "\"'`.,;:!?()[]{}<>|#*$%&="
_WORD, _BLANK = re.compile(r"\S+"), re.compile(r"\s")
STATES = ("O", *[f"{p}-{k}" for k in CRF_KINDS for p in "BI"])
NONE, CAP, INITIAL, LOW, UPPER, NUM, HEX, MIXED, OTHER, OUTSIDE = range(10)
N_KINDS, N_SAID = 10, 3 * (len(CUES) + 1)
#: Numbers of values of the features that look at neighbours, in the order of Crf.context.
SIZES = (N_SAID * N_KINDS, 3 * N_SAID * N_KINDS, N_KINDS * N_KINDS, 4 * N_KINDS, 4 * N_KINDS, 12, 4 * N_KINDS, 2 * (len(CUES) + 1) * N_KINDS)
OFFSETS = np.cumsum((0, *SIZES))
EPOCHS, RATE, DECAY = 150, 0.5, 0.02
#: Words looked at in one numpy step, words with padding decoded at a time, distinct words remembered, characters split at a time.
BLOCK, MOST_CELLS, CACHE, PIECE = 1 << 16, 100_000, 200_000, 1 << 20

#: Lines of the training table. {P} a full name with a given name, {Q} any name, {S} a key, {W} a password, {N} a national
#: number, {I} and {J} an account number in one and in several words, {X} a passport number, {C} an address written out.
LINES = """
set token = "{S}" in the file
token = "{S}" was left
TOKEN = "{S}" !! AND THE REST
api_key = "{S}" is used
the access_key : {S} of them
password: {W} must change
the password is {W} so change it
passwd = "{W}" in config
my pwd: {W} works
the secret = {S} was found
apikey: {S} here
private key: {S} kept
they left {S} in the log
export AWS {S} for the build
found {S} on the page
clone it with {S} as user
{S} is what they sent
ssn {N} on file
SSN: {N} and more
his social security number {N} was sold
a form with {N} on it
{N} belongs to the client
rows of {N} and {N} in the sheet
iban {I} of the firm
IBAN: {I} please
{I} was charged twice
{I} was paid
from {I} to {I}
pay to {I} by noon
iban: {J} please
send it to {J} today
{J} is the account
passport no {X} was lost
passport number: {X} issued
write to {C} today
mail {C} for it
reach {C} now
{C} is where to ask
contact {C} please.
Mr. {Q} came and left
by Dr. {Q} of the firm
by Dr {P} of the firm
Mrs. {P} said so
and Prof {Q} came
Frau {P} war hier
name: {Q} born here
Name: {P} and others
name : {P} born here
my name is {P} and I live here
her name was {Q} then
Yesterday {P} from Lisbon signed the contract
{P} was born in a village
The letter that {P} wrote to {P} was found.
a talk by {P}, who left in May
It was {P} again.
gestern kam {P} in die Stadt
ayer {P} firmó el contrato
hier {P} a signé le contrat
ask {P} or {P}
"""
#: Lines without any, each as it stands.
PLAIN = """
a token is a word and a key is a thing
the password is long and was changed in 2019 by them
the password is wrong again
the api version = 12 was set
a secret that was kept and the token of love
the key to the house and the key of C minor
security was tight and the passport was old
on 2019-05-11 20 people came and 35 left
version 1.2.3 of 12-10-2020 has 4500 lines
pages 120-145 and 12-15 of volume 7
look at the dot on the map
he was at home and at work
met at noon by the dot
love was at the dot in 2019
he sat at the dot of the map
look at that dot on it
point at a dot and go
she looked at one dot after another
it is at its end dot by dot
the dr. said that mr. is a title
The Firm and The House of Lords
name of the thing is long
the name is known and the name was lost
call 4785380592391139 or 12 lines of 300
from 192.168.1.1 to 10.0.0.1 in 5 steps
it has 1500 parts | 20 rows | 7 keys
word123 and abc9 are codes of x2 and y77
sum = 40 and rate = 0.75 hold
In 2019 1200 cars and 3400 bikes were sold
room AB12 has 1200 seats and 30 rows
the A320 and the B747 flew over D12
flight LH12 left at 1030 from gate 4
The United Nations met in New York on Monday
The University of North Carolina and the Bank of England
We went to Paris, Rome and Madrid in June.
Der Hund und die Katze schlafen im Garten hinter dem Haus
Die Stadt an der Elbe hat eine neue Brücke und einen Hafen
Im Winter liegt Schnee auf den Bergen. Der Weg ist lang.
La casa de la colina tiene un jardín y una puerta roja
El niño que vino de Madrid trae los libros
Le chat de la maison dort dans le jardin avec les enfants
Les rues de Paris et les ponts sur la Seine
THE QUICK FOX RAN OVER THE HILL AND THE RIVER
THIS IS A TITLE IN CAPITALS !! WITH SIGNS !!
the and of to in is was that for with on by
river stone house water light garden window morning letter
the quick fox ran over the hill and then it slept for a while
Maria went home. Then Peter came too.
We saw David and Laura at the station.
Maria and Peter are here
Yesterday Anna was ill
the St. James park and the King James version
visit http://example.com/a/b or www.example.org for more
see https://example.com/index?id=12&k=9 and follow
def f(x): return x + 1 if x else None
for i in range(10): total += a[i] * 2
a = b + c ; d = e - f
{"id": 12, "value": 3.5, "rows": [1, 2]}
<p> text of a page </p> and <b> more </b>
* item one * item two # heading
10% of 2,500 is 250 and $40 is more than $30
the size is 1024x768 or 640x480 at 60Hz
born 12.05.1980 and left 3/4/2001
write to a.person@mail5.example.com or first.last.99@mail2.example.org for it
tel 555 1234 or 030 12345
ISBN 978-3-16-148410-0 and DOI 10.1000/182
mp3 and mp4 files, h264 video, utf8 text
v2.0.1-beta3 of lib32 for x86_64
"""
SURNAMES = "Gonzalez Miller Smith Schneider Dubois Rossi Novak Tanaka Okafor Silva Larsen Kowalski Haddad Brown Weber Moreau Ortiz Petrov Yilmaz Chen".split()
OTHERS = "Zorina Malek Bram Tilda Doe Major Carla Young Oskar Wren Ilse Thorn".split()


def _draw(r: random.Random, slot: str) -> list[str]:
    """Words for a slot."""
    some = lambda chars, a, b=0: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes = digits + "abcdef"
    if slot == "P":
        middle = r.choice([[], [], [], [r.choice(upper) + "."], [r.choice(SURNAMES)]])
        return [r.choice(sorted(GIVEN)), *middle, r.choice(SURNAMES)]
    if slot == "Q":
        return [r.choice(OTHERS + SURNAMES) for _ in range(r.choice((1, 2)))]
    if slot == "S":
        return [r.choice([
            some(hexes, 32), some(hexes, 40), some(hexes.upper(), 40), some(hexes, 64), "AKIA" + some(upper + digits, 16), "ghp_" + some(lower + upper + digits, 36),
            "sk-" + some(lower + upper + digits, 24, 40), "eyJ" + some(lower + upper + digits, 40), "A1b" + some(lower + upper + digits, 21, 37), "k9Z" + some(lower + upper + digits, 21, 37),
        ])]
    if slot == "W":
        return [r.choice([some(lower, 5, 7) + some(digits, 1, 3) + some(lower, 1), "Tr0ub" + some(digits, 1) + "dor" + some(digits, 2), some(lower, 4) + some(digits, 4), some(hexes, 8, 24)])]
    if slot == "N":
        return [f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}" + r.choice(["", "", ",", "."])]
    if slot == "I":
        return [some(upper, 2) + some(digits, 2) + r.choice([some(digits, 18), some(upper, 4) + some(digits, 14), some(digits, 10) + some(upper + digits, 9)])]
    if slot == "J":
        return [some(upper, 2) + some(digits, 2), *[r.choice([some(digits, 4), some(digits, 4), some(upper, 4)]) for _ in range(r.randint(3, 5))], *r.choice([[], [some(digits, 2)], [some(digits, 2)], [some(digits, 1)]])]
    if slot == "X":
        return [r.choice([some(upper, 1) + some(digits, 7), some(upper, 1) + some(digits, 7) + some(upper, 1), some(upper, 2) + some(digits, 7)])]
    at, dot = r.choice([("at", "dot"), ("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)")])
    return [r.choice(["john", "mary", "bob.k", "anna77", "info", "tomas", "Jane"]), at, r.choice(["example", "mail", "site", "firm", "acme9", "posteo"]), dot, r.choice(["com", "org", "net", "de", "io"])]


def _noise(r: random.Random) -> list[str]:
    """A line without personal data: short sentences of made-up words, at times in capitals, with signs, or one word over and over."""
    word = lambda: "".join(r.choice("an er in th ou le es de ra mo ti lu sch ción é ñ ß".split()) for _ in range(r.randint(1, 4)))
    if r.random() < 0.3:
        return [r.choice([word(), "at", "Key", "it", "es", "de", "com", word().capitalize(), word().capitalize(), word().upper()]) + r.choice(["", "", ".", ","])] * r.choice((5, 12))
    words: list[str] = []
    while len(words) < 14:
        one = [word() for _ in range(r.choice((1, 1, 2, 3, 5)))]
        words += [one[0].capitalize(), *one[1:]]
        words[-1] += r.choice([".", ".", ".", "!", ",", ""])
    style, sign = r.random(), r.choice(["!!", "###", "%%%", "&&&", "***", ""])
    return [x.upper() + sign for x in words] if style < 0.25 else [x + sign for x in words] if style < 0.4 else words


def training_table(draws: int = 6, seed: int = 7, noise: int = 200) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: words and their states, the same at every call. Each line of LINES with `draws` fillings, PLAIN, and noise."""
    r = random.Random(seed)
    kinds = {"P": "person", "Q": "person", "S": "secret", "W": "secret", "N": "id", "I": "id", "J": "id", "X": "id", "C": "contact"}
    plain = [x.split() for x in PLAIN.strip().split("\n")] + [_noise(r) for _ in range(noise)]
    rows = [(x, ["O"] * len(x)) for x in plain]
    for text in LINES.strip().split("\n"):
        for _ in range(draws):
            words, states = [], []
            for w in text.split():
                m = re.search(r"\{(\w)\}", w)
                if m is None:
                    words.append(w)
                    states.append("O")
                    continue
                got = _draw(r, m[1])
                got[0], got[-1] = w[: m.start()] + got[0], got[-1] + w[m.end() :]
                words += got
                states += [f"{'I' if i else 'B'}-{kinds[m[1]]}" for i in range(len(got))]
            rows.append((words, states))
    return rows


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs at most four long."""
    s = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", word[:64])))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)[:10]


_LENGTHS = (4, 8, 12, 16, 20, 32)


def kind_of(core: str) -> int:
    if not core:
        return NONE
    if core.isalpha():
        if core.islower():
            return LOW
        if len(core) == 1:
            return INITIAL if core.isupper() else OTHER
        return CAP if core[0].isupper() and core[1:].islower() else UPPER if core.isupper() else OTHER
    if core.isdigit():
        return NUM
    digits = any(c.isdigit() for c in core)
    if digits and all(c in "0123456789abcdefABCDEF" for c in core):
        return HEX
    return MIXED if digits and any(c.isalpha() for c in core) else OTHER


def describe(word: str) -> tuple:
    """What the model knows of a word: kind, cue with colon, linker, given name, end of a sentence, names of its own features."""
    core, last = word.strip(_EDGE), word[-1]
    kind, low = kind_of(core), core.lower()
    cue = _CUE.get(low if word[:1] not in "[(" else word.lower(), 0)
    colon = 2 if word in ("=", ":") else 1 if last in ":=" else 0
    linker, given = low in LINKERS, core in GIVEN
    own = [f"kind={kind}", f"size={kind},{bisect_right(_LENGTHS, len(core))}", f"cue={cue}"]
    if low in TLDS:
        own.append("tld")
    if linker:
        own.append("linker")
    if given:
        own.append("given")
    if kind in (NUM, HEX, MIXED, OTHER):
        own.append(f"shape={shape(core)}")
        flags = {"ssn": _SSN, "iban": _IBAN, "iban_head": _IBAN_HEAD, "keylike": _KEYLIKE}
        own += [k for k, p in flags.items() if p.fullmatch(core)]
        if kind == MIXED and len(core) >= 16 and core.isalnum() and any(c.islower() for c in core) and any(c.isupper() for c in core):
            own.append("three")
    return kind, 3 * cue + colon, int(linker), int(given), int(last in ".!?"), *own


_OUT = (OUTSIDE, 0, 0, 0, 1)  # what stands before and behind a text


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Crf:
    """Weights by feature and state, and by pair of states. A text is a chain with O before and behind it."""

    def __init__(self, rows: list[tuple[list[str], list[str]]] | None = None, epochs: int = EPOCHS) -> None:
        rows = training_table() if rows is None else rows
        self.names: dict[str, int] = {}
        for words, _ in rows:
            for w in words:
                for f in describe(w)[5:]:
                    self.names.setdefault(f, len(self.names))
        self.forget()
        n = len(STATES)
        may = lambda a, b: not b.startswith("I-") or a[2:] == b[2:]
        self.block = np.array([[0.0 if may(a, b) else -1e6 for b in STATES] for a in STATES])
        self.w, self.t = np.zeros((OFFSETS[-1] + len(self.names) + 1, n)), np.zeros((n, n))
        # every position as a row of feature numbers; the last number is a feature that is never on
        length = np.array([len(x) for x, _ in rows])
        codes = np.array([c for words, _ in rows for c in (0, 0, 0, *map(self.known.__getitem__, words))] + [0, 0, 0])
        real = np.flatnonzero(codes)
        most = max(len(x) for x in self.own)
        own = np.array([[*x, *[len(self.names)] * (most - len(x))] for x in self.own])[codes[real]] + OFFSETS[-1]
        feats = np.concatenate([self.context(codes, real), own], axis=1)
        y = np.array([STATES.index(s) for _, states in rows for s in states])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for _ in range(epochs):  # AdaGrad on the whole table; its order is fixed, so training repeats exactly
            _, dw, dt = self.gradient(feats, y, length)
            dw, dt = dw - DECAY * self.w, dt - DECAY * self.t
            dw[-1] = 0
            gw += dw * dw
            gt += dt * dt
            self.w += RATE * dw / np.sqrt(gw + 1e-8)
            self.t += RATE * dt / np.sqrt(gt + 1e-8)
        self.settle()

    def forget(self) -> None:
        """Empties what was learnt of words, code 0 being the outside of a text."""
        self.classes: dict[tuple, int] = {_OUT: 0}
        self.own: list[list[int]] = [[]]
        self.attrs: list[tuple] = [_OUT]
        self.known = _Known(self)
        self._tables: tuple | None = None

    def class_of(self, word: str) -> int:
        """Code of all that the model knows of a word; there are as many as combinations of known features."""
        told = describe(word)
        key = (*told[:5], *[f for f in told[5:] if f in self.names])
        got = self.classes.get(key)
        if got is None:
            got = self.classes[key] = len(self.own)
            self.own.append([self.names[f] for f in key[5:]])
            self.attrs.append(key[:5])
        return got

    def context(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Feature numbers of positions from their neighbours; three codes 0 stand before and behind each text."""
        table = np.array(self.attrs, np.int32)
        kind, said, linker, given, ends = (table[:, i] for i in range(5))
        c = [codes[at + d] for d in (-3, -2, -1, 0, 1, 2, 3)]
        cue = said // 3
        own = kind[c[3]]
        joined = lambda d: (cue[c[3 + d]] == _AT) & (cue[c[5 + d]] == _DOT)
        place = np.zeros(len(at), np.int32)  # where a word stands in "x at y dot z"
        for number, d in enumerate((1, 0, -1, -2, -3), 1):
            place[joined(d)] = number
        out = (
            said[c[2]] * N_KINDS + own,
            (said[c[1]] * 3 + said[c[2]] % 3) * N_KINDS + own,
            kind[c[2]] * N_KINDS + own,
            (given[c[2]] * 2 + ends[c[2]]) * N_KINDS + own,
            (given[c[3]] * 2 + ends[c[3]]) * N_KINDS + kind[c[4]],
            place * 2 + linker[c[3]],
            (linker[c[2]] * 2 + linker[c[4]]) * N_KINDS + own,
            (cue[c[1]] * 2 + linker[c[2]]) * N_KINDS + own,
        )
        return np.stack(out, axis=1) + OFFSETS[:-1]

    def gradient(self, feats: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of all chains and its gradient, by forward and backward sums over all chains at once."""
        n, t = len(STATES), self.t + self.block
        rows, width = len(length), int(length.max())
        first = np.cumsum(length) - length
        chain = np.repeat(np.arange(rows), length)
        step = np.arange(len(y)) - first[chain]
        e = np.zeros((rows, width, n))
        e[chain, step] = self.w[feats].sum(axis=1)
        fw, bw = np.zeros_like(e), np.zeros_like(e)
        fw[:, 0], bw[:, -1] = e[:, 0] + t[0], t[:, 0]
        for i in range(1, width):
            fw[:, i] = e[:, i] + _log_sum(fw[:, i - 1, :, None] + t, 1)
        for i in range(width - 2, -1, -1):
            inner = _log_sum(t + (e[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
            bw[:, i] = np.where((i + 1 < length)[:, None], inner, t[:, 0])
        last = length - 1
        z = _log_sum(fw[np.arange(rows), last] + t[:, 0], 1)
        p = np.exp(fw + bw - z[:, None, None])[chain, step]
        left = -p
        left[np.arange(len(y)), y] += 1
        flat = feats.ravel()
        dw = np.stack([np.bincount(flat, np.repeat(left[:, s], feats.shape[1]), len(self.w)) for s in range(n)], axis=1)
        dt = np.zeros((n, n))
        dt[0] += left[step == 0].sum(axis=0)
        ends = step == last[chain]
        dt[:, 0] += left[ends].sum(axis=0)
        for i in range(1, width):
            live = length > i
            dt -= np.exp(fw[live, i - 1, :, None] + t + (e[live, i] + bw[live, i])[:, None, :] - z[live, None, None]).sum(axis=0)
        inner = np.flatnonzero(step > 0)
        np.add.at(dt, (y[inner - 1], y[inner]), 1)
        steps = np.where(step == 0, 0, np.roll(y, 1))
        told = self.w[feats].sum(axis=1)[np.arange(len(y)), y].sum() + t[steps, y].sum() + t[y[ends], 0].sum()
        return float(told - z.sum()), dw, dt

    def settle(self) -> None:
        """What decoding needs: bounds by kind, and small copies of the weights."""
        t = self.t + self.block
        self.light = self.w.astype(np.float32)
        self.inner, self.outer = np.zeros((2, len(CRF_KINDS)))
        after = [0, *range(1, len(STATES), 2)]  # states that may follow O
        for k in range(len(CRF_KINDS)):
            b, i = 1 + 2 * k, 2 + 2 * k
            self.inner[k] = max(t[b, i], t[i, i]) - t[0, 0]
            enter = max(t[a, b] - t[a, 0] for a in range(len(STATES)))
            leave = max(t[s, a] - t[0, a] for s in (b, i) for a in after)
            self.outer[k] = enter + leave - self.inner[k]
        self.forget()

    def emissions(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the states at positions."""
        if self._tables is None or len(self._tables) < len(self.own):
            light = self.light[OFFSETS[-1] :]
            self._tables = np.array([light[x].sum(axis=0) for x in self.own], np.float32)
        out = self._tables[codes[at]].astype(np.float64)
        for column in self.context(codes, at).T:
            out += self.light[column]
        return out

    def open_words(self, codes: np.ndarray) -> np.ndarray:
        """Positions that some best path may leave O at; all others are O in every best path.

        Take a best path and a span of kind k in it. With O in place of the span, the path changes by
        at most the sum of gain over the span's words, plus outer: gain is the better of the span's two
        states over O, plus the best inner step over the step from O to O. As the path is best, that is no
        loss, so the sum of gain over a span that holds the position is at least -outer. The largest sum
        over all runs that hold a position comes from running extremes of the prefix sums.
        """
        inside = np.zeros(len(codes), bool)
        gain = np.empty((len(CRF_KINDS), len(codes)))
        real = np.flatnonzero(codes)
        for lo in range(0, len(real), BLOCK):
            at = real[lo : lo + BLOCK]
            e = self.emissions(codes, at)
            for k in range(len(CRF_KINDS)):
                gain[k, at] = np.maximum(e[:, 1 + 2 * k], e[:, 2 + 2 * k]) - e[:, 0] + self.inner[k]
        gain[:, codes == 0] = -1e4  # hardly a run crosses the ends of a text; if one does, more is open than need be
        for k in range(len(CRF_KINDS)):
            total = np.cumsum(gain[k])
            least = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
            most = np.maximum.accumulate(total[::-1])[::-1]
            inside |= most - least + self.outer[k] > -1e-3
        return np.flatnonzero(inside & (codes > 0))

    def paths(self, codes: np.ndarray) -> np.ndarray:
        """The best state of each position, by Viterbi over the chains between words that are O in every best path."""
        out = np.zeros(len(codes), np.int8)
        at = self.open_words(codes)
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            for part, path in zip(np.split(at, cuts), self.viterbi(np.split(self.emissions(codes, at), cuts)), strict=True):
                out[part] = path
        return out

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best states of many chains of emissions at once, O before and behind each: one numpy step a position."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
        t = self.t + self.block
        at = 0
        while at < len(order):
            group = order[at : at + max(1, MOST_CELLS // len(chains[order[at]]))]
            at += len(group)
            sizes = np.array([len(chains[i]) for i in group])
            e = np.zeros((len(group), sizes[0], len(STATES)))
            for k, i in enumerate(group):
                e[k, : sizes[k]] = chains[i]
            score, back = e[:, 0] + t[0], np.zeros(e.shape, np.int8)
            for p in range(1, sizes[0]):
                live = int((sizes > p).sum())
                step = score[:live, :, None] + t
                back[:live, p] = step.argmax(axis=1)
                score[:live] = step.max(axis=1) + e[:live, p]
            path = np.zeros((len(group), sizes[0]), np.int8)
            state = (score + t[:, 0]).argmax(axis=1)
            for p in range(sizes[0] - 1, -1, -1):
                live = int((sizes > p).sum())
                path[:live, p] = state[:live]
                state[:live] = back[np.arange(live), p, state[:live]]
            for k, i in enumerate(group):
                out[i] = path[k, : sizes[k]]
        return out


class _Known(dict):
    """Words and their codes, as far as remembered."""

    def __init__(self, crf: Crf) -> None:
        super().__init__()
        self.crf = crf

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = self.crf.class_of(word)
        return got

    def __reduce__(self):  # a copy in another process begins with nothing
        return _Known, (self.crf,)


@cache
def model() -> Crf:
    """Trained once on the driver, from the training table alone."""
    return Crf()


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of pieces of about PIECE characters that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        m = _BLANK.search(text, end) if end < len(text) else None
        end = m.start() if m else len(text)
        yield at, text[at:end]
        at = end


def crf_spans(texts: list[str], crf: Crf | None = None) -> list[list[Span]]:
    """Spans of the CRF kinds in each text."""
    crf = crf or model()
    codes, sizes = [np.zeros(3, np.int32)], []
    for text in texts:
        sizes.append(0)
        for _, part in pieces(text):
            words = part.split()
            sizes[-1] += len(words)
            codes.append(np.fromiter(map(crf.known.__getitem__, words), np.int32, len(words)))
        codes.append(np.zeros(3, np.int32))
    states = crf.paths(np.concatenate(codes))
    found: list[list[Span]] = []
    at = 3
    for text, n in zip(texts, sizes, strict=True):
        own = states[at : at + n]
        at += n + 3
        begins = np.flatnonzero(own % 2 == 1)
        if not len(begins):
            found.append([])
            continue
        # a span ends before the next word that does not go on with it
        stops = np.append(np.flatnonzero((own == 0) | (own % 2 == 1)), n)
        ends = stops[np.searchsorted(stops, begins, side="right")] - 1
        places = _places(text, np.union1d(begins, ends))
        spans = []
        for first, last in zip(begins.tolist(), ends.tolist(), strict=True):
            a, b = places[first][0], places[last][1]
            # quotes, brackets and stops around the value are not part of it
            body = text[a:b]
            a += len(body) - len(body.lstrip(_EDGE))
            b -= len(body) - len(body.rstrip(_EDGE))
            if a < b:
                spans.append((STATES[own[first]][2:], a, b))
        found.append(spans)
    return found


def _places(text: str, wanted: np.ndarray) -> dict[int, tuple[int, int]]:
    """Start and end of the wanted words (sorted numbers)."""
    out, seen = {}, 0
    for start, part in pieces(text):
        spans = [m.span() for m in _WORD.finditer(part)]
        for k in wanted[np.searchsorted(wanted, seen) : np.searchsorted(wanted, seen + len(spans))].tolist():
            a, b = spans[k - seen]
            out[k] = (start + a, start + b)
        seen += len(spans)
    return out


def find_spans(texts: list[str], crf: Crf | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of each text."""
    col = pa.array(texts, pa.string())
    signs = pc.match_substring_regex(col, "[0-9@]").to_pylist()
    base = [base_spans(t) if s else [] for t, s in zip(texts, signs, strict=True)]
    added = []
    for own, more in zip(base, crf_spans(texts, crf), strict=True):
        added.append(sorted({x for x in more if not any(x[1] < b and a < x[2] for _, a, b in own)}, key=lambda x: (KINDS.index(x[0]), x[1])))
    return base, added


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, base (span string), spans (span string of all), n_email, n_ip, n_card, n_phone, n_spans (of all kinds), redacted, and the columns of carry."""
    shared = docs.sparkSession.sparkContext.broadcast(model())  # some thousand features, whatever the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        base, added = find_spans(texts, shared.value)
        both = [sorted(a + b, key=lambda x: (KINDS.index(x[0]), x[1])) for a, b in zip(base, added, strict=True)]
        counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in BASE_KINDS]
        counts.append(pa.array(map(len, both), pa.int64()))
        clear = [redact(t, s) if s else t for t, s in zip(texts, both, strict=True)]
        return pa.record_batch([*batch.columns, *counts, pa.array([line(b) for b in base], pa.string()), pa.array([line(b) for b in both], pa.string()), pa.array(clear, pa.string())], names=[*batch.schema.names, *[f"n_{k}" for k in BASE_KINDS], "n_spans", "base", "spans", "redacted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return map_slices(given, run, f"{kinds}, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, n_spans long, base string, spans string, redacted string")


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(line(spans).encode()).hexdigest()
