"""Toxicity by noisy-channel deobfuscation.

Restoring: a word that is not plain letters, holds a letter three times or more in a row, or is
spelt out letter by letter, becomes a lattice: a look-alike symbol may be one of the letters it
stands for or noise, a repetition may be one letter or two, a sign that joins may be a gap, a gap between single letters, or between short pieces of
which one is no likely word, may be a gap or nothing. Viterbi, over all states, takes the path that a character trigram model and the channel's costs make
likeliest. A plain word has a lattice of one path and is left as it is. The language model is
counted over all documents: each task leaves its counts once, at most 64**3 of them.

Scoring: from labelled documents (at most MAX_LABELLED, those of the smallest id hashes; their
whole texts) stems of restored words are counted: whole words and prefixes of STEM_LENGTHS
letters. Stems that mostly occur in toxic documents are taken greedily, each judged on the toxic
documents that earlier ones do not explain, so that chance companions of a toxic word do not
enter. A document's score is 1 - (1 - base) * product(1 - p) over the stems it holds.

Null and empty text score the base rate; a text of any length and a word of any length is read whole. Equal readings:
the first in the order of the lattice. Columns other than doc_id and text are not read unless carried, whatever their names. Without labels every score is 0. Repeated labels of one
document count once, as toxic if any is. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charcode import N, TABLE, _MOST, codes, merged, trigrams
from .common import crc_rest, table, text_slices, texts_of, written

MAX_LABELLED, MIN_DOCS, MIN_SHARE, MIN_PURITY = 60_000, 3, 0.004, 0.6
#: A stem of this share of the toxic documents and this purity is taken even if earlier ones explain its documents.
SURE_SHARE, SURE_DOCS, SURE_PURITY = 0.015, 8, 0.9
STEM_LENGTHS, THRESHOLD, FOLDS, HELD_OUT, CACHE = (4, 5, 6), 0.7, 3, 1, 100_000
#: Letters that a symbol is commonly written for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "", "%": "", "&": "", "^": "", "~": "", "_": "", "-": "", ".": "", "'": ""}
#: Signs that may stand between two words without a blank.
JOINERS = frozenset(".,;:/_-")
#: Channel costs in bits: a symbol for a letter, a symbol or a digit as noise, a repetition as one or two letters, a gap kept.
COST_LETTER, COST_NOISE, COST_DIGIT, COST_ONE, COST_TWO, COST_GAP = 1.0, 6.0, 14.0, 0.5, 1.5, 3.0
#: Letters of a short piece, pieces read with an odd one on each side, bits from which a piece is no usual word of the corpus, cost of joining.
PIECE, AROUND, ODD_BITS, COST_JOIN = 3, 3, 16.0, 1.0
_EDGE = ".,;:?|\"()[]{}<>…"
_TAIL = re.compile(r"(?:([^\w\s])\1{2,}|!+)$")
_REPEAT = re.compile(r"(.)\1\1")
#: Equal characters, or equal single ones with blanks between.
_RUN = re.compile(r"(?<!\S)(\S)(?: \1)+(?!\S)|(.)\2*", re.S)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """gram, n over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for whole in batches:
            for batch in text_slices(whole):
                code = merged(np.concatenate(([0], codes("\n".join(texts_of(batch)).lower()), [0])).astype(np.uint8))
                if len(code) > 2:
                    total += np.bincount(trigrams(code), minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi over character lattices under the trigram model of the corpus."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros(N**3)
        counts[gram] = n
        c = counts.reshape(N, N, N)
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + N)
        two = (c.sum(axis=0) + 8 * one) / (c.sum(axis=(0, 2))[:, None] + 8)
        three = (c + 8 * two) / (c.sum(axis=2, keepdims=True) + 8)
        self.bits, self.first = -np.log2(three).astype(np.float32), -np.log2(two[0]).astype(np.float32)
        self.pieces: dict[str, bool] = {}

    def odd(self, piece: str) -> bool:
        """Whether a short piece is unlikely as a word of the corpus; every one is worked out once."""
        got = self.pieces.get(piece)
        if got is None:
            code = [0, *codes(piece).tolist(), 0]
            cost = float(self.first[code[1]]) + sum(float(self.bits[code[i : i + 3][0], code[i + 1], code[i + 2]]) for i in range(len(code) - 2))
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            got = self.pieces[piece] = cost >= ODD_BITS
        return got

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Readings of each run of equal characters, with their costs."""
        out, pieces = [], any(len(x) > 1 for x in word.split(" "))
        for m in _RUN.finditer(word):
            c, n = m.group()[0], m.group().count(m.group()[0])
            if c == " ":  # of single letters a gap is likely nothing, of pieces likely a gap
                out.append([(" ", 0.0), ("", COST_JOIN)] if pieces else [(" ", COST_GAP), ("", 0.0)])
            elif c.isalpha() and n < len(m.group()):  # spelt out: as it stands, one letter, or the end of a word and the start of the next
                out.append([(c * 2, COST_TWO * (n > 2)), (c, COST_ONE), (f"{c} {c}", COST_GAP)])
            elif c.isalpha():
                out.append([(c * n, 0.0)] if n < 3 else [(c, COST_ONE), (c * 2, COST_TWO)])
            else:
                reads = [("", (COST_DIGIT if c.isdigit() else COST_NOISE) if LOOKALIKES.get(c) else 0.0)]
                if c in JOINERS:
                    reads.append((" ", COST_JOIN))
                for a in LOOKALIKES.get(c, ""):
                    reads.append((a, COST_LETTER + 0.5 * (n > 1)))
                    if n > 1:
                        reads.append((a * 2, COST_LETTER + 0.5))
                out.append(reads)
        return out

    def restore(self, word: str) -> str:
        """The likeliest reading; its words are separated by blanks."""
        bits, best = self.bits, {(0, 0): (0.0, None)}
        for reads in [*self.lattice(word), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for text, extra in reads:
                    p, q, total, kept = a, b, cost + extra, path
                    for ch in text:
                        r = int(TABLE[min(ord(ch), _MOST)])
                        if r or q:  # a boundary after a boundary is none
                            total += float(bits[p, q, r])
                            p, q = q, r
                        kept = (ch, kept)
                    if (p, q) not in new or total < new[p, q][0]:
                        new[p, q] = (total, kept)
            best = new
        path = min(best.values(), key=lambda x: x[0])[1]
        letters = []
        while path is not None:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters)).strip()

    def words(self, word: str) -> list[str]:
        """Restored words of one lower-case word (or of letters spelt out with blanks)."""
        if word.isalpha() and not _REPEAT.search(word):
            return [word]
        core = _TAIL.sub("", word.strip(_EDGE)).strip(_EDGE)
        if core.isalpha() and not _REPEAT.search(core):
            return [core]
        if not any(c.isalpha() for c in core):
            return []  # no letter to anchor a reading
        return self.restore(core).split()


def spelt_out(words: list[str], odd: Callable[[str], bool] | None = None) -> list[str]:
    """Runs of three or more single characters, joined by blanks; with `odd`, also runs of two or more short pieces with an odd one."""
    single = bytes([len(w) == 1 for w in words])
    out = []
    if b"\1\1\1" in single:
        for m in re.finditer(rb"\x01{3,}", single):
            # more than three equal neighbours read like three
            run = words[m.start() : m.end()]
            kept = [w for k, w in enumerate(run) if k < 3 or not w == run[k - 1] == run[k - 2] == run[k - 3]]
            out += [" ".join(kept[k : k + 40]) for k in range(0, len(kept), 32)]  # overlapping pieces of bounded length
    if odd is not None:
        short = {w for w in set(words) if len(w) <= PIECE and w.isalpha()}
        strange = {w for w in short if len(w) > 1 and odd(w)}
        for k in [k for k, w in enumerate(words) if w in strange] if strange else ():
            first = last = k
            while first > max(0, k - AROUND) and words[first - 1] in short:
                first -= 1
            while last < min(len(words) - 1, k + AROUND) and words[last + 1] in short:
                last += 1
            if first < last:
                out.append(" ".join(words[first : last + 1]))
    return out


def stems_of(word: str) -> list[str]:
    """The word and its prefixes; a prefix ends with *."""
    if len(word) < 3:
        return []
    return [word, *[word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n]]


def document_words(restorer: Restorer, text: str, known: dict[str, list[str]]) -> set[str]:
    """Distinct restored words of a text."""
    words = text.lower().split()
    found: set[str] = set()
    for w in {*words, *spelt_out(words, restorer.odd)}:
        got = known.get(w)
        if got is None:
            if len(known) >= CACHE:
                known.clear()
            got = known[w] = restorer.words(w)
        found.update(got)
    return found


def copy_key(words: set[str], text: str) -> int:
    """The same for exact copies and most near copies: from the two least hashes of long words."""
    least = sorted(zlib.crc32(w.encode()) for w in words if len(w) >= 8)[:2]
    return least[0] << 31 ^ least[1] if len(least) == 2 else zlib.crc32(text.encode())


def _labelled(docs: DataFrame, labels: DataFrame, restorer: Restorer, work, schema: str) -> DataFrame:
    """work(toxic flags, stem sets) over the labelled documents, a batch at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(restorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}

        def sets() -> Iterator[tuple[int, set[str], int]]:
            for whole in batches:
                for batch in text_slices(whole):
                    for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
                        words = document_words(shared.value, text, known)
                        yield toxic, {s for w in words for s in stems_of(w)}, copy_key(words, text)

        yield from work(sets())

    # at most MAX_LABELLED rows of two numbers: a proven bound for the broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id").select("toxic", "text").mapInArrow(run, schema)


def learn_stems(docs: DataFrame, labels: DataFrame, restorer: Restorer) -> tuple[dict[str, float], float]:
    """Toxic stems with their probabilities, and the base rate of documents without any. labels: doc_id, toxic."""
    sample = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("doc_id is not null")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).cache()
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic:
        return {}, 0.0

    def toxic_counts(sets: Iterator[tuple[int, set[str], int]]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, stems, _ in sets:
            counts.update(stems)
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])

    # a toxic document has some hundred stems, so there are some hundred / MIN_SHARE of them at most
    least = max(MIN_DOCS, MIN_SHARE * n_toxic)
    toxic = _labelled(docs, sample.where("toxic = 1"), restorer, toxic_counts, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = sorted((-r["n"], r["stem"]) for r in toxic.collect())
    stems = [x for _, x in found]
    place = {x: i for i, x in enumerate(stems)}

    def incidence(sets: Iterator[tuple[int, set[str], int]]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        rows = lambda *cols: pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "at", "stem", "n"])
        clean = np.zeros(len(place), np.int64)
        for flag, words, key in sets:
            at = np.array(sorted(place[s] for s in words if s in place), np.int32)
            if flag:
                yield rows([key], [at.tobytes()], [None], [None])
            elif len(at):
                clean[at] += 1
        seen = np.flatnonzero(clean)
        yield rows([None] * len(seen), [None] * len(seen), seen, clean[seen])

    rows = written(_labelled(docs, sample, restorer, incidence, "key long, at binary, stem int, n long"), "stems")
    clean = np.zeros(len(stems), np.int64)
    for r in rows.where("stem is not null").groupBy("stem").agg(F.sum("n").alias("n")).collect():
        clean[r["stem"]] = r["n"]
    # copies only lower the number of toxic documents of a stem, so those impure by all of them are impure
    pure = np.array([-n for n, _ in found]) / np.maximum(np.array([-n for n, _ in found]) + clean, 1) >= MIN_PURITY if found else np.zeros(0, bool)
    renamed = np.where(pure, np.cumsum(pure) - 1, -1).astype(np.int32)

    def only_pure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [renamed[np.frombuffer(x, np.int32)] for x in batch.column("at").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array([x[x >= 0].tobytes() for x in held], pa.binary())], names=["key", "at"])

    # of a group of copies, one speaks; at most MAX_LABELLED rows with the pure stems that they hold
    groups = rows.where("key is not null").groupBy("key").agg(F.min("at").alias("at")).mapInArrow(only_pure, "key long, at binary")
    members = {r["key"]: np.frombuffer(bytes(r["at"]), np.int32) for r in groups.collect()}
    sample.unpersist()
    return choose([x for x, p in zip(stems, pure, strict=True) if p], clean[pure], [members[k] for k in sorted(members)], least, n_all)


def choose(stems: list[str], clean: np.ndarray, members: list[np.ndarray], least: float, n_all: int) -> tuple[dict[str, float], float]:
    """Greedy cover of the toxic documents by pure stems, and every stem that is frequent and pure enough by itself.

    A prefix gives way to a longer stem that explains nine tenths of its documents.
    """
    total = np.bincount(np.concatenate(members), minlength=len(stems)) if members else np.zeros(len(stems), np.int64)
    pure = total / np.maximum(total + clean, 1) >= MIN_PURITY
    size = np.array([len(s.rstrip("*")) + 0.5 * (not s.endswith("*")) for s in stems])
    left, chosen = np.where(pure, total, 0), {}
    open_docs = [m[pure[m]] for m in members]

    def longest(i: int, counts: np.ndarray) -> int:
        head = stems[i].rstrip("*")
        inner = [j for j in np.flatnonzero(counts >= 0.9 * counts[i]) if stems[i].endswith("*") and stems[j].startswith(head)]
        return max([*inner, i], key=lambda j: (size[j], -j))

    def take(i: int) -> None:
        chosen[stems[i]] = float((total[i] + 1) / (total[i] + clean[i] + 1.5))

    while len(left) and left.max() >= least:
        top = int(left.argmax())
        best = longest(top, left)
        if left[best] / (left[best] + clean[best]) >= MIN_PURITY:
            take(best)
            rest = []
            for m in open_docs:
                if (m == best).any():
                    left[m] -= 1
                else:
                    rest.append(m)
            open_docs = rest
        left[best] = 0
    sure = (total >= max(SURE_DOCS, SURE_SHARE * len(members))) & (total / np.maximum(total + clean, 1) >= SURE_PURITY)
    for i in np.flatnonzero(sure):
        take(longest(int(i), np.where(sure, total, 0)))
    return chosen, min(0.3, (len(open_docs) + 0.5) / (n_all + 1))


class Scorer:
    """Scores texts; made once on the driver, its cache lives in the worker."""

    def __init__(self, restorer: Restorer, stems: dict[str, float], base: float) -> None:
        self.restorer, self.stems, self.base = restorer, stems, base
        self.lengths = sorted({len(s) - 1 for s in stems if s.endswith("*")})
        self.known: dict[str, tuple] = {}

    def hits(self, word: str) -> tuple:
        """Stems that a raw word or spelt-out run holds."""
        found = set()
        for w in self.restorer.words(word):
            keys = [w, *[w[:n] + "*" for n in self.lengths if len(w) >= n]]
            found.update(k for k in keys if k in self.stems)
        return tuple(found)

    def score(self, text: str) -> tuple[float, list[str]]:
        words = text.lower().split()
        known, found = self.known, set()
        for w in {*words, *spelt_out(words, self.restorer.odd)}:
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[w] = self.hits(w)
            if got:
                found.update(got)
        clear = 1.0 - self.base
        for s in sorted(found):
            clear *= 1.0 - self.stems[s]
        return (1.0 - clear if self.stems else 0.0), sorted(found)

    def restored(self, text: str) -> str:
        """The text with each word replaced by its likeliest reading."""
        return " ".join(" ".join(self.restorer.words(w)) for w in text.lower().split())


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The language model from all docs, the stems from labels (doc_id, toxic)."""
    grams = count_trigrams(docs).toArrow()  # at most 64**3 rows
    restorer = Restorer(grams["gram"].to_numpy(), grams["n"].to_numpy())
    return Scorer(restorer, *learn_stems(docs, labels, restorer))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(crc_rest(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "toxic")


def toxicity(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, carry: tuple = (), keep_text: bool = False) -> DataFrame:
    """doc_id, score, predicted, stems (found in the restored text), text if asked, and the columns of carry as carry_<name>."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in texts_of(batch)]
        score = np.array([s for s, _ in found])
        return pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([s for _, s in found], pa.list_(pa.string()))], names=[*batch.schema.names, "score", "predicted", "stems"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                yield from map(scored, text_slices(whole))
        finally:  # a worker outlives its task; its cache need not
            shared.value.known.clear()

    # own names, so that columns called score or text in carry do not clash
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    out = base.mapInArrow(run, f"{kinds}, score double, predicted int, stems array<string>")
    return out.select("doc_id", "score", "predicted", "stems", *["text"] * keep_text, *[f"carry_{c}" for c in carry])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, learnable(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", F.coalesce(crc_rest(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
