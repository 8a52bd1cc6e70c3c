"""Byte-level BPE with the tokenizers library: ids, offsets, exact decoding.

The ranks of a .tiktoken file become a tokenizers BPE model over characters that stand for
bytes: every split of a token into two earlier tokens is a merge, in order of the token's rank,
and a piece that is itself a token is taken at once. Each match of the pattern is a piece and
is encoded on its own, so a worker encodes each distinct piece once and keeps its ids.

Null text counts as empty: no ids, the digests of b"". Repeated rows give repeated rows; extra
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, table, texts_of

#: Distinct pieces that a worker keeps, and the longest piece it keeps, in characters.
CACHE_PIECES = 300_000
CACHE_PIECE_CHARS = 64


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """Encodes and decodes by one rank file; made once in each worker."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(t)):
                if ranks.get(t[:i], r) < r and ranks.get(t[i:], r) < r:
                    merges.append((shown[t[:i]], shown[t[i:]]))
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for s, r in ((s, ranks[t]) for t, s in shown.items()):
            self.bytes_of[r] = bytes(back[c] for c in s)
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.model.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, dtype="<u4").tobytes() for p, e in zip(pieces, found, strict=True)}

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            pieces = self.findall(text)
            known = self.known
            if new := [p for p in dict.fromkeys(pieces) if p not in known]:
                if len(known) + len(new) > CACHE_PIECES:
                    self.known = known = {}
                    new = list(dict.fromkeys(pieces))
                learnt = self._learn(new)
                if len(new) > CACHE_PIECES or any(len(p) > CACHE_PIECE_CHARS for p in new):
                    known.update((p, b) for p, b in learnt.items() if len(p) <= CACHE_PIECE_CHARS)
                    out.append(b"".join([learnt.get(p) or known[p] for p in pieces]))
                    continue
                known.update(learnt)
            out.append(b"".join([known[p] for p in pieces]))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end in characters of each id; ids that share a character name it both."""
        spans = []
        for m in self.finditer(text):
            spans += [(m.start() + a, m.start() + b) for a, b in self.model.encode(m.group(), add_special_tokens=False).offsets]
        return spans

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; an id sequence cut within a character gives U+FFFD for its bytes."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


_made: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """One tokenizer a process; by default the multilingual rank file of public_tokenizers."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (string): every text encoded and decoded again."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        packed = bpe.encode_packed(texts_of(batch))
        ids = [np.frombuffer(p, dtype="<u4").astype("int32") for p in packed]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode_bytes(p).decode("utf-8", "replace") for p in packed], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        packed = bpe.encode_packed(texts_of(batch))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.record_batch(
            [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p) for p in packed], pa.string()), pa.array([sha(bpe.decode_bytes(p)) for p in packed], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
