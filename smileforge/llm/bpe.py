"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Encoding.  An Aho-Corasick automaton over all vocabulary entries gives, for
every position of a pre-token, the entries that start there.  The encoder walks
left to right, takes the longest entry that is compatible with the entry before
it, falls back to shorter ones, and steps back when none is left; positions
that turned out to lead nowhere are not tried again, so the work is linear.
Two neighbouring entries are compatible if merging their concatenation gives
just these two; then the only sequence that is compatible throughout is what
the merges give.

Decoding.  The bytes of all entries lie one after the other; the bytes of an id
sequence are gathered through the table of their offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import hold, spread, table, trimmed

VOCABULARY = "byte_bpe_50k.json"
_SPACES = r"\t-\r \x85\xa0  -     　"
#: Splits where no pre-token runs on: before a single space or at white space.
_COARSE = re.compile(rf" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_FINE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Distinct chunks whose ids a Python worker keeps; emptied when full.
CACHE_CHUNKS = 250_000
#: Longer chunks are not kept.
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        entries = vocab | {k.encode(): v for k, v in self.special.items()}
        size = max(entries.values()) + 1
        self.tokens = [b""] * size
        for token, i in entries.items():
            self.tokens[i] = token
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(t) for t in self.tokens])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.vocab = vocab
        ids = {token: i for token, i in spec["model"]["vocab"].items()}
        #: (left, right) -> (rank, merged); and what each entry was merged from.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merges.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        #: The longest entry that is a proper prefix of an entry, or -1.
        self.shorter = [next((vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in vocab), -1) for t in self.tokens]
        self._compatible: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side."""
        key = left << 20 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 500_000:
                self._compatible.clear()
            known = self._compatible[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # The merges that made either entry are undone from the seam outwards,
        # latest first; a merge across the seam that comes earlier breaks them.
        limit = len(self.merges) + 1
        while True:
            across = self.merges.get((left, right))
            if across is not None and across[0] < limit:
                return False
            made_l, made_r = self.parts.get(left), self.parts.get(right)
            rank_l = self.merges[made_l][0] if made_l else -1
            rank_r = self.merges[made_r][0] if made_r else -1
            if rank_l < 0 and rank_r < 0:
                return True
            if rank_l > rank_r:
                limit = rank_l
                left = made_l[1]
            else:  # of equal merges the leftmost happens first, and the seam lies to the left
                limit = rank_r + 1
                right = made_r[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.vocab.get(piece)
        if whole is not None and (whole in self.parts or len(piece) == 1):
            return [whole]
        shown = piece.decode("latin-1")
        known = self._compatible
        greedy = [i for _, (_, i) in self.automaton.iter_long(shown)]
        last = greedy[0]
        for i in greedy[1:]:
            ok = known.get(last << 20 | i)
            if not (self.compatible(last, i) if ok is None else ok):
                return self._backtrack(shown)
            last = i
        return greedy

    def _backtrack(self, piece: str) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, (length, i) in self.automaton.iter(piece):
            longest[end - length + 1] = i  # matches come by their end, so the longest is the last
        sizes, shorter, known = self.sizes, self.shorter, self._compatible
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, i = 0, longest[0]
        while pos < n:
            if out:
                last = out[-1] << 20
                while i >= 0:
                    if open_[pos + sizes[i]]:
                        ok = known.get(last | i)
                        if self.compatible(out[-1], i) if ok is None else ok:
                            break
                    i = shorter[i]
            else:
                while i >= 0 and not open_[pos + sizes[i]]:
                    i = shorter[i]
            if i >= 0:
                out.append(i)
                pos += sizes[i]
                i = longest[pos] if pos < n else -1
            else:
                open_[pos] = 0
                i = out.pop()
                pos -= sizes[i]
                i = shorter[i]
        return out

    def _chunk(self, chunk: str) -> bytes:
        body, end = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
        if (body[1:] if body[:1] == " " else body).isalpha():  # as the pattern splits it, without running it
            ids = self.encode_piece(body.encode())
            if end:
                ids = [*ids, self.vocab[end.encode()]]
        else:
            ids = []
            for piece in _FINE.findall(chunk):
                ids += self.encode_piece(piece.encode())
        packed = array("I", ids).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self._chunks) >= CACHE_CHUNKS:
                self._chunks.clear()
            self._chunks[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        known, new = self._chunks.get, self._chunk
        for part in self._pattern.split(text) if self._pattern else (text,):
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            else:
                for chunk in _COARSE.findall(part):
                    out.append(known(chunk) or new(chunk))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of an id sequence."""
        ids_ = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(ids_):
            return b""
        begins = self.offsets[ids_]
        sizes = self.offsets[ids_ + 1] - begins
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        return self.blob[index].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies are; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded text of every row of ``docs``.

    A null text is an empty one: no ids, and the decoded text is empty.  Texts
    of any length are encoded whole.  Repeated rows give repeated rows, an
    empty table an empty result; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", codec.cache_clear)
        c = codec(vocabulary_path(vocabulary))
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            decoded = [c.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; as ``encode``, but only digests leave the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", codec.cache_clear)
        c = codec(vocabulary_path(vocabulary))
        for batch in batches:
            rows = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and of the decoded text, of every document."""
    return digests(spread(table(spark, sf_dir, "documents")))
