"""Operator 6: byte-level BPE encoding and decoding.

A text is cut at the vocabulary's special tokens, then into pre-tokens by the byte-level pattern. A pre-token's bytes
form a doubly linked list of symbols; a priority queue of (merge rank, position) yields the next merge, and an entry
whose symbols have changed since it was pushed is stale and skipped. Decoding concatenates the vocabulary's strings and
reads the bytes as UTF-8. The tables come from a public tokenizer file whose path is a parameter: the driver reads it
(a few MB, whatever the corpus) and broadcasts it; every Python worker builds its tables once.

Words repeat, so finished pre-tokens are kept in dictionaries of at most twice CACHE entries per worker, which let go of
what has not been used of late. That bounds memory and changes no result.

Defined results: a null text encodes as an empty one: 0 tokens, the digest of nothing. White space, control and
astral characters and texts of any length take the same path. Rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from martflow.llm.shared import annotate, held, table

CACHE = 250_000
#: The pre-token pattern of byte-level BPE files with use_regex (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIGESTS = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Results of make, those used of late: when CACHE are new, they become the old ones, and an old one that is used again
    is new."""

    def __init__(self, make, share: float = 1.0):
        super().__init__()
        self.make, self.share, self.old = make, share, {}

    def __missing__(self, key):
        if len(self) >= CACHE * self.share:
            self.old = dict(self)
            self.clear()
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class ByteBPE:
    """encode() and decode() by the tables of a tokenizer file (bytes of its JSON)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer or prefix space are supported")
        vocab = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        strings = dict.fromkeys(range(max([*vocab.values(), *special.values()]) + 1), b"")
        for s, i in chain(vocab.items(), special.items()):
            try:
                strings[i] = bytes(value[c] for c in s)
            except KeyError:
                strings[i] = s.encode()
        self.strings = list(strings.values())
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(PATTERN)
        self.token = _Cache(self._merged, 0.9)  # a pre-token's ids
        self.first = _Cache(self._piece, 0.4)  # the ids of a run without spaces
        self.later = _Cache(lambda p: self._piece(" " + p))  # of one that a single space goes before
        self.doubled = re.compile(r"\s\s|^\s|\s\Z")
        self.newline = self._piece("\n")

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        queue = [(rank, i, new, a, b) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of its symbols has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(queue, (r[0], h, r[1], ids[h], new))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _merged(self, token: str) -> bytes:
        return np.array(self.merge(token.encode()), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.token.__getitem__, self.words.findall(piece)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens.

        Where white space never doubles, a pre-token cannot reach over a space or line break that stands between two
        other characters, so each run between them can be looked up by itself.
        """
        if self.doubled.search(text):
            return self._piece(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.newline)
            out.append(self.first[head])
            out.extend(map(self.later.__getitem__, rest))
        return b"".join(out[1:])

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text) if text else b""
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.cut.split(text) if p)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace")


def built(content: bytes) -> ByteBPE:
    """The tables of a tokenizer file, built once in each Python process while it works on BPE."""
    return held(f"{__name__} {hashlib.sha256(content).hexdigest()}", lambda: ByteBPE(content))


def _shipped(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(col: pa.Array):
    """Its strings, a few at a time."""
    for i in range(0, len(col), 256):
        for t in col.slice(i, 256).to_pylist():
            yield t or ""


def bpe_encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with ids (binary: little-endian unsigned 32-bit) and n_tokens."""
    shipped = _shipped(df.sparkSession, path)

    def make(col):
        t = built(shipped.value)
        ids = [t.encode_bytes(x) for x in _texts(col)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return annotate(df, text, [("ids", "binary"), ("n_tokens", "long")], make)


def bpe_decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with decoded, the text of its ids."""
    shipped = _shipped(df.sparkSession, path)

    def make(col):
        t = built(shipped.value)
        return [pa.array([t.decode_bytes(x or b"").decode("utf-8", "replace") for x in col.to_pylist()], pa.string())]

    return annotate(df, ids, [("decoded", "string")], make)


def bpe_digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with n_tokens and the digests of the ids and of the text decoded from them."""
    shipped = _shipped(df.sparkSession, path)

    def make(col):
        t = built(shipped.value)
        n, a, b = [], [], []
        for x in _texts(col):
            ids = t.encode_bytes(x)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(t.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return annotate(df, text, DIGESTS, make)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def encoded_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens and both digests of each row of docs."""
    return bpe_digests(docs.select("doc_id", "text")).drop("text")
