"""Byte-level BPE encoding and decoding.

The merges of one piece run on a segment tree over its byte positions. A leaf holds
the rank of the pair that starts there, joined with the position, so that the root is
the leftmost pair of least rank. A merge changes the leaves of the live neighbours
only, each in logarithmic time, so a piece of n bytes takes O(n log n).

Edge cases: a null or empty text has no tokens and decodes to no bytes; texts of any
length are encoded whole; repeated rows give repeated results; an empty table gives an
empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_rows

#: Pieces whose encoding a Python worker keeps; beyond it the memory is dropped and starts anew.
CACHE_PIECES = 400_000
#: Only pieces of at most this many characters are kept.
CACHE_CHARS = 64
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece, by least rank first and leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    width = 1
    while width < n:
        width *= 2
    tree = [_NONE] * (2 * width)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    for at in range(n - 1):
        rank = rank_of(piece[at : at + 2])
        if rank is not None:
            tree[width + at] = rank * n + at
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(at: int, value: int) -> None:
        node = width + at
        if tree[node] == value:
            return
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            best = value if value < other else other
            node //= 2
            if tree[node] == best:
                return
            tree[node] = value = best

    def pair_at(at: int) -> int:
        middle = after[at]
        if middle >= n:
            return _NONE
        rank = rank_of(piece[at : after[middle]])
        return _NONE if rank is None else rank * n + at

    while tree[1] != _NONE:
        at = tree[1] % n
        gone = after[at]
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        put(gone, _NONE)
        put(at, pair_at(at))
        if before[at] >= 0:
            put(before[at], pair_at(before[at]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Encoded(dict):
    """Piece -> its ids as decimal text; filled on demand, bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.encoded = _Encoded(self.ranks)
        self.bytes_of = {str(rank): token for token, rank in self.ranks.items()}

    def encode_text(self, text: str | None) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.encoded.__getitem__, self.split(text))) if text else ""

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of this process; a Python worker builds it once."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the token ids of every text. The rank file must lie on every executor."""

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        return [batch.column(0), [[int(x) for x in c.encode_text(t).split()] for t in batch.column(1).to_pylist()]]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary): the bytes that the ids stand for; null ids give no bytes, an unknown id is an error."""

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        return [batch.column(0), [c.decode_text(" ".join(map(str, x or []))) for x in batch.column(1).to_pylist()]]

    kind = tokens.schema[key].dataType.simpleString()
    return map_rows(tokens.select(F.col(key), F.col(ids).cast("array<int>")), run, f"`{key}` {kind}, bytes binary")


def token_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, exact): encode each text, decode the ids, digest both.

    ``exact`` says whether the decoded bytes equal the UTF-8 bytes of the text.
    """

    def run(batch: pa.RecordBatch) -> list:
        c = codec(path, pattern)
        counts, of_ids, of_bytes, exact = [], [], [], []
        for t in batch.column(1).to_pylist():
            ids = c.encode_text(t)
            back = c.decode_text(ids)
            counts.append(ids.count(" ") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
            of_bytes.append(hashlib.sha256(back).hexdigest())
            exact.append(back == (t or "").encode("utf-8", "surrogatepass"))
        return [batch.column(0), counts, of_ids, of_bytes, exact]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")
