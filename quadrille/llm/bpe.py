"""Byte-level BPE by a rank queue over hierarchical bitmaps, and its decoding.

A pre-token's bytes are a linked list of parts.  Every pair of neighbours that the vocabulary joins waits in the bucket of
its rank, a heap of positions; two levels of bitmaps say which buckets hold something, so the first bit that is set names the
next rank, the first position of its bucket the leftmost pair.  Joining a pair gives its left and right neighbours
new ranks; their old entries stay behind and are skipped when they come up, as the list no longer agrees with them.
So a pre-token of n bytes takes O(n log n) steps, however long.  Of a short one the ranks are a list, whose least is looked for anew each time.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are split in pieces of about so many characters.
CHUNK = 1 << 16
#: Pre-tokens of at most so many characters are remembered, so many and those that came before them a Python worker.
SHORT, REMEMBERED = 48, 1 << 18
#: Pre-tokens of at most so many bytes are merged on a list of ranks.
SHORT_BYTES = 64
#: Ranks that share a word of the lower bitmap.
LOW_BITS = 8
LOW = (1 << LOW_BITS) - 1
_CUT = regex.compile(r"(?<=\S)(?=\s)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks from a file of lines ``base64 rank``; read where the query is built."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BIT = [1 << i for i in range(LOW + 1)]


_NO_RANK = 1 << 62


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, get = len(piece), ranks.get
    cut = list(range(n + 1))
    at = [get(piece[i : i + 2], _NO_RANK) for i in range(n - 1)]
    while at:
        least = min(at)
        if least == _NO_RANK:
            break
        i = at.index(least)
        del at[i], cut[i + 1]
        if i:
            at[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], _NO_RANK)
        if i < len(at):
            at[i] = get(piece[cut[i] : cut[i + 2]], _NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank, the leftmost of equal ones, is joined until none is left.

    A bucket with one position is that number, one with more a heap."""
    n = len(piece)
    if n <= SHORT_BYTES:
        return _merge_short(piece, ranks)
    kind = list if n <= 256 else lambda x: array("q", x)
    after, before, rank_at = kind(range(1, n + 1)), kind(range(-1, n)), kind([-1]) * n
    buckets: dict[int, int | list[int]] = {}
    low: dict[int, int] = {}
    top, bit, get = 0, _BIT, ranks.get

    def push(r: int, p: int) -> int:
        """The rank's bit of the top level; the lower ones are set."""
        rank_at[p] = r
        if r in buckets:
            bucket = buckets[r]
            if bucket.__class__ is int:
                buckets[r] = [bucket, p] if bucket < p else [p, bucket]
            else:
                heappush(bucket, p)
            return 0
        buckets[r] = p
        high = r >> LOW_BITS
        low[high] = low.get(high, 0) | bit[r & LOW]
        return 1 << high

    for p in range(n - 1):
        r = get(piece[p : p + 2])
        if r is not None:
            top |= push(r, p)
    while top:
        high = (top & -top).bit_length() - 1
        word = low[high]
        r = high << LOW_BITS | (word & -word).bit_length() - 1
        bucket = buckets[r]
        if bucket.__class__ is int:
            p = bucket
        else:
            p = heappop(bucket)
        if bucket.__class__ is int or not bucket:
            del buckets[r]
            word &= word - 1
            low[high] = word
            if not word:
                top &= top - 1
        if rank_at[p] != r:
            continue
        q = after[p]
        e = after[q]
        after[p] = e
        rank_at[q] = rank_at[p] = -1
        if e < n:
            before[e] = p
            r = get(piece[p : after[e]])
            if r is not None:
                top |= push(r, p)
        o = before[p]
        if o >= 0:
            r = get(piece[o:e])
            if r is not None:
                top |= push(r, o)
            else:
                rank_at[o] = -1
    ids, p = [], 0
    while p < n:
        q = after[p]
        ids.append(ranks[piece[p:q]])
        p = q
    return ids


def _chunks(text: str) -> Iterator[str]:
    """The text cut where white space follows something else: no match of a pattern whose matches hold white space only at
    their beginning or throughout goes across such a place."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        cut = _CUT.search(text, at + CHUNK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of texts; each different short pre-token is merged once as long as it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state

    def ids(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists."""
        if not hasattr(self, "_known"):
            self._known, self._older, self._compiled = {}, {}, regex.compile(self.pattern)
        for chunk in _chunks(text):
            out: list[int] = []
            known, older = self._known, self._older
            pieces = self._compiled.findall(chunk) if len(chunk) <= 4 * CHUNK else (m.group() for m in self._compiled.finditer(chunk))
            for piece in pieces:
                ids = known.get(piece)
                if ids is None:
                    ids = older.get(piece)
                    if ids is None:
                        raw = piece.encode()
                        whole = self.ranks.get(raw)
                        ids = tuple(merge(raw, self.ranks)) if whole is None else (whole,)
                    if len(piece) <= SHORT:
                        if len(known) >= REMEMBERED:
                            self._known, self._older = known, older = {}, known
                        known[piece] = ids
                out += ids
            yield out


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): the ids of the whole text.

    Each match of ``pattern`` is encoded by itself; no match may hold white space behind something else, as then a text cannot be cut.
    There are no special tokens: their strings are ordinary text.  A null or empty text has no ids; repeated rows and
    ids give a row each; other columns are not read.  The vocabulary is of fixed size, so is what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))

    def run(batches):
        for batch in batches:
            ids, at = array("i"), [0]
            for text in batch.column("text"):
                for some in shared.value.ids(text.as_py() or ""):
                    ids.extend(some)
                at.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded) for every row (doc_id, ids): the bytes of the ids.

    Null or no ids give no bytes; an id that the vocabulary lacks is an error."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            lists, table = batch.column("ids"), shared.value
            decoded = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
