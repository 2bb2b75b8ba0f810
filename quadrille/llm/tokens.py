"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of byte strings; a piece that begins a word begins with a space.
Where a word cannot go on in the trie, greedy matching would pop one piece or more and start
anew behind them: the failure link leads to the node of what is left, and the number of
pieces popped on the way is kept with it.  So a word takes one step a byte and one failure
a piece, and no piece is ever built.  Many short words take their steps together, a long one
(text without white space, say) takes its own.
"""

from __future__ import annotations

import base64
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _pieces, hashes, spans, text_bytes

#: Words of at most so many bytes are stepped together, in so many steps a chunk.
SHORT = 64


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces from a file of lines ``base64 rank``; read where the query is built."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    #: Edges: sorted keys node * 256 + byte, and where they lead.
    keys: np.ndarray
    to: np.ndarray
    #: Failure link (-1: none) and the pieces popped on it, by node; node 0 is the root.
    fail: np.ndarray
    pops: np.ndarray

    @staticmethod
    def build(vocabulary: list[bytes]) -> Automaton:
        goto: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                if b not in goto[node]:
                    goto[node][b] = len(goto)
                    goto.append({})
                    final.append(False)
                node = goto[node][b]
            final[node] = final[node] or bool(piece)
        fail, pops = [-1] * len(goto), [0] * len(goto)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in goto[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and b not in goto[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = goto[z][b], n
        pairs = sorted((u * 256 + b, v) for u, edges in enumerate(goto) for b, v in edges.items())
        return Automaton(np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32), np.array(fail, np.int32), np.array(pops, np.int32))

    def count(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word raw[start:end]; a word that cannot be matched is one unknown piece."""
        short = end - start <= SHORT
        total = np.zeros(len(start), np.int64)
        total[short] = self._count_together(raw, start[short], end[short])
        for i in np.flatnonzero(~short):
            total[i] = self._count_one(raw[start[i] : end[i]].tobytes())
        return total

    def _count_one(self, word: bytes) -> int:
        if not hasattr(self, "_scalar"):
            self._scalar = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        edges, fail, pops = self._scalar
        step, state, got = edges.get, 0, 0
        for b in b" " + word:
            to = step(state * 256 + b)
            while to is None:
                got += pops[state]
                state = fail[state]
                if state < 0:
                    return 1
                to = step(state * 256 + b)
            state = to
        while state > 0:
            got += pops[state]
            state = fail[state]
        return got if state == 0 else 1

    def _count_together(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(start)
        total = np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.ones(n, np.int64)
        size = end - start
        order = np.argsort(-size, kind="stable")
        first, size = start[order], size[order]
        state = np.zeros(n, np.int64)
        got = np.zeros(n, np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")
        for step in range(-1, int(size[0])):
            k = n if step < 0 else int(live[step])
            byte = np.full(k, 0x20, np.int64) if step < 0 else raw[first[:k] + step].astype(np.int64)
            todo = np.flatnonzero(state[:k] >= 0)
            while len(todo):
                s = state[todo]
                key = s * 256 + byte[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                state[todo[hit]] = self.to[at[hit]]
                todo = todo[~hit]
                s = s[~hit]
                got[todo] += self.pops[s]
                state[todo] = self.fail[s]
                todo = todo[state[todo] >= 0]
        todo = np.flatnonzero(state > 0)
        while len(todo):
            s = state[todo]
            got[todo] += self.pops[s]
            state[todo] = self.fail[s]
            todo = todo[state[todo] > 0]
        got[state < 0] = 1
        total[order] = got
        return total


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and 0x09-0x0D, their case as it is.  A null, empty or
    wordless text has no words and tokens.  Every different word of a chunk is matched once.
    The vocabulary's size is fixed, so is what is broadcast.  Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary))

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, at = text_bytes(batch.column("text"))
                words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for i, j, part, offsets in _pieces(raw, at):
                    start, end = spans(part, offsets)
                    _, one, inverse = np.unique(hashes(part, start, end, lower=False), return_index=True, return_inverse=True)
                    pieces = np.concatenate([[0], np.cumsum(shared.value.count(part, start[one], end[one])[inverse])])
                    edge = np.searchsorted(start, offsets)
                    words[i:j] += np.diff(edge)
                    tokens[i:j] += np.diff(pieces[edge])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
