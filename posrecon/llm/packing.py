"""Packing documents into training sequences, in order, by dynamic programming.

Each task reads its documents in order as one stream of token ids. Cuts are chosen at
document ends, at sentence ends, or, where neither is near, after exactly ``size``
tokens. The cost of a window is its padding plus a penalty for a cut inside a document
(small at a sentence end, larger elsewhere). The best cost of ending a window at position
``p`` is ``min(cost[j] + j) + size - p + penalty(p)`` over the nodes ``j`` that lie at
most ``size`` back, and that minimum is the front of a monotone queue. A node that
leaves the queue at its front gives the node ``size`` tokens further on, the full window;
nodes that a later one beats need none. The stream is decided block by block: the last
windows of a block wait for the next one. What remains at the end of a task may be split
into powers of two, which need no padding.

Ids are those of the byte-level vocabulary, with the end-of-text string of a text read as
that token (as the tokenizers library does), and a separator id after every document.

A null text counts as empty (just the separator). Documents of any length are cut over
several windows. Repeated rows are packed like any others. A task without rows gives no
sequences. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from posrecon.llm.tokens import WordCache, batches_of, once_per_worker


@dataclass(frozen=True)
class Packing:
    size: int = 1024
    separator: int = 0
    sentence_penalty: int = 2
    hard_penalty: int = 14
    #: Tokens decided at a time, and windows that wait for the next block.
    block: int = 262_144
    waiting: int = 16

    def __post_init__(self):
        # Else a node that a later one beats could still be needed.
        if not 0 <= self.sentence_penalty <= self.hard_penalty:
            raise ValueError("a cut at a sentence end must not cost more than any other")


PRODUCTION = Packing()
RANKS = "byte_bpe_50k.tiktoken"
#: The special token of the vocabulary and its id, and the white space of its splitter.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_PLAIN = re.compile("([ \n]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]+)")


class ByteTokens:
    """Ids of a text and the positions where sentences end."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encode = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        ).encode_ordinary
        self._ids = WordCache(self._word, 600_000)

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            return self._ids[plain[1]] + self._ids[plain[2]]
        return array("I", self._encode(word)).tobytes()

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        import numpy as np

        out, ends, total = [], [], 0
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(array("I", [SPECIAL_ID]).tobytes())
                total += 1
            # White space goes with the word after it: the splitter never joins across its front.
            words = _WORD.findall(part)
            if not words:
                continue
            ids = list(map(self._ids.__getitem__, words))
            upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4 + total
            stop = np.fromiter([w[-1] in ".!?" for w in words], bool, len(words))
            stop[:-1] |= np.fromiter([w[0] == "\n" for w in words], bool, len(words))[1:]
            ends.extend(upto[stop].tolist())
            out.extend(ids)
            total = int(upto[-1])
        return b"".join(out), ends


def best_cuts(points, penalties, p: Packing, final: bool) -> list[int]:
    """Cut positions of a stream that starts at 0 and ends at the last of ``points``."""
    size, hard = p.size, p.hard_penalty
    pos, cost, back = [0], [0], [-1]
    queue = deque([(0, 0)])  # (cost + position, node), least first

    def add(at: int, c: int, before: int) -> None:
        pos.append(at)
        cost.append(c)
        back.append(before)
        v = c + at
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, len(pos) - 1))

    for at, penalty in zip(points, penalties):
        while pos[queue[0][1]] + size < at:
            _, f = queue.popleft()
            if pos[-1] < pos[f] + size:
                add(pos[f] + size, cost[f] + hard, f)
        v, f = queue[0]
        add(at, v + size - at + penalty, f)
    node = len(pos) - 1
    end = pos[node]
    tail: list[int] = []
    if final:
        # The rest after node j: one padded window, or its binary digits.
        def ending(j: int) -> tuple[int, int]:
            digits = (end - pos[j]).bit_count()
            split = hard * (digits - 1)
            return cost[j] + (split if digits == 1 else min(split, size - end + pos[j])), -j

        j = node - 1
        reach = []
        while j >= 0 and end - pos[j] <= size:
            reach.append(j)
            j -= 1
        j = min(reach, key=ending)
        rest = end - pos[j]
        tail = [end]
        if rest.bit_count() > 1 and hard * (rest.bit_count() - 1) < size - rest:
            tail, at = [], pos[j]
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    at += 1 << bit
                    tail.append(at)
        node = j
    cuts = []
    while node > 0:
        cuts.append(pos[node])
        node = back[node]
    return cuts[::-1] + tail


class Packer:
    """Pieces of a stream of documents: (key, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, p: Packing, first_sequence: int):
        self.p, self.sequence = p, first_sequence
        self.docs: list = []  # (key, ids, ends, total tokens, start of what is held)
        self.held = 0

    def add(self, key, ids: bytes, ends: list[int]):
        ids += array("I", [self.p.separator]).tobytes()
        n = len(ids) // 4
        self.docs.append((key, ids, ends, n, 0))
        self.held += n
        if self.held >= self.p.block:
            yield from self.flush(final=False)

    def flush(self, final: bool = True):
        if not self.docs:
            return
        p = self.p
        points, penalties, at = [], [], 0
        for _, ids, ends, n, start in self.docs:
            inner = [at + e - start for e in ends if start < e < n]
            points += inner
            penalties += [p.sentence_penalty] * len(inner)
            at += n - start
            points.append(at)
            penalties.append(0)
        cuts = best_cuts(points, penalties, p, final)
        if not final:
            cuts = [c for c in cuts if c <= at - p.waiting * p.size]
        docs, k, before = self.docs, 0, 0
        key, ids, ends, n, start = docs[0]
        for cut in cuts:
            offset = 0
            while before < cut:
                length = min(cut - before, n - start)
                yield key, start, length, ids[4 * start : 4 * (start + length)], n, self.sequence, offset
                before, offset, start = before + length, offset + length, start + length
                if start == n:
                    k += 1
                    if k < len(docs):
                        key, ids, ends, n, start = docs[k]
            self.sequence += 1
        self.docs = [(key, ids, ends, n, start), *docs[k + 1 :]] if k < len(docs) else []
        self.held = at - before


SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Packing = PRODUCTION, ranks: bytes | None = None) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    No shuffle: a task packs the documents of its partition; sequence ids hold its number.
    """
    import public_tokenizers

    if ranks is None:
        with open(public_tokenizers.path(RANKS), "rb") as f:
            ranks = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, public_tokenizers.PATTERN))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        table, pattern = shared.value
        tokens = once_per_worker(("bytes", hash(table)), lambda: ByteTokens(table, pattern))
        packer = Packer(p, TaskContext.get().partitionId() << 36)
        kinds = {"ids": pa.binary()}
        names = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from packer.add(key, *tokens(text.as_py() or ""))
            yield from packer.flush()

        yield from batches_of(rows(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def packing_report(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with a checksum of their ids."""
    return packed(docs).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
