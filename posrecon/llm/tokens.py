"""What the token operators share: vocabulary files and word caches in Python workers."""

from __future__ import annotations

from collections.abc import Callable

#: Names of the vocabulary files; their folder is a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """The text of a public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class WordCache(dict):
    """Results per word: recent words in the dict itself, the generation before in ``old``.

    It holds at most twice ``size`` words, and words in use stay.
    """

    def __init__(self, compute: Callable, size: int = 200_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(word) < 200:
            self[word] = found
        return found


_BUILT: dict = {}


def once_per_worker(key, build: Callable):
    """A value that one Python worker builds once and keeps for later tasks; one per kind."""
    kind = key[0]
    if _BUILT.get(kind, (None, None))[0] != key:
        _BUILT[kind] = (key, build())
    return _BUILT[kind][1]


def batches_of(rows, schema, limit: int = 8 << 20):
    """Arrow batches of rows (tuples), closed when about ``limit`` bytes are in."""
    import pyarrow as pa

    def batch(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)
