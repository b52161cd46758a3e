"""Periodic runs of words: where a text says the same thing over and over.

A run is a maximal stretch of words with a smallest period q, here of at least
``min_words`` words and ``min_repeats`` periods. Every run starts a period with a Lyndon word
(under the order of words or its inverse), so the Lyndon arrays of both orders name
all candidates: position i with root length q = array[i]. Each array comes from the grouping phase of
Baier's suffix sorter: suffixes are grouped by their Lyndon prefix, groups are taken from
the highest down, and the nearest lower suffix left of each member moves to a new group
whose prefix is longer by the members behind it. A root becomes a run by extending it both
ways, with longest common extensions from a table of equal blocks (naming, exact, no hashes).

Before that, a vectorised cut keeps the stretches in which every word lies in a five-word window that its
document holds again: a run of six words and four periods has only such windows, so
nothing is lost. Parts of all texts in a block of documents are grouped in one go.

No shuffle: a task works through its documents in blocks of bounded text. A null or blank
text has no words and no runs; a text of any length is treated whole, in memory
proportional to n log n words; repeated rows get equal results; an empty table gives an empty result. Other
columns, whatever their names, are not read. A row without an id is treated like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import let, words_of
from posrecon.llm.tokens import batches_of

#: Words in the windows of the cut. Runs of ``CUT + 1`` words and four periods hold each of their windows twice.
CUT = 5
#: Bytes of text that are worked on together.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rules:
    min_words: int = CUT + 1
    min_repeats: int = 4

    def __post_init__(self):
        if self.min_words <= CUT or self.min_repeats < 4:
            raise ValueError(f"runs have more than {CUT} words and at least 4 periods")


PRODUCTION = Rules()


def lyndon_array(symbols, top: int):
    """Length of the longest Lyndon word at each position, by Baier's grouping.

    ``symbols`` are 0 to ``top``; the first and the last are 0, which is lower than all others
    and is no word (its entries stay 0).
    """
    import numpy as np

    s = np.asarray(symbols)
    places = np.argsort(s, kind="stable")
    ends = np.cumsum(np.bincount(s, minlength=top + 1)).tolist()
    listed = places.tolist()
    members = [listed[a:b] for a, b in zip([0, *ends], ends)]
    group = s.tolist()
    context = [1] * (top + 1)
    lower = list(range(-1, top))
    higher = list(range(1, top + 2))
    nearest = list(range(len(group)))  # itself, or somewhere left of it once its group was taken
    found = [0] * len(group)
    at = top
    while at > 0:
        held = [i for i in members[at] if group[i] == at]
        members[at] = ()
        if held:
            size = context[at]
            for i in held:
                found[i] = size
                nearest[i] = i - 1
            behind = {}
            for i in held:
                j = nearest[i]
                while nearest[j] != j:
                    nearest[j] = j = nearest[nearest[j]]
                nearest[i] = j
                behind[j] = behind.get(j, 0) + 1
            moved = {}
            for j, count in behind.items():
                if group[j]:
                    moved.setdefault((count, group[j]), []).append(j)
            for count, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new, above = len(context), higher[old]
                for j in moved[count, old]:
                    group[j] = new
                members.append(moved[count, old])
                context.append(context[old] + count * size)
                lower.append(old)
                higher.append(above)
                higher[old] = new
                lower[above] = new
        at = lower[at]
    return np.array(found, dtype=np.int64)


class Extensions:
    """Longest common extensions of pairs of positions, from names of equal blocks of 1, 2, 4, ... symbols."""

    def __init__(self, symbols):
        import numpy as np

        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        half = 1
        while 2 * half <= len(symbols):
            last = self.names[-1].astype(np.int64)
            kinds, names = np.unique(last[:-half] * len(symbols) + last[half:], return_inverse=True)
            self.names.append(names.astype(np.int32))
            if len(kinds) == len(names):
                break  # no block of this size occurs twice
            half *= 2

    def _extend(self, i, j, step):
        import numpy as np

        length = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            a, b = (i + length, j + length) if step > 0 else (i - length - size + 1, j - length - size + 1)
            inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            length += size * (inside & (names[a] == names[b]))
        return length

    def right(self, i, j):
        """Equal symbols from i and j on."""
        return self._extend(i, j, 1)

    def left(self, i, j):
        """Equal symbols up to i and j, these included."""
        return self._extend(i, j, -1)


def _cut(ids, doc):
    """Mask of the words in a window of ``CUT`` words that their document holds at least twice."""
    import numpy as np

    mask = np.zeros(len(ids), dtype=bool)
    if len(ids) <= CUT:
        return mask

    def named(a, b):
        return np.unique(a * (len(ids) + 1) + b, return_inverse=True)[1].astype(np.int64)

    one = named(doc, ids)
    two = named(one[:-1], one[1:])
    five = named(named(two[:-2], two[2:])[:-1], one[4:])
    again = (np.bincount(five)[five] > 1) & (doc[:-4] == doc[4:])
    for k in range(CUT):
        mask[k : k + len(again)] |= again
    return mask


def find_runs(texts_ids, rules: Rules = PRODUCTION):
    """For each list of word ids, its runs (start, length, period) by start and period."""
    import numpy as np

    sizes = np.array([len(x) for x in texts_ids], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    out = [[] for _ in texts_ids]
    ids = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(x, dtype=np.int64) for x in texts_ids)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kept = np.flatnonzero(_cut(ids, doc))
    if not len(kept):
        return out
    # Stretches of kept words of one document, each after a 0, and a last 0.
    fresh = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
    fresh = np.union1d(fresh, np.flatnonzero(np.diff(doc[kept], prepend=-1)))
    names = np.unique(ids[kept], return_inverse=True)[1].astype(np.int64) + 1
    symbols = np.append(np.insert(names, fresh, 0), 0)
    place = np.append(np.insert(kept, fresh, -1), -1)
    top = int(names.max())
    marks = symbols == 0
    unlike = symbols.copy()
    unlike[marks] = top + 1 + np.arange(marks.sum())
    same = Extensions(unlike)
    runs = []
    for order in (symbols, np.where(marks, 0, top + 1 - symbols)):
        roots = lyndon_array(order, top)
        i = np.flatnonzero((roots > 0) & (np.arange(len(roots)) + roots < len(roots)))
        q = roots[i]
        right, left = same.right(i, i + q), same.left(i - 1, i + q - 1)
        length = left + q + right
        good = (length >= rules.min_words) & (length >= rules.min_repeats * q)
        runs.append(np.stack([i[good] - left[good], q[good], length[good]], axis=1))
    for at, q, length in np.unique(np.concatenate(runs), axis=0).tolist():
        d = doc[place[at]]
        out[d].append((int(place[at] - begins[d]), length, q))
    return out


def _collapsed(words: list[bytes], runs) -> bytes:
    """The words outside the repetitions: the first period of each run stays."""
    if runs:
        import numpy as np

        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


SCHEMA = "id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = PRODUCTION
) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``runs`` (structs of start, length and period, by start
    and period; counted in words) and ``collapsed``, the text without the repetitions."""

    def run(batches):
        import itertools
        from collections import defaultdict

        import pyarrow as pa

        longs = pa.list_(pa.int64())
        kinds = {"starts": longs, "lengths": longs, "periods": longs, "collapsed": pa.binary()}
        names = ("id", "n_words", "starts", "lengths", "periods", "collapsed")
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

        def solved(block):
            number = defaultdict(itertools.count().__next__)
            ids = [list(map(number.__getitem__, words)) for _, words in block]
            for (key, words), runs in zip(block, find_runs(ids, rules)):
                starts, lengths, periods = zip(*runs) if runs else ((), (), ())
                yield key, len(words), starts, lengths, periods, _collapsed(words, runs)

        def rows():
            block, size = [], 0
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py() or b""
                    block.append((key, text.split()))
                    size += len(text)
                    if size >= BLOCK_BYTES:
                        yield from solved(block)
                        block, size = [], 0
            yield from solved(block)

        yield from batches_of(rows(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    runs = F.arrays_zip("starts", "lengths", "periods")
    return rows.mapInArrow(run, SCHEMA).select(
        "id", "n_words",
        F.transform(
            runs,
            lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")),
        ).alias("runs"),
        F.col("collapsed").cast("string").alias("collapsed"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` where one document in ten has a periodic end.

    With h = crc32 of the id and g = h div 10: where h % 10 = 0, words from a = g % n on repeat with the period
    1 + (n - a) div (3 + g % 8). Documents without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, F.when(i < a, i).otherwise(a + (i - a) % p) + 1)
        )
        return F.when(n > 0, F.array_join(moved, " "))

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return docs.select("doc_id", F.when(chosen, let(words_of(F.col("text")), planted)).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests per document, with planted runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = periodic_runs(with_planted_runs(docs)).withColumns({"best": best, "lines": lines})
    length, period = F.col("best.n"), -F.col("best.q")
    return told.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
