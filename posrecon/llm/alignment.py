"""Aligning the tokens of two vocabularies, and counting which of them mean the same.

A text is encoded twice, by a byte-level BPE (A) and a sentence-piece BPE (B). Where a token of A
and one of B end at the same byte of the same document, a group ends. All tokens of A in a
group are linked with all of B in it. A pair of ids counts in how many documents of the corpus
it is linked; a document is told how its links stand in that count.

Blocks of documents are Arrow tables in a task. Id lists are flattened with their parent indices; byte ends are
cumulative sums of token lengths, counted from where the document begins; an Acero hash join on
(document, end) finds the borders of the groups. Table.group_by reduces links to one row per document and
pair, and those to one row per block and pair, which is what Spark adds up for the whole corpus. The sums go
back to blocks (one row per block and pair, never per document and pair) and meet their documents there.

What goes through shuffles: the distinct pairs of each block twice, the coded links of each document once. No pair
has more than one row per block. The best count per A id is at most as long as the vocabulary
and is sent to every task. Groups of many tokens are reduced to distinct ids with counts before
pairs are formed, and those in slices.

A null or empty text, or one that B changes (its joined tokens are not the text), has no tokens: zeros and an empty
digest. Texts of any length are aligned whole. Repeated rows count as documents of
their own; a null id is an id like others; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, functions as F

from posrecon.llm.common import saved
from posrecon.llm.tokens import once_per_worker

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Bytes of text in a block, links formed at a time, and links of a group from which its ids are counted first.
BLOCK_BYTES = 2 << 20
SLICE = 2 << 20
LARGE_GROUP = 1024


class Vocabulary:
    """Encoder of one vocabulary, with the bytes, their number and the decimal name of each id."""

    def __init__(self, encode, pieces: list[bytes]):
        import pyarrow as pa

        self.encode = encode
        self.pieces = pa.array(pieces, pa.binary())
        self.lengths = pa.array([len(p) for p in pieces], pa.int64())
        self.names = pa.array([str(i) for i in range(len(pieces))], pa.string())


def byte_vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """Texts get a space in front; strings of special tokens are plain text."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encode = tiktoken.Encoding("aligning", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    pieces = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        pieces[i] = piece
    return Vocabulary(lambda texts: [encode(" " + t) for t in texts], pieces)


def piece_vocabulary(model: bytes) -> Vocabulary:
    """The model adds the space in front itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [
        bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
        for i in range(library.get_piece_size())
    ]
    return Vocabulary(lambda texts: library.encode(texts, num_threads=1), pieces)


def _lists(ids):
    """Lists of ids as one Arrow array."""
    import itertools

    import numpy as np
    import pyarrow as pa

    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))


def _joined(lists, strings, separator):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.ListArray.from_arrays(lists, strings), separator)


class Tokens:
    """The tokens of a block of documents in one vocabulary."""

    def __init__(self, lists, vocabulary: Vocabulary):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.ids = lists.flatten()
        self.doc = pc.list_parent_indices(lists)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        total = pc.cumulative_sum(pc.take(vocabulary.lengths, self.ids))
        upto = np.append(0, total.to_numpy())
        begins = pa.array(upto[np.append(0, np.cumsum(self.sizes))[:-1]])
        end = pc.subtract(total, pc.take(begins, self.doc))
        self.key = pc.add(pc.multiply(self.doc.cast(pa.int64()), pa.scalar(1 << 32, pa.int64())), end)

    def table(self, place: str):
        import numpy as np
        import pyarrow as pa

        return pa.table({"key": self.key, place: pa.array(np.arange(len(self.key)))})


def _counted(ids, group, large):
    """Ids with their group and how often each stands there; those of large groups once."""
    import numpy as np
    import pyarrow as pa

    ids, ones = ids.to_numpy().astype(np.int64), np.ones(len(group), dtype=np.int64)
    many = large[group]
    if not many.any():
        return ids, group, ones
    told = pa.table({"g": group[many], "id": ids[many]}).group_by(["g", "id"], use_threads=False).aggregate([([], "count_all")])
    few = ~many
    group = np.append(group[few], told["g"].to_numpy())
    order = np.argsort(group, kind="stable")
    return (
        np.append(ids[few], told["id"].to_numpy())[order], group[order],
        np.append(ones[few], told["count_all"].to_numpy())[order],
    )


def _added(key, links):
    import pyarrow as pa

    told = pa.table({"key": key, "links": links}).group_by("key", use_threads=False).aggregate([("links", "sum")])
    return told["key"].to_numpy(), told["links_sum"].to_numpy()


def _links(a: Tokens, b: Tokens, group_a, group_b, doc_of_group, n_b: int):
    """(document << 32 | A id * n_b + B id) and the number of links, one row per document and pair, by document."""
    import numpy as np

    n_groups = len(doc_of_group)
    sizes_a, sizes_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    large = sizes_a * sizes_b > LARGE_GROUP
    ids_a, group_a, times_a = _counted(a.ids, group_a, large)
    ids_b, group_b, times_b = _counted(b.ids, group_b, large)
    held = np.bincount(group_b, minlength=n_groups)
    first = np.cumsum(held) - held
    partners, slices = held[group_a], []
    upto = np.cumsum(partners)
    at = 0
    while at < len(ids_a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
        n = partners[at:end]
        left = np.repeat(np.arange(at, end), n)
        right = first[group_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        key = (doc_of_group[group_a[left]] << 32) + ids_a[left] * n_b + ids_b[right]
        slices.append(_added(key, times_a[left] * times_b[right]))
        at = end
    if not slices:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes_a * sizes_b
    key, links = (np.concatenate(x) for x in zip(*slices))
    if len(slices) > 1:
        key, links = _added(key, links)
    order = np.argsort(key >> 32, kind="stable")
    return key[order], links[order], sizes_a * sizes_b


def align_block(texts: list[str], va: Vocabulary, vb: Vocabulary):
    """Per text the counts of tokens, groups and links and the groups as text (None without tokens), and the
    document, pair and number of links of every row of a document and pair."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not texts:
        return [], (np.zeros(0, np.int64),) * 3
    lists = [_lists(v.encode(texts)) for v in (va, vb)]
    plain = pa.array([b" " + t.encode() for t in texts], pa.binary())
    good = pa.array([bool(t) for t in texts])
    for ids, v in zip(lists, (va, vb)):
        good = pc.and_(good, pc.equal(_joined(ids.offsets, pc.take(v.pieces, ids.values), b""), plain))
    kept = np.flatnonzero(good.to_numpy(zero_copy_only=False))
    a, b = (Tokens(pc.take(x, pa.array(kept)), v) for x, v in zip(lists, (va, vb)))
    borders = a.table("a").join(b.table("b"), keys="key", join_type="inner", use_threads=False).sort_by("a")
    ends = [borders[c].to_numpy() for c in ("a", "b")]
    doc_of_group = (borders["key"].to_numpy() >> 32).astype(np.int64)
    group_a, group_b = (np.repeat(np.arange(len(e)), np.diff(e, prepend=-1)) for e in ends)
    key, links, n_links = _links(a, b, group_a, group_b, doc_of_group, len(vb.names))
    offsets = [pa.array(np.append(0, e + 1), pa.int32()) for e in ends]
    told = [_joined(o, pc.take(v.names, x.ids), ",") for o, v, x in zip(offsets, (va, vb), (a, b))]
    n_groups = np.bincount(doc_of_group, minlength=len(kept))
    of_doc = pa.array(np.append(0, np.cumsum(n_groups)), pa.int32())
    groups = _joined(of_doc, pc.binary_join_element_wise(*told, "|"), ";").to_pylist()
    all_links = np.bincount(doc_of_group, weights=n_links, minlength=len(kept)).astype(np.int64)
    facts = [(0, 0, 0, 0, None)] * len(texts)
    for k, i in enumerate(kept.tolist()):
        facts[i] = (int(a.sizes[k]), int(b.sizes[k]), int(n_groups[k]), int(all_links[k]), groups[k])
    return facts, (kept[key >> 32], key & 0xFFFFFFFF, links)


FACTS = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string"
CODED = f"block long, {FACTS}, at binary, links binary, pairs array<int>, docs array<int>"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per document, with its distinct pairs as places in the block's list (``at``, 32-bit) and links
    of each (``links``, 8 or 64 bits), and one row per block with that list (``pairs``) and its counts of documents."""
    import public_tokenizers

    files = []
    for name in (RANKS, PIECES):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast((*files, public_tokenizers.PATTERN))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ranks, model, pattern = shared.value
        va, vb = once_per_worker(
            ("aligning", hash(ranks), hash(model)), lambda: (byte_vocabulary(ranks, pattern), piece_vocabulary(model))
        )
        ints, longs = pa.list_(pa.int32()), pa.int64()
        schema = pa.schema([
            ("block", longs), ("id", longs), ("n_a", longs), ("n_b", longs), ("n_groups", longs), ("n_links", longs),
            ("groups", pa.string()), ("groups_sha256", pa.string()), ("at", pa.binary()), ("links", pa.binary()),
            ("pairs", ints), ("docs", ints),
        ])
        number = TaskContext.get().partitionId() << 32

        def aligned(keys, texts):
            facts, (doc, pair, links) = align_block(texts, va, vb)
            told = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            pairs = told["pair"].to_numpy()
            at = np.searchsorted(pairs, pair).astype("<i4")
            stops = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
            rows, start = [], 0
            for key, (n_a, n_b, n_groups, n_links, groups), stop in zip(keys, facts, stops):
                mine = links[start:stop]
                mine = mine.astype("u1" if not len(mine) or mine.max() < 256 else "<i8").tobytes()
                sha = "" if groups is None else hashlib.sha256(groups.encode()).hexdigest()
                rows.append((number, key, n_a, n_b, n_groups, n_links, groups if keep_groups else None, sha, at[start:stop].tobytes(), mine, None, None))
                start = stop
            rows.append((number, *(None,) * 9, pairs.astype(np.int32), told["count_all"].to_numpy().astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield aligned(keys, texts)
                    keys, texts, size, number = [], [], 0, number + 1
        if keys:
            yield aligned(keys, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CODED)


def _block_pairs(coded: DataFrame) -> DataFrame:
    told = coded.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    return told.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").cast("long").alias("docs"))


def _pair_counts(coded: DataFrame, n_b: int) -> DataFrame:
    """``a``, ``b``, ``pair`` and ``docs``: in how many documents each pair of ids is linked."""
    a = F.floor(F.col("pair") / n_b).cast("int")
    totals = _block_pairs(coded).groupBy("pair").agg(F.sum("docs").alias("docs"))
    return totals.select(a.alias("a"), (F.col("pair") % n_b).alias("b"), "pair", "docs")


def _piece_count() -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES)).get_piece_size()


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus-wide table of linked ids: ``a``, ``b``, ``docs``."""
    return _pair_counts(encoded(docs, id_col, text_col), _piece_count()).select("a", "b", "docs")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per document: counts, ``n_best``, ``count_sum``, the digest of its groups, and on demand
    the groups themselves as text."""
    coded = saved(encoded(docs, id_col, text_col, keep_groups))
    totals = saved(_pair_counts(coded, _piece_count()))
    best = totals.groupBy("a").agg(F.max("docs").alias("best"))
    # One row per id of A: never more than its vocabulary has.
    stands = totals.join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("best")).alias("is_best"))
    back = _block_pairs(coded).drop("docs").join(stands, "pair")
    back = back.select(F.col("block").alias("of_block"), "place", "docs", "is_best")
    facts = [c.split()[0] for c in FACTS.split(", ")]

    def summed(documents, pairs):
        import numpy as np
        import pyarrow as pa

        docs, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        place = pairs["place"].to_numpy()
        docs[place], best[place] = pairs["docs"].to_numpy(), pairs["is_best"].to_numpy().astype(np.int64)
        sums = []
        for at, links in zip(documents["at"].to_pylist(), documents["links"].to_pylist()):
            at = np.frombuffer(at, "<i4")
            links = np.frombuffer(links, "u1" if len(links) == len(at) else "<i8").astype(np.int64)
            sums.append((int(links @ best[at]), int(links @ docs[at])))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        out = documents.select(facts)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    rows = coded.where(F.col("pairs").isNull()).select("block", *facts, "at", "links")
    both = rows.groupBy("block").cogroup(back.groupBy("of_block"))
    return both.applyInArrow(summed, f"{FACTS}, n_best long, count_sum long")


def alignment_report(docs: DataFrame) -> DataFrame:
    return aligned(docs).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
