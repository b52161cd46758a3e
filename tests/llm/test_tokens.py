"""BPE and packing against the tokenizers library and brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from posrecon.llm import bpe, packing
from posrecon.llm.tokens import BYTE_BPE, WORD_BPE, WordCache, vocabulary

ODD = [
    "", "  ", "it's I'm don't we'LL <|endoftext|>x<|startoftext|> ok", "ÀÉ日本語 ﬁ １２３ İstanbul ΣΑΣ 😀😀 x y\x0b\u0085z",
    "a" * 300, "......!!!!????-----=====", "é ẋ̣", "'' '''s 's", "a\n\n\nb  \n c \t\t", "x\x1cy\xa0z !\x1c",
]


def random_texts(seed, n):
    rnd = random.Random(seed)
    wide = lambda: chr(rnd.choice([32, rnd.randint(32, 126), rnd.randint(0x80, 0x2FF), rnd.randint(0x370, 0x5FF), rnd.randint(0x3000, 0x9FFF), rnd.randint(0x1F300, 0x1F6FF)]))
    for k in range(n):
        size = rnd.randint(1, 200)
        yield "".join(rnd.choice("abcdeé  .,\n\t'1!") for _ in range(size)) if k % 2 else "".join(wide() for _ in range(size))


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *random_texts(1, 400)]


def test_bpe_equals_the_library(texts):
    mine, library = bpe.PrefixBpe(vocabulary(WORD_BPE)), Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = mine.encode(t)
        assert ids == struct.pack(f"<{len(want)}I", *want), t
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_words_of_the_vocabulary_equal_the_library():
    mine = bpe.PrefixBpe(vocabulary(WORD_BPE))
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for name in sorted(library.get_vocab())[::7]:
        word = name.removesuffix("</w>")
        want = library.encode(word, add_special_tokens=False).ids
        assert mine.encode(word) == struct.pack(f"<{len(want)}I", *want), word


def test_bpe_report(frame, edge):
    got = bpe.encoding_report(frame(edge, clash=True)).collect()
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))

    def digests(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r[0], *digests(r[1])) for r in edge)
    assert bpe.encoding_report(frame([])).count() == 0


def test_word_cache_is_bounded_and_keeps_words_in_use():
    calls = Counter()
    cache = WordCache(lambda w: calls.update([w]) or w.upper(), 10)
    for k in range(500):
        assert cache["often"] == "OFTEN" and cache[f"w{k}"] == f"W{k}"
    assert len(cache) + len(cache.old) <= 20 and calls["often"] == 1


@pytest.fixture(scope="module")
def byte_tokens():
    with open(public_tokenizers.path(packing.RANKS), "rb") as f:
        return packing.ByteTokens(f.read(), public_tokenizers.PATTERN)


def test_packing_ids_equal_the_library(texts, byte_tokens):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert byte_tokens(t)[0] == struct.pack(f"<{len(want)}I", *want), t


def cheapest(points, penalties, size, hard):
    """All positions, whole minima."""
    at = dict(zip(points, penalties))
    cost = [0] + [1 << 30] * points[-1]
    for a in range(1, len(cost)):
        for j in range(max(0, a - size), a):
            if a in at or a - j == size:
                cost[a] = min(cost[a], cost[j] + size - (a - j) + at.get(a, hard))
    return cost[-1]


def test_cuts_are_the_cheapest():
    rnd = random.Random(4)
    for _ in range(500):
        hard = rnd.randint(1, 9)
        p = packing.Packing(size=12, sentence_penalty=rnd.randint(0, hard), hard_penalty=hard)
        points = sorted(rnd.sample(range(1, 90), rnd.randint(1, 25)))
        penalties = [rnd.choice([0, p.sentence_penalty]) for _ in points]
        penalties[-1] = 0
        cuts, cost, before = packing.best_cuts(points, penalties, p, False), 0, 0
        for c in cuts:
            assert 0 < c - before <= 12
            cost += 12 - (c - before) + dict(zip(points, penalties)).get(c, hard)
            before = c
        assert before == points[-1] and cost == cheapest(points, penalties, 12, hard)
    with pytest.raises(ValueError):
        packing.Packing(sentence_penalty=9, hard_penalty=1)


def test_packing_pieces(frame, edge):
    rows = [*edge, *((100 + i, f"Sentence {i} is here. " * (i % 40)) for i in range(300))]
    got = packing.packing_report(frame(rows, clash=True)).collect()
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    ids = Counter(tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows)
    by_key = defaultdict(list)
    for r in rows:
        by_key[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 0])
    used = Counter()
    for r in got:
        doc = by_key[r.doc_id][0]
        assert r.doc_tokens == len(doc)
        assert zlib.crc32(struct.pack(f"<{r.length}I", *doc[r.start : r.start + r.length])) == r.ids_crc32
        used[r.doc_id] += r.length
    assert used == {k: sum(map(len, v)) for k, v in by_key.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding < 0.05 * sum(map(len, ids.elements()))
    assert packing.packing_report(frame([])).count() == 0


def test_blocks_change_no_content(byte_tokens):
    docs = [(k, *byte_tokens(f"Words and words {k}. " * (k % 70))) for k in range(200)]
    for block in (3000, 1 << 30):
        packer = packing.Packer(packing.Packing(size=64, block=block, waiting=4), 0)
        rows = [r for d in docs for r in packer.add(*d)] + list(packer.flush())
        for key, ids, _ in docs:
            assert b"".join(r[3] for r in rows if r[0] == key) == ids + b"\0\0\0\0"
