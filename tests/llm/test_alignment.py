"""Alignment of two vocabularies against brute force with the two libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from posrecon.llm import alignment as al
from tests.llm.test_tokens import ODD, random_texts

#: Byte-level vocabularies write bytes that are no printable Latin-1 characters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def groups(self, text):
        """[(A ids, B ids)] or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        in_a = [bytes(_BYTE[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = [self.b.id_to_piece(i) for i in b]
        in_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, in_b)]
        whole = (" " + text).encode()
        if b"".join(in_a) != whole or b"".join(in_b) != whole:
            return None
        out, i, j, at, bt = [], 0, 0, 0, 0
        first_i = first_j = 0
        while i < len(a) or j < len(b):
            if at <= bt:
                at, i = at + len(in_a[i]), i + 1
            else:
                bt, j = bt + len(in_b[j]), j + 1
            if at == bt and i > first_i and j > first_j:
                out.append((a[first_i:i], b[first_j:j]))
                first_i, first_j = i, j
        return out

    def report(self, rows):
        told = [(key, self.groups(text)) for key, text in rows]
        links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in told]
        docs = Counter(p for c in links for p in c)
        best = defaultdict(int)
        for (x, _), n in docs.items():
            best[x] = max(best[x], n)
        for (key, g), c in zip(told, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
            yield (
                key, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()),
                sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()),
                "" if g is None else hashlib.sha256(text.encode()).hexdigest(),
            )


@pytest.fixture(scope="module")
def brute():
    return Brute()


TEXTS = [*ODD, *random_texts(3, 250), "x▁y", "a\x00b", "<s> </s> <unk> <0x41>", "<|endoftext|> and <|endoftext|>", "q" * 700, "日本" * 300]


def test_report_equals_brute_force(frame, edge, brute):
    rows = [*edge, *((100 + k, t) for k, t in enumerate(TEXTS))]
    got = al.alignment_report(frame(rows, clash=True)).collect()
    assert Counter(map(tuple, got)) == Counter(brute.report([r[:2] for r in rows]))


def test_small_blocks_slices_and_large_groups(frame, brute, monkeypatch):
    with open(P.path(al.RANKS), "rb") as f, open(P.path(al.PIECES), "rb") as g:
        va, vb = al.byte_vocabulary(f.read(), P.PATTERN), al.piece_vocabulary(g.read())
    texts = [t for t in TEXTS if t]
    want_facts, want = al.align_block(texts, va, vb)
    monkeypatch.setattr(al, "SLICE", 7)
    monkeypatch.setattr(al, "LARGE_GROUP", 2)
    facts, got = al.align_block(texts, va, vb)
    assert facts == want_facts
    assert Counter(zip(*(x.tolist() for x in got))) == Counter(zip(*(x.tolist() for x in want)))
    assert (got[0][1:] >= got[0][:-1]).all()
    for k, t in enumerate(texts):
        groups = brute.groups(t)
        links = Counter((x, y) for a, b in groups or [] for x in a for y in b)
        mine = {divmod(int(p), len(vb.names)): int(n) for d, p, n in zip(*got) if d == k}
        assert mine == links


def test_link_counts_of_the_table(spark, brute):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = al.alignment_report(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(brute.report(rows))
    want = Counter(p for _, t in rows for p in {(x, y) for a, b in brute.groups(t) or [] for x in a for y in b})
    assert {(r.a, r.b): r.docs for r in al.link_counts(docs).collect()} == want


def test_groups_as_text(frame):
    row = al.aligned(frame([(1, "hello")]), keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and "|" in row.groups


def test_empty_table(frame):
    assert al.alignment_report(frame([])).count() == 0
    assert al.alignment_report(frame([(1, None)])).first()[1:7] == (0,) * 6
