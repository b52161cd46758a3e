"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last of its encoding. A
suffix-linked automaton of the vocabulary (Aho-Corasick) lists, at each position, the tokens that are
suffixes of the prefix; the right one starts where a prefix ends whose last token is
*compatible* with it, which means that the two tokens side by side encode to just
themselves. The last token of each prefix is stored, and following it back from the end
of the word gives the ids. Nothing is merged step by step.

Normalisation and the split into words are those of the vocabulary file, by the
tokenizers library. Its special tokens are found in the raw text first, as the library
does. Words recur, so a bounded cache per Python worker keeps their ids.

A null text counts as empty and gives no ids; texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from array import array

from pyspark.sql import DataFrame, functions as F

from posrecon.llm.tokens import WORD_BPE, WordCache, batches_of, once_per_worker, vocabulary

#: Words without anything that a pattern could split, and what may follow them.
_PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,;:!?]*)")
_NEVER = 1 << 60


class PrefixBpe:
    """Encoder and decoder of one vocabulary (the text of a tokenizers JSON file)."""

    def __init__(self, spec: str):
        import ahocorasick
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        library = Tokenizer.from_str(spec)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self.end_mark = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.names |= {i: t for t, i in specials.items()}
        self._special_ids = {t: array("I", [i]).tobytes() for t, i in specials.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left, right) -> (rank, merged token), and for each merged token its two parts.
        self._merge, self._parts, self._rank = {}, {}, {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._merge[left, right] = rank
            self._parts[whole], self._rank[whole] = (left, right), rank
        self._left, self._right, self._fits = {}, {}, {}
        self._automaton = ahocorasick.Automaton()
        self._whole = {}
        reachable: dict[int, bool] = {}
        for token in sorted(vocab.values(), key=lambda t: self._rank.get(t, -1)):
            parts = self._parts.get(token)
            reachable[token] = parts is None or (
                reachable[parts[0]] and reachable[parts[1]] and self._crossing(*parts) == self._rank[token]
            )
            if reachable[token]:
                symbols = self._symbols(self.names[token])
                self._automaton.add_word(symbols, (token, len(symbols)))
                self._whole[symbols] = token
        self._automaton.make_automaton()
        self._chunks = WordCache(self._encode_chunk, 300_000)

    def _symbols(self, name: str) -> str:
        """A letter of its own for a character that ends a word."""
        mark = self.end_mark
        if mark and name.endswith(mark) and name != mark:
            name = name[: -len(mark)]
            return name[:-1] + chr(0xF0000 + ord(name[-1]))
        return name

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one border of a token while it is merged, each with the rank that ends it."""
        held = (self._left, self._right)[side]
        if token not in held:
            parts = self._parts.get(token)
            if parts is None:
                held[token] = [(token, _NEVER)]
            else:
                inner = self._spine(parts[side], side)
                held[token] = [*inner[:-1], (inner[-1][0], self._rank[token]), (token, _NEVER)]
        return held[token]

    def _crossing(self, left: int, right: int) -> int:
        """Rank of the first merge across the border of two tokens, ``_NEVER`` if none is made."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self._merge.get((x, y), _NEVER)
            # Equal ranks go from left to right.
            if across < x_ends and across <= y_ends and across < _NEVER:
                return across
            if x_ends == y_ends == _NEVER:
                return _NEVER
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _compatible(self, left: int, right: int, key: int) -> bool:
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        found = self._fits[key] = self._crossing(left, right) == _NEVER
        return found

    def _encode_word(self, word: str) -> bytes:
        """Ids of one word of the splitter (in the letters of the vocabulary)."""
        symbols = word
        if self.end_mark:
            symbols = word[:-1] + chr(0xF0000 + ord(word[-1]))
        whole = self._whole.get(symbols)
        if whole is not None:
            return array("I", [whole]).tobytes()
        n = len(symbols)
        last = [-1] * (n + 1)
        start_of = [0] * (n + 1)
        fits = self._fits
        for end, (token, length) in self._automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                fit = fits.get(key)
                if fit is None:
                    fit = self._compatible(before, token, key)
                if not fit:
                    continue
            last[end], start_of[end] = token, start
        if last[n] < 0:
            raise ValueError(f"no encoding of {word!r}: the vocabulary lacks a character")
        ids = array("I")
        while n:
            ids.append(last[n])
            n = start_of[n]
        ids.reverse()
        return ids.tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return b"".join([self._encode_word(w) for w, _ in self._split(chunk)])
        word, rest = plain.groups()
        if rest:
            return self._chunks[word] + self._encode_word(rest)
        return self._encode_word(word if word.isascii() else "".join([_LETTER[b] for b in word.encode()]))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self._special.split(text or "")):
            if k % 2:
                out.append(self._special_ids[part])
            elif part:
                # White space is one blank each after normalisation and never inside a word.
                out.append(b"".join(map(self._chunks.__getitem__, self._normalize(part).split(" "))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token names joined by blanks: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def _letter_table() -> dict[int, str]:
    """Byte-level vocabularies write byte b as one printable character (public rule)."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


_LETTER = _letter_table()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: str | None = None) -> DataFrame:
    """(id, ids, decoded): ids as little-endian 32-bit integers, and their decoding."""
    shared = docs.sparkSession.sparkContext.broadcast(spec if spec is not None else vocabulary(WORD_BPE))

    def run(batches):
        import pyarrow as pa

        text = shared.value
        bpe = once_per_worker(("bpe", hash(text)), lambda: PrefixBpe(text))
        schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

        def rows():
            for batch in batches:
                for key, doc in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = bpe.encode(doc.as_py())
                    yield key, ids, bpe.decode(ids)

        yield from batches_of(rows(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string")


def encoding_report(docs: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded text of every row."""
    return encoded(docs).select(
        F.col("id").alias("doc_id"),
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
