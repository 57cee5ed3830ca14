"""Encoding with a public byte-level BPE vocabulary by backtracking over longest matches.

A text is cut into pieces by the vocabulary's pattern. Within a piece, an Aho-Corasick automaton over all tokens gives the longest
token that starts at each byte; the encoder takes it if the last token and it are compatible, that is if merging their
bytes by rank would give just these two; otherwise it tries the next shorter token or steps back. Any sequence whose neighbours are
all compatible is the sequence that merging by rank gives, so the result is exact, in linear time: each byte position fails at most
once. Compatibility is found from the merge table and kept. Pieces repeat (Zipf), so their ids are kept in a bounded table.

Decoding joins slices of one byte string by an offset table.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies; a parameter of every function here.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MANY = 1 << 30


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as letters: printable ones as themselves, the others as letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + k)] = b
    return out


class ByteBpe:
    """A byte-level BPE vocabulary in the JSON form of the `tokenizers` library, without its special tokens."""

    def __init__(self, path: str, pattern: str = PATTERN, kept_pieces: int = 200_000):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        vocab, merges = model["vocab"], model["merges"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        base = {as_bytes[t]: i for t, i in vocab.items() if t in as_bytes and len(as_bytes[t]) == 1}
        self.pair: dict[tuple[int, int], int] = {}
        split: dict[int, tuple[int, int]] = {i: (i, i) for i in base.values()}
        known = set(base.values())
        for m in merges:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = z
            split.setdefault(z, (x, y))
            known.add(z)
        # Ids rise with merge rank; the backtracking test relies on it.
        self.token = {i: as_bytes[t] for t, i in vocab.items() if i in known}
        size = max(self.token) + 1
        self.left, self.right = [split.get(i, (i, i))[0] for i in range(size)], [split.get(i, (i, i))[1] for i in range(size)]
        self.length = [len(self.token.get(i, b"")) for i in range(size)]
        self.by_text = {v.decode("latin-1"): i for i, v in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(i) for i in range(size)]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.findall = regex.compile(pattern).findall
        self.kept, self.kept_pieces = {}, kept_pieces
        flat = [self.token.get(i, b"") for i in range(size)]
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in flat])])

    def _shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i, or -1."""
        t = self.token.get(i, b"").decode("latin-1")
        for n in range(len(t) - 1, 0, -1):
            if (j := self.by_text.get(t[:n])) is not None:
                return j
        return -1

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b by rank leaves a and b apart: no merge across their border comes before the
        merges that build them."""
        if (known := self.compatible.get((a, b))) is not None:
            return known
        key, limit, out = (a, b), _MANY, True
        while True:
            merged = self.pair.get((a, b))
            if merged is not None and merged < limit:
                out = False
                break
            # Undo the later of the two last merges and look at the border again.
            if a > b:
                limit = a
                a = self.right[a]
                if a == limit:
                    limit = b + 1
                    b = self.left[b]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = self.left[b]
                if b + 1 == limit:
                    limit = a
                    a = self.right[a]
                    if a == limit:
                        break
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = out
        return out

    def piece(self, text: str) -> list[int]:
        """Ids of one piece (bytes as latin-1 text)."""
        if (whole := self.by_text.get(text)) is not None and self.shorter[whole] == -1:
            return [whole]
        n = len(text)
        longest = [-1] * n
        size = [0] * n
        for end, (k, i) in self.automaton.iter(text):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, i
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token, length, shorter, fits = 0, longest[0], self.length, self.shorter, self.fits
        while True:
            end = at + length[token]
            if open_[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept, extend = self.kept, out.extend
        for w in self.findall(text):
            ids = kept.get(w)
            if ids is None:
                ids = self.piece(w.encode("utf-8", "replace").decode("latin-1"))
                if len(w) <= 64:
                    if len(kept) >= self.kept_pieces:
                        kept.clear()
                    kept[w] = ids
            extend(ids)
        return out

    def decode_bytes(self, ids) -> bytes:
        """The bytes of a sequence of ids: slices of one byte string, gathered at once."""
        i = np.asarray(ids, dtype=np.int64)
        if not len(i):
            return b""
        start, length = self.offset[i], self.offset[i + 1] - self.offset[i]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(start, length)
        return self.bytes[at].tobytes()


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary, built once in a worker process."""
    kept = sys.__dict__.setdefault("_quakespark_vocabularies", {})
    if path not in kept:
        kept[path] = ByteBpe(path)
    return kept[path]


def encode_texts(df: DataFrame, key: str, text: str, *, path: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list, blank texts the ids of their white space. Texts are never cut, whatever their length.
    Each row gives a row, repeated ones too; null keys stay. Empty tables give an empty result. Narrow: nothing is shuffled; only key
    and text are read.
    """
    kind = df.schema[key].dataType
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField(key, kind), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(out)

    def encode(batches):
        v = vocabulary(path)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column(1):
                t = t.as_py()
                if t:
                    flat.extend(v.encode(t))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(arrow.field(1).type)], schema=arrow)

    return df.select(df[key], df[text].cast("string")).mapInArrow(encode, out)


def decode_texts(df: DataFrame, key: str, ids: str, *, path: str = BYTE_BPE_50K, text: str = "text") -> DataFrame:
    """(key, text) of token ids; bytes that are no UTF-8 become U+FFFD. A null list gives a null text, an empty one an empty text."""
    from pyspark.sql import types as T

    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(text, T.StringType())])

    def decode(batches):
        v = vocabulary(path)
        for b in batches:
            got = [None if (x := i.as_py()) is None else v.decode_bytes(x).decode("utf-8", "replace") for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=[key, text])

    return df.select(df[key], df[ids]).mapInArrow(decode, out)
