"""Evaluation passages inside a corpus: suffix arrays over the corpus, searched with every suffix of the test items.

Each partition of the corpus is made into shards of a bounded number of words (a document is never cut). A shard's suffixes are sorted by
prefix doubling, whatever the test items are; every suffix of every test item is found by binary search, word after word, and each hit that goes
on no further to the left is extended to the right, which gives the longest verbatim matches and their places. All documents are read whole;
none is skipped for its size or source. Shards can be stored and searched again with other items (`build_index`, `search_index`); `find_leaks` searches
each shard as soon as it is sorted and stores nothing while the items fit one pass, and stores the index where they need several.

Scale. Narrow over the corpus: what is shuffled is one row a leaking (document, item) and partition. The test items are broadcast in
chunks of at most `chunk_chars` characters. Hits are taken in blocks of bounded size, also those of a single passage that is in every document.
An index takes about as many bytes as the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.common import Scratch

#: A word is a longest run of letters or digits.
WORD = r"[^\W_]+"
#: Words to which suffixes are sorted; longer passages are compared word by word.
DEPTH = 16


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; none for null."""
    return re.findall(WORD, text.lower()) if text else []


class _Numbers(dict):
    """A 63-bit number above 0 for each word, the same in every process; two words of a corpus share one by chance only."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 or 1
        return n


class Shard:
    """Documents as one row of words (numbers in a sorted vocabulary, 0 at a document's end), and the order of its suffixes."""

    def __init__(self, keys, starts: np.ndarray, vocabulary: np.ndarray, ids: np.ndarray, suffixes: np.ndarray):
        self.keys, self.starts, self.vocabulary, self.ids, self.suffixes = keys, starts, vocabulary, ids, suffixes


def sort_shard(keys: list, texts: list[np.ndarray]) -> Shard:
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    hashes = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int64))])
    vocabulary, ids = np.unique(hashes, return_inverse=True)  # 0 is the first
    rank, size, n = ids, 1, len(ids)
    while size < DEPTH:
        behind = np.zeros(n, np.int64)
        behind[: n - size] = rank[size:] + 1 if size < n else 0
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if rank[order[-1]] == n - 1:  # all apart
            break
    return Shard(keys, starts, vocabulary, ids.astype(np.int32), order.astype(np.int32))


class _Items:
    def __init__(self, rows: list[tuple], min_words: int):
        number = _Numbers()
        texts = [(k, [number[w] for w in words(t)]) for k, t in rows if k is not None]
        texts = [(k, w) for k, w in texts if len(w) >= min_words]
        self.keys = [k for k, _ in texts]
        length = np.array([len(w) for _, w in texts], np.int64)
        self.hashes = np.array([x for _, w in texts for x in (*w, 0)], np.int64)
        self.item = np.repeat(np.arange(len(texts)), length + 1)
        self.at = np.arange(len(self.hashes)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
        self.starts = np.flatnonzero(self.at <= (length - min_words)[self.item]) if len(texts) else np.zeros(0, np.int64)


def _narrow(column, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """First place from low to high (each its own) whose number is at least `wanted`, or above it."""
    low, high = low.copy(), high.copy()
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo]) >> 1
        x = column(mid)
        right = x <= wanted[todo] if after else x < wanted[todo]
        low[todo[right]] = mid[right] + 1
        high[todo[~right]] = mid[~right]
    return low


def search_shard(shard: Shard, items: _Items, min_words: int, hits_at_once: int = 1_000_000):
    """Longest matches in a shard: arrays (doc, item, words, place in doc, place in item), one for each (doc, item)."""
    best = [np.zeros(0, np.int64)] * 5
    if not len(items.starts) or len(shard.vocabulary) < 2:
        return best
    # Words of the items as numbers of the shard, -1 where it has none.
    where = np.minimum(np.searchsorted(shard.vocabulary, items.hashes), len(shard.vocabulary) - 1)
    test = np.where((shard.vocabulary[where] == items.hashes) & (items.hashes > 0), where, -1)
    depth = min(min_words, DEPTH)
    missing = np.concatenate([[0], np.cumsum(test < 0)])
    q = items.starts[missing[items.starts + depth] == missing[items.starts]]
    text = np.concatenate([shard.ids.astype(np.int64), np.full(DEPTH, -2)])
    test = np.concatenate([test, np.full(DEPTH, -1)])
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(shard.suffixes), np.int64)
    for k in range(depth):  # suffixes from low to high begin with the k words before
        column = lambda at, k=k: text[shard.suffixes[at] + k]
        low, high = _narrow(column, low, high, test[q + k], False), _narrow(column, low, high, test[q + k], True)
        keep = low < high
        q, low, high = q[keep], low[keep], high[keep]
    upto = np.cumsum(high - low)
    total = int(upto[-1]) if len(upto) else 0
    for a in range(0, total, hits_at_once):
        n = np.arange(a, min(a + hits_at_once, total))
        of = np.searchsorted(upto, n, "right")
        p, s = shard.suffixes[high[of] - (upto[of] - n)].astype(np.int64), q[of]
        # Only where a match begins: the words before differ (ends of documents and items differ from all).
        first = (p == 0) | (s == 0) | (text[p - 1] != test[s - 1])
        p, s = p[first], s[first]
        length, todo = np.full(len(p), depth), np.arange(len(p))
        while len(todo):
            i = length[todo][:, None] + np.arange(DEPTH)
            same = text[np.minimum(p[todo][:, None] + i, len(text) - 1)] == test[np.minimum(s[todo][:, None] + i, len(test) - 1)]
            more = np.where(same.all(1), DEPTH, same.argmin(1))
            length[todo] += more
            todo = todo[more == DEPTH]
        long = length >= min_words
        p, s, length = p[long], s[long], length[long]
        doc = np.searchsorted(shard.starts, p, "right") - 1
        got = [np.concatenate(z) for z in zip(best, (doc, items.item[s], length, p - shard.starts[doc], items.at[s]))]
        d, i, w, x, y = got
        order = np.lexsort((y, x, -w, i, d))
        one = np.ones(len(order), bool)
        one[1:] = (d[order[1:]] != d[order[:-1]]) | (i[order[1:]] != i[order[:-1]])
        best = [z[order[one]] for z in got]
    return best


def _shards(batches, min_words: int, shard_words: int):
    """Sorted shards of batches of (key, text); texts of fewer than `min_words` words are left out."""
    find, number = re.compile(WORD).findall, _Numbers()
    keys, texts, total = [], [], 0
    for b in batches:
        for key, t in zip(b.column(0).to_pylist(), b.column(1)):
            w = find(t.as_py().lower())
            if len(w) < min_words:
                continue
            keys.append(key)
            texts.append(np.array([number[x] for x in w], np.int64))
            total += len(w)
            if total >= shard_words:
                yield sort_shard(keys, texts)
                keys, texts, total = [], [], 0
    if keys:
        yield sort_shard(keys, texts)


def _schemas(key: T.DataType, item: T.DataType) -> tuple[T.StructType, pa.Schema]:
    out = T.StructType([T.StructField("d", key), T.StructField("k", item), *[T.StructField(c, T.IntegerType()) for c in ("words", "doc_word", "item_word")]])
    return out, to_arrow_schema(out)


def _rows(shard: Shard, known: _Items, min_words: int, arrow: pa.Schema) -> pa.RecordBatch:
    r = search_shard(shard, known, min_words)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard.keys[j] for j in r[0]], arrow.field(0).type), pa.array([known.keys[j] for j in r[1]], arrow.field(1).type), *[pa.array(z.astype(np.int32)) for z in r[2:]]], schema=arrow
    )


def _chunks(items: DataFrame, item_id: str, item_text: str, chunk_chars: int) -> list[Broadcast]:
    test = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).distinct()
    chars = test.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // chunk_chars))
    rows = lambda c: [tuple(r) for r in test.where(F.pmod(F.xxhash64("k"), F.lit(n)) == c).collect()]  # noqa: E731 - bounded by chunk_chars on average
    return [items.sparkSession.sparkContext.broadcast(rows(c)) for c in range(n)]


def _longest(parts: list[DataFrame], doc_id: str, item_id: str) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("x"), (-F.col("item_word")).alias("y")))
    found = found.groupBy("d", "k").agg(best.alias("m"))
    return found.select(F.col("d").alias(doc_id), F.col("k").alias(item_id), F.col("m.words").alias("words"), (-F.col("m.x")).alias("doc_word"), (-F.col("m.y")).alias("item_word"))


def build_index(docs: DataFrame, doc_id: str, text: str, *, shard_words: int = 250_000) -> DataFrame:
    """Suffix arrays of a corpus, one row a shard: (keys, starts, vocabulary, ids, suffixes). Write it once; `search_index` reads it for any
    test items. Null texts and rows with a null id are left out."""
    out = T.StructType([T.StructField("keys", T.ArrayType(docs.schema[doc_id].dataType))] + [T.StructField(c, T.ArrayType(t())) for c, t in (("starts", T.IntegerType), ("vocabulary", T.LongType), ("ids", T.IntegerType), ("suffixes", T.IntegerType))])
    arrow = to_arrow_schema(out)

    def build(batches):
        for s in _shards(batches, 1, shard_words):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((s.keys, s.starts.astype(np.int32), s.vocabulary, s.ids, s.suffixes), arrow)], schema=arrow)

    return docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text).mapInArrow(build, out)


def search_index(index: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, item_text: str, min_words: int = 12, chunk_chars: int = 4_000_000) -> DataFrame:
    """As `find_leaks`, from a stored index of the corpus."""
    out, arrow = _schemas(index.schema["keys"].dataType.elementType, items.schema[item_id].dataType)
    parts = []
    for shared in _chunks(items, item_id, item_text, chunk_chars):

        def search(batches, shared=shared):
            known = _Items(shared.value, min_words)
            for b in batches:
                for k in range(b.num_rows):
                    array = lambda c, k=k, b=b: b.column(c)[k].values
                    starts, vocabulary, ids, suffixes = (array(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
                    yield _rows(Shard(array(0).to_pylist(), starts.astype(np.int64), vocabulary, ids, suffixes), known, min_words, arrow)

        parts.append(index.select("keys", "starts", "vocabulary", "ids", "suffixes").mapInArrow(search, out))
    return _longest(parts, doc_id, item_id)


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, min_words: int = 12, shard_words: int = 1_000_000, chunk_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): for each document and item that share `min_words` consecutive words or more, the
    longest shared passage and where it starts in either (counted in words from 0; of equally long ones the first in the document).

    Case, punctuation and spacing do not matter. Null, empty and short texts match nothing, nor do rows with a null id. Repeated rows
    give one row for each (doc_id, item_id). An item counts for every document that holds it, also where items share words. Empty
    tables give an empty result; other columns are ignored.
    """
    chunks = _chunks(items, item_id, item_text, chunk_chars)
    if len(chunks) > 1:
        index = Scratch(docs.sparkSession, "suffixes").keep(build_index(docs, doc_id, text))
        return search_index(index, items, doc_id=doc_id, item_id=item_id, item_text=item_text, min_words=min_words, chunk_chars=chunk_chars)
    out, arrow = _schemas(docs.schema[doc_id].dataType, items.schema[item_id].dataType)
    shared = chunks[0]

    def search(batches):
        known = _Items(shared.value, min_words)
        for s in _shards(batches, min_words, shard_words):
            yield _rows(s, known, min_words, arrow)

    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text)
    return _longest([corpus.mapInArrow(search, out)], doc_id, item_id)


def remove_leaked(docs: DataFrame, leaks: DataFrame, doc_id: str) -> DataFrame:
    """The corpus without documents that hold a passage."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
