"""Text decoded with the wrong character encoding: found, and restored where the garbling can be undone.

Garbled sequences are computed beforehand for all encoding pairs and matched by multi-pattern automata:
- UTF-8 read as a single-byte encoding: the sequence of every character of many scripts, which is hardly ever meant as it stands. Matches
  are replaced by their character, again and again where text was garbled twice.
- UTF-8 read as a multi-byte encoding, where characters do not become sequences of their own: runs whose bytes are UTF-8, judged by counts.
- A single-byte encoding, or a Japanese, Chinese or Korean one of several bytes, read as another single-byte one: what becomes of the character pairs that the corpus has often, where
  the garbled pair is much rarer in it. Matches only propose an encoding pair; the words around them are recoded, and counted as
  garbled where that makes their character pairs much more usual, by all counts of the corpus. Other words stay as they are.
- U+FFFD, which decoders put where bytes were invalid: found, but the bytes are lost.

Scale. One pass counts character pairs (vectorised, combined map-side, distinct pairs bounded by the square of the characters that the
encodings have); a second is narrow. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Encodings that UTF-8 is mistaken for.
UTF8_AS = ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "cp850", "koi8-r", "cp866", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "cp852", "iso8859-5", "iso8859-7"]
#: Encodings that text of one script is written in, and those that they are mistaken for.
WRITTEN_IN = {
    "latin": ["cp1252", "cp1254", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-15"],
    "cyrillic": ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"],
    "greek": ["cp1253", "iso8859-7", "mac_greek"],
    "wide": ["euc_jp", "cp932", "gbk", "big5", "euc_kr"],
}
READ_AS = ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1253", "cp1254", "cp1250", "iso8859-5", "mac_cyrillic"]
#: Multi-byte encodings that UTF-8 is mistaken for.
UTF8_AS_WIDE = ["cp932", "euc_jp", "gbk"]
#: Encodings for which one UTF-8 match in a text is enough.
CERTAIN = {"cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251"}
#: Blocks whose characters are looked for in garbled UTF-8.
BLOCKS = [(0x80, 0xA0), (0xA0, 0x250), (0x370, 0x530), (0x590, 0x5F5), (0x600, 0x6FF), (0x900, 0x970), (0xE00, 0xE5C), (0x2000, 0x2070), (0x2070, 0x20D0), (0x2100, 0x2400), (0x2500, 0x2600), (0x3000, 0x3100), (0x4E00, 0x9FB0), (0xAC00, 0xD7A4), (0xFB00, 0xFB07), (0xFE0F, 0xFE10), (0xFEFF, 0xFF00), (0xFF01, 0xFFA0), (0x1F300, 0x1F700)]
_WIDE = 0x3000


def read_as(data: bytes, encoding: str) -> str | None:
    """Bytes as that encoding reads them; a byte that a Windows encoding leaves open becomes the control character of its number."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if not encoding.startswith("cp125"):
            return None
    out = []
    for x in data:
        try:
            out.append(bytes([x]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(x))
    return "".join(out)


def byte_table(encoding: str) -> dict[str, int]:
    """Byte of each upper character of a single-byte encoding."""
    out = {}
    for x in range(128, 256):
        c = read_as(bytes([x]), encoding)
        if c is not None:
            out.setdefault(c, x)
    return out


def known_characters() -> np.ndarray:
    """Which characters below U+3000 are ASCII or in one of the encodings."""
    known = np.zeros(_WIDE, bool)
    known[32:127] = True
    for e in {*UTF8_AS, *READ_AS, *(x for s in ("latin", "cyrillic", "greek") for x in WRITTEN_IN[s])}:
        known[[ord(c) for c in byte_table(e) if ord(c) < _WIDE]] = True
    return known


def count_pairs(df: DataFrame, text: str) -> DataFrame:
    """(pair, n): how often each pair of neighbouring characters occurs of which one is not ASCII, and each wide character alone.

    `pair` is the first code point times 2^21 plus the second (0 for a wide character alone). All rows count; null texts have none.
    """

    def count(batches):
        known = known_characters()
        for b in batches:
            joined = "\n".join(t for t in b.column(0).to_pylist() if not t.isascii())
            c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if not len(c):
                continue
            low = c < _WIDE
            ok = np.zeros(len(c), bool)
            ok[low] = known[c[low]]
            a, z = c[:-1], c[1:]
            both = ok[:-1] & ok[1:] & ((a > 127) | (z > 127))
            wide = c[(c >= _WIDE) & (c < 0x10000)]
            k, n = np.unique(np.concatenate([(a[both] << 21) + z[both], wide << 21]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string")).mapInArrow(count, "pair long, n long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"))


class Garbling:
    """Automata over garbled sequences, and the counts that weigh them."""

    def __init__(self, pairs: list[tuple[int, int]], *, ratio: float = 5.0, least_share: float = 1e-5):
        import ahocorasick

        mask = (1 << 21) - 1
        self.n = {chr(p >> 21) + (chr(p & mask) if p & mask else ""): n for p, n in pairs}
        self.total = sum(self.n.values()) or 1
        self.alone: dict[str, int] = {}
        for p, n in self.n.items():
            self.alone[p[0]] = self.alone.get(p[0], 0) + n
        self.log = {p: float(np.log(n + 0.5)) for p, n in self.n.items()}
        self.unseen = float(np.log(0.5))
        self.judged: dict[tuple[tuple[str, str], str], float] = {}
        self.utf8 = ahocorasick.Automaton()
        found: dict[str, dict[str, str]] = {}
        for low, high in BLOCKS:
            for o in range(low, high):
                data = chr(o).encode()
                for e in UTF8_AS:
                    s = read_as(data, e)
                    if s and all(ord(c) > 127 for c in s):
                        found.setdefault(s, {}).setdefault(e, chr(o))
        for s, v in found.items():
            self.utf8.add_word(s, (len(s), v))
        self.utf8.make_automaton()

        tables = {e: byte_table(e) for e in {*READ_AS, *(x for s in ("latin", "cyrillic", "greek") for x in WRITTEN_IN[s])}}
        upper = {e: {x: c for c, x in t.items()} for e, t in tables.items()}
        self.recode: dict[tuple[str, str], dict[int, str]] = {}  # garbled character to meant character
        meant: dict[tuple[str, str], dict[str, str]] = {}
        for script in ("latin", "cyrillic", "greek"):
            for r in WRITTEN_IN[script]:
                for w in READ_AS:
                    there = {c: upper[w][x] for c, x in tables[r].items() if x in upper[w]}
                    changed = {c: g for c, g in there.items() if c != g}
                    if changed:
                        meant[r, w] = there
                        self.recode[r, w] = {ord(g): c for c, g in there.items()}
        self.words = ahocorasick.Automaton()
        usual = {p: n for p, n in self.n.items() if n >= max(3, least_share * self.total) and p.isalpha()}
        proposals: dict[str, list[tuple[str, str]]] = {}
        for p, n in usual.items():
            if len(p) == 1:
                for r in WRITTEN_IN["wide"]:
                    try:
                        data = p.encode(r)
                    except UnicodeEncodeError:
                        continue
                    for w in READ_AS:
                        g = read_as(data, w) if len(data) > 1 else None
                        if g and (self.n.get(g, 0) + 1) * ratio <= n:
                            proposals.setdefault(g, []).append((r, w))
                continue
            for key, there in meant.items():
                g = "".join(c if ord(c) < 128 else there.get(c, "\0") for c in p)
                if g != p and "\0" not in g and (self.n.get(g, 0) + 1) * ratio <= n:
                    proposals.setdefault(g, []).append(key)
        for g, keys in proposals.items():
            self.words.add_word(g, keys)
        if len(self.words):
            self.words.make_automaton()

    def usual(self, pair: str) -> float:
        return self.log.get(pair, self.unseen)

    def undo_utf8(self, text: str, threshold: float = 6.0) -> tuple[str, list[str]]:
        """Replace garbled UTF-8, the encoding with most matches first, until none is left.

        Of an encoding outside CERTAIN, only runs of matches that do not become less usual are replaced: two matches or more if they
        gain at all, a single one if it gains more than the threshold. Where it is rejected the next encoding is tried.
        """
        used: list[str] = []
        while True:  # every turn shortens the text
            hits = list(self.utf8.iter(text))
            votes: dict[str, tuple[int, int]] = {}  # matches, and their characters
            for _, (k, by) in hits:
                for e in by:
                    n, length = votes.get(e, (0, 0))
                    votes[e] = n + 1, length + k
            rejected = False
            for e in sorted(votes, key=lambda e: (-votes[e][0], -votes[e][1], UTF8_AS.index(e))):
                spans, at = [], 0
                for start, k, c in sorted((end - k + 1, -k, by[e]) for end, (k, by) in hits if e in by):
                    if start >= at:
                        at = start - k
                        spans.append((start, at, c))
                least = threshold if e not in CERTAIN else None
                if e in CERTAIN and not rejected or (spans := self._plausible(text, spans, least)):
                    break
                rejected = True
            else:
                return text, used
            out, at = [], 0
            for start, end, c in spans:
                out += [text[at:start], c]
                at = end
            text = "".join(out) + text[at:]
            used.append(f"utf-8 as {e}")

    def _plausible(self, text: str, spans: list[tuple[int, int, str]], threshold: float | None) -> list[tuple[int, int, str]]:
        """The spans that are garbled by the counts of the corpus; without a threshold, those that no count speaks against."""
        kept, total, run = [], 0.0, []
        for n, span in enumerate(spans):
            run.append(span)
            if n + 1 < len(spans) and spans[n + 1][0] == span[1]:
                continue
            before, after = text[max(0, run[0][0] - 1) : run[0][0]], text[span[1] : span[1] + 1]
            gain = self._gain(before + text[run[0][0] : span[1]] + after, before + "".join(c for _, _, c in run) + after)
            if any(ord(c) > 0xFFFF for _, _, c in run):  # not counted, but hardly ever four characters by chance
                gain = max(gain, 2 * (threshold or 0.0))
            if gain >= 0:
                kept, total = kept + run, total + gain
            run = []
        return kept if threshold is None or total > (0 if len(kept) > 1 else threshold) else []

    def undo_wide(self, text: str, threshold: float = 6.0) -> tuple[str, list[str]]:
        """Replace UTF-8 read as a multi-byte encoding: runs whose bytes are UTF-8 and that become much more usual. Of a run that lost
        bytes, the characters that are left."""
        used: list[str] = []
        if max(text) < chr(_WIDE):
            return text, used
        for e in UTF8_AS_WIDE:
            out, at = [], 0
            for m in re.finditer(r"[^\x00-\x7f\ufffd]+", text):
                s = m.group()
                if max(s) < chr(_WIDE):  # the first byte of UTF-8 begins a wide character
                    continue
                try:
                    new = s.encode(e).decode("utf-8", "replace")
                except UnicodeEncodeError:
                    continue
                lost = new.count("\ufffd")
                if 2 * lost > len(new):
                    continue
                before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
                if self._gain(before + s + after, before + new + after) - 4.0 * lost > threshold:
                    out += [text[at : m.start()], new]
                    at = m.end()
            if out:
                text = "".join(out) + text[at:]
                used.append(f"utf-8 as {e}")
        return text, used

    def _score(self, text: str) -> float:
        pairs = sum(self.usual(text[i : i + 2]) - self.unseen for i in range(len(text) - 1) if ord(text[i]) > 127 or ord(text[i + 1]) > 127)
        return pairs + sum(self.usual(c) - self.unseen for c in text if ord(c) >= _WIDE)

    def _gain(self, old: str, new: str) -> float:
        return self._score(new) - self._score(old)

    def votes(self, text: str) -> dict[tuple[str, str], int]:
        """How many garbled sequences of each encoding pair a text has."""
        out: dict[tuple[str, str], int] = {}
        if len(self.words):
            for _, keys in self.words.iter(text):
                for k in keys:
                    out[k] = out.get(k, 0) + 1
        return out

    def undo_single(self, text: str, threshold: float, scripts: set[str], votes: dict | None = None) -> tuple[str, list[str]]:
        """Recode the words that another encoding makes much more usual, until none is left; `scripts`: of the encodings to try.

        Every encoding pair that has two garbled sequences in the text (one of several bytes: one) is tried.
        """
        used: list[str] = []
        wanted = {e for x in scripts for e in WRITTEN_IN[x]}
        seen = {text}
        while True:
            votes = self.votes(text) if votes is None else votes
            found, votes = {k: n for k, n in votes.items() if k[0] in wanted}, None
            if not found:
                break
            best = (threshold, None, text)
            upper = sorted({ord(c) for c in text if ord(c) > 127})
            tried = set()
            for key, n in sorted(found.items(), key=lambda kv: -kv[1]):
                wide = key[0] in WRITTEN_IN["wide"]
                if n < 2 and not wide:  # one pair weighs 6 at most
                    continue
                if not wide:
                    # Pairs that recode all characters of the text alike give the same text and gain.
                    same = tuple(map(self.recode[key].get, upper))
                    if same in tried:
                        continue
                    tried.add(same)
                gain, new = (self._multibyte if wide else self._recoded)(text, key)
                if gain > best[0] and new not in seen:
                    best = (gain, key, new)
            if best[1] is None:
                break
            text = best[2]
            seen.add(text)
            used.append(f"{best[1][0]} as {best[1][1]}")
        return text, used

    def _evidence(self, old: str, new: str, i: int) -> float:
        """How much more usual pair i of a word becomes. At a word's edge only a character that is very rare here says anything, and
        little: a sign there may be meant (a dash, a fraction)."""
        a, z = old[i], old[i + 1]
        if ord(a) < 128 and ord(z) < 128:
            return 0.0
        for k in (i, i + 1):
            c = old[k]
            if ord(c) > 127 and not c.isalpha() and not (0 < k < len(old) - 1 and new[k - 1].isalpha() and new[k + 1].isalpha() and not c.isspace()):
                return self._rarity(c, new[k]) if k == i else 0.0
        pair = new[i : i + 2]
        gain = self.usual(pair) - self.usual(old[i : i + 2])
        if gain > 0 and not pair.isalpha():
            return self._rarity(a, new[i]) if ord(a) > 127 else 0.0
        return max(-6.0, min(6.0, gain))

    def _rarity(self, old: str, new: str) -> float:
        if old == new or old.isspace():
            return 0.0
        return max(0.0, min(2.0, float(np.log(self.alone.get(new, 0) + 0.5) - np.log(self.alone.get(old, 0) + 0.5) - np.log(50))))

    def _word(self, w: str, table: dict[int, str]) -> float:
        """How much more usual a word becomes; -8 where the encoding does not have its characters."""
        if any(ord(c) > 127 and ord(c) not in table for c in w):
            return -8.0
        old, new = f" {w} ", f" {w.translate(table)} "
        return sum(self._evidence(old, new, i) for i in range(len(w) + 1))

    def _recoded(self, text: str, key: tuple[str, str]) -> tuple[float, str]:
        """Recode segments of words whose summed gain is positive; the gain of the best segment."""
        table = self.recode[key]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\s]*[^\x00-\x7f][^\s]*", text)]
        parts, best = [], 0.0
        segment, total = [], 0.0

        def close():
            nonlocal segment, total, best
            while segment and segment[-1][1] <= 0:
                total -= segment.pop()[1]
            if total >= 3.0:
                parts.extend(w for w, g in segment if g > -2)
                best = max(best, total)
            segment, total = [], 0.0

        for a, z in words:
            w = text[a:z]
            g = self.judged.get((key, w))
            if g is None:
                g = self._word(w, table)
                if len(self.judged) > 500_000:
                    self.judged.clear()
                if len(w) <= 64:
                    self.judged[key, w] = g
            if total + g < 0 or g < -6:
                close()
                if g <= 0:
                    continue
            segment.append(((a, z), g))
            total += g
        close()
        if not parts:
            return 0.0, text
        out, at = [], 0
        for a, z in sorted(parts):
            out += [text[at:a], text[a:z].translate(table)]
            at = z
        return best, "".join(out) + text[at:]

    def _multibyte(self, text: str, key: tuple[str, str]) -> tuple[float, str]:
        r, w = key
        table = self.__dict__.setdefault("_tables", {}).setdefault(w, byte_table(w))
        out, at, best = [], 0, 0.0
        for m in re.finditer(r"[^\x00-\x7f　-￿](?:[^　-￿\n]*[^　-￿\n])?", text):
            s = m.group()
            if any(ord(c) > 127 and c not in table for c in s):
                continue
            got = bytes(table.get(c, ord(c) & 127) for c in s).decode(r, "replace")
            wide = [c for c in got if ord(c) >= _WIDE and c != "�"]
            gain = sum(self.usual(c) - 1.0 for c in wide) - 4.0 * got.count("�") - 2.0 * sum(0x80 <= ord(c) < _WIDE for c in got)
            if gain > 6.0:
                out += [text[at : m.start()], got]
                at, best = m.end(), best + gain
        return best, "".join(out) + text[at:]

    def repair(self, text: str, threshold: float = 6.0) -> tuple[bool, str, str]:
        """(garbled, restored text, how): `how` names the encoding pairs, and 'lost' where bytes cannot be had back."""
        if text.isascii():
            return False, text, ""
        votes = self.votes(text)
        new, how = self.undo_single(text, threshold, {"wide"}, votes)
        new, how1 = self.undo_wide(new, threshold)
        new, how2 = self.undo_utf8(new, threshold)
        how2 = how1 + how2
        new, how3 = self.undo_single(new, threshold, {"latin", "cyrillic", "greek"}, None if how or how2 else votes)
        how += how2 + how3
        if "�" in text or "�" in new:
            how.append("lost")
        return bool(how), new, ", ".join(how)


def find_garbled(df: DataFrame, key: str, text: str, *, threshold: float = 6.0, pairs: DataFrame | None = None) -> DataFrame:
    """(key, restored, how) of every row whose text holds a garbled passage.

    `restored`: the text with the passages that could be undone replaced and all else untouched. `how`: the encodings, as
    'written in' as 'read as'; 'lost' where U+FFFD stands for lost bytes. `threshold`: how much more usual (in logarithms of counts) a
    passage must become. Null, empty and ASCII texts are not garbled. Repeated rows give a row each; null keys stay. Empty tables give an
    empty result; other columns are ignored. `pairs`: counts of `count_pairs` over another corpus of the same languages.
    """
    counts = (pairs if pairs is not None else count_pairs(df, text)).collect()  # bounded: see known_characters
    pairs_ = sorted((r["pair"], r["n"]) for r in counts)
    shared = df.sparkSession.sparkContext.broadcast(pairs_)
    name = hashlib.blake2b(np.array(pairs_, np.int64).tobytes()).hexdigest()  # a reused worker keeps the automata of one corpus
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("restored", T.StringType()), T.StructField("how", T.StringType())])
    arrow = to_arrow_schema(out)

    def repair(batches):
        kept = sys.__dict__.setdefault("_quakespark_garbling", {})
        if name not in kept:
            kept.clear()
            kept[name] = Garbling(shared.value)
        g = kept[name]
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                bad, new, how = g.repair(t.as_py(), threshold)
                if bad:
                    rows.append((k, new, how))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(3)], schema=arrow)

    return df.where(F.col(text).isNotNull()).select(df[key], df[text].cast("string")).mapInArrow(repair, out)
