"""Garbled passages that few sequences of a text point to."""

from quakespark.llm.encodings import Garbling, known_characters
from tests.llm.test_llm import CLEAN


def pairs(texts, times=40):
    known, n = known_characters(), {}
    fits = lambda c: ord(c) < 0x3000 and known[ord(c)]
    for t in texts:
        found = [(ord(a) << 21) + ord(z) for a, z in zip(t, t[1:]) if not (a + z).isascii() and fits(a) and fits(z)]
        for p in found + [ord(c) << 21 for c in t if 0x3000 <= ord(c) < 0x10000]:
            n[p] = n.get(p, 0) + times
    return list(n.items())


def garbling():
    return Garbling(pairs(CLEAN.values()))


def test_short_passage_among_many_pairs():
    g = garbling()
    # Words that propose 31 other pairs more often, and that none of them has whole.
    filler = "îé一 r\xa0一 " * 80
    meant = " ".join(CLEAN["ru"].split()[:2])
    passage = meant.encode("koi8-r").decode("cp866")
    votes = g.votes(filler + passage)
    assert sum(n > votes["koi8-r", "cp866"] for n in votes.values()) > 12
    assert g.repair(filler + passage) == (True, filler + meant, "koi8-r as cp866")
    assert not g.repair(filler)[0]


def test_single_utf8_sequence_of_an_uncertain_encoding():
    g = garbling()
    for e in ("cp850", "koi8-r", "cp866", "cp852", "cp1253"):
        passage = "é".encode().decode(e)
        assert g.repair(f"Le r{passage}sidu est faible.") == (True, "Le résidu est faible.", f"utf-8 as {e}")


CAPITALS = "ТАРИРОВКА И РУБАШКА: УБОРКА, ТАБЛИЦА, ШАБЛОН, УПОР"


def test_chance_matches_do_not_hide_others():
    g = Garbling(pairs([*CLEAN.values(), CAPITALS]))
    assert len(list(g.utf8.iter(CAPITALS))) > 3 and not g.repair(CAPITALS)[0]
    for e in ("cp1252", "cp850", "koi8-r"):
        passage = "é".encode().decode(e)
        assert g.repair(f"{CAPITALS} caf{passage} est") == (True, f"{CAPITALS} café est", f"utf-8 as {e}")
    # Chance matches stay where the same encoding's garbled passage is undone.
    meant = "Größere Lücken"
    assert g.repair(f"{CAPITALS} {meant.encode().decode('iso8859-5')} im") == (True, f"{CAPITALS} {meant} im", "utf-8 as iso8859-5")


def test_wide_characters_in_every_encoding():
    g = garbling()
    for meant in ("再決定", "残差 減少"):
        for e in ("cp850", "cp866", "koi8-r", "iso8859-2"):
            assert g.repair(f"x {meant.encode().decode(e)} y") == (True, f"x {meant} y", f"utf-8 as {e}"), e
    assert g.repair("Fine " + "😀".encode().decode("koi8-r") + " day") == (True, "Fine 😀 day", "utf-8 as koi8-r")


def test_utf8_read_as_a_multi_byte_encoding():
    g = garbling()
    for meant in (CLEAN["ja"], "再決定後", CLEAN["ru"], CLEAN["fr"]):
        for e in ("cp932", "gbk", "euc_jp"):
            passage = meant.encode().decode(e, "replace")
            bad, text, how = g.repair(f"See: {passage} end")
            if "�" not in passage:
                assert (bad, text, how) == (True, f"See: {meant} end", f"utf-8 as {e}"), (meant, e)
    whole = "れれ減減地地"  # no byte of it is lost in cp932
    for meant, e in (("再決", "gbk"), ("résidu près", "cp932"), (whole, "cp932")):
        passage = meant.encode().decode(e)
        assert g.repair(f"See: {passage} end") == (True, f"See: {meant} end", f"utf-8 as {e}")
    assert "utf-8 as cp932" in g.repair(CLEAN["ja"].encode().decode("cp932", "replace"))[2]
    for t in CLEAN.values():
        assert not g.repair(t)[0]


def test_japanese_read_as_cyrillic():
    g = garbling()
    for written, read in (("euc_jp", "koi8-r"), ("cp932", "koi8-r"), ("euc_jp", "cp866"), ("cp932", "cp866")):
        bad, text, how = g.repair("See: " + CLEAN["ja"].encode(written).decode(read))
        assert bad and how == f"{written} as {read}" and text.endswith(CLEAN["ja"][-12:]), (written, read, text)


def test_chinese_and_korean_read_as_single_bytes():
    texts = {"gbk": "地震台网记录到多次余震，需要重新定位震源深度", "big5": "地震觀測網記錄到多次餘震，需要重新定位震源深度", "euc_kr": "지진 관측망에서 여진을 여러 번 기록하여 진원 깊이를 다시 정한다"}
    g = Garbling(pairs([*CLEAN.values(), *texts.values()]))
    for written, meant in texts.items():
        for read in ("latin-1", "cp1252", "koi8-r", "cp866"):
            raw = meant.encode(written)
            try:
                passage = raw.decode(read)
            except UnicodeDecodeError:
                continue
            bad, text, how = g.repair(f"See: {passage} end")
            assert bad and f"{written} as" in how, (written, read, how, text)
        assert not g.repair(meant)[0]
