"""Operators of the llm subpackage against brute force, exact round trips, and their edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quakespark.llm")

from quakespark.llm.components import connected_groups  # noqa: E402
from quakespark.llm.encodings import find_garbled  # noqa: E402
from quakespark.llm.leakage import _Items, build_index, find_leaks, remove_leaked, search_index, search_shard, sort_shard, words  # noqa: E402
from quakespark.llm.nearest_time import match_nearest  # noqa: E402
from quakespark.llm.percentiles import count_ladder, exact_percentiles, ladder_error, ladder_percentiles, merge_ladders  # noqa: E402
from quakespark.llm.tokenizer import BYTE_BPE_50K, ByteBpe, decode_texts, encode_texts  # noqa: E402

T0 = dt.datetime(2024, 1, 1)

# Nearest time


def near(left, right, tol):
    out = set()
    for i, e, t in left:
        if None in (i, e, t):
            continue
        best = min(((abs(t2 - t), t2, j) for j, e2, t2 in right if None not in (j, e2, t2) and e2 == e and abs(t2 - t) <= tol), default=None)
        if best:
            out.add((i, best[2]))
    return out


@pytest.mark.parametrize("target", [200_000, 30])
def test_nearest_time(spark, target):
    rng = random.Random(5)
    ent = lambda: rng.choice(["A", "A", "A", "B", "C", None])  # noqa: E731 - A is hot
    when = lambda: None if rng.random() < 0.03 else rng.randrange(0, 3 * 86400) * 1000 + rng.randrange(0, 999)  # noqa: E731 - ms
    left = [(i if rng.random() > 0.02 else None, ent(), when()) for i in range(2000)]
    right = [(f"r{i}", ent(), when()) for i in range(3000)] + [("x1", "A", 86_400_000 - 100), ("x0", "A", 86_400_000 - 100), ("x2", "A", 86_400_000 + 100)]
    left += [(5000, "A", 86_400_000), left[7]]  # on a day's edge, with a tie; and a repetition
    right += right[:50]
    ts = lambda ms: None if ms is None else T0 + dt.timedelta(milliseconds=ms)
    a = spark.createDataFrame([(i, e, ts(t), "x") for i, e, t in left], "id long, ent string, time timestamp, rid string")
    b = spark.createDataFrame([(i, e, ts(t), 1) for i, e, t in right], "rid string, ent string, time timestamp, t int")
    got = match_nearest(a, b, by=["ent"], time="time", ids=("id", "rid"), tolerance_s=60.0, max_tolerance_s=60.0, target_rows=target).collect()
    want = near([(i, e, t) for i, e, t in left], right, 60_000)
    assert {(r["id"], r["rid"]) for r in got} == want and len(got) == len(want) > 500
    assert (5000, "x0") in want and all(abs(r["dt_s"]) <= 60 for r in got)


def test_nearest_time_burst_and_repetitions(spark):
    """A burst far above `target_rows` within one narrowest range, on both sides, with repeated times."""
    rng = random.Random(6)
    left = [(i, "A", 43_200_000 + rng.randrange(0, 900)) for i in range(900)] + [(1000 + i, "B", 1000 * i) for i in range(50)]
    right = [(f"r{i}", "A", 43_200_000 + rng.randrange(-200, 1100)) for i in range(1500)] + [(f"s{i}", "B", 1000 * i + 3) for i in range(50)]
    ts = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    a = spark.createDataFrame([(i, e, ts(t)) for i, e, t in left], "id long, ent string, time timestamp")
    b = spark.createDataFrame([(i, e, ts(t)) for i, e, t in right], "rid string, ent string, time timestamp")
    got = match_nearest(a, b, by=["ent"], time="time", ids=("id", "rid"), tolerance_s=0.8, max_tolerance_s=0.8, target_rows=100).collect()
    assert {(r["id"], r["rid"]) for r in got} == near(left, right, 800) and len(got) == 950


def test_nearest_time_bounds_and_empty(spark):
    a = spark.createDataFrame([(1, "A", T0)], "id long, ent string, time timestamp")
    b = spark.createDataFrame([(9, "A", T0 + dt.timedelta(milliseconds=400)), (8, "A", T0 - dt.timedelta(milliseconds=401))], "rid long, ent string, time timestamp")
    how = dict(by=["ent"], time="time", ids=("id", "rid"), max_tolerance_s=0.4)
    assert [r["rid"] for r in match_nearest(a, b, tolerance_s=0.4, **how).collect()] == [9]
    assert match_nearest(a, b, tolerance_s=F.lit(0.3), **how).count() == 0
    assert match_nearest(a.limit(0), b, tolerance_s=0.4, **how).count() == 0 == match_nearest(a, b.limit(0), tolerance_s=0.4, **how).count()


# Percentiles

PS = [0.0, 0.1, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("cuts", [1024, 2])
def test_exact_percentiles(spark, cuts):
    rng = np.random.default_rng(4)
    v = {"a": np.concatenate([rng.normal(0, 1, 800), rng.standard_cauchy(100) * 1e5, [0.0, -0.0, 1e-300]]), "b": np.array([3.5]), "c": np.repeat(2.0, 50), "d": rng.integers(0, 5, 301) / 3, None: np.array([1.0, 2.0])}
    rows = [(k, float(x), 1, "y") for k, xs in v.items() for x in xs] + [("a", None, 1, "y"), ("a", float("nan"), 1, "y"), ("b", float("inf"), 1, "y"), ("e", None, 1, None)]
    d = spark.createDataFrame(rows, "k string, x double, n int, value string")
    got = {(r["k"], r["percentile"]): r for r in exact_percentiles(d, ["k"], "x", PS, cuts=cuts).collect()}
    assert len(got) == len(PS) * len(v)
    for k, xs in v.items():
        for p in PS:
            assert got[k, p]["value"] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-300) and got[k, p]["n"] == len(xs)
    assert exact_percentiles(d.limit(0), ["k"], "x", PS).count() == 0
    with pytest.raises(ValueError):
        exact_percentiles(d, ["value"], "x", PS)
    assert exact_percentiles(d.where("k = 'd'"), [], "x", [0.5]).first()["value"] == pytest.approx(np.median(v["d"]))


def test_ladders_add_up(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_cauchy(5000)
    d = spark.createDataFrame([("g", i % 7, float(v)) for i, v in enumerate(x)], "k string, day long, x double")
    whole = count_ladder(d, ["k"], "x")
    parts = merge_ladders(count_ladder(d, ["k", "day"], "x"), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(whole.columns).collect()))
    r, a = ladder_error()
    for row in ladder_percentiles(parts, ["k"], [0.01, 0.5, 0.99]).collect():
        exact = np.quantile(x, row["percentile"])
        assert abs(row["value"] - exact) <= row["error"] + 1e-12 <= r * abs(exact) * 1.1 + a + abs(exact) * 0.01


# Groups


def union_find(pairs):
    p = {}

    def root(x):
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            p[max(a, b)] = min(a, b)
    return {x: root(x) for x in p}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "mixed"])
def test_connected_groups(spark, shape):
    rng = random.Random(2)
    name = lambda i: f"e{i:04d}"
    pairs = {
        "random": [(name(rng.randrange(400)), name(rng.randrange(400))) for _ in range(300)],
        "chain": [(name(i), name(i + 1)) for i in range(130)],
        "star": [(name(300), name(i)) for i in range(300)],
        "mixed": [(name(2 * i), name(2 * i + 1)) for i in range(40)] + [(name(i), name(i + 64)) for i in range(40)] + [(None, "a"), ("a", None), ("b", "b"), ("ä", "z"), ("z", "Z")],
    }[shape]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:20]
    d = spark.createDataFrame([(a, b, 1) for a, b in pairs], "u string, w string, label int")
    got = {r["record_id"]: r["group_id"] for r in connected_groups(d, "u", "w").collect()}
    assert got == union_find(pairs)


def test_no_groups(spark):
    d = spark.createDataFrame([("a", "a"), (None, "b")], "u string, w string")
    assert connected_groups(d, "u", "w").count() == 0 and connected_groups(d.limit(0), "u", "w").count() == 0


# Encoding

TEXTS = ["Hello world", "", None, "   ", " \n\t x", "naïve Ångström 地震 🌋👩🏽‍🔬", "<|endoftext|>", "I'LL we'll don't", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "İıŞ №½ ﬁrst", "1234567890 3.14", "тест κείμενο תחנה", "\x01\x07 \x85  ", "zź"]


def test_encoding_is_exact_and_decodes():
    tokenizers = pytest.importorskip("tokenizers")
    v = ByteBpe(BYTE_BPE_50K)
    t = tokenizers.Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    rng = random.Random(0)
    some = [x for x in TEXTS if x] + ["".join(rng.choice("abcdefgh étß 地震\n19.,") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    for x in some:
        assert v.encode(x) == t.encode(x, add_special_tokens=False).ids
        assert v.decode_bytes(v.encode(x)) == x.encode()


def test_encoding_frames(spark):
    d = spark.createDataFrame([(i, x, "z") for i, x in enumerate(TEXTS)] + [(None, "x", "z"), (0, TEXTS[0], "z")], "doc_id long, text string, ids string")
    e = encode_texts(d, "doc_id", "text")
    got = {(r["doc_id"], tuple(r["ids"])) for r in e.collect()}
    assert e.count() == len(TEXTS) + 2 and (2, ()) in got and (1, ()) in got
    back = {r["doc_id"]: r["text"] for r in decode_texts(e, "doc_id", "ids").collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(TEXTS))
    assert encode_texts(d.limit(0), "doc_id", "text").count() == 0


# Leaks


def brute_leaks(docs, items, k):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, x in items:
            v = words(x)
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [1_000_000, 50])
def test_leaks(spark, shard):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30)))) for i in range(30)] + [(90, None), (91, ""), (None, "a b c d e f")]
    docs = [(i, " ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "  \n "), (None, items[0][1])]
    long = items[5][1]
    docs += [(903, "Xx " * 3000 + long.upper().replace(" ", " -- ") + " yy" * 3000), (904, long + "; " + long)]
    docs += docs[:5]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, words int")
    t = spark.createDataFrame(items, "item_id long, item_text string")
    got = find_leaks(d, t, doc_id="doc_id", text="text", item_id="item_id", item_text="item_text", min_words=5, shard_words=shard, chunk_chars=300)
    rows = got.collect()
    want = brute_leaks([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None], 5)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    full = {(r["doc_id"], r["item_id"]): r for r in rows}[903, 5]
    assert full["words"] == len(words(long)) and full["doc_word"] == 3000 and full["item_word"] == 0
    by = dict(docs), dict(items)
    for r in rows[:50]:
        a, b = words(by[0][r["doc_id"]]), words(by[1][r["item_id"]])
        assert a[r["doc_word"] : r["doc_word"] + r["words"]] == b[r["item_word"] : r["item_word"] + r["words"]]
    assert not {r["doc_id"] for r in remove_leaked(d, got, "doc_id").collect()} & {x for x, _ in want}


def test_stored_index_and_common_passage(spark, tmp_path):
    """A stored index gives what a direct search gives, for any passage length; a passage that is in every document many times is not held at once."""
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(9)}" for _ in range(40))
    docs = [(i, " ".join([base] * 6) + f" u{i}") for i in range(60)] + [(70, None), (71, "")]
    items = [(i, base + f" v{i}") for i in range(4)] + [(9, "nothing like it at all")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    build_index(d, "doc_id", "text", shard_words=3000).write.parquet(str(tmp_path / "i"))
    index, names = spark.read.parquet(str(tmp_path / "i")), dict(doc_id="doc_id", item_id="item_id", item_text="item_text")
    for k in (5, 20, 40, 41):
        got = {tuple(r) for r in search_index(index, t, min_words=k, **names).collect()}
        assert got == {tuple(r) for r in find_leaks(d, t, text="text", min_words=k, **names).collect()}
        assert got == ({(i, j, 40, 0, 0) for i in range(60) for j in range(4)} if k <= 40 else set())
    shard = sort_shard(list(range(60)), [np.array([hash(w) % 10**9 + 1 for w in words(x)]) for _, x in docs[:60]])
    known = _Items([(0, base)], 5)
    known.hashes = np.array([*[hash(w) % 10**9 + 1 for w in words(base)], 0])
    assert [z.tolist() for z in search_shard(shard, known, 5, hits_at_once=7)] == [z.tolist() for z in search_shard(shard, known, 5)]


def test_no_leaks(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    t = spark.createDataFrame([], "item_id long, item_text string")
    how = dict(doc_id="doc_id", text="text", item_id="item_id", item_text="item_text")
    assert find_leaks(d, t, **how).count() == 0 and find_leaks(d.limit(0), d.selectExpr("doc_id as item_id", "text as item_text"), **how).count() == 0


# Garbled text

CLEAN = {
    "fr": "Après relocalisation, le résidu passe de 1.6 s à 0.3 s, où 69 phases ont été utilisées près de la côte.",
    "de": "Größere Lücken im Kanal wurden überbrückt; während des Sturms stieg die Störung, das Beben fällt für die Höhe auf.",
    "es": "Después de la relocalización, el residuo cuadrático de la estación no coincidía con el análisis de la señal.",
    "ru": "Автоматическое вступление опережает ручной отсчёт на несколько миллисекунд, землетрясение отнесено к району.",
    "el": "Μετά τον επαναπροσδιορισμό το υπόλοιπο μειώθηκε, το κανάλι έχει κενά και η μέτρηση δεν είναι αξιόπιστη.",
    "tr": "Yeniden konumlandırmadan sonra artık düştü; sığ katmanlarda sönüm güçlü, ağırlığı düşük gözlemler çıkarıldı.",
    "ja": "再決定後、残差は減少した。自動読み取りの波は手動より早い。地震の深さは浅いと決定された。",
    "en": "The naïve fit isn’t enough – the “Pn” time was 45° off… x² + y² ≤ 9, ½ ¼ ⅔ № ™, Søren’s café.",
}
PAIRS = [("fr", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("de", "utf-8", "cp437"), ("es", "utf-8", "mac_roman"), ("ru", "utf-8", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "latin-1"), ("el", "iso8859-7", "latin-1"), ("tr", "cp1254", "latin-1"), ("fr", "latin-1", "mac_roman"), ("es", "latin-1", "cp850"), ("ja", "euc_jp", "latin-1"), ("ja", "utf-8", "latin-1")]


def test_garbled(spark):
    rows = [(i * 100 + k, t) for i, t in enumerate(CLEAN.values()) for k in range(40)]
    bad = {}
    for n, (lang, written, read) in enumerate(PAIRS):
        t = CLEAN[lang]
        g = t.encode(written, "ignore").decode(read)
        bad[10_000 + n] = (t + " Ok. ", g)
    twice = CLEAN["de"].encode().decode("latin-1").encode().decode("latin-1")
    bad[10_100] = ("", twice)
    bad[10_101] = ("", "A atenua��o � maior")
    rows += [(k, a + b) for k, (a, b) in bad.items()]
    rows += [(20_000, None), (20_001, ""), (20_002, "plain text"), (20_003, "├─ step └─ done"), (20_004, "ÂNGULO DE 25°, SEÇÃO Ã-3"), (None, "plain")]
    d = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, how int")
    got = {r["doc_id"]: r for r in find_garbled(d, "doc_id", "text").collect()}
    assert set(got) == set(bad)
    for n, (lang, written, read) in enumerate(PAIRS):
        meant = CLEAN[lang].encode(written, "ignore").decode(written)
        text = got[10_000 + n]["restored"]
        assert text.startswith(CLEAN[lang] + " Ok. ")
        same = sum(x == y for x, y in zip(text[len(CLEAN[lang]) + 5 :], meant)) / len(meant)
        assert same > 0.9, (lang, written, read, text)
    assert got[10_100]["restored"] == CLEAN["de"] and "lost" in got[10_101]["how"]
    assert find_garbled(d.limit(0), "doc_id", "text").count() == 0


def test_grouped_percentiles(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 11 == 0 else f"s{i % 3}", i % 5, float(np.round(rng.standard_t(2), 2))) for i in range(4000)]
    d = spark.createDataFrame(rows, "s string, d int, x double")
    got = exact_percentiles(d, ["s", "d"], "x", [0.1, 0.5], groupings=[["s"], ["d"], ["s", "d"]]).collect()
    for r in got:
        x = [v for s, e, v in rows if ("s" not in r["grouping"] or s == r["s"]) and ("d" not in r["grouping"] or e == r["d"])]
        assert r["n"] == len(x) and r["value"] == pytest.approx(np.quantile(x, r["percentile"]))
    assert len(got) == 2 * (4 + 5 + 20) and sum(r["grouping"] == "s" and r["s"] is None for r in got) == 2
