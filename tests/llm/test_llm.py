import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import leak, mixing, quantiles, splitting
from urbanloom.llm.tokens import encoder, ranks_path


# percentiles


@pytest.mark.parametrize("alpha", [0.05, 0.002])
def test_percentiles_are_within_alpha_and_merge(spark, alpha):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 4, 3000), -rng.lognormal(0, 4, 3000), np.zeros(50)])
    rows = [(float(v), k % 5, None if k % 5 == 0 else "x") for k, v in enumerate(values)] + [(None, 1, "x"), (float("nan"), 1, "x")]
    df = spark.createDataFrame(rows, "v double, part int, g string")
    parts = quantiles.sketch(df, ["part"], "v", alpha)
    whole = quantiles.merged(parts.withColumn("all", F.lit(1)), ["all"])
    at = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = quantiles.percentiles(whole, ["all"], at, alpha).first()
    assert got.n == len(values)
    ordered = np.sort(values)
    for name, q in at.items():
        low = ordered[int(np.floor(q * (len(ordered) - 1)))]
        exact = np.quantile(values, q)
        assert got[f"{name}_min"] - 1e-9 <= exact <= got[f"{name}_max"] + 1e-9
        if q in (0.01, 0.9, 1.0):
            assert abs(got[name] - exact) <= alpha * abs(exact) * 1.001 + 1e-9, (name, low)
    direct = quantiles.sketch(df.withColumn("all", F.lit(1)), ["all"], "v", alpha)
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in whole.collect()}
    assert quantiles.sketch(df.limit(0), ["part"], "v").count() == 0


def test_infinite_and_tiny(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1e-300,), (1e300,), (-1e-13,)], "v double")
    got = quantiles.percentiles(quantiles.sketch(df.withColumn("g", F.lit(1)), ["g"], "v"), ["g"], {"lo": 0.25, "hi": 0.75})
    r = got.first()
    assert abs(r.lo) <= 1e-12 and r.hi == pytest.approx(1e300, rel=0.002)


def test_wrong_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w", f"p{k % 3}", None if k % 2 else 7, float(v)) for k, v in enumerate(rng.normal(50, 20, 3000))]
    rows += rows[:100] + [(9999, "w", "p0", 7, None), (9998, "w", "p0", 7, float("nan")), (9997, "w", None, 7, 1.0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, w string, p string, c int, v double, n int")
    groups = {}
    for _, w, p, c, v in {r[0]: r for r in rows}.values():
        if v is None or v != v:
            continue
        groups.setdefault((w, None, c), []).append(v)
        if p:
            groups.setdefault((w, p, c), []).append(v)
    stats, want, n = [], set(), 0
    for key, values in groups.items():
        for off in (0.0, 0.3, 0.499, 0.501, 3.0, -0.4995, -0.6):
            m = float(np.quantile(values, 0.5))
            stats.append((n, *key, m + off, float(np.quantile(values, 0.9))))
            if abs(off) > 0.5:
                want.add(n)
            n += 1
    stats += [(n, "w", "p0", 7, None, None), (n + 1, "gone", None, 7, 1.0, 1.0)]
    st = spark.createDataFrame(stats, "sid bigint, w string, p string, c int, m double, q double")
    got = quantiles.wrong_statistics(df, "id", "v", "w", "p", ["c"], st, "sid", {"a": ("m", 0.5), "b": ("q", 0.9)}, 0.5, relative=False, alpha=0.01)
    assert {r[0] for r in got.collect()} == want


# leaks


def _brute(documents, items, window=leak.WINDOW):
    out = set()
    for d, text in documents:
        own = leak.words(text)
        for i, passage in items:
            w = leak.words(passage)
            need = min(window, len(w))
            runs = {tuple(own[k : k + need]) for k in range(len(own) - need + 1)}
            if need and any(tuple(w[k : k + need]) in runs for k in range(len(w) - need + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    pick = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(pick.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 4, 5, 6, 12, 13, 14, 20, 30, 40])]
    items += [(90, items[9][1]), (91, ""), (92, None)]
    documents = []
    for k in range(120):
        words = pick.choices(vocabulary, k=pick.choice([0, 3, 30]))
        source = leak.words(items[pick.randrange(11)][1])
        a = pick.randrange(len(source))
        words[pick.randint(0, len(words)) : 0] = source[a : a + pick.choice([11, 12, 13, 14, 50])]
        documents.append((k, pick.choice([" ", ", ", "\n> ", " **"]).join(words)))
    documents += [(500, None), (501, "")]
    d = spark.createDataFrame([(*r, 1, "k") for r in documents], "doc_id bigint, text string, item bigint, key string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leak.leaks(d, i).collect()}
    assert got == _brute(documents, items)
    assert leak.leaks(d.limit(0), i).count() == 0 and leak.leaks(d, i.limit(0)).count() == 0


def test_words_as_a_reader_sees_them():
    plain = leak.words("The Müller's café, 42 ways")
    assert plain == leak.words("THE Mül­ler's\n> *café* ​４２ wa‍ys!")
    assert leak.words(None) == [] and leak.words("…") == []


# mixing


def test_rake_meets_sources_and_caps():
    tokens = np.array([100.0, 300.0, 50.0, 50.0, 10.0])
    source = np.array([0, 0, 1, 1, 2])
    cap = np.array([1.0, 1.0, 3.0, 3.0, 2.0])
    label = np.array([0, 1, 0, 1, 0])
    factor = mixing.rake(tokens, cap, source, np.array([200.0, 200.0, 100.0]), [(label, np.array([230.0, 190.0]))])
    mass = tokens * factor
    assert np.bincount(source, mass) == pytest.approx([200, 200, 20])
    assert (factor <= cap + 1e-9).all() and (factor >= 0).all()
    assert mass[label == 0].sum() > 200


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tags array<string>, text string, weight double, expected string")


def test_mixture(spark):
    rows = []
    for k in range(1200):
        source = "abc"[0 if k < 900 else 1 if k < 1150 else 2]
        rows.append((k, source, [None, "en", "sv"][k % 3], None if k % 5 == 0 else [f"t{k % 4}"], "word " * (5 + k % 9), 0.0, ""))
    rows += [(5000, None, "en", ["t1"], "word " * 50, 0.0, ""), (5001, "a", "en", [], None, 0.0, ""), (5002, "zz", "en", [], "", 0.0, "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("none", 0.05, 5)], "source string, weight double, max_repeats int")
    mix = mixing.Mixture(_documents(spark, rows), targets)
    shares = {r.source: r for r in mix.shares().collect()}
    assert {s for s, r in shares.items() if r.falls_short} == {"c", "none"}
    for s in "ab":
        assert shares[s].taken == pytest.approx(shares[s].wanted, rel=0.1)
    assert shares["c"].taken == 2 * shares["c"].available and shares["none"].taken == 0
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    most = {r.source: r.m for r in mix.chosen().groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["a"] <= 1 and most["b"] <= 3 and most["c"] == 2
    assert mixing.Mixture(_documents(spark, []), targets).chosen().count() == 0
    assert mixing.Mixture(_documents(spark, rows), targets.limit(0)).chosen().count() == 0


# splitting


def _texts():
    pick = random.Random(7)
    word = lambda: "".join(pick.choices("abcdefghij", k=pick.randint(2, 9)))
    prose = "\n\n".join(" ".join(f"{' '.join(word() for _ in range(12)).capitalize()}." for _ in range(8)) for _ in range(40))
    return {1: prose, 2: "".join(pick.choices("ABCDEFabcdef0123456789+/", k=9000)), 3: "点群の境界を確認する。" * 400, 4: "🙂👩‍🚀é" * 900, 5: "short", 6: None, 7: "", 8: "a" * 20_000, 9: " \n" * 4000 + "x y " * 3000, 10: "\x00퟿ line\r\n" * 900}


def test_pieces(spark):
    texts = _texts()
    df = spark.createDataFrame([(k, t, "m", 0) for k, t in texts.items()], "doc_id bigint, text string, marks string, piece int")
    tokens = encoder(ranks_path())
    by = {}
    for r in splitting.pieces(df).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {k for k, t in texts.items() if t and len(tokens.encode_ordinary(t)) > splitting.LIMIT}
    for k, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert own[0].start == 0 and own[-1].start + len(own[-1].text) == len(texts[k])
        for i, r in enumerate(own):
            assert r.text == texts[k][r.start : r.start + len(r.text)]
            assert len(tokens.encode_ordinary(r.text)) <= splitting.LIMIT and r.n_tokens <= splitting.LIMIT
            if i:
                shared = own[i - 1].first_token + own[i - 1].n_tokens - r.first_token
                assert splitting.OVERLAP <= shared <= splitting.OVERLAP + 3
    assert {r.boundary for r in by[1][:-1]} == {"p"}
    assert {r.boundary for r in by[3][:-1]} == {"s"}
    assert {r.boundary for r in by[2][:-1]} == {"c"}
    assert splitting.pieces(df.limit(0)).count() == 0


def test_an_early_boundary_beats_a_cut_inside_a_word(spark):
    blob = _texts()[2]
    df = spark.createDataFrame([(1, "Some words first.\n" + blob)], "doc_id bigint, text string")
    own = sorted(splitting.pieces(df).collect(), key=lambda r: r.piece)
    assert own[0].text == "Some words first.\n" and own[0].boundary == "l" and own[1].boundary == "c"


def test_pieces_with_other_limits(spark):
    df = spark.createDataFrame([(1, _texts()[1])], "doc_id bigint, text string")
    assert all(r.n_tokens <= 200 for r in splitting.pieces(df, 200, 20).collect())
    with pytest.raises(ValueError, match="overlap"):
        splitting.pieces(df, 100, 90)


# bounds, hot values, other types


def test_sketches_of_two_alphas_are_refused(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 50)], "g int, v double")
    both = quantiles.sketch(df, ["g"], "v", 0.002).union(quantiles.sketch(df, ["g"], "v", 0.01))
    with pytest.raises(Exception, match="another alpha"):
        quantiles.percentiles(quantiles.merged(both, ["g"]), ["g"], {"m": 0.5}).collect()


def test_tiny_values_keep_the_relative_error(spark):
    values = [1e-200 * k for k in range(1, 101)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    r = quantiles.percentiles(quantiles.sketch(df, ["g"], "v"), ["g"], {"m": 0.5}).first()
    assert r.m == pytest.approx(float(np.quantile(values, 0.5)), rel=0.0021)


def test_one_hot_bucket_is_settled_in_ranges(spark):
    rng = np.random.default_rng(5)
    values = [float(v) for v in 100 + rng.random(400) / 10]
    rows = [(k, "w", f"p{k % 2}", v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, w string, p string, v double")
    m = float(np.quantile(values, 0.5))
    stats = spark.createDataFrame([(1, "w", None, m + 0.0011), (2, "w", None, m + 0.0009)], "sid bigint, w string, p string, m double")
    got = quantiles.wrong_statistics(df, "id", "v", "w", "p", [], stats, "sid", {"a": ("m", 0.5)}, 0.001, relative=False, sort_rows=10)
    assert {r[0] for r in got.collect()} == {1}


def test_leaks_with_text_keys_and_repeated_phrases(spark):
    item = " ".join(f"w{k}" for k in range(20))
    documents = spark.createDataFrame([("a", ("w0 w1 w2 w3 w4 " * 3000) + item), ("b", "w0 w1 w2 w3 w4 " * 3000), (None, item)], "key string, text string")
    items = spark.createDataFrame([("i", item), ("j", "w0 w1 w2 w3 w4 w0 w1")], "name string, text string")
    got = {tuple(r) for r in leak.leaks(documents, items, "key", "name").collect()}
    assert got == {("a", "i"), ("a", "j"), ("b", "j")}


def _mixed(spark, count=400):
    pick = random.Random(9)
    rows = [(k, pick.choice("abc"), f"l{pick.randrange(40)}", [f"t{pick.randrange(200)}" for _ in range(pick.randrange(4))], "word " * pick.randrange(1, 40)) for k in range(count)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tags array<string>, text string"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("d", 0.1, 1)], "source string, weight double, max_repeats int")


def test_many_languages_and_topics_are_kept_apart(spark):
    documents, targets = _mixed(spark)
    held = mixing.Mixture(documents, targets)
    margins = {(r.margin, r.label): r for r in held.margins().collect()}
    assert len([k for k in margins if k[0] == "topic"]) > 150 and len([k for k in margins if k[0] == "lang"]) == 40
    assert sum(r.natural_share for k, r in margins.items() if k[0] == "topic") == pytest.approx(1)
    assert {r.source for r in held.shares().where("falls_short").collect()} >= {"d"}


def test_cells_as_a_table_fit_alike(spark):
    documents, targets = _mixed(spark, 120)
    one = {(r.source, r.lang, tuple(r.topics)): r.expected for r in mixing.Mixture(documents, targets).cells.collect()}
    cells = mixing.Mixture(documents, targets).cells.select("source", "lang", "topics", "tokens", "cap")
    wanted = mixing.Mixture(documents, targets).goals.select("source", "wanted")
    rooms = cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("cap")).alias("room")).join(wanted, "source")
    reach = rooms.agg(F.sum(F.least("room", "wanted"))).first()[0]
    two = mixing.rake_table(cells, wanted, reach, rounds=3).collect()
    three = {}
    rows = cells.collect()
    places = {r.source: k for k, r in enumerate(wanted.collect())}
    tokens, cap = np.array([r.tokens for r in rows], float), np.array([r.cap for r in rows], float)
    margins = []
    for labels in ([[r.lang] for r in rows], [r.topics for r in rows]):
        cell = np.repeat(np.arange(len(rows)), [len(x) for x in labels])
        part = 1.0 / np.array([len(x) for x in labels], float)[cell]
        _, label = np.unique([v for x in labels for v in x], return_inverse=True)
        natural = np.bincount(label, tokens[cell] * part)
        margins.append((cell, label, part, natural / natural.sum() * reach))
    factor = mixing.rake(tokens, cap, np.array([places[r.source] for r in rows]), np.array([r.wanted for r in wanted.collect()]), margins, rounds=3)
    three = {(r.source, r.lang, tuple(r.topics)): f for r, f in zip(rows, factor, strict=True)}
    assert {k for k in one} == {(r.source, r.lang, tuple(r.topics)) for r in two}
    assert all(r.expected == pytest.approx(three[r.source, r.lang, tuple(r.topics)], rel=1e-6, abs=1e-9) for r in two)


def test_running_sums(spark):
    steps = [random.Random(1).randrange(1, 9) for _ in range(1000)]
    df = spark.createDataFrame([(steps,), ([],), ([5],)], "s array<int>")
    got = [r[0] for r in df.select(splitting.running_sums(F.col("s"))).collect()]
    assert got == [np.cumsum(steps).tolist(), [], [5]]


def test_pieces_of_a_very_long_text_with_text_keys(spark):
    text = "Some words of a sentence. " * 60_000
    df = spark.createDataFrame([("k", text)], "doc_id string, text string")
    own = sorted(splitting.pieces(df).collect(), key=lambda r: r.piece)
    assert len(own) > 300 and own[-1].start + len(own[-1].text) == len(text) and all(r.text == text[r.start : r.start + len(r.text)] for r in own)
