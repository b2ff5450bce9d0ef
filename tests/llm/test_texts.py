"""Packing, mixing and languages: limits, exact round trips, held-out accuracy and edge cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import language
from evalloom.llm import tokens as tok
from evalloom.llm.byte_cnn import ByteCNN, stack, strip_accents, windows, wrongly_decoded
from evalloom.llm.language import LANGUAGE_NAMES, classify, decode, label_language, language_stretches, repaired, units
from evalloom.llm.mixing import mix, unique_texts
from evalloom.llm.packing import pack, pack_texts
from evalloom.llm.queries import p8_shares

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


def test_pack_respects_all_limits():
    rng = np.random.default_rng(1)
    sizes = np.column_stack([rng.integers(1, 1500, 700), np.ones(700), rng.integers(0, 700, 700)]).astype(float)
    sizes[:, 2] = np.minimum(sizes[:, 0], sizes[:, 2])
    limits = (2048.0, 5.0, 900.0)
    at = pack(sizes, limits)
    sums = np.zeros((at.max() + 1, 3))
    np.add.at(sums, at, sizes)
    assert (at >= 0).all() and (sums <= np.asarray(limits) + 1e-9).all()
    lower = max(np.ceil(sizes.sum(axis=0) / limits))
    assert at.max() + 1 <= 1.15 * lower + 1
    assert len(pack(np.zeros((0, 3)), limits)) == 0
    assert sorted(pack(np.array([[5.0, 1, 0]] * 4), (10.0, 9.0, 9.0)).tolist()) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        pack(np.array([[11.0, 1, 0]]), (10.0, 9.0, 9.0))


def test_pack_texts_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 90, 100, 101, 250, 1000]) if i % 3 else rng.randint(1, 100), rng.randint(0, 30)) for i in range(400)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "d bigint, n bigint, p bigint").withColumn("container", F.lit("clash"))
    got = pack_texts(df, "d", "n", "p", 100, most_segments=6, block_items=64).collect()
    by, boxes = {}, {}
    for r in got:
        by.setdefault(r["d"], []).append((r["start_token"], r["end_token"]))
        box = boxes.setdefault(r["container"], [0, 0])
        box[0] += r["tokens"]
        box[1] += 1
    for d, n, _ in rows:
        if not n:
            assert d not in by
            continue
        spans = sorted(by[d])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == -(-n // 100)
    assert max(b[0] for b in boxes.values()) <= 100 and max(b[1] for b in boxes.values()) <= 6
    each = pack_texts(df, "d", "n", "p", 100, most_segments=4, most_loss=70, block_items=10**6).groupBy("container").agg(F.sum("loss_tokens").alias("x"), F.count("d").alias("k")).collect()
    assert all(r["x"] <= 70 or r["k"] == 1 for r in each) and any(r["x"] > 70 for r in each) and max(r["k"] for r in each) == 4
    cut = {r["d"] for r in pack_texts(df, "d", "n", "p", 100, most_loss=70).where("piece > 0").collect()}
    assert cut == {r[0] for r in rows if r[1] and r[1] > 100}  # a text is never cut for its loss
    assert pack_texts(df.where("false"), "d", "n", "p", 100).count() == 0


def test_measured(spark):
    rows = [(1, "Hello there. How are you?"), (2, ""), (3, None), (4, "hello  THERE. how are you?"), (5, "x " * 60_000), (6, "只有中文。没有别的")]
    got = {r["d"]: r for r in tok.measured(spark.createDataFrame(rows, "d int, text string"), "text", ["d"]).collect()}
    enc = tok.encoding(tok.RANKS)
    assert all(got[d]["tokens"] == (len(enc.encode_ordinary(t)) if t else 0) for d, t in rows)
    assert got[1]["prompt_tokens"] == len(enc.encode_ordinary("Hello there.")) and got[1]["fingerprint"] == got[4]["fingerprint"] and got[2]["fingerprint"] is None


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 4 else "small", rng.randint(5, 50), rng.random()) for i in range(2000)] + [(5000, "other", 9, 0.5), (5001, "small", 7, None), (5002, "small", 7, float("nan"))]
    texts = spark.createDataFrame(rows, "ident bigint, source string, tokens bigint, quality double")
    targets = {"big": (0.3, 1), "small": (0.6, 2), "absent": (0.1, 3)}
    out, report = mix(texts, targets)
    got = {r["ident"]: r for r in out.collect()}
    by = {r[0]: r for r in report}
    small = sum(r[2] for r in rows if r[1] == "small")
    assert by["small"][3] == 2 * small and by["small"][6] == 2 and by["absent"][2] == 0.0 and 5000 not in got
    assert abs(by["big"][3] - small * 2 / 0.6 * 0.3) < 50 and all(r["uses"] <= targets[r["source"]][1] for r in got.values())
    some, report = mix(texts, targets, total=20_000.0)
    assert abs({r[0]: r for r in report}["big"][3] - 6000) <= 25
    picked = [r for r in rows if r[0] in {x["ident"] for x in some.collect()} and r[1] == "big"]
    assert np.mean([r[3] for r in picked]) > np.mean([r[3] for r in rows if r[1] == "big"]) + 0.05  # better texts come first
    again, _ = mix(texts.repartition(5), targets, total=20_000.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, some.collect()))
    empty, report = mix(texts.where("false"), targets)
    assert empty.count() == 0 and all(r[2] == 0 for r in report)


def test_no_source_starves(spark):
    # Texts larger than their budget, no quality, huge and tiny qualities.
    rng = random.Random(7)
    rows = [(i, "tiny", 10, 1.0) for i in range(20)] + [(100 + i, "large", 900 + i, 5.0) for i in range(3)] + [(200 + i, "odd", rng.randint(1, 40), rng.choice([None, 0.0, -1.0, float("nan"), 1e-9, 1e9, 2.0])) for i in range(400)]
    texts = spark.createDataFrame(rows, "ident bigint, source string, tokens bigint, quality double")
    out, report = mix(texts, {"tiny": (0.4, 2), "large": (0.2, 1), "odd": (0.4, 1)})
    by = {r[0]: r for r in report}
    assert by["tiny"][3] == by["tiny"][4] == 400 and by["large"][3] == 900 and by["odd"][4] == 400
    sizes = {r[0]: r[2] for r in rows}
    got = {r["ident"]: r["uses"] for r in out.collect()}
    left = [sizes[i] for i in sizes if i not in got and 200 <= i]
    miss = by["odd"][3] - 400
    assert all(abs(miss) <= abs(miss + n) for n in left)  # no single text more would end nearer
    picked = {i for i in got if i >= 200}
    blank = {r[0] for r in rows if r[0] >= 200 and not (r[3] and r[3] > 0)}
    assert len(blank & picked) <= 1  # only as the closing text
    assert all(sum(sizes[i] * n for i, n in got.items() if lo <= i < lo + 100) == by[s][3] for s, lo in (("tiny", 0), ("large", 100)))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_shares_of_the_test_tables(spark, scale):
    rows = p8_shares(spark, f"/root/testdata/{scale}").collect()
    reached = [r for r in rows if r["available_tokens"]]
    assert all(r["tokens"] > 0 for r in reached)
    assert sum(abs(r["tokens"] - r["budget"]) <= 0.15 * r["budget"] for r in reached) >= len(reached) - 1  # one source has a single text


def test_unique_texts(spark):
    rows = [(2, "a", "f", 5, 0.1), (1, "a", "f", 5, 0.2), (3, "b", None, 0, 0.0), (4, None, "g", 3, 0.1), (5, "b", "h", 3, 0.1)]
    got = unique_texts(spark.createDataFrame(rows, "d int, s string, f string, n bigint, q double"), "d", "s", "f", "n", "q").collect()
    assert sorted(r["ident"] for r in got) == [1, 5]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet(SAMPLES).orderBy("sample_id").collect()
    train = [r for r in rows if r["sample_id"] % 5]
    fitted = ByteCNN(sorted(LANGUAGE_NAMES)).fit([r["sample_text"] for r in train], [r["lang"] for r in train], steps=500)
    return fitted, [r for r in rows if r["sample_id"] % 5 == 0]


def test_held_out_accuracy(model):
    net, held = model
    for form in (str, str.upper, strip_accents, wrongly_decoded):
        found = classify([form(r["sample_text"]) for r in held], net)
        right = sum(len(f) == 1 and net.labels[f[0][2]] == r["lang"] for f, r in zip(found, held, strict=True))
        assert right >= 0.9 * len(held), form


def test_stretches(spark, model):
    net, held = model
    by = {}
    for r in held:
        by.setdefault(r["lang"], []).append(r["sample_text"])
    en, ru, zh = " ".join(by["en"]), " ".join(by["ru"]), "".join(by["zh"])
    mixed = f"{en} (см. кухня) {{'answer': 1.2}}\n{ru} 'old piano' x=1.2 {en}\n\n{zh}"
    rows = [(1, mixed), (2, ""), (3, None), (4, "| 12 | 0.3 |"), (5, en * 300), (6, wrongly_decoded(ru))]
    df = spark.createDataFrame(rows, "d int, text string").withColumn("stretches", F.lit("clash"))
    got = {r["d"]: r["stretches"] for r in language_stretches(df, "d", "text", net).collect()}
    assert [s["lang"] for s in got[1]] == ["en", "ru", "en", "zh"] and all(0 < s["confidence"] <= 1 for s in got[1])
    assert mixed[got[1][1]["start"] : got[1][1]["end"]].startswith(ru[:20]) and [s["start"] for s in got[1]] == sorted(s["start"] for s in got[1])
    assert got[2] == got[3] == got[4] == [] and [s["lang"] for s in got[5]] == ["en"] and [s["lang"] for s in got[6]] == ["ru"]
    assert language_stretches(df.where("false"), "d", "text", net).count() == 0


def test_pieces():
    assert windows(b"abc") == [b"abc"] and all(len(w) == 96 for w in windows(b"x" * 200)) and stack([b"a"]).shape == (1, 96)
    text, steps = repaired(wrongly_decoded("Über größe, ok"))
    assert text == "Über größe, ok" and len(steps) == 3
    found = units('One two three. "una cita corta" Four five six! (a b c d e f g h i) tail')
    assert [u[2] for u in found] == ["one two three.", "four five six!", "(a b c d e f g h i)", "tail"]
    assert decode(np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1]])), [20, 20, 20]) == [0, 0, 0]
    assert decode(np.log(np.array([[0.999, 0.001], [0.0001, 0.9999]])), [20, 20]) == [0, 1]


def test_label_language(spark):
    labels = ["en-GB", "English", "espanol", "Español", "zh-Hans", "FRA", " DE ", "it_CH", "ca", "??", "", None, "unknown", "Português", "中文", "Brazilian Portuguese", "English (UK)"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(label_language(F.col("l"))).collect()]
    assert got == ["en", "en", "es", "es", "zh", "fr", "de", "it", None, None, None, None, None, "pt", "zh", "pt", "en"]


def test_hostile_long_texts_take_linear_time():
    n = 300_000
    began = time.perf_counter()
    for text in ("." * n, "x" * n, "(" * n, "(a) " * (n // 4), "中" + "x" * n, "中" + "x1 " * (n // 3), "'" * n, '"a b" ' * (n // 6), "Ã¼" * (n // 2), "a. " * (n // 3), "\n" * n, "1" * n, "«" * n):
        units(text)
    assert time.perf_counter() - began < 20
    assert sum(u[3] for u in units("word " * n)) == n
    enc = tok.encoding(tok.RANKS)
    assert len(enc.encode_ordinary("word " * n)) >= n


def test_fitted_weights_are_kept(spark, monkeypatch):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr")]
    monkeypatch.setattr(language, "STEPS", (20, 20))
    one = language.fitted(spark, rows, seed=91)
    monkeypatch.setattr(language, "_fitted", {})  # as in another process
    monkeypatch.setattr(ByteCNN, "fit", lambda *a, **k: pytest.fail("fitted again"))
    two = language.fitted(spark, rows[::-1], seed=91)
    x = stack([t.encode() for t, _ in rows])
    assert two.labels == one.labels and (two.log_probabilities(x) == one.log_probabilities(x)).all()
    with pytest.raises(ValueError):
        language.fitted(spark, [])


def test_equal_units_are_scored_as_if_alone(model):
    net, held = model
    texts = [r["sample_text"] for r in held] * 2 + [" ".join(r["sample_text"] for r in held[:5]), None, ""]
    together = classify(texts, net)
    for t, found in zip(texts, together, strict=True):
        alone = classify([t], net)[0]
        assert [x[:3] for x in alone] == [x[:3] for x in found] and np.allclose([x[3] for x in alone], [x[3] for x in found], atol=1e-5)
    assert [len(p) for p in language.slices(["a" * 5, None, "b" * 6, "c" * 20, "d"], 11)] == [3, 1, 1]
    assert list(language.slices([], 10)) == []


def test_wrong_labels_do_not_teach(spark, monkeypatch):
    rows = spark.read.parquet(SAMPLES).collect()
    text = {x: " ".join(r["sample_text"] for r in rows if r["lang"] == x) for x in ("de", "fr")}
    docs = spark.createDataFrame([(1, text["de"], "de"), (2, text["fr"], "de"), (3, text["de"] + " " + text["fr"], "fr"), (4, None, "de"), (5, "", "de")], "d int, t string, l string")
    taught = []
    monkeypatch.setattr(language, "fitted", lambda s, rows, seed=0, start=None, real=language.fitted: taught.append(rows) or real(s, rows, seed, start))
    language.fit_on_documents(spark.read.parquet(SAMPLES), "sample_text", "lang", docs, "d", "t", F.col("l"))
    more = set(taught[1]) - set(taught[0])
    assert more and {x for _, x in more} == {"de"} and max(len(p) for p, _ in more) <= 96
