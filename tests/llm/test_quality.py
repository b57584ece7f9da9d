from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridledger.llm import quality, queries


def slow_model(grams, order=4, classes=64):
    """grams: Counter of tuples; probability function of interpolated modified Kneser-Ney."""
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, context = {}, {}
    for k, level in levels.items():
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        d = [min(max(0.5 * c if y is None or not n[c] else c - (c + 1) * y * n[c + 1] / n[c], 0.05), c) for c in (1, 2, 3)]
        cuts[k] = d
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        context[k] = (total, mass)

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / classes
        total, mass = context[k]
        if g[:-1] not in total:
            return prob(g[1:])
        c = levels[k].get(g, 0)
        own = c - cuts[k][min(c, 3) - 1] if c else 0.0
        return (own + mass[g[:-1]] * prob(g[1:])) / total[g[:-1]]
    return prob


def test_codes_slide_over_the_text_in_any_chunk(monkeypatch):
    text = "Aé b\n日本!" * 7
    whole = np.concatenate(list(quality.codes_of(text.encode())))
    classes = [0, 0, 0, *(int(quality.TABLE[min(ord(c), 0x250)]) for c in text)]
    want = [((classes[i] * 64 + classes[i + 1]) * 64 + classes[i + 2]) * 64 + classes[i + 3] for i in range(len(text))]
    assert whole.tolist() == want
    monkeypatch.setattr(quality, "CHUNK", 5)
    assert np.concatenate(list(quality.codes_of(text.encode()))).tolist() == want
    assert quality.TABLE.max() == 63 and (quality.TABLE > 0).all()


def test_model_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaabbc d") for _ in range(60)) for _ in range(12)]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    model = quality.kneser_ney(quality.count_grams(df))
    built = quality._collect(model, ["x"])["x"]
    assert np.allclose(built.probs.sum(axis=1), 1)
    grams = Counter()
    for t in texts:
        grams.update(tuple((g >> s) & 63 for s in (18, 12, 6, 0)) for codes in quality.codes_of(t.encode()) for g in codes.tolist())
    prob = slow_model(grams)
    for t in (texts[0], "abc abd", "zzz Q!", "daaac"):
        codes = np.concatenate(list(quality.codes_of(t.encode())))
        want = -sum(math.log2(prob(tuple((g >> s) & 63 for s in (18, 12, 6, 0)))) for g in codes.tolist())
        assert math.isclose(built.bits(codes), want, rel_tol=1e-5)


def test_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "no", "ti", "le", "ra"]) for _ in range(rng.randint(1, 4)))
    good = [(i, " ".join(word() for _ in range(60)), ["a", "b", None][i % 3]) for i in range(900)]
    bad = [(2000, "XQ$$ ZZ## " * 20, "a"), (2001, None, "a"), (2002, "", "b"), (None, "%%%%%%%%%%% " * 30, "new"),
           (2005, "QQQQQQQQQQ!! " * 20, None), (2005, "QQQQQQQQQQ!! " * 20, None)]
    fine = [(2003, "bano tilera leti " * 2000, "new"), (2004, "bano", "a"), (None, "noti leba ra tino", None)]
    df = spark.createDataFrame([*good, *bad, *fine], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(None, 1, 0), (7, 0, 0), (8, 1, None), (2000, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    judged = model.judge(df)
    assert judged.columns == [*df.columns, "perplexity", "_score", "bound", "rejected"]
    rows = judged.collect()
    assert len(rows) == 909 and sum(r.rejected for r in rows if r.doc_id is not None and r.doc_id < 900) <= 9
    assert all(r.rejected for r in rows if not r.text or any(c in r.text for c in "$%Q"))
    assert not any(r.rejected for r in rows if r.text and r.text in {t for _, t, _ in fine})
    assert all((r.perplexity is None) == (not r.text) for r in rows)
    kept = model.keep(df)
    assert kept.columns == df.columns and kept.count() == sum(not r.rejected for r in rows)
    forced = quality.train(df, labels, broadcast_ids=0).judge(df, ["doc_id"]).where("rejected").count()
    assert forced == sum(r.rejected for r in rows)
    none = quality.train(df, labels.limit(0)).judge(df, ["doc_id", "text"])
    assert sum(r.rejected for r in none.collect()) == 2 and none.count() == 909
    assert quality.train(df.limit(0), labels).judge(df.limit(0)).count() == 0


def test_small_languages_keep_their_own_model_and_bound(spark):
    rng = random.Random(3)
    parts = {"a": ["ba", "no", "ti", "le", "ra"], "b": ["xu", "kwo", "zy", "vu", "qo"]}
    text = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(60))
    good = [(i, text("b" if i % 10 == 0 else "a"), "b" if i % 10 == 0 else "a") for i in range(300)]
    other = [(1000, text("a"), "b"), (1001, text("b"), "b"), (1002, text("a"), "a"), (1003, text("a"), "c"), (1004, text("a"), "d")]
    df = spark.createDataFrame([*good, *other], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1004, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert model.known == ["la", "lb"] and set(model.bounds) == {"la", "lb", quality.ALL}
    judged = {r.doc_id: r for r in model.judge(df).collect()}
    assert judged[1000].rejected and not any(judged[i].rejected for i in (1001, 1002, 1003, 1004))
    assert judged[1001].bound == model.bounds["lb"][1] and judged[1003].bound == judged[1004].bound == model.bounds[quality.ALL][1]


def test_query_keeps_good_and_rejects_garbled_text(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op1(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share[1] < 0.01 and share[0] > 0.8


def test_models_hold_four_bytes_a_probability():
    rows = pa.table({"length": [0], "context": [0], "total": [4], "mass": [1.5], "classes": [[1, 2]], "kept": [[1.5, 1.0]]})
    model = quality.Model(rows)
    assert np.allclose(model.probs[1], (np.bincount([1, 2], [1.5, 1.0], quality.CLASSES) + 1.5 / quality.CLASSES) / 4)
    held = sum(x.nbytes for x in vars(model).values() if isinstance(x, np.ndarray))
    assert held == 4 * (2 * quality.CLASSES + quality.CLASSES ** 3)
