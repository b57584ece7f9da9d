from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridledger.llm import quality, words


def slow_words(text):
    singles = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in words.SINGLE)
    return re.findall(f"[{singles}]|[^\\x20\\x09-\\x0D{singles}]+", text)


def slow_pairs(text):
    w = slow_words(text)
    return list(zip(["", *w], [*w, ""], strict=True)) if w else []


def cuts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
    return [0.0, *(min(max(0.5 * c if y is None or not n[c] else c - (c + 1) * y * n[c + 1] / n[c], 0.05), c) for c in (1, 2, 3))]


def slow_bits(pairs, trusted, less=None):
    """Bits of pairs by the counts of ``trusted``, less a text's; discounts and the number of words are of all."""
    total = Counter(p for t in trusted for p in slow_pairs(t))
    before = Counter(b for _, b in total)
    d2, d1, size = cuts(total.values()), cuts(before.values()), len(before)
    if less is not None:
        total = Counter(p for t in trusted if t != less for p in slow_pairs(t))
        before = Counter(b for _, b in total)
    cut = lambda d, n: d[min(n, 3)]
    all_ = sum(before.values())
    after, mass = Counter(), Counter()
    for (a, _), n in total.items():
        after[a] += n
        mass[a] += cut(d2, n)
    spare = sum(cut(d1, n) for n in before.values())
    bits = 0.0
    for a, b in pairs:
        p = (before[b] - cut(d1, before[b]) + spare / (size + 1)) / all_ if all_ else 1 / (size + 1)
        if after[a]:
            p = (total[a, b] - cut(d2, total[a, b]) + mass[a] * p) / after[a]
        bits -= math.log2(p)
    return bits


def test_words_of_any_script_in_any_chunk(monkeypatch):
    text = "  It's a Test, a test\nκαι ένα τεστ; 我们的 テスト x" + "y" * 5000 + " 𠀀𠀀 $$\t" * 3
    found = slow_words(text)
    whole = words.words(text)
    assert len(whole) == len(found) and len(set(whole.tolist())) == len(set(found))
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(found, whole.tolist(), strict=True))
    monkeypatch.setattr(words, "CHUNK", 3)
    assert words.words(text).tolist() == whole.tolist()
    assert not len(words.words("")) and not len(words.words(" \n\t "))


@pytest.mark.parametrize("size", [words.PART, 400])
def test_scores_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(words, "PART", size)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["a", "bé", "c", "d", "日", "e,"], [9, 5, 3, 2, 1, 1], k=rng.randint(1, 30)))
    good = {m: [text() for _ in range(20)] for m in "xy"}
    good["x"] += [good["x"][0]] * 7 + ["only once seen", " "]
    other = {"x": [text(), "strange words", good["x"][1], "\n"], "y": [good["x"][0]], "z": ["no trusted text"]}
    rows = [(m, t, n) for n, part in ((1, good), (0, other)) for m, texts in part.items() for t in texts]
    df = spark.createDataFrame(rows, "model string, text string, n long").repartition(3)
    got = {(r.model, r.k1, r.k2): r for r in words.scores(df.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.length("text").cast("long"))).collect()}
    keys = {r.text: (r.k1, r.k2) for r in df.select("text", F.xxhash64("text").alias("k1"), F.length("text").cast("long").alias("k2")).collect()}
    assert len(got) == len({(m, t) for m, t, _ in rows})
    for m, t, _ in rows:
        r, trusted = got[(m, *keys[t])], good.get(m, [])
        pairs = slow_pairs(t)
        assert r.n == len(pairs) and (r.held is None) == (t not in trusted)
        assert math.isclose(r.bits, slow_bits(pairs, trusted), rel_tol=1e-9, abs_tol=1e-9)
        if t in trusted:
            assert math.isclose(r.held, slow_bits(pairs, trusted, t), rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_sum_to_one():
    trusted = ["a b a c", "a b b", "c a"]
    seen = ["", "a", "b", "c", "unseen"]
    for left in ("a", "", "unseen"):
        assert math.isclose(sum(2 ** -slow_bits([(left, w)], trusted) for w in seen), 1)


def test_garbled_and_shuffled_texts_of_any_script_are_rejected(spark):
    rng = random.Random(6)
    scripts = {"el": [chr(c) for c in range(0x3B1, 0x3C9)], "zh": [chr(c) for c in range(0x4E00, 0x4E60)], "en": list("abcdefghijklmnopqrstuvwxyz")}
    rows, wrong = [], {}
    for at, (lang, letters) in enumerate(scripts.items()):
        space = "" if lang == "zh" else " "
        vocabulary = ["".join(rng.choices(letters, k=1 if lang == "zh" else rng.randint(2, 8))) for _ in range(60)]
        follows = {w: rng.sample(vocabulary, 4) for w in vocabulary}

        def prose(follows=follows, vocabulary=vocabulary):
            out = [rng.choice(vocabulary)]
            while len(out) < 80:
                out.append(rng.choice(follows[out[-1]]))
            return out
        rows += [(1000 * at + i, space.join(prose()), lang) for i in range(120)]
        shuffled, fine = prose(), prose()
        rng.shuffle(shuffled)
        garbled = ["".join(rng.choices(letters, k=len(w))) for w in prose()] if space else [chr(rng.randint(0x5000, 0x9000)) for _ in range(80)]
        for i, (text, bad) in enumerate(((garbled, True), (shuffled, True), (fine, False))):
            rows.append((1000 * at + 500 + i, space.join(text), lang))
            wrong[rows[-1][0]] = bad
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] not in wrong], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = {r.doc_id: r for r in model.judge(df).collect()}
    assert {i: got[i].rejected for i in wrong} == wrong
    assert sum(r.rejected for i, r in got.items() if i not in wrong) <= 3
    assert {r.doc_id for r in model.keep(df).collect()} == {i for i, r in got.items() if not r.rejected}
    later = spark.createDataFrame([(1, " ".join(reversed(rows[1][1].split())), "el"), (2, rows[2][1], "el"), (3, " \n", "el"), (4, rows[-1][1], "new")],
                                  "doc_id long, text string, lang string")  # texts and languages not met in training
    late = {r.doc_id: r for r in model.judge(later).collect()}
    assert [late[i].rejected for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert late[2].score == pytest.approx(got[2].score) and late[4].bound == model.bounds[quality.ALL][1]
    assert {r.doc_id for r in model.keep(later).collect()} == {2, 4}
    assert np.isfinite([r.perplexity for r in got.values()]).all()


def test_held_out_bits_some_texts_at_a_time(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 30))) or " " for _ in range(60)]
    rows = {"k1": list(range(60)), "k2": [0] * 60, "n": [i % 3 for i in range(60)], "body": [zlib.compress(t.encode()) for t in texts]}
    parts, key, table = {"m": 1}, (pa.scalar("m"), pa.scalar(0)), pa.table(rows)
    said = words._add_pairs(parts)(key, words._ask_pairs(parts)(key, table))
    kind = np.array(said["kind"].to_pylist())
    found = words._add_words(key, said.take(np.flatnonzero(kind == words.WORDS)), words._ask_words(parts)(key, table))
    sums = {k: [r[f"n{c}"] for c in (1, 2, 3, 4)] for k, t in (("pairs", said), ("words", found)) for r in t.to_pylist() if r["kind"] == words.SUMS}
    last = found.to_pylist()[-1]
    models = {"m": words._Sums(sums["pairs"], sums["words"], last["words"], last["total"])}
    back = pa.concat_tables([said.take(np.flatnonzero(kind == words.PAIRS)), found.take([0])])
    whole = words._score(parts, models)(key, table, back).to_pylist()
    monkeypatch.setattr(words, "CHUNK", 8 * 40)
    pieces = words._score(parts, models)(key, table, back).to_pylist()
    trusted = [t for t, n in zip(texts, rows["n"], strict=True) for _ in range(n)]
    for t, a, b in zip(texts, whole, pieces, strict=True):
        assert a["bits"] == b["bits"] and (a["held"] is None) == (b["held"] is None)
        assert a["held"] is None or math.isclose(a["held"], b["held"])
        assert math.isclose(a["bits"], slow_bits(slow_pairs(t), trusted), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("numbered", [0, 1 << 16])
def test_packed_texts_and_blocks_come_back(monkeypatch, numbered):
    monkeypatch.setattr(words, "NUMBERED", numbered)
    texts = ["a b a, c", "", " \n", "日本 x" * 3, "b " * 500, "\ud83d"]
    rows = [(i - 3, -i, i % 2, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts)]
    for row, (*key, text) in zip(rows, words._unpack(words._pack(rows)), strict=True):
        found = words.words(text.decode("utf-8", "replace")) if isinstance(text, bytes) else text
        assert (*key,) == row[:3] and found.tolist() == words.words(row[3].decode("utf-8", "replace")).tolist()
    hashes = np.unique(np.concatenate([[0, (1 << 48) - 1], words.words("some words in here")])).astype(np.uint64)
    for some in (hashes, hashes[:0], hashes[:1], hashes[-1:]):
        assert words._hashes_in(words._hashes_out(some)).tolist() == some.tolist()
        assert words._counts_in(words._counts_out(some)).tolist() == some.tolist()


def test_a_step_leaves_no_shuffle_but_the_texts(spark):
    rng = random.Random(8)
    rows = [("m", i, " ".join(rng.choices([f"w{k}" for k in range(3000)], k=400)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, k1 long, text string, n long").withColumn("k2", F.lit(0).cast("long"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {int(x) for x in re.findall(r"\d+", str(blocks.shuffleStatuses().keys().mkString(" ")))}
    before, set_before = held(), spark.conf.get(key, None)
    parts = words.scores(df)
    assert parts.count() == 300 and spark.conf.get(key, None) == set_before
    assert len(held() - before) <= 5  # the texts dealt to parts, the models' sizes and two sums, and the count


def test_pairs_in_turns_are_all_pairs():
    rng = random.Random(9)
    part = words._Part(pa.table({"k1": [1, None], "k2": [1, None], "n": [1, None], "body": [
        zlib.compress(b"a b c"), words._pack([(2, 2, 0, " ".join(rng.choices([f"w{k}" for k in range(50)], k=900)).encode())])]}))
    part.pair()
    for buckets in (1, 7, 40):
        whole = {b: at.tolist() for b, at in part.pairs_by_bucket(buckets)}
        turns = [{b: at.tolist() for b, at in part.pairs_by_bucket(buckets, t, 3)} for t in range(3)]
        assert {b: at for turn in turns for b, at in turn.items()} == whole and sum(map(len, turns)) == len(whole)
        assert sorted(i for at in whole.values() for i in at) == list(range(len(part.left)))
