from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    """rows: (doc_id, fp); smallest id reachable over pairs of at most four differing bits."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, doc), doc)
    return [least[x] for x in label]


def test_every_pair_within_the_radius_meets_in_a_table():
    tables = simhash.masks()
    rng = np.random.default_rng(1)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in tables)
    assert len(tables) == 31 and all(20 <= m.bit_count() <= 44 for m in tables)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.lists(st.integers(0, 63), max_size=40), st.integers(3, 9),
       st.integers(1, 5))
def test_buckets_split_anywhere_lose_no_link(seeds, flips, block, step):
    """Sorted rows in batches of any size: small buckets by forest, large ones by pairs of blocks."""
    values = set(seeds) | {(seeds[0] if seeds else 7) ^ (1 << f) for f in flips}
    values = np.array(sorted(values), np.uint64)
    keys = (values & np.uint64(1)).astype(np.int64)
    order = np.lexsort((values, keys))
    state = simhash._Buckets(4, block)
    parts = []
    for at in range(0, len(values), step):
        cut = order[at:at + step]
        state.add([np.zeros(len(cut), np.int32), keys[cut], values[cut]])
        parts.append(state.batch())
    state.end()
    parts.append(state.batch())
    rows = [r for p in parts for r in zip(*(c.to_pylist() for c in p.columns), strict=True)]
    links = [(a, b) for a, b, _, _, n in rows if n < 0]
    members = {}
    for a, _, _, key, n in rows:
        if n >= 0:
            members.setdefault(key, []).append((n, a))
    for found in members.values():
        for i in {n for n, _ in found}:
            for j in {n for n, _ in found}:
                both = np.unique(np.array([a for n, a in found if n in (i, j)], np.int64).view(np.uint64))
                links += [tuple(np.array(x, np.uint64).view(np.int64).tolist()) for x in simhash.forest(both, 4)]
    label = {int(v): int(v) for v in values.view(np.int64)}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        label[top(a)] = top(b)
    want = [(int(v.view(np.int64)), int(v)) for v in values]
    for key in (0, 1):
        own = [w for w, k in zip(want, keys, strict=True) if k == key]
        expect = slow_components(own)
        for i in range(len(own)):
            for j in range(i):
                assert (top(own[i][0]) == top(own[j][0])) == (expect[i] == expect[j])


def test_query_against_brute_force(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    texts = [None, "", " \t", "one", "ONE", "one two", "Été été b c d e", *base]
    texts += [b + " tail" for b in base] + [b.upper() for b in base[:3]] + [base[0]] * 5
    texts += [" ".join(w if rng.random() > 0.01 else "zz" for w in base[i % 6].split()) for i in range(60)]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    want = {i: (int(np.uint64(fp).astype(np.int64)), c) for (i, fp), c in zip(prints, slow_components(prints), strict=True)}
    assert got == want
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted({c for _, c in want.values()})
    assert simhash.keep_one(df).columns == df.columns


def test_large_buckets_null_ids_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(2**63))
    fps = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df, block=16)
    from gridledger.llm.common import components
    roots = {r.root for r in components(found).collect()}
    assert len(roots) == 1
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "q r s t u v w x"), (3, "q r s t u v w x"), (3, "k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == [(3, "k l m n"), (3, "q r s t u v w x"), (None, "a b c d e f g")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
