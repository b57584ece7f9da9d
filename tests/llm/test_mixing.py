from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

from gridledger.llm import mixing, queries


def slow_targets(sizes):
    """sizes: source -> words; shares by weight, stopped at three times the size, exactly."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        free -= over
    return target | {s: level * weight[s] for s in free}


def close(rows, sizes):
    want = slow_targets(sizes)
    words, longest = Counter(), Counter()
    for source, r in rows:
        assert abs(r.target - want[source]) <= 1e-9 * max(1, want[source])
        assert r.source_size == sizes[source] and r.taken <= 3 * r["size"]
        words[source] += r.taken
        longest[source] = max(longest[source], r["size"])
    for source in sizes:
        assert abs(words[source] - want[source]) <= 6 * longest[source] + 0.02 * float(want[source])


def test_edges_and_hot_source(spark):
    docs = [(i, "w " * (1 + i * i % 90), "hot") for i in range(900)] + [(i, "a b c", "é") for i in range(30)]
    docs += [(1, None, None), (None, "x y", None), (2, "", "empty"), (3, "  ", "empty"), (4, "z", "")] + [(9, "rep eat", "r")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target")
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    slim = df.selectExpr("doc_id", "text", "source")
    got = mixing.taken(slim).collect()
    assert len(got) == len(docs)
    source = {}
    for i, t, s in docs:
        source.setdefault(sizes[s], s)
    close([(source[r.source_size], r) for r in got if r.source_size], {s: n for s, n in sizes.items() if n})
    assert all(r.taken == 0 == r.target for r in got if r.source_size == 0)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(slim.repartition(3)).collect()))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(r.copies for r in mixing.taken(df).collect()) == out.count()
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.taken(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op10(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes = defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text))
        sizes[docs[r.doc_id].source] += r["size"]
    for r in got:
        assert r.source_size == sizes[docs[r.doc_id].source]
    want = slow_targets(sizes)
    words = Counter()
    for r in got:
        source = docs[r.doc_id].source
        assert abs(r.target - float(want[source])) < 1e-6 and r.taken <= 3 * r["size"]
        words[source] += r.taken
    longest = Counter()
    for r in got:
        longest[docs[r.doc_id].source] = max(longest[docs[r.doc_id].source], r["size"])
    assert all(abs(words[s] - want[s]) <= longest[s] for s in want)
    assert sum(abs(words[s] - want[s]) for s in want) <= 0.04 * sum(want.values())  # some fifty documents a source
