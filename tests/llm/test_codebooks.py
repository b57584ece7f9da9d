from __future__ import annotations

import hashlib
import math

import numpy as np

from gridledger.llm import codebooks, queries
from tests.oracle import connect, difference


def plain(rows, rounds=6, entries=16, parts=8):
    """Lloyd's rounds over Python integers: {row number: (code, error)}, digest of the codebooks."""
    kept = [(i, v, [math.floor(4096 * x) for x in e]) for i, v, e in rows]
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0))
    n = len(kept[0][2])
    cut = lambda v, p: v[p * n // parts:(p + 1) * n // parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        near = [[nearest(v, p)[1] for p in range(parts)] for _, _, v in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, _, v), at in zip(kept, near, strict=True) if at[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = {}
    for i, _, v in kept:
        found = [nearest(v, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op12(spark, folder), connect(folder), queries.op12_sql()) is None


def test_rounds_ties_repeats_and_uneven_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, round(float(rng.integers(0, 40))), rng.normal(size=11).round(2).tolist()) for i in range(60)]
    rows += [(60 + i, 100 + i, [0.5] * 11) for i in range(40)]  # a group of copies
    rows += [(100, 200, [7.0] * 11), (101, None, [1.0] * 11)]
    rows = [(i, v if i >= 60 else i, e) for i, v, e in rows]
    df = spark.createDataFrame([(v, e, None if i % 3 else "l", "x") for i, v, e in rows], "vec_id long, embedding array<double>, label string, entry string")
    want, digest = plain(rows)
    books, coded = codebooks.fit(df, members=8)
    assert books.sha256() == digest
    found = codebooks.with_label_error(coded).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in found) == sorted(
        (v is None, v or 0, *want[i]) for i, v, _ in rows)
    for label in (None, "l"):
        total = sum(want[i][1] for i, _, _ in rows if (None if i % 3 else "l") == label)
        assert {r.label_error for r in found if r.label == label} == {total}
    some = found[0]
    assert len(books.vector(some.code)) == 11


def test_repeated_rows_count_each(spark):
    rows = [(i, i // 3, [float(i // 3 % 5), 1.0, -2.5, 0.25, 3.0, 1e-3, 0.0, float(i // 6)]) for i in range(60)]
    df = spark.createDataFrame([(v, e, 1) for _, v, e in rows], "vec_id long, embedding array<float>, label int")
    want, digest = plain([(i, v, [float(np.float32(x)) for x in e]) for i, v, e in rows])
    books, coded = codebooks.fit(df)
    assert books.sha256() == digest
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted((v, *want[i]) for i, v, _ in rows)


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    good = [(1, [0.1] * 8, 1), (2, [0.2] * 8, None)]
    bad = [(0, None, 1), (3, [], 1), (4, [0.1] * 7 + [None], 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [0.1] * 9, 1), (8, [1e30] * 8, 1)]
    books, coded = codebooks.fit(spark.createDataFrame(good + bad, schema))
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    for rows in ([], bad[:5]):
        books, coded = codebooks.fit(spark.createDataFrame(rows, schema))
        assert codebooks.with_label_error(coded).collect() == [] and books.entries.size == 0
