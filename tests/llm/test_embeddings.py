from __future__ import annotations

import numpy as np

from gridledger.llm import embeddings, queries


def slow(rows):
    """rows: (vec_id, vector or None); (links, component) by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                near[i, j] = near[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    label = list(range(n))
    for i, j in zip(*np.nonzero(near), strict=True):
        old, new = label[i], label[j]
        label = [new if x == old else x for x in label]
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if label[k] == label[i] and rows[k][0] is not None]
        out.append((vec, int(near[i].sum()), min(ids, default=None)))
    return sorted(out, key=repr)


def test_edges_long_runs_and_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [2e300, 1e299]), (10, [1.0, 0.0, 0.0]), (None, [-1.0, 0.0])]
    center = rng.standard_normal(16)
    rows += [(100 + i, (center + 0.15 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(300 + i, rng.standard_normal(16).tolist()) for i in range(150)]
    rows += [(500 + i, (np.array(rows[-1 - i][1]) * 3 + 1e-3).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS v")
    want = slow(rows)
    for options in ({}, {"window": 8}, {"window": 8, "bits": 4}):  # four bits: runs of equal hashes over many blocks
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, **options).collect()), key=repr)
        if options.get("bits") or not options:
            assert got == want
        else:
            assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.99 * len(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    only = embeddings.near_duplicates(df.limit(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_query_recall_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op6(spark, folder).collect()
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum() - len(rows)
    found = sum(r.n_links for r in got)
    assert len(got) == len(rows) and 0.99 * near <= found <= near
    assert {r.vec_id for r in got if r.kept} == {r.component_id for r in got}
