from __future__ import annotations

from collections import Counter

import __spark_entry__
import corpus_pipeline
from gridledger.llm import common, quality
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_mixing import slow_targets
from tests.llm.test_shingles import slow_roots

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in common.read(spark, FOLDER, "benchmark").collect()]
    out = [[tuple(r) for r in docs.collect()]]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, FOLDER)
        assert n == 4 or found.columns == columns
        found.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        out.append([tuple(r) for r in docs.collect()])
    start, good, single, clean, mixed, sharded = out
    model = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), common.read(spark, FOLDER, "labels"))
    verdict = {r.doc_id: r.rejected for r in model.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id"]).collect()}
    assert sorted(good) == sorted(r for r in start if not verdict[r[0]])
    labels = {r.doc_id: r.quality for r in common.read(spark, FOLDER, "labels").collect()}
    lost = [r[0] for r in start if labels.get(r[0]) == 1 and verdict[r[0]]]
    assert len(lost) <= 0.03 * sum(labels.values())
    good.sort()
    group = {}
    for r, label in zip(good, slow_roots([r[1] for r in good]), strict=True):  # the smallest id of each group stays
        group.setdefault(label, r[0])
    assert sorted(r[0] for r in single) == sorted(group.values())
    hits = {r[0]: slow_hits(r[1], bench) for r in single}
    assert sorted(r[0] for r in clean) == sorted(i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n))
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    source = columns.index("source")
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r[source]] += len(r[1].split())
        longest[r[source]] = max(longest[r[source]], len(r[1].split()))
    for r in mixed:
        taken[r[source]] += len(r[1].split())
    want = slow_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 3 * longest[s] for s in sizes)
    assert Counter(r[:-2] for r in sharded) == Counter(mixed)
    by = Counter(r[-2] for r in sharded)
    assert max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r[-1] for r in sharded if r[-2] == s) == list(range(by[s]))


def test_run_and_registration(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).columns[-2:] == ["shard", "slot"]
    assert len([q for q in __spark_entry__.queries() if q.startswith("op")]) >= 10
