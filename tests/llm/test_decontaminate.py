from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import decontaminate, queries
from tests.oracle import connect, difference

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def slow(text, bench, window=13):
    w = words(text)
    hit, items = set(), set()
    for item, body in bench:
        b = words(body)
        k = min(window, len(b))
        for i in range(len(b) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j:j + k] == b[i:i + k]:
                    hit.update(range(j, j + k))
                    items.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.sampled_from("abc"), max_size=40),
       st.integers(1, 5))
def test_tables_find_every_occurrence(bench, doc, window):
    tables = decontaminate.tables_of([(str(i), [x.encode() for x in b]) for i, b in enumerate(bench)], window)
    hits, found = bytearray(len(doc)), set()
    for table in tables:
        table.scan([x.encode() for x in doc], hits, found)
    assert (len(doc), sum(hits), sorted(found)) == slow(" ".join(doc), [(i, " ".join(b)) for i, b in enumerate(bench)], window)


def test_scan_in_one_and_in_many_shards(spark):
    long = " ".join(f"w{i % 17}x{i}" for i in range(60))
    bench = [(1, long), (2, "Short, item!"), (3, None), (4, "..."), (None, "été naïve"), (2, "Short, item!"), (5, long[40:200])]
    docs = [(1, None, "a"), (2, "", "a"), (3, "a SHORT item here", "a"), (4, "x " * 5000 + long + " y" * 400, "b"),
            (4, long, "b"), (None, "un ÉTÉ été naïve", "b"), (7, "nothing at all", None), (3, "a SHORT item here", "a")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    want = sorted((repr((i, h)), *slow(t, bench)) for i, t, h in docs)
    for size in (200_000, 20):
        got = decontaminate.scan(d, b, shard_words=size)
        assert sorted((repr((r.doc_id, r.hits)), r.n_words, r.n_hit, r["items"]) for r in got.collect()) == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.collect())
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in want)
    assert decontaminate.keep_clean(d, b.limit(0)).count() == len(docs)
    assert decontaminate.scan(d.limit(0), b).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op2(spark, folder), connect(folder), queries.OP2_SQL) is None
