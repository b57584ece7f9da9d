from __future__ import annotations

import hashlib
import random

import zstandard

from gridledger.llm import queries, warc
from tests.oracle import connect, difference


def slow(rows):
    """rows: (page_id, url, html); the expected records as a sorted list."""
    body = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in body:
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out, seen = [], set()
    for i, b in body:
        f = first.get(b) if i is not None else None
        again = f is not None and (f != i or (i, b) in seen)
        seen.add((i, b))
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_round_trip_and_ranged_reads(spark, tmp_path):
    rng = random.Random(2)
    big = "<p>" + "".join(rng.choice("abcdefgh ") for _ in range(300_000)) + "\r\n\r\nWARC/1.1 é"
    rows = [(1, "http://a/\r\nX: y", "x" * 99), (2, None, "x" * 99), (3, "u", None), (4, "u", ""), (9, "é ü", "é" * 50), (5, "u", "é" * 50),
            (7, "u", big), (8, "u", big), (8, "u", big), (None, "u", "q" * 200), (None, "u", "q" * 200), (6, "u", "é" * 49 + "a")]
    rows += [(100 + i, f"http://h/{i}", f"{i} " * 40) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload", "3 AS first")
    path = str(tmp_path / "w")
    warc.write(df.repartition(3), path, frame_bytes=4096, bundle_bytes=20_000)
    got = warc.read(spark, path).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == slow(rows)
    text = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in text for r in got if r.record_type == "response")
    at = warc.index(spark, path)
    assert at.count() == len(rows)
    asked = at.where("record in ('urn:page:7', 'urn:page:150')")
    some = warc.read(spark, path, asked)
    assert sorted(r.page_id for r in some.collect()) == [7, 150]
    for r in spark.read.parquet(path).collect():
        plain = zstandard.ZstdDecompressor().stream_reader(bytes(r.body), read_across_frames=True).read()  # skips the table
        assert len(plain) == sum(x.length for x in r.records) == sum(n for *_, n in warc.frames_of(bytes(r.body)))
    files = warc.export_bundles(spark, path, f"file://{tmp_path}/out").collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{f.bundle}.warc.zst" for f in files)
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op8(spark, folder), connect(folder), queries.OP8_SQL) is None
