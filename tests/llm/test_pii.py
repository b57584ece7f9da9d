from __future__ import annotations

import hashlib
import random
import re

from gridledger.llm import pii, queries


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow(text):
    """Base spans (kind, start, end) by the contract's patterns."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def texts():
    rng = random.Random(9)
    pieces = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "..", "a@b", "_", "%", "-", " ", "  ", "\n", "1.2.3.4", "300.1.1.1", "001.2.3.4",
              "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111 1111  1111 1111", "4012888888881881",
              "+1 (269) 555-3296", "+49.30.1234567", "+1", "+", "(", ")", "12", "é", "日本", "\U0001F600", "\x01", "\x02", "\x03", "word", "order no 123456",
              "tel: 555-1234", "joe at example dot com", "joe(at)example.org", "4222222222222", "000000000000000000", "12.5", "Z", ":"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    out += ["a@b" + ".c" * 20_000, "1 " * 30_000, "a" * 60_000, "a" * 50_000 + "@", "1." * 30_000, "+1" * 20_000, "1.2.3.4 " * 5_000,
            "a@b.c_d@e.f-g@h.i", "x" * 90_000 + " a@b.co", "9" * 50_000]
    return out


def test_base_spans_against_plain_patterns(spark):
    rows = [*enumerate(texts()), (None, None), (-1, ""), (0, "a@b.c"), (0, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans", "'x' AS kind")
    models = pii.train(df)
    got = pii.spans(df, models).collect()
    want = sorted((repr(i), slow(t)) for i, t in rows)
    assert sorted((repr(r.doc_id), [tuple(x) for x in r.base]) for r in got) == want
    assert all({tuple(x) for x in r.base} <= {tuple(x) for x in r.spans} for r in got)
    red = {r.doc_id: r.text for r in pii.redacted(df, models).collect()}
    assert red[0] is not None and red[None] is None and red[-1] == ""
    assert pii.spans(df.limit(0)).count() == 0


def test_trees_add_spans_like_the_accepted_ones_and_leave_clean_text(spark):
    rng = random.Random(3)
    good = [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or mail ab{i}@mail.example.com now" for i in range(400)]
    clean = [f"In {rng.randint(1000, 2000)} order no {rng.randint(10**15, 10**16)} of 12.50 and 3.5.1.2.9 at home" for i in range(400)]
    more = ["Mail joe(at)mail.example.com now", "mail AB9@Mail.Example.Com now"]
    df = spark.createDataFrame([*enumerate([*good, *clean, *more])], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert all([x.kind for x in got[i].spans] == [0, 3] for i in range(400))
    assert sum(len(got[i].spans) - len(got[i].base) for i in range(400, 800)) == 0
    assert [x.kind for x in got[801].spans] == [0]
    red = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert red[0] == "call [phone] or mail [email] now" and red[801] == "mail [email] now"


def test_boosting_separates_cells_and_calibration_holds_precision():
    rng = random.Random(1)
    cells = {}
    for _ in range(300):
        cell = tuple(rng.randrange(n) for n in pii.LEVELS)
        yes = cell[0] >= 2 and cell[4] > 0
        cells[cell] = (2, 98) if yes else (97, 3)
    model = pii.boost(cells)
    pii.calibrate(model, cells, 0.95)
    chosen = [c for c in cells if model.margin(c) >= model.threshold]
    assert chosen and all(c[0] >= 2 and c[4] > 0 for c in chosen)
    none = pii.boost({(0,) * 9: (5, 0)})
    pii.calibrate(none, {(0,) * 9: (5, 0)})
    assert none.threshold is None


def test_query_against_plain_patterns(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    extra = 0
    for r in queries.op4(spark, folder).collect():
        want = slow(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in range(4)]
        listed = set(filter(None, r.spans.split(",")))
        assert set(filter(None, text.split(","))) <= listed
        extra += len(listed) - len(want)
    assert extra <= 5
