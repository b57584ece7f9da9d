from __future__ import annotations

from gridledger.llm import preference, queries
from tests.oracle import connect, difference


def slow(turns, pairs):
    """turns: conv -> [(role, text)]; expected rows of known pairs."""
    show = lambda part: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in part)
    out = []
    for pair, chosen, rejected in pairs:
        if chosen in turns and rejected in turns:
            a, b = turns[chosen], turns[rejected]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            masks = []
            for part in (a[n:], b[n:]):
                at, spans = 0, []
                for r, t in part:
                    head, whole = at + len(f"<|im_start|>{r}\n"), at + len(show([(r, t)]))
                    if r == "assistant":
                        spans.append((head, whole))
                    at = whole
                masks.append(spans)
            status = {0: "equal", 1: "prefix", 2: "pair"}[(len(a) > n) + (len(b) > n)]
            out.append((pair, chosen, rejected, status, n, show(a[:n]), show(a[n:]), masks[0], show(b[n:]), masks[1]))
    return sorted(out, key=repr)


def test_prefixes_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é \U0001F600"), (1, 2, "user", "more"), (1, 3, "assistant", "end"),
            (2, 0, "user", "hi"), (2, 5, "assistant", "é \U0001F600"), (2, 9, "user", "other"), (3, None, None, None), (3, 0, "user", ""),
            (4, 0, "user", "hi"), (4, 1, "assistant", "é \U0001F600"), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 0, "assistant", "b"),
            (None, 0, "user", "lost"), (6, 0, "user", "long " * 50_000), (7, 0, "user", "long " * 50_000), (7, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS place")
    pairs = [(1, 1, 2), (2, 1, 1), (3, 4, 1), (4, 3, 1), (5, 1, 99), (6, None, 1), (7, 5, 4), (8, 6, 7), (9, 1, 2), (9, 1, 2), (None, 1, 4)]
    p = spark.createDataFrame(pairs, "pair_id long, chosen long, rejected long")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "none", r[3] or "")
    turns = {}
    for r in sorted([r for r in rows if r[0] is not None], key=key):
        turns.setdefault(r[0], []).append((r[2] or "none", r[3] or ""))
    got = preference.format_pairs(preference.ordered_turns(df), p).collect()
    got = [tuple([tuple(s) for s in v] if isinstance(v, list) else v for v in r) for r in got]
    assert sorted(got, key=repr) == slow(turns, pairs)
    none = preference.ordered_turns(df.limit(0))
    assert preference.format_pairs(none, p).count() == 0
    assert preference.format_pairs(none, p, preference.rejected_sides(none)).count() == 0


def slow_sides(turns):
    """Rejected side of every conversation, by walking them in order."""
    ids, out = sorted(turns), {}
    answers = {c: [t for r, t in turns[c] if r == "assistant"][-1:] for c in ids}
    for n, c in enumerate(ids):
        like = [d for d in ids[n + 1:] if turns[d][0] == turns[c][0]]
        donors = [answers[d][0] for d in ids[n + 1:] + ids if answers[d]]
        side = list(turns[c])
        if like:
            side = turns[like[0]]
        elif donors and answers[c]:
            last = max(i for i, (r, _) in enumerate(side) if r == "assistant")
            side[last] = ("assistant", donors[0])
        elif donors:
            side.append(("assistant", donors[0]))
        out[c] = side
    return out


def test_every_conversation_has_a_row(spark, monkeypatch):
    """Ids 5, 6 and -6; chunks of two ids; no answer, one answer, a long one, turns after the answer, equal answers, shared openings."""
    rows = [(5, 0, "user", "a"), (5, 1, "assistant", "x"), (5, 2, "user", "later"), (6, 0, "user", "b"), (6, 1, "assistant", "y"),
            (-6, 0, "user", "c"), (-6, 1, "user", "nobody answers"), (7, 0, "user", "d"), (8, 0, "user", "e"), (8, 1, "assistant", "z"),
            (8, 2, "assistant", "long " * 50_000), (9, 0, "assistant", "same"), (10, 0, None, None), (11, 0, "user", "f"), (11, 3, "assistant", "same"),
            (12, 0, "user", "a"), (12, 1, "assistant", "x"), (12, 2, "user", "other"), (20, 0, "user", "a"), (21, 0, "user", "g"), (21, 0, "user", "g"),
            (10**12, 0, "user", "h"), (10**12, 1, "assistant", "x"), (None, 0, "assistant", "lost")]
    turns = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or 0)):
        turns.setdefault(r[0], []).append((r[2] or "none", r[3] or ""))
    sides = slow_sides(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    monkeypatch.setattr(preference, "CHUNK", 2)
    ordered = preference.ordered_turns(df)
    got = {}
    for r in preference.rejected_sides(ordered).collect():
        got.setdefault(r.conv, {})[r.place] = (r.role, r.text)
    assert {c: [t for _, t in sorted(v.items())] for c, v in got.items()} == sides
    pairs = spark.createDataFrame([(c, c, c) for c in turns], "pair_id long, chosen long, rejected long")
    found = preference.format_pairs(ordered, pairs, preference.rejected_sides(ordered)).collect()
    found = sorted((tuple([tuple(s) for s in v] if isinstance(v, list) else v for v in r) for r in found), key=repr)
    want = [(c, c, c, *slow({1: turns[c], 2: sides[c]}, [(0, 1, 2)])[0][3:]) for c in turns]
    assert found == sorted(want, key=repr)
    assert {r[3] for r in found} == {"pair", "prefix", "equal"}


def test_query_against_sql_and_no_turn_lost(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op5(spark, folder), connect(folder), queries.OP5_SQL) is None
    turns = preference.ordered_turns(spark.read.parquet(f"{folder}/conversations.parquet")).collect()
    rows = {r.pair_id: r for r in queries.op5(spark, folder).collect()}
    assert set(rows) == {t.conv for t in turns}
    for c, r in rows.items():
        whole = "".join(f"<|im_start|>{t.role}\n{t.text}<|im_end|>\n" for t in sorted((t for t in turns if t.conv == c), key=lambda t: t.place))
        assert r.prompt + r.chosen_text == whole
    assert {r.status for r in rows.values()} >= {"pair", "prefix"}
