from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import common, licenses, queries
from tests.oracle import connect, difference


def slow_statistics(words, sequences):
    """Longest run ending at each word that stands in some sequence."""
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    out = []
    for end in range(1, len(words) + 1):
        out.append(max((n for n in range(1, end + 1) if tuple(words[end - n:end]) in subs), default=0))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=4),
       st.lists(st.text("abc", min_size=1, max_size=4), max_size=3, unique=True), st.text("abcx", max_size=30))
def test_matching_statistics_and_places(templates, phrases, text):
    spaced = lambda s: " ".join(s)
    auto = licenses.Automaton({spaced(p): p for p in phrases}, {str(i): spaced(t) for i, t in enumerate(templates)})
    words = [c.encode() for c in text]
    got = [0] * len(words)
    for at, state, length in auto.statistics(words):
        got[at] = length
        for number, upto in auto.ends[state]:
            own = auto.templates[number][1]
            assert own[upto - length:upto] == words[at + 1 - length:at + 1]
        stands = {(n, u) for n, (_, own) in enumerate(auto.templates) for u in range(length, len(own) + 1)
                  if own[u - length:u] == words[at + 1 - length:at + 1]}
        assert stands == set(auto.ends[state])
    assert got == slow_statistics(list(text), [*templates, *phrases])
    want = sorted((m.start(), p) for p in phrases for m in re.finditer(f"(?={p})", text))
    assert auto.scan(words)[0] == want


def test_spans_with_gaps_and_changes():
    auto = licenses.Automaton()
    for label, text in licenses.TEMPLATES.items():
        words = common.words_of(f"und so {text} weiter".encode())
        spans = auto.scan(words)[1]
        assert (2, len(words) - 1, label, 1.0) in spans, (label, spans)
        cut = words[:7] + [b"inserted"] + words[7:]
        assert any(x == label and 0.75 <= c <= 1 for *_, x, c in auto.scan(cut)[1]), label
        half = words[:2 + len(words) // 3]
        assert not any(x == label for *_, x, _ in auto.scan(half)[1])
    prose = common.words_of(b"you may not use the copy of the file without fee and the work is free for any person " * 50)
    assert auto.scan(prose)[1] == []


def test_edges(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, None), (2, ""), (3, "..."), (4, "Under THE mit-license, under the MIT license"), (None, mit), (4, (mit + " ") * 3),
            (5, "x " * 100_000 + "Apache License, Version 2"), (6, "cc by nc by nc cc by nc"), (6, "cc by nc by nc cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "doc_id AS places")
    got = [(r.doc_id, r.n_words, [p.start for p in r.places], sorted({s.label for s in r.spans}), r.score) for r in licenses.scan(df).collect()]
    n = len(common.words_of(mit.encode()))
    assert sorted(map(repr, got)) == sorted(map(repr, [
        (1, 0, [], [], 0.0), (2, 0, [], [], 0.0), (3, 0, [], [], 0.0), (4, 8, [0, 4], [], 1.0), (None, n, [], ["mit"], 1.0),
        (4, len(common.words_of((mit + " ").encode() * 3)), [], ["mit"], 1.0), (5, 100_004, [100_000], [], 1.0), (6, 8, [0, 5], [], 1.0), (6, 8, [0, 5], [], 1.0)]))
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op9(spark, folder)
    assert difference(got.drop("labels", "score"), connect(folder), queries.OP9_SQL) is None
    for r in got.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
