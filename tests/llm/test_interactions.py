from __future__ import annotations

from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from gridledger.llm import interactions, queries
from tests.oracle import connect, difference


def marginal(value):
    """Shapley values times the number of orders, by walking all orders."""
    n = len(value).bit_length() - 1
    out = [0] * n
    for order in permutations(range(n)):
        before = 0
        for i in order:
            out[i] += value[before | 1 << i] - value[before]
            before |= 1 << i
    return out


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=31, max_size=31))
def test_least_squares_is_the_mean_over_orders(values):
    value = [0, *values]
    assert [120 * x for x in interactions.shapley(value)] == marginal(value)


def words(text):
    return [w for w in text.translate({i: " " for i in range(9, 14)}).split(" ") if w]


def plain(docs, labels):
    """Every order of the filters applied left to right, document by document."""
    docs = [(d, part or "", text or "") for d, part, text in docs]
    good, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    failed = []
    for d, _, text in docs:
        w = words(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        copy = d is not None and any(o is not None and o < d and t == text for o, _, t in docs)
        failed.append("".join(f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), copy), strict=True) if x))
    rows = []
    for part in {p for _, p, _ in docs}:
        mine = [(d, f) for (d, p, _), f in zip(docs, failed, strict=True) if p == part]
        total = {f: 0 for f in "ABCDE"}
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                found.append((part, order, step, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == f for x in mine),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        rows += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return sorted(rows)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_walking_the_orders(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, "en", long), (2, "en", long), (2, "en", long), (3, "de", long), (None, "en", long), (None, None, "short"), (4, None, None), (5, "", ""),
            (6, "en", "a " * 300), (7, "en", long.upper()), (8, "de", long + " 5%"), (9, "en", long + "\x0b|x y"), (10, "fr", "É" * 5000),
            (11, "fr", "word " * 50_000), (-3, "de", "short"), (12, "en", long.upper() + " #"), (1, "en", "tie"), (2, "fr", "tie"), (2, "fr", "tie")]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, 1), (6, 1, None), (99, 1, 1), (None, 1, 1), (7, 0, 1)]
    df = spark.createDataFrame([(d, p, t, 7) for d, p, t in docs], "doc_id long, lang string, text string, mask int")
    given_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(df, given_labels)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, labels)
    assert interactions.audit(df.limit(0), given_labels).collect() == []
    assert interactions.audit(df, given_labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op13(spark, folder), connect(folder), queries.OP13_SQL) is None
