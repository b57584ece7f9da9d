"""Order-dependent operators against brute force, with one group holding most rows."""
from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridledger.operators.evidence import dedup_capped, greedy_dedup
from gridledger.operators.joins import match_plants, match_word_terms
from gridledger.operators.prices import price_day_summary
from gridledger.operators.ranking import (
    cap_documents, number_rows, number_sources, one_per_domain, rank_results, until_satisfied)
from gridledger.sources.prices import typed_price_rows

QUIET = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def walk(rows):
    """Sequential reference: (packet, pos, url, fingerprint) to retained positions."""
    kept, urls, prints = set(), set(), set()
    for packet, pos, url, text in sorted(rows):
        if (packet, url) in urls or (packet, text) in prints:
            continue
        kept.add((packet, pos))
        urls.add((packet, url))
        prints.add((packet, text))
    return kept


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "packet_id int, pos int, dedup_url string, fingerprint string").withColumn(
        "generic", F.lit(False))


@QUIET
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=40))
def test_greedy_dedup_is_sequential(spark, picks):
    rows = [(p, i, f"u{u}", f"t{t}") for i, (p, u, t) in enumerate(picks)]
    got = greedy_dedup(docs_frame(spark, rows)).where("retained").collect()
    assert {(r.packet_id, r.pos) for r in got} == walk(rows)


def test_greedy_dedup_chain_and_hot_copies(spark):
    chain = [(0, i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(60)]
    copies = [(1, i, f"v{i}", "same") for i in range(2000)]
    for at_once in (100, 100_000):  # in rounds, and by one walk per packet
        got = greedy_dedup(docs_frame(spark, chain + copies), walk=at_once).where("retained").collect()
        assert {(r.packet_id, r.pos) for r in got} == walk(chain + copies)


def test_a_long_chain_and_many_packets_cost_one_walk(spark):
    """Every second document of a chain of alternating keys falls to the one before it."""
    chain = [(0, i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(10_000)]
    many = [(p, i, f"u{i % 3}", f"t{i % 2}") for p in range(1, 400) for i in range(5)]
    df = docs_frame(spark, chain + many).repartition(4)
    spark.sparkContext.setJobGroup("walk", "walk")
    out = greedy_dedup(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk"))
    spark.sparkContext.setJobGroup("other", "other")
    got = out.where("retained").collect()
    assert {(r.packet_id, r.pos) for r in got} == walk(chain + many)
    assert jobs <= 6  # the checkpoint and the look for large packets, whatever their number


def test_dedup_capped(spark):
    rng = random.Random(3)
    rows = [(p, i, f"u{rng.randint(0, 2)}", f"t{rng.randint(0, 2)}") for p in range(40) for i in range(6 if p else 40)]
    got = dedup_capped(docs_frame(spark, rows), key="packet_id").where("retained").collect()
    assert {(r.packet_id, r.pos) for r in got} == walk(rows)


def test_numbering_a_hot_group_in_chunks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", i, float(rng.randint(0, 4)))
            for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "question_id string, pos bigint, score double")
    out = number_sources(df, chunk_size=100).collect()
    ranked = rank_results(df, chunk_size=100).collect()
    by_key = {}
    for key, pos, score in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(key, []).append((pos, score))
    assert {(r.question_id, r.pos): r.source_no for r in out} == {
        (k, pos): i + 1 for k, items in by_key.items() for i, (pos, _) in enumerate(items)}
    assert {(r.question_id, r.pos): r.result_rank for r in ranked} == {
        (k, pos): i + 1 for k, items in by_key.items()
        for i, (pos, _) in enumerate(sorted(items, key=lambda x: (-x[1], x[0])))}


def test_number_rows_only_sorts_chunks(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("pos"))
    plan = number_rows(df, ["key"], [F.col("pos")], [("c", F.floor(F.col("pos") / 10), True)])
    assert plan.agg(F.max("row_no")).first()[0] == 1000


def test_until_satisfied_matches_a_loop(spark):
    rng = random.Random(7)
    rows = [(q, i, rng.randint(0, 2)) for q in range(30) for i in range(12)]
    rows = [(q, i, n, rng.randint(0, n)) for q, i, n in rows]
    df = spark.createDataFrame(rows, "question_id int, pos int, records int, primary_records int")
    for need, primary in ((1, True), (4, True), (3, False)):
        expected = set()
        for q in range(30):
            have = seen = 0
            for _, i, n, p in sorted(r for r in rows if r[0] == q):
                expected.add((q, i))
                have, seen = have + n, seen + p
                if n and have >= need and (seen or not primary):
                    break
        got = until_satisfied(df, min_records=need, require_primary=primary).collect()
        assert {(r.question_id, r.pos) for r in got} == expected


def test_caps(spark):
    docs = spark.createDataFrame([(1, i, i not in (2, 5)) for i in range(20)], "question_id int, pos int, accepted boolean")
    assert sorted(r.pos for r in cap_documents(docs).collect()) == list(range(8))
    rows = [(1, 0, "a", False), (1, 1, "a", True), (1, 2, "a", True), (1, 3, "", True), (1, 4, "", True),
            (1, 5, "b", True), (1, 6, "c", True), (1, 7, "d", True), (1, 8, "e", True)]
    df = spark.createDataFrame(rows, "question_id int, pos int, domain string, ok boolean")
    assert sorted(r.pos for r in one_per_domain(df).collect()) == [1, 3, 4, 5]


def test_plant_tiers(spark):
    units = spark.createDataFrame([(0, "Diablo Canyon 1", 100), (1, "Diablo Canyon 2", 0), (2, "Canyon", 50)],
                                  "pos int, unit_name string, power_percent int")
    asks = spark.createDataFrame([("diablo-canyon",), ("CANYON",), ("Palo",)], "plant_query string")
    got = {(r.plant_query, r.unit_name, r.tier) for r in match_plants(asks, units).collect()}
    assert got == {("diablo-canyon", "Diablo Canyon 1", 2), ("diablo-canyon", "Diablo Canyon 2", 2),
                   ("CANYON", "Canyon", 1)}


def test_word_terms_match_whole_words_only(spark):
    texts = spark.createDataFrame([(1, "The unit's heat-wave!"), (2, "community wave"), (3, "heat")], "id int, text string")
    vocab = spark.createDataFrame([("a", "unit"), ("w", "heat wave"), ("h", "heat")], "label string, term string")
    got = {(r.id, r.term) for r in match_word_terms(texts, vocab, "id", "text").collect()}
    assert got == {(1, "unit"), (1, "heat wave"), (1, "heat"), (3, "heat")}


def test_day_repeated_many_times(spark):
    rows = spark.range(20_000).select(
        F.lit("TH_NP15_GEN-APND").alias("location"), F.lit("DAM").alias("market"), F.lit("LMP").alias("component"),
        F.date_format(F.timestamp_seconds(1785654000 + (F.col("id") % 24) * 3600), "yyyy-MM-dd HH:mm:ss").alias("interval_start"),
        F.date_format(F.timestamp_seconds(1785657600 + (F.col("id") % 24) * 3600), "yyyy-MM-dd HH:mm:ss").alias("interval_end"),
        (F.col("id") % 7).cast("string").alias("price"), F.lit(None).cast("string").alias("operating_hour"),
        F.lit(None).cast("string").alias("operating_interval"))
    row = price_day_summary(typed_price_rows(rows)).collect()
    assert len(row) == 1 and row[0].row_count == 20_000 and row[0].actual_count == 24
    assert row[0].coverage == "duplicate"


def test_plants_by_pieces_against_plain_search(spark):
    """Exact name, else names that contain the query; short queries, repeated letters, a piece that no name has."""
    from gridledger.operators.joins import match_plants
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    asks = ["a", "ab", " a ", "abc", "aaa", "zz", "", None, "A-B", "b c"] + ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    units = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "unit int, unit_name string")
    questions = spark.createDataFrame([(i, q) for i, q in enumerate(asks)], "question_id int, plant_query string")
    norm = lambda t: " ".join((t or "").lower().replace("-", " ").split())
    want = set()
    for i, q in enumerate(asks):
        if norm(q):
            exact = [u for u, n in enumerate(names) if norm(n) == norm(q)]
            inside = [u for u, n in enumerate(names) if norm(q) in norm(n)]
            want |= {(i, u, 1 if exact else 2) for u in exact or inside}
    assert {(r.question_id, r.unit, r.tier) for r in match_plants(questions, units).collect()} == want
