"""Queries of the training-data operators on the given tables, with equal SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import (codebooks, common, decontaminate, embeddings, interactions, licenses, mixing, packing, pii, preference,
                            quality, sharding, simhash, warc)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op3_simhash_covering")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents as lists of lower-cased words, benchmark windows, and their occurrences.
OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i + 1:i + least(13, len(w))], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i
        FROM doc, (SELECT DISTINCT k FROM pattern) WHERE len(w) >= k)),
occurrence AS (SELECT doc_id, i, g.k, item_id FROM gram g JOIN pattern USING (k, p)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM occurrence) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurrence) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontaminate.scan(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op7_external_shuffle")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shard sizes differ by one row at most."""
    columns = {
        "doc_id": F.col("doc_id"),
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")),
    }
    placed = sharding.places(common.read(spark, sf_dir, "documents"), columns)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op10_mix_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    found = mixing.taken(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)
"""


@query("op8_warc_bundles", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC bundles into the shared folder and read back."""
    folder = common.shared_folder(spark)
    warc.write(common.read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("payload")


OP9_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrase(p, k, label) AS (VALUES ('under the mit license', 4, 'mit'), ('apache license version 2', 4, 'apache-2'), ('cc by nc', 3, 'cc-by-nc')),
place AS (
  SELECT doc_id, i, label
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM doc WHERE len(w) >= 3) JOIN phrase
    ON array_to_string(w[i + 1:i + k], ' ') = p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels
FROM doc LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i) AS BIGINT) AS last_word,
                           string_agg(DISTINCT label, ',' ORDER BY label) AS labels
                    FROM place GROUP BY doc_id) USING (doc_id)
"""


@query("op9_license_automaton")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    found = licenses.scan(common.read(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"), "score")


@query("op1_quality_perplexity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    docs = common.read(spark, sf_dir, "documents")
    judged = quality.train(docs, common.read(spark, sf_dir, "labels")).judge(docs, ["doc_id", "lang"])
    return judged.select("doc_id", "lang", "perplexity", "score", "bound", "rejected")


@query("op4_pii_boosting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    found = pii.spans(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)),
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op6_embedding_passes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(common.read(spark, sf_dir, "embeddings"))


#: Rejected sides (``rej``): the next conversation with the same first turn, else the conversation with another's answer.
OP5_SQL = r"""
WITH t AS (
  SELECT conv_id AS conv, coalesce(role, 'none') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'none'), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
sibling AS (SELECT conv, lead(conv) OVER (PARTITION BY role, text ORDER BY conv) AS other FROM t WHERE place = 0 QUALIFY other IS NOT NULL),
ends AS (SELECT conv, count(*) AS n, max(place) FILTER (role = 'assistant') AS last, arg_max(text, place) FILTER (role = 'assistant') AS answer FROM t GROUP BY conv),
donor AS (
  SELECT e.conv, e.n, e.last,
         coalesce((SELECT arg_min(answer, conv) FROM ends x WHERE x.conv > e.conv AND answer IS NOT NULL), (SELECT arg_min(answer, conv) FROM ends WHERE answer IS NOT NULL)) AS other
  FROM ends e WHERE conv NOT IN (SELECT conv FROM sibling)),
rej AS (
  SELECT s.conv, t.place, t.role, t.text FROM sibling s JOIN t ON t.conv = s.other
  UNION ALL SELECT t.conv, place, role, CASE WHEN place = last THEN coalesce(other, text) ELSE text END FROM t JOIN donor USING (conv)
  UNION ALL SELECT conv, n, 'assistant', other FROM donor WHERE last IS NULL AND other IS NOT NULL),
cut AS (
  SELECT conv, coalesce(min(place) FILTER (t.role IS NULL OR rej.role IS NULL OR t.role <> rej.role OR t.text <> rej.text), any_value(n)) AS k
  FROM t FULL JOIN rej USING (conv, place) JOIN ends USING (conv) GROUP BY conv),
turn AS (
  SELECT conv, side, place, role, text, k, 24 + length(role) + length(text) AS size
  FROM (SELECT *, 'c' AS side FROM t UNION ALL SELECT *, 'r' FROM (SELECT conv, role, text, place FROM rej)) JOIN cut USING (conv)),
span AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown,
         coalesce(sum(size) FILTER (place >= k) OVER (PARTITION BY conv, side ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM turn)
SELECT conv AS pair_id,
       CASE (count(*) FILTER (side = 'c' AND place >= k) = 0)::INT + (count(*) FILTER (side = 'r' AND place >= k) = 0)::INT
         WHEN 2 THEN 'equal' WHEN 1 THEN 'prefix' ELSE 'pair' END AS status,
       CAST(any_value(k) AS INTEGER) AS n_prefix,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'c' AND place < k), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'c' AND place >= k), '') AS chosen_text,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'r' AND place >= k), '') AS rejected_text,
       coalesce(string_agg((before + 13 + length(role)) || ':' || (before + size), ',' ORDER BY place)
         FILTER (side = 'c' AND place >= k AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((before + 13 + length(role)) || ':' || (before + size), ',' ORDER BY place)
         FILTER (side = 'r' AND place >= k AND role = 'assistant'), '') AS rejected_mask
FROM span GROUP BY conv
"""


@query("op5_preference_pairs", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against another one with its opening turn, or against itself with another one's answer."""
    turns = common.checkpointed(preference.ordered_turns(common.read(spark, sf_dir, "conversations")))
    conv = F.col("conv")
    pairs = turns.select(conv.alias("pair_id"), conv.alias("chosen"), conv.alias("rejected")).distinct()
    found = preference.format_pairs(turns, pairs, preference.rejected_sides(turns))
    listed = lambda mask: F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias(mask)
    return found.select("pair_id", "status", "n_prefix", "prompt", "chosen_text", "rejected_text", listed("chosen_mask"), listed("rejected_mask"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    found = packing.pieces(common.read(spark, sf_dir, "documents"), ["doc_id"])
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_sql(rounds: int = codebooks.ROUNDS) -> str:
    """The rounds unrolled: assignment ``a<r>`` to codebook ``c<r>``, then codebook ``c<r+1>``."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, p, e, d FROM (
    SELECT vec_id, p, e, d, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS best
    FROM (SELECT vec_id, p, e, sum((x - y) * (x - y)) AS d FROM comp JOIN c{r} USING (p, j) GROUP BY ALL)) WHERE best = 1)"""
    update = """
c{n} AS MATERIALIZED (
  SELECT p, e, j, CAST(coalesce((s - ((s % n + n) % n)) // n, y) AS BIGINT) AS y
  FROM c{r} LEFT JOIN (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM a{r} JOIN comp USING (vec_id, p) GROUP BY ALL) USING (p, e, j))"""
    body = ",".join(assign.format(r=r) + "," + update.format(r=r, n=r + 1) for r in range(rounds)) + "," + assign.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({codebooks.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
comp AS MATERIALIZED (
  SELECT vec_id, k * {codebooks.PARTS} // len AS p, k % (len // {codebooks.PARTS}) AS j, x
  FROM (SELECT vec_id, len(v) AS len, unnest(v) AS x, unnest(range(0, len(v))) AS k FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {codebooks.ENTRIES}),
c0 AS MATERIALIZED (SELECT p, e, j, x AS y FROM first JOIN comp USING (vec_id)),{body},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query("op12_member_resident_codes", op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    books, coded = codebooks.fit(common.read(spark, sf_dir, "embeddings"))
    return codebooks.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


OP13_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INTEGER) AS mask
  FROM doc),
tally AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM failed LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
filter(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
place AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
         unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) AS before,
         unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit
  FROM filter a, filter b, filter c, filter d, filter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM place, tally GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every order of the five filters, for each language."""
    return interactions.audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
