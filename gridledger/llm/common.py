"""Shared pieces: words, row identity, size-checked broadcast, connected components."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.session import cut_lineage

#: Words of ASCII letters, digits and everything beyond ASCII; the text is lower-cased (A-Z) first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a UTF-8 text to word bytes (lower-cased) or a space, so that ``split`` gives the words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    """Words (``WORD``) of a UTF-8 text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_keys(df: DataFrame) -> list[Column]:
    """128-bit identity of a whole row: equal rows are interchangeable. Map columns count by entries."""
    parts = []
    for name, kind in df.dtypes:
        column = F.col(quoted(name))
        parts.append(F.to_json(F.struct(column)) if kind.startswith(("map", "variant")) else column)
        parts.append(column.isNull())
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    return cut_lineage(df)


def landed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint after which the shuffles that made it are removed from the executors' disks; those of cached tables stay."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return checkpointed(df.select("*"))  # a plan is told when it is made
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder (a temporary one in local sessions that have none)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node.

    Alternates large-star and small-star steps, in which every node hands its
    neighbours the smallest node it knows; a component of any shape becomes a
    star in a logarithmic number of rounds. Only links move, a hub's links are
    joined with one minimum (adaptive execution splits them), and each round is
    checkpointed. Self links and links with a null end are ignored; nodes
    without links are not returned.
    """
    links = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    links = checkpointed(links)
    before = None
    while True:
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # A neighbour above the least one is handed the least; the row of the least one keeps the node's own link.
        own = F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u"))
        links = checkpointed(large.join(least, "u").select(own.alias("u"), F.col("m").alias("v")).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
