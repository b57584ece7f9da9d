"""Near copies by word shingles: texts link at Jaccard similarity ``LIKE`` or more of their distinct five-word shingles.

Candidates come from SimHash. The covering tables of ``simhash`` (four-word shingles, radius 4) give all pairs within
their radius. Pairs at the threshold mostly differ in more bits; for them a text also has ``PRINTS`` fingerprints of 64 bits over its
distinct shingles; tables take blocks of their bits, and texts that agree on a block
and lie within the radius of all fingerprints together are candidates. Two texts
at the threshold differ in ``acos(2 s / (1 + s)) / pi`` of the bits (fewer if their sizes
differ); tables are added until such a pair is missed by all with probability at most
``1 - RECALL``. Blocks grow with the number of texts, so a bucket holds few strangers.

A few tables run first: each text takes the smallest one it links with as its own, and the
other tables add only links between those. A bucket or a block of one gives a spanning
forest, never all of its pairs, so links number at most texts times tables.

Candidates are then verified by their exact Jaccard similarity (shingles as 64-bit hashes).
The texts of a component are dealt into blocks; the component's first text goes to each of
them and is compared with the block's texts, which is linear. Only texts that this leaves
apart from the first meet the other blocks.

Rows: words are lower-cased (ASCII) and end at white space; a text of fewer than five words
is one shingle. Texts of equal shingles are one class, as are texts without words (null or
empty). Null and repeated ids are rows like any other.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm import common, simhash

WORDS = 5
LIKE = 0.8
RECALL = 0.999
PRINTS = 4
NAMES = [f"f{i}" for i in range(PRINTS)]
SEED = 42
#: Texts of a bucket, and texts and bytes of a block of candidates, compared in one step.
BLOCK, TEXTS, BYTES = 4096, 256, 1 << 20
#: One table in so many runs first.
FIRST = 8
#: Strangers in a bucket, on average; more would cost more comparisons, fewer more tables.
STRANGERS = 64
#: Buckets up to this size are compared for all rows of a batch at once.
SMALL = 1024
#: Classes with candidates, and components of several blocks, that are joined by broadcast; a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    width = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = ends - [len(w) for w in found]
    pieces = zip(starts[:len(found) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in pieces), np.uint64, len(found) - width + 1))


def _mixed(x: np.ndarray, number: int) -> np.ndarray:
    """Another hash of each hash (SplitMix64)."""
    x = x + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: bytes | None, words: int = WORDS) -> list[int]:
    """Class of the shingles and the fingerprints (majority bits of the distinct shingles), as signed integers."""
    hashes = shingle_hashes(text, words)
    out = [xxhash.xxh64_intdigest(hashes.tobytes(), SEED)]
    for number in range(1, PRINTS + 1):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), simhash.CHUNK):
            part = _mixed(hashes[at:at + simhash.CHUNK], number)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))
    return [x - (x >> 63 << 64) for x in out]


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            values = np.array([sketch(t, words) for t in texts], np.int64).reshape(-1, PRINTS + 1)
            cover = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cover), *(pa.array(c) for c in values.T)],
                                  names=["doc_id", "row_key", "cover", "node", *NAMES])
    return run


def differing(like: float) -> float:
    """Share of fingerprint bits in which two texts of equal size and that similarity differ."""
    return math.acos(2 * like / (1 + like)) / math.pi


def tables_for(bits: int, like: float = LIKE, recall: float = RECALL) -> int:
    """Tables of ``bits`` bits, dealt over the fingerprints, after which a pair at the threshold has met with that probability."""
    p = differing(like)
    odds = [math.comb(64, d) * p ** d * (1 - p) ** (64 - d) for d in range(65)]
    meet = [math.comb(64 - d, bits) / math.comb(64, bits) for d in range(65)]
    missed = lambda n: sum(o * (1 - m) ** n for o, m in zip(odds, meet, strict=True)) ** PRINTS
    each = 1
    while missed(each) > 1 - recall:
        each += 1
    return PRINTS * each


def bits_for(texts: int) -> int:
    """Bits of a block: at most ``STRANGERS`` strangers a bucket, but 10 bits at least."""
    return max(10, math.ceil(math.log2(max(texts, 1) / STRANGERS)))


def radius_for(like: float = LIKE) -> int:
    """Differing bits of all fingerprints, four deviations above the mean of a pair at the threshold."""
    p, bits = differing(like), 64 * PRINTS
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def block_masks(bits: int, tables: int) -> list[tuple[int, int]]:
    """(fingerprint, bit mask as a signed long) of each table: blocks of seeded orders of the bits."""
    rng, out = np.random.default_rng(SEED), []
    for number in range(PRINTS):
        mine: list[int] = []
        while len(mine) < tables // PRINTS:
            order = rng.permutation(64).tolist()
            mine += [sum(1 << b for b in order[at:at + bits]) for at in range(0, 64 - bits + 1, bits)]
        out += [(number, m - (m >> 63 << 64)) for m in mine[:tables // PRINTS]]
    return out


def forest(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(first, member) of each linked group; ``near`` tells which of the others link with one."""
    left, out = np.arange(size), []
    while len(left) > 1:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            hit = near(queue.pop(), left)
            if hit.any():
                queue.extend(left[hit])
                out.extend((first, x) for x in left[hit])
                left = left[~hit]
    return out


def _close(prints: np.ndarray, radius: int) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda one, others: np.bitwise_count(prints[others] ^ prints[one]).sum(axis=1) <= radius


def _join_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links a[i] - b[i] that a spanning forest needs."""
    leader: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := leader.get(x, x)) != x:
            leader[x] = x = leader.get(up, up)
        return x

    needed = []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            leader[max(x, y)] = min(x, y)
            needed.append(at)
    return a[needed], b[needed]


def _bucket_links(radius: int, block: int):
    """Rows (slot, node, comp, fingerprints..) sorted by slot: links in buckets, members of large ones with their block."""
    width = 3 + PRINTS

    def links_of(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Links between components in complete buckets of at most ``block`` rows."""
        slot, node, comp, prints = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3:].view(np.uint64)
        each = [prints[:, n].copy() for n in range(PRINTS)]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(slot)]]))
        at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        for step in range(1, SMALL):
            at = at[at + step < len(slot)]
            at = at[slot[at] == slot[at + step]]
            if not len(at):
                break
            apart = at[comp[at] != comp[at + step]]
            far = sum(np.bitwise_count(f[apart] ^ f[apart + step]).astype(np.int16) for f in each)
            hit = apart[far <= radius]
            yield np.stack([comp[hit], comp[hit + step]])
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            found = np.array(forest(size, _close(prints[start:start + size], radius)), np.int64).reshape(-1, 2)
            yield comp[start + found].T

    def record(pairs: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
        pair = _join_up(*np.unique(pair[:, pair[0] != pair[1]], axis=1))
        rows = np.concatenate([np.zeros((0, width + 1), np.int64), *members])  # slot, node, comp, fingerprints.., block
        none = np.full(len(pair[0]), -1, np.int64)
        columns = [(pair[0], rows[:, 2]), (pair[1], rows[:, 0]), *((none, rows[:, n]) for n in range(3, width + 1))]
        return pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", *NAMES, "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, blocks = np.zeros((0, width), np.int64), None, 0  # the open bucket; the large one being let go, its blocks so far
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
                cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            else:
                rows, cuts = held, np.array([len(held)])
            members = []

            def leave(part: np.ndarray) -> None:
                nonlocal large, blocks
                large, blocks = (large, blocks) if large == part[0, 0] else (part[0, 0], 0)
                number = blocks + np.arange(len(part)) // block
                blocks = int(number[-1]) + 1
                members.append(np.concatenate([part, number[:, None]], axis=1))

            first = int(cuts[0]) if len(cuts) else 0
            last = int(cuts[-1]) if len(cuts) else 0
            done, held = rows[:last], rows[last:]
            if first and (large == rows[0, 0] or first > block):  # only the first bucket can have been open
                leave(rows[:first])
                done = rows[first:last]
            pairs = []
            if len(done):
                sizes = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], done[1:, 0] != done[:-1, 0]])), [len(done)]]))
                big = np.repeat(sizes > block, sizes)
                for value in np.unique(done[big, 0]):
                    leave(done[done[:, 0] == value])
                pairs = list(links_of(done[~big])) if not big.all() else []
            if len(held) > block:  # too large to hold: whole blocks leave now
                whole = len(held) // block * block
                leave(held[:whole])
                held = held[whole:]
            yield record(pairs, members)
    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _block_links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.unique(pdf[["node", *NAMES]].to_numpy(), axis=0)
        found = np.array(forest(len(rows), _close(rows[:, 1:].view(np.uint64), radius)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": rows[found[:, 0], 0], "b": rows[found[:, 1], 0]})
    return run


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (.., block, blocks) once for every pair (i, j) of blocks with their own."""
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("block", "blocks", "other"))


def _table_links(classes: DataFrame, masks: list[tuple[int, tuple[int, int]]], radius: int, block: int) -> DataFrame:
    """Links (a, b) of components of ``classes`` (node, comp, fingerprints..) that meet in one of the numbered tables."""
    keys = [F.xxhash64(F.lit(n), F.col(f"f{i}").bitwiseAND(F.lit(m))) for n, (i, m) in masks]
    keyed = (classes.select(F.explode(F.array(*keys)).alias("slot"), "node", "comp", *NAMES)
             .repartition("slot").sortWithinPartitions("slot", "node"))
    found = common.checkpointed(keyed.mapInArrow(_bucket_links(radius, block), "a long, b long, " + ", ".join(f"{n} long" for n in NAMES) + ", block long"))
    large = found.where("block >= 0").select(F.col("a").alias("node"), F.col("b").alias("slot"), *NAMES, "block")
    blocks = large.groupBy("slot").agg((F.max("block") + 1).alias("blocks"))
    rest = (_in_block_pairs(large.join(blocks, "slot")).groupBy("slot", "i", "j")
            .applyInPandas(_block_links(radius), "a long, b long"))
    return found.where("block < 0").select("a", "b").unionByName(rest)


def candidates(classes: DataFrame, like: float = LIKE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the classes (node, fingerprints..) that meet in some table within the radius."""
    bits = bits_for(classes.count())
    masks = list(enumerate(block_masks(bits, tables_for(bits, like, recall))))
    radius = radius_for(like)
    early = _table_links(classes.withColumn("comp", F.col("node")), masks[::FIRST], radius, block)
    early = early.groupBy(F.greatest("a", "b").alias("of")).agg(F.min(F.least("a", "b")).alias("comp"))
    known = common.checkpointed(classes.select("node", *NAMES).join(early, F.col("node") == F.col("of"), "left")
                                .select("node", *NAMES, F.coalesce("comp", "node").alias("comp")))
    late = _table_links(known, [m for n, m in enumerate(masks) if n % FIRST], radius, block)
    return known.where("comp <> node").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(late)


def covered(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of ``prints`` (node, cover) whose texts the covering tables join.

    Classes of one fingerprint link with its least class, and linked fingerprints by their least classes: the
    components are left to the one pass over all candidates.
    """
    member = common.checkpointed(prints.select("node", "cover").distinct())
    least = common.checkpointed(member.groupBy("cover").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    same = member.join(least.where("n > 1"), "cover").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    across = simhash.links(least.select(F.col("cover").alias("fp")))
    for end in ("a", "b"):
        across = across.join(least.select(F.col("cover").alias(end), F.col("least").alias(f"least_{end}")), end)
    return same.unionByName(across.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def jaccard_forest(texts: list[bytes], like: float = LIKE, words: int = WORDS) -> list[tuple[int, int]]:
    """(first, member) of each group linked by exact similarity."""
    sets = [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(s) for s in sets])
    known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.split(numbers, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(known), bool)

    def near(one: int, others: np.ndarray) -> np.ndarray:
        mark[mine[one]] = True
        both = np.array([np.count_nonzero(mark[mine[o]]) for o in others])
        mark[mine[one]] = False
        return both >= like * (sizes[one] + sizes[others] - both) - 1e-9
    return forest(len(sets), near)


def _verified(like: float, words: int):
    """For a block's own texts (node, root, body) the first text they are linked with; the root's text stands in every block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "own"]).drop_duplicates("node", keep="last")
        node = pdf["node"].to_numpy()
        first = node.copy()
        for one, member in jaccard_forest(pdf["body"].tolist(), like, words):
            first[member] = node[one]
        return pd.DataFrame({"node": node, "root": pdf["root"].to_numpy(), "first": first, "blocks": pdf["blocks"].to_numpy()})[pdf["own"].to_numpy() == 1]
    return run


def _bridges(like: float, words: int):
    """Links of the texts that are ``apart`` with the texts of a block; texts of one first text are linked already."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("apart", ascending=False).drop_duplicates("node")
        comp = pdf["first"].to_numpy(copy=True)
        sets = [shingle_hashes(t, words) for t in pdf["body"]]
        sizes = np.array([len(s) for s in sets])
        out = []
        for one in range(int(pdf["apart"].sum())):
            for other in np.flatnonzero(comp != comp[one]).tolist():
                if comp[other] != comp[one]:
                    both = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
                    if both >= like * (sizes[one] + sizes[other] - both) - 1e-9:
                        out.append((comp[one], comp[other]))
                        comp[comp == comp[other]] = comp[one]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def verified(bodies: DataFrame, like: float = LIKE, words: int = WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of the texts of ``bodies`` (node, root, body) that are linked by exact similarity; ``bodies`` is a written table."""
    blocks = F.ceil(F.greatest(F.count("*") / TEXTS, F.sum(F.length("body")) / BYTES))
    many = _sized(common.checkpointed(bodies.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")), broadcast_rows)
    block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).alias("block")
    dealt = bodies.join(many, "root", "left").select("node", "root", "body", F.coalesce("blocks", F.lit(1)).alias("blocks"), block)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    roots = dealt.where("node = root and blocks > 1").select("node", "root", "body", "blocks", every, F.lit(0).alias("own"))
    near = common.checkpointed(dealt.withColumn("own", F.lit(1)).unionByName(roots).groupBy("root", "block").applyInPandas(
        _verified(like, words), "node long, root long, first long, blocks long"))
    linked = near.where("first <> node").select("node", F.col("first").alias("root"))
    apart = near.where("blocks > 1 and first <> root").select("node", "root", "first")
    if apart.isEmpty():
        return linked
    sizes = _sized(common.checkpointed(apart.groupBy("root").agg(F.ceil(F.count("*") / TEXTS).alias("groups"))), broadcast_rows)
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group")
    texts = dealt.join(sizes, "root").join(near.select("node", "first"), "node")
    left = (texts.where("first <> root").withColumn("group", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("groups")))
            .select("node", "root", "body", "first", "group", every, F.lit(1).alias("apart")))
    right = texts.select("node", "root", "body", "first", groups, "block", F.lit(0).alias("apart"))
    more = common.checkpointed(left.unionByName(right).groupBy("root", "group", "block").applyInPandas(_bridges(like, words), "a long, b long"))
    if more.isEmpty():
        return linked
    return common.components(linked.toDF("a", "b").unionByName(more))


def near_duplicates(docs: DataFrame, words: int = WORDS, like: float = LIKE, recall: float = RECALL,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, row_key, root) for every row; rows of one root are linked by verified near copies."""
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), F.col("text").cast("binary"))
    prints = common.checkpointed(slim.mapInArrow(
        _sketches(words), "doc_id long, row_key long, cover long, node long, " + ", ".join(f"{n} long" for n in NAMES)))
    classes = prints.groupBy("node").agg(*(F.first(n).alias(n) for n in NAMES))
    groups = common.components(covered(prints).unionByName(candidates(classes, like, recall)))
    groups = common.checkpointed(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()))
    # One text of each class that has a candidate.
    one = common.checkpointed(prints.join(groups, "node").groupBy("node", "root").agg(F.min("row_key").alias("row_key")))
    bodies = (docs.select(F.xxhash64("text").alias("row_key"), F.col("text").cast("binary").alias("body"))
              .join(_sized(one, broadcast_rows), "row_key").groupBy("node", "root").agg(F.first("body").alias("body")))
    found = verified(common.checkpointed(bodies), like, words, broadcast_rows)
    return (prints.join(found, "node", "left")
            .select("doc_id", "row_key", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, as ``simhash.keep_one`` chooses it."""
    return simhash.kept_first(docs, near_duplicates(docs, **options))
