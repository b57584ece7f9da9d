"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed capacity.

A document is its token ids and an end token; one longer than a sequence is cut into full
pieces and a rest. Pieces are dealt into random groups of about ``GROUP`` pieces. Within a
group they are placed longest first, each into the open sequence with the least room that
still holds it; a segment tree over the remaining capacities finds that room in logarithmic
time. Sequences with at most ``SLACK`` tokens of room are done; the pieces of the others meet
in a next round of fewer groups, as long as a round at least halves their number. So each
task sees a bounded group, and the groups lose next to nothing against one packing of all.

Only piece lengths and the columns asked for are shuffled, never texts. Results are a
function of the input files' split (pieces are dealt by their place in it).

Rows: null and empty texts are one piece that holds the end token alone. Null and repeated
ids and repeated rows are documents like any other. An empty table gives no pieces. Columns
kept from the input keep their names; a new one whose name is taken gets a leading ``_``.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm import common

CAPACITY = 4096
END = 1
#: Pieces of a group, on average.
GROUP = 4096
#: Room that a finished sequence may have.
SLACK = 32
SEED = 11
#: Word pieces whose ids a task remembers.
REMEMBERED = 600_000

#: Texts of these characters alone (ASCII, Latin letters, common punctuation) may be cut at word pieces before they
#: are tokenized: composing leaves them as they are, lower-casing goes letter by letter, and no marker can be in them.
PLAIN = re.compile("[\t\n\r\x20-\x3b\x3d-\x7e¡-¬®-įı-ſ‐-‧€]*")
#: What the tokenizer's own pattern finds in lower-cased plain texts: endings, runs of letters, digits, other runs.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|"
                   "[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼-¾]|"
                   "[^\\sa-z0-9ª²³µ¹º¼-¾ß-öø-ÿĀ-ſ]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts by a tokenizer file; ids of word pieces are remembered where a text is plain."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.cut = self._ends_words()
        self.forget()

    def _ends_words(self) -> bool:
        """Whether word ends are marked and the pattern is the expected one, so that pieces can be told apart."""
        probe = "it's 12 l'été!! <<x>> a_b"
        pieces = PIECE.findall(probe)
        whole, split = self._ids(probe), self._ids(" ".join(pieces))
        return whole == split and int(self.ends[np.array(split, np.int64)].sum()) == len(pieces)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        found = np.array(self._ids(" ".join(pieces)), np.int64)
        stops = np.flatnonzero(self.ends[found]) + 1
        if len(stops) != len(pieces):
            raise ValueError("a word piece was not encoded as one word")
        self.starts = np.concatenate([self.starts, stops + len(self.ids)])
        self.ids = np.concatenate([self.ids, found])
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.index) > self.remembered:
            self.forget()
        plain = [self.cut and PLAIN.fullmatch(t) is not None for t in texts]
        cut = [PIECE.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p]
        pieces = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(pieces[i] for i in missing)))
            at[missing] = [self.index[pieces[i]] for i in missing]
        starts = self.starts[at]
        lengths = self.starts[at + 1] - starts
        ends = np.cumsum(lengths)
        found = self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        tokens = np.concatenate([[0], ends])[np.cumsum([len(p) for p in cut[:-1]], dtype=np.int64)] if cut else []
        joined = iter(np.split(found, tokens) if cut else [])
        return [next(joined) if p else np.array(self._ids(t), np.int64) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(kept: int, tokenizer: str, capacity: int, end: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                encoded = encoder.batch([t or "" for t in batch.column(kept).to_pylist()])
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, found in enumerate(encoded):
                    whole = np.append(found, end).astype("<u4")
                    for number, first in enumerate(range(0, len(whole), capacity)):
                        part = whole[first:first + capacity]
                        rows.append(row)
                        piece.append(number)
                        start.append(first)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                taken = batch.take(pa.array(rows, pa.int64()))
                columns = [*taken.columns[:kept], pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return run


def pieces(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str | None = None,
           capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(kept columns.., piece, start, length, ids_crc32[, ids]): every document's pieces, in a written table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    slim = docs.select(*(common.quoted(c) for c in keep), F.col(common.quoted(text)).cast("string").alias("\x00text"))
    names = common.fresh(docs.select(*(common.quoted(c) for c in keep)), "piece", "start", "length", "ids_crc32", "ids")
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())]
    new = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)][:5 if with_ids else 4]
    schema = T.StructType([*slim.schema.fields[:-1], *new])
    run = _pieces(len(keep), tokenizer or default_tokenizer(), capacity, end, with_ids, to_arrow_schema(schema))
    return common.checkpointed(slim.mapInArrow(run, schema))


class Rooms:
    """Segment tree over remaining capacities: how many open sequences have each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        count, at = self.count, room + self.size
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Least room of an open sequence that is at least ``need``."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to a node whose right neighbour has a sequence
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        return at - self.size

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.open[room].pop()


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, and the room each sequence has left."""
    rooms, room = Rooms(capacity), []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        left = rooms.tightest(need)
        if left is None:
            left, number = capacity, len(room)
            room.append(capacity)
        else:
            number = rooms.take(left)
        sequence[at], offset[at] = number, capacity - left
        room[number] = left - need
        if left > need:
            rooms.add(left - need, number)
    return sequence, offset, np.array(room, np.int64)


def _pack_group(group: str, length: str, capacity: int, number: int, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        sequence, offset, room = best_fit(table[length].to_numpy(), capacity)
        base = (number << 56) + (table[group][0].as_py() << 24)
        out = table.drop_columns([group])
        for values in (base + sequence, offset, room[sequence]):
            out = out.append_column("x", pa.array(values, pa.int64()))
        return out.rename_columns(names)
    return run


def pack(found: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """(columns of ``found``.., sequence_id, offset): a place for every piece; ``found`` is a written table."""
    names = common.fresh(found, "sequence_id", "offset", "room", "group")
    sequence_id, offset, room, dealt = names
    schema = T.StructType([*found.schema.fields, *(T.StructField(n, T.LongType()) for n in names[:3])])
    done, left, rows, number = None, found, found.count(), 0
    while True:
        groups = max(1, round(rows / group))
        keyed = left.withColumn(dealt, F.pmod(F.xxhash64(F.lit(SEED + number), F.monotonically_increasing_id()), F.lit(groups)))
        placed = common.checkpointed(keyed.groupBy(dealt).applyInArrow(_pack_group(dealt, length, capacity, number, schema.names), schema))
        rest = 0 if groups == 1 else placed.where(F.col(room) > slack).count()
        last = not rest or 2 * rest > rows
        kept = placed if last else placed.where(F.col(room) <= slack)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.drop(room)
        left, rows, number = placed.where(F.col(room) > slack).select(*(common.quoted(c) for c in found.columns)), rest, number + 1


def sequences(docs: DataFrame, tokenizer: str | None = None, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, ids, starts): the token ids of every sequence and where its pieces start."""
    packed = pack(pieces(docs, [], text, tokenizer, capacity, end, with_ids=True), capacity=capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts")))
