"""Word model: interpolated modified Kneser-Ney over hashed word pairs, counted and joined in shards.

A word is a run of characters other than ASCII white space, as written; a punctuation mark of ASCII, and a
character of a script without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese), is a word of its own. Words
are known by 48 bits of a hash; the edges of a text are a word too. A pair is never seen as a whole where it does
not occur, so garbled text in any script and shuffled words cost more than the text they were made of.

Texts are dealt to parts of about ``PART`` bytes by a hash, equal texts to one part. A part sends its distinct
pairs, with the trusted texts' counts, to buckets of pairs, each of which adds up its counts, sends them back to the
parts that asked, and what they say of words to buckets of words: how often a word is followed, by how many
words once, twice and more often, and how many words precede it. These come back the same way, and the part works out
its texts. Each step is a shuffle of blocks of sorted hashes; nothing is broadcast but four numbers a model, and
parts and buckets grow in number with the texts, not in size. A word of many followers is spread over buckets.
The parts ask for pairs in ``TURNS`` turns, each for a share of the buckets, and every step's answers are
checkpointed and its shuffle removed: of the pairs on their way to buckets, one turn's lie on disk at a time.

A trusted text's held out score is by the counts less its own and its copies'. Discounts and the number of
words stay those of all trusted texts.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm import common

#: Bytes of text in a part.
PART = 12 << 20
#: Characters hashed at once.
CHUNK = 1 << 20
#: Turns in which pairs are asked for.
TURNS = 2
#: Bytes of texts packed together; longer ones are packed alone.
PACK = 1 << 20
#: Bytes from which a pack holds numbered words: smaller than the texts there, and cut into words once.
NUMBERED = 1 << 16
#: Copies that a task tells from new texts.
KNOWN = 1 << 20
EDGE = 0
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Ranges of characters that are words of their own.
SINGLE = [(0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F), (0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3000, 0x3100),
          (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF00, 0xFF66), (0x20000, 0x40000)]
ZSTD = pa.Codec("zstd", compression_level=3)
MIX, TURN, BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


def _kinds() -> np.ndarray:
    """0 for white space, 1 for the characters of words, 2 for words of their own."""
    kinds = np.ones(0x110000, np.uint8)
    kinds[[0x20, *range(9, 14)]] = 0
    for low, high in SINGLE:
        kinds[low:high] = 2
    return kinds


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])


KIND = _kinds()
POWERS = _powers(4096)


def _hashed(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KIND[points]
    starts = np.flatnonzero((kind == 2) | ((kind == 1) & np.concatenate([[True], kind[:-1] != 1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    points, kind, starts = points[starts[0]:], kind[starts[0]:], starts - starts[0]
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    place[kind == 0] = 0
    last = int(place.max())
    value = (points.astype(np.uint64) + np.uint64(1)) * MIX
    value = (value ^ (value >> np.uint64(31))) * (POWERS if last < len(POWERS) else _powers(last))[place]
    value[kind == 0] = 0
    out = np.add.reduceat(value, starts)
    out = (out ^ (out >> np.uint64(32))) * TURN
    return ((out ^ (out >> np.uint64(29))) * MIX) >> np.uint64(16)


def words(text: str) -> np.ndarray:
    """48-bit hashes of a text's words, a chunk at a time; chunks end at white space."""
    out, at = [], 0
    while at < len(text):
        space = SPACE.search(text, at + CHUNK)
        end = space.start() if space else len(text)
        out.append(_hashed(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _packed(a: np.ndarray) -> bytes:
    """Integers from 0, the lowest bytes of all first; the number and the width of the integers go ahead."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(a).to_bytes(4, "little") + bytes([width]) + ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpacked(block: bytes) -> np.ndarray:
    n, width = int.from_bytes(block[:4], "little"), block[4]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(ZSTD.decompress(block[5:], n * width), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _hashes_out(a: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return _packed(np.diff(a, prepend=np.uint64(0)))


def _hashes_in(block: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(block), dtype=np.uint64)


def _counts_out(a: np.ndarray) -> bytes:
    return _packed(a)


def _counts_in(block: bytes) -> np.ndarray:
    return _unpacked(block).astype(np.int64)


def _followers_out(a: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes in any order: the distinct ones, and the place of each among them."""
    distinct, place = _numbered(a)
    return _hashes_out(distinct), _packed(place)


def _numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and the place of every given one among them."""
    place, distinct = pd.factorize(a)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[place]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(change)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _distinct(left: np.ndarray, right: np.ndarray, size: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of numbers below ``size``, their sums of ``n``, and the place of every given pair among them."""
    pairs, place = _numbered(left.astype(np.int64) * size + right)
    return pairs // size, pairs % size, np.bincount(place, n, len(pairs)).astype(np.int64), place


def _pack(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Texts, or their words, with keys and counts in one block."""
    sizes = [len(r[3]) for r in rows]
    if numbered := sum(sizes) >= NUMBERED:
        texts = [words(r[3].decode("utf-8", "replace")) for r in rows]
        sizes = [len(t) for t in texts]
        distinct, place = _numbered(np.concatenate(texts))
        known, body = _hashes_out(distinct), _packed(place)
    else:
        known, body = b"", ZSTD.compress(b"".join(r[3] for r in rows), asbytes=True)
    head = np.array([(numbered, len(rows), len(known), 0), *((*r[:3], size) for r, size in zip(rows, sizes, strict=True))], "<i8")
    return head.tobytes() + known + body


def _unpack(block: bytes) -> Iterator[tuple[int, int, int, bytes | np.ndarray]]:
    numbered, count, known, _ = np.frombuffer(block, "<i8", 4).tolist()
    head = np.frombuffer(block, "<i8", 4 * count, 32).reshape(-1, 4)
    at, ends = 32 + head.nbytes, np.cumsum(head[:, 3])
    if numbered:
        texts = _hashes_in(block[at:at + known])[_unpacked(block[at + known:])]
    else:
        texts = ZSTD.decompress(block[at:], int(ends[-1]), asbytes=True)
    for (k1, k2, n, size), end in zip(head.tolist(), ends.tolist(), strict=True):
        yield k1, k2, n, texts[end - size:end]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed, short ones together without keys in their row; a task sends the text of copies once, and adds up how
    often the others are trusted."""
    more: dict[tuple, int] = {}
    names, kinds = ["model", "part", "k1", "k2", "n", "body"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    for batch in batches:
        rows, packs = [], {}
        for model, part, k1, k2, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (model, part, k1, k2)
            if key in more:
                more[key] += n
                continue
            more[key] = 0
            if len(text) >= PACK:
                rows.append((*key, n, zlib.compress(text, 6)))
                continue
            pack = packs.setdefault((model, part), [])
            pack.append((k1, k2, n, text))
            if len(pack) % 64 == 0 and sum(len(p[3]) for p in pack) >= PACK:
                rows.append((model, part, None, None, None, _pack(packs.pop((model, part)))))
        rows += [(*of, None, None, None, _pack(pack)) for of, pack in packs.items()]
        if rows:
            yield out(rows)
        if len(more) > KNOWN:
            yield out([(*key, n, None) for key, n in more.items() if n])
            more.clear()
    yield out([(*key, n, None) for key, n in more.items() if n])


class _Part:
    """The texts of a part: keys, how often each is trusted, and its words; pairs once they are asked for."""

    def __init__(self, table: pa.Table) -> None:
        found: dict[tuple, list] = {}

        def add(k1: int, k2: int, n: int, text: bytes | np.ndarray | None) -> None:
            held = found.setdefault((k1, k2), [0, None])
            held[0] += n
            if held[1] is None and text is not None:
                held[1] = words(text.decode("utf-8", "replace")) if isinstance(text, bytes) else text

        for k1, k2, n, body in zip(*(table[c] for c in ("k1", "k2", "n", "body")), strict=True):
            k1, k2, n, body = k1.as_py(), k2.as_py(), n.as_py(), body.as_py()
            if k1 is None:
                for row in _unpack(body):
                    add(*row)
            else:
                add(k1, k2, n, None if body is None else zlib.decompress(body))
        self.keys = sorted(found)
        self.trusted = np.array([found[k][0] for k in self.keys], np.int64)
        edge = np.array([EDGE], np.uint64)
        texts = [found[k][1] for k in self.keys]
        self.sizes = np.array([len(t) + 1 if len(t) else 0 for t in texts], np.int64)
        both = np.concatenate([edge, *(x for t in texts if len(t) for x in (t, edge))])  # an edge lies between two texts
        del texts, found
        self.words, self.sequence = _numbered(both)

    def pair(self) -> None:
        """Distinct pairs: places of their words, hashes, how often they are trusted, and the place of each pair of the texts."""
        self.text = np.repeat(np.arange(len(self.keys), dtype=np.int32), self.sizes)
        self.li, self.ri, self.n, self.place = _distinct(self.sequence[:-1], self.sequence[1:], len(self.words), self.trusted[self.text])
        self.left, self.right = self.words[self.li], self.words[self.ri]
        del self.sequence

    def pairs_by_bucket(self, buckets: int, turn: int = 0, turns: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """A turn's buckets with the pairs that each holds; the followers of a word are spread over some of the buckets."""
        spread = np.uint64(1 + buckets // 16)
        yield from _split((_bucket(self.left, buckets) + self.right % spread) % np.uint64(buckets), turn, turns)

    def words_by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        yield from _split(_bucket(self.words, buckets))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Neighbours share a bucket, so that their differences are small."""
    return hashes // np.uint64(-(-(1 << 48) // buckets))


def _split(bucket: np.ndarray, turn: int = 0, turns: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint16 if bucket.max(initial=0) < 1 << 16 else np.uint32), kind="stable")
    if turns > 1:
        order = order[bucket[order] % np.uint64(turns) == turn]
    if not len(order):
        return
    starts = _runs(bucket[order])
    for at, end in zip(starts, np.append(starts, len(order))[1:], strict=True):
        yield int(bucket[order[at]]), order[at:end]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


ASKED = "model string, bucket int, part int, hashes binary, followers binary, places binary, sizes binary, n binary"
SAID = "model string, kind int, to int, bucket int, hashes binary, n binary, n1 long, n2 long, n3 long, n4 long, words long, total long"
SCORED = "model string, k1 long, k2 long, bits double, held double, n long"
PAIRS, WORDS, SUMS = 0, 1, 2


def _ask_pairs(parts: dict[str, int], turn: int = 0, turns: int = 1):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        model, part = (k.as_py() for k in key)
        held, rows = _Part(table), []
        held.pair()
        for bucket, at in held.pairs_by_bucket(parts[model], turn, turns):
            starts = _runs(held.left[at])
            rows.append((model, bucket, part, _hashes_out(held.left[at][starts]), *_followers_out(held.right[at]),
                         _counts_out(np.diff(np.append(starts, len(at)))), _counts_out(held.n[at])))
        return _table(rows, ASKED)
    return run


def _ask_words(parts: dict[str, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        model, part = (k.as_py() for k in key)
        held = _Part(table)
        rows = [(model, bucket, part, _hashes_out(held.words[at]), *[None] * 4) for bucket, at in held.words_by_bucket(parts[model])]
        return _table(rows, ASKED)
    return run


def _counted(n: np.ndarray) -> list[int]:
    return [int((n == c).sum()) for c in (1, 2, 3, 4)]


def _add_pairs(parts: dict[str, int]):
    """Counts of a bucket's pairs, sent to the parts, and what they say of words, sent to the buckets of words."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        model, bucket = (k.as_py() for k in key)
        asked = [table[c].to_pylist() for c in ("part", "hashes", "followers", "places", "sizes", "n")]
        counts = [_counts_in(c) for c in asked[5]]
        hashes, place = _numbered(np.concatenate([*(np.repeat(_hashes_in(h), _counts_in(s)) for h, s in zip(asked[1], asked[4], strict=True)),
                                                  *(_hashes_in(f)[_counts_in(p)] for f, p in zip(asked[2], asked[3], strict=True))]))
        half = len(place) // 2
        left, right, n, place = _distinct(place[:half], place[half:], len(hashes), np.concatenate(counts))
        left, right = hashes[left], hashes[right]
        rows, at = [], 0
        for part, size in zip(asked[0], map(len, counts), strict=True):
            rows.append((model, PAIRS, part, bucket, None, _counts_out(n[place[at:at + size]]), *[None] * 6))
            at += size
        left, right, n = left[n > 0], right[n > 0], n[n > 0]
        starts = _runs(left) if len(left) else np.zeros(0, np.int64)
        after = [_sums(v.astype(np.int64), starts) for v in (n, n == 1, n == 2, n >= 3)]
        before, many = np.unique(right, return_counts=True)
        both = np.union1d(left[starts], before)
        said = np.zeros((5, len(both)), np.int64)
        said[:4, np.searchsorted(both, left[starts])] = after
        said[4, np.searchsorted(both, before)] = many
        if len(both):
            rows += [(model, WORDS, to, bucket, _hashes_out(both[at]), _counts_out(said[:, at].ravel()), *[None] * 6)
                     for to, at in _split(_bucket(both, parts[model]))]
        rows.append((model, SUMS, -1, bucket, None, None, *_counted(n), None, None))
        return _table(rows, SAID)
    return run


def _add_words(key: tuple, said: pa.Table, asked: pa.Table) -> pa.Table:
    """Sums of a bucket's words, sent to the parts that asked."""
    model, bucket = (k.as_py() for k in key)
    hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes_in(h) for h in said["hashes"].to_pylist())])
    sums = np.concatenate([np.zeros((5, 0), np.int64), *(_counts_in(n).reshape(5, -1) for n in said["n"].to_pylist())], axis=1)
    order = np.argsort(hashes, kind="stable")
    hashes, sums = hashes[order], sums[:, order]
    starts = _runs(hashes) if len(hashes) else np.zeros(0, np.int64)
    hashes = hashes[starts]
    sums = np.concatenate([np.add.reduceat(sums, starts, axis=1) if len(starts) else sums, np.zeros((5, 1), np.int64)], axis=1)
    rows = []
    for part, block in zip(asked["part"].to_pylist(), asked["hashes"].to_pylist(), strict=True):
        wanted = _hashes_in(block)
        at = np.searchsorted(hashes, wanted)
        if len(hashes):
            at = np.where(hashes[np.minimum(at, len(hashes) - 1)] == wanted, at, len(hashes))
        rows.append((model, WORDS, part, bucket, None, _counts_out(sums[:, at].ravel()), *[None] * 6))
    before = sums[4]
    rows.append((model, SUMS, -1, bucket, None, None, *_counted(before), int((before > 0).sum()), int(before.sum())))
    return _table(rows, SAID)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and above, kept within 0.05 and the count."""
    seen, y = (n1, n2, n3, n4), n1 / (n1 + 2 * n2) if n1 + n2 else None
    cuts = [0.5 * c if y is None or not seen[c - 1] else c - (c + 1) * y * seen[c] / seen[c - 1] for c in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), c) for c, d in zip((1, 2, 3), cuts, strict=True))])


class _Sums:
    """A model's discounts of pairs and words, and the number and the sum of its words' left neighbours."""

    def __init__(self, pairs: tuple, before: tuple, words: int, total: int) -> None:
        self.pairs, self.before, self.words, self.total = discounts(*pairs), discounts(*before), words, total
        rest = words - before[0] - before[1]
        self.mass = before[0] * self.before[1] + before[1] * self.before[2] + rest * self.before[3]

    def left(self, n: np.ndarray) -> np.ndarray:
        """Counts of pairs less their discount."""
        return n - self.pairs[np.minimum(n, 3)]

    def word(self, before: np.ndarray, total, mass) -> np.ndarray:
        """Probability of words by the number of their left neighbours; the rest is spread evenly over the words and an unseen one."""
        kept = before - self.before[np.minimum(before, 3)] + mass / (self.words + 1)
        return np.where(total > 0, kept / np.maximum(total, 1), 1 / (self.words + 1))


def _bits(n, after, mass, word, sums: _Sums) -> np.ndarray:
    return -np.log2(np.where(after > 0, (sums.left(n) + mass * word) / np.maximum(after, 1), word))


def _grouped(*keys: np.ndarray) -> np.ndarray:
    return np.unique(keys[0] * (int(keys[1].max(initial=0)) + 1) + keys[1], return_inverse=True)[1]


def _held(part: _Part, n, li, ri, known: np.ndarray, sums: _Sums) -> np.ndarray:
    """Bits of each trusted text by the counts less its own and its copies', some texts at a time."""
    out, ends = np.zeros(len(part.keys)), np.cumsum(part.sizes)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK // 8, "right")))
        out += _held_of(part, slice(ends[at - 1] if at else 0, ends[to - 1]), n, li, ri, known, sums)
        at = to
    return out


def _held_of(part: _Part, mine: slice, n, li, ri, known: np.ndarray, sums: _Sums) -> np.ndarray:
    size = len(n) + 1
    text, pair = part.text[mine].astype(np.int64), part.place[mine]
    good = part.trusted[text] > 0
    both, count = np.unique(text[good] * size + pair[good], return_counts=True)
    text, pair = both // size, both % size
    rest = n[pair] - part.trusted[text] * count
    by_left, by_right = _grouped(text, li[pair]), _grouped(text, ri[pair])
    gone = np.bincount(text, rest == 0, len(part.keys)).astype(np.int64)
    after = known[0, li[pair]] - np.bincount(by_left, n[pair] - rest)[by_left].astype(np.int64)
    mass = sums.pairs[1:] @ known[1:4]
    cut = sums.pairs[np.minimum(n[pair], 3)] - sums.pairs[np.minimum(rest, 3)]
    mass = mass[li[pair]] - np.bincount(by_left, cut)[by_left]
    old = known[4, ri[pair]]
    before = old - np.bincount(by_right, rest == 0)[by_right].astype(np.int64)
    first = np.unique(by_right, return_index=True)[1]
    shift = sums.before[np.minimum(old, 3)] - sums.before[np.minimum(before, 3)]
    spread = sums.mass - np.bincount(text[first], shift[first], len(part.keys))
    word = sums.word(before, (sums.total - gone)[text], spread[text])
    return np.bincount(text, count * _bits(rest, after, mass, word, sums), len(part.keys))


def _score(parts: dict[str, int], models: dict[str, _Sums]):
    def run(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        model = key[0].as_py()
        part = _Part(table)
        part.pair()
        if not len(part.text):
            return _table([(model, *k, 0.0, 0.0 if t else None, 0) for k, t in zip(part.keys, part.trusted, strict=True)], SCORED)
        sums = models[model]
        blocks = {(k, b): n for k, b, n in zip(*(said[c].to_pylist() for c in ("kind", "bucket", "n")), strict=True)}
        n, known = np.zeros(len(part.left), np.int64), np.zeros((5, len(part.words)), np.int64)
        for bucket, at in part.pairs_by_bucket(parts[model]):
            n[at] = _counts_in(blocks[PAIRS, bucket])
        for bucket, at in part.words_by_bucket(parts[model]):
            known[:, at] = _counts_in(blocks[WORDS, bucket]).reshape(5, -1)
        li, ri = part.li, part.ri
        mass = sums.pairs[1:] @ known[1:4]
        bits = _bits(n, known[0, li], mass[li], sums.word(known[4], sums.total, sums.mass)[ri], sums)
        bits = np.bincount(part.text, bits[part.place], len(part.keys))
        held = _held(part, n, li, ri, known, sums)
        return _table([(model, *k, float(b), float(h) if t else None, int(s))
                       for k, b, h, t, s in zip(part.keys, bits, held, part.trusted, part.sizes, strict=True)], SCORED)
    return run


def scores(rows: DataFrame) -> DataFrame:
    """rows (model, k1, k2, n, text; n is 1 for a trusted text, else 0; texts of equal keys are copies) to ``SCORED``: a row
    for each text; ``bits`` by all trusted texts of the model, ``held`` of a trusted text by those but itself, ``n``
    its words and the end of the text (0 without words)."""
    sizes = rows.groupBy("model").agg(F.sum(F.octet_length("text")).alias("size")).collect()  # a row a model
    parts = {r.model: 1 + r.size // PART for r in sizes}
    if not parts:
        return rows.sparkSession.createDataFrame([], SCORED)
    number = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col("model")]
    dealt = (rows.select("model", F.pmod("k1", number).cast("int").alias("part"), "k1", "k2", F.col("n").cast("long"), F.col("text").cast("binary"))
             .mapInArrow(_dealt, "model string, part int, k1 long, k2 long, n long, body binary"))
    tasks = max(8, 2 * sum(parts.values()))
    texts = dealt.repartition(tasks, "model", "part").persist()
    pairs = None
    for turn in range(turns := min(TURNS, max(parts.values()))):
        one = common.landed(texts.groupBy("model", "part").applyInArrow(_ask_pairs(parts, turn, turns), ASKED)
                            .groupBy("model", "bucket").applyInArrow(_add_pairs(parts), SAID))
        pairs = one if pairs is None else pairs.unionByName(one)
    asked = texts.groupBy("model", "part").applyInArrow(_ask_words(parts), ASKED).select("model", "bucket", "part", "hashes")
    said = pairs.where(F.col("kind") == WORDS).select("model", F.col("to").alias("bucket"), "hashes", "n")
    found = common.landed(said.groupBy("model", "bucket").cogroup(asked.groupBy("model", "bucket")).applyInArrow(_add_words, SAID))
    names = ["n1", "n2", "n3", "n4", "words", "total"]
    total = lambda df: {r.model: tuple(r)[1:] for r in df.where(F.col("kind") == SUMS).groupBy("model")
                        .agg(*(F.sum(c).alias(c) for c in names)).collect()}
    of_pairs, of_words = total(pairs), total(found)
    models = {m: _Sums(of_pairs[m][:4], of_words[m][:4], *of_words[m][4:]) for m in of_words}
    back = (pairs.where(F.col("kind") == PAIRS).unionByName(found.where(F.col("kind") == WORDS))
            .select("model", F.col("to").alias("part"), "kind", "bucket", "n"))
    out = (texts.groupBy("model", "part").cogroup(back.groupBy("model", "part")).applyInArrow(_score(parts, models), SCORED))
    out = common.landed(out)
    texts.unpersist()
    return out
