"""Search for several hundred vocabulary terms with an index of their first q-grams.

Looking terms up with ``contains`` scans the text once per term, and a pattern of all terms
is tried at every character. Here the texts of an Arrow batch are one byte array: its
four-byte codes are made in a few vector operations, one look-up in a table of the terms'
first codes leaves the places where a term can start (about one in a hundred), and only
there the rest of the term is compared. The cost hardly depends on the number of terms.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Q = 4
#: Bytes of text searched in one step.
STEP = 1 << 22


class TermIndex:
    """Terms by the code of their first ``Q`` bytes (all their bytes if they are shorter)."""

    def __init__(self, terms: Sequence[str]) -> None:
        self.terms = [t.encode() for t in terms]
        self.by_width: dict[int, dict[int, list[int]]] = {}
        for number, term in enumerate(self.terms):
            width = min(Q, len(term))
            code = int.from_bytes(term[:width], "little")
            self.by_width.setdefault(width, {}).setdefault(code, []).append(number)
        self.longest = max(map(len, self.terms), default=0)
        self.tables = {width: self._table(codes) for width, codes in self.by_width.items()}

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(16)

    def _table(self, codes: dict[int, list[int]]) -> np.ndarray:
        table = np.zeros(1 << 16, bool)
        table[self._slot(np.array(list(codes), np.uint32))] = True
        return table

    def places(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(term, places where it starts) in a byte array that ends with ``longest + Q`` zeros."""
        end = len(data) - self.longest - Q
        for start in range(0, end, STEP):
            n = min(STEP, end - start)
            raw = data[start:start + n + Q].tobytes() + bytes(2 * Q)
            codes = np.empty((n + Q - 1) // Q * Q, np.uint32)
            for shift in range(Q):
                codes[shift::Q] = np.frombuffer(raw, "<u4", len(codes) // Q, shift)
            for width, by_code in self.by_width.items():
                masked = codes[:n] if width == Q else codes[:n] & np.uint32((1 << 8 * width) - 1)
                at = np.flatnonzero(self.tables[width][self._slot(masked)])
                found = masked[at]
                order = np.argsort(found, kind="stable")
                at, found = at[order] + start, found[order]
                for code, numbers in by_code.items():
                    low, high = np.searchsorted(found, np.uint32(code), "left"), np.searchsorted(found, np.uint32(code), "right")
                    if low < high:
                        for number in numbers:
                            yield number, self._rest(data, at[low:high], self.terms[number], width)

    @staticmethod
    def _rest(data: np.ndarray, at: np.ndarray, term: bytes, width: int) -> np.ndarray:
        for n in range(width, len(term)):
            at = at[data[at + n] == term[n]]
            if not len(at):
                break
        return at

    def search(self, texts: pa.Array) -> pa.ListArray:
        """Sorted numbers of the terms in each text."""
        texts = texts.cast(pa.string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        body = texts.buffers()[2]
        used = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None and n else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = np.concatenate([used, np.zeros(self.longest + Q, np.uint8)])
        hits = [np.zeros(0, np.int64)]
        for number, at in self.places(data):
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + len(self.terms[number]) <= offsets[row + 1]
            hits.append(np.unique(row[inside]) * len(self.terms) + number)
        pairs = np.unique(np.concatenate(hits))
        ends = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(self.terms)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % max(1, len(self.terms)), pa.int32()))


def find_terms(text: Column, terms: Sequence[str]) -> Column:
    """Sorted numbers (positions in ``terms``) of the terms contained in ``text``; none for null."""
    wanted = tuple(terms)
    if len(set(wanted)) != len(wanted) or "" in wanted:
        raise ValueError("terms must be distinct and not empty")
    if not wanted:
        return F.array().cast("array<int>")
    index = TermIndex(wanted)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return index.search(texts)

    return found(text)
