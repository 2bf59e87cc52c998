"""Exact encoding of many texts with a public tokenizer, each distinct word encoded once.

A byte-pair tokenizer treats what stands between two blanks on its own, so a text is cut at its single blanks and line
feeds, and at a comma or full stop that ends a word, which is a token of its own. Unknown pieces go through the ``tokenizers``
library, many at a time; the ids of known ones come from a table of bounded size, found by 64-bit hashes of their bytes (two
of a million pieces clash with a chance of 3 in 10^8). Texts for which such a cut could differ (other white space next to a
blank, a blank at the end, control characters, the strings of special tokens, characters beyond the extended Latin letters)
go through the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelworks.llm import kernel

# Pieces that one worker remembers; beyond that it keeps those met more than once. A piece takes about 60 bytes.
REMEMBERED = 500_000
# Unknown pieces that go through the library together.
JOINED = 200

_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[[*range(0x00, 0x0A), *range(0x0B, 0x20), 0x7F, *range(0xC9, 0x100)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Told apart from the hashes of words: the first word of a line, and the pieces that are one character.
_AT_START, _FEED, _COMMA, _DOT = (np.uint64(x) for x in kernel.mix(np.arange(1, 5, dtype=np.uint64)))


def unusual(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts go through the library as a whole: see above."""
    found = _CONTROL[data]
    if len(data) > 1:
        one, two = data[:-1], data[1:]
        blank = (data == 0x20) | (data == 0x0A)
        found[:-1] |= (blank[:-1] & blank[1:]) | ((one == 0xC2) & (two <= 0xA0)) | ((one == 0x3C) & (two == 0x7C))
    odd = kernel.sums_within(found, offsets) > 0
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    odd[full] |= data[offsets[1:][full] - 1] == 0x20
    return odd


def _ends_in_stop(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that are a letter, at least, and a comma or full stop after it."""
    last, one = data[ends - 1], data[np.maximum(ends - 2, 0)]
    two = data[np.maximum(ends - 3, 0)]
    wide = (one >= 0x80) & (two >= 0xC3) & (two <= 0xC8) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & (ends - starts > 2)
    return ((last == 0x2C) | (last == 0x2E)) & (ends - starts > 1) & (_LETTER[one] | wide)


class Table:
    """Hashes to numbers from 0 on, with open addressing; all look-ups and insertions of a slice at once."""

    def __init__(self) -> None:
        self.size, self.hashes, self.numbers = 0, np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for an unknown one."""
        mask = np.uint64(len(self.hashes) - 1)
        found, open_ = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        place = hashes & mask
        while len(open_):
            at = place[open_].astype(np.int64)
            number = self.numbers[at]
            hit = (number >= 0) & (self.hashes[at] == hashes[open_])
            found[open_[hit]] = number[hit]
            open_ = open_[(number >= 0) & ~hit]
            place[open_] = (place[open_] + np.uint64(1)) & mask
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Number new, distinct hashes in their order."""
        number = np.arange(self.size, self.size + len(hashes))
        self.size += len(hashes)
        if 2 * self.size > len(self.hashes):
            old = self.numbers >= 0
            hashes, number = np.concatenate([self.hashes[old], hashes]), np.concatenate([self.numbers[old], number])
            room = 1 << int(4 * self.size - 1).bit_length()
            self.hashes, self.numbers = np.zeros(room, np.uint64), np.full(room, -1, np.int32)
        mask = np.uint64(len(self.hashes) - 1)
        place = hashes & mask
        while len(hashes):
            at = place.astype(np.int64)
            free = self.numbers[at] < 0
            # Of several that want a free place the last one gets it.
            self.numbers[at[free]] = number[free]
            won = self.numbers[at] == number
            self.hashes[at[won]] = hashes[won]
            hashes, number, place = hashes[~won], number[~won], (place[~won] + np.uint64(1)) & mask


class Vocabulary:
    """``lead``: a piece keeps the blank before it (byte-level vocabularies with blanks inside tokens)."""

    def __init__(self, path: str, lead: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.lead = lead
        # A separator that is one token of its own; pieces that hold it are encoded one by one.
        self.mark = b"\n" if lead else b"0"
        single = {h: self.model.encode(c, add_special_tokens=False).ids for h, c in ((_COMMA, ","), (_DOT, "."), (_FEED, "\n"))}
        (self.mark_id,) = self.model.encode(self.mark.decode(), add_special_tokens=False).ids
        self.single = single
        self._clear()

    def _clear(self) -> None:
        self.table = Table()
        self.first, self.count, self.met = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.ids, self.used = np.zeros(4096, dtype=np.uint32), 0
        self._add(np.array(list(self.single), dtype=np.uint64), list(map(len, self.single.values())), np.array([i for ids in self.single.values() for i in ids], dtype=np.uint32))

    def _forget(self) -> None:
        """Keep the pieces met more than once, unless that leaves too many."""
        kept = np.arange(len(self.single), self.table.size)
        kept = kept[self.met[kept] > 1]
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        hashes, sizes, flat = self.hashes[kept], self.count[kept], self._gather(kept)
        self._clear()
        self._add(hashes, sizes, flat)

    def _gather(self, which: np.ndarray) -> np.ndarray:
        sizes = self.count[which]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[which] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        at, more = self.table.size, len(hashes)
        self.first, self.count, self.met, self.hashes = (_room(a, at + more) for a in (self.first, self.count, self.met, self.hashes))
        self.ids = _room(self.ids, self.used + len(flat))
        self.first[at : at + more] = self.used + np.cumsum(sizes) - sizes
        self.count[at : at + more] = sizes
        self.met[at : at + more] = 0
        self.hashes[at : at + more] = hashes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.add(hashes)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], bare: np.ndarray) -> None:
        """Encode unknown pieces; ``bare``: without a blank before it."""
        alone = np.array([self.mark in p for p in pieces], dtype=bool) | bare
        own = np.flatnonzero(alone)
        texts = [(" " if self.lead and not bare[k] else "") + pieces[k].decode() for k in own]
        encoded = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(hashes[own], np.fromiter(map(len, encoded), np.int64, len(encoded)), np.fromiter((i for ids in encoded for i in ids), np.uint32))
        rest = np.flatnonzero(~alone)
        between = self.mark + b" " if self.lead else b" " + self.mark + b" "
        for first in range(0, len(rest), JOINED):
            some = rest[first : first + JOINED]
            whole = (b" " if self.lead else b"") + between.join([pieces[k] for k in some])
            flat = np.asarray(self.model.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            marks = np.flatnonzero(flat == self.mark_id)
            if len(marks) != len(some) - 1:
                raise ValueError("the separator is not a token of its own")
            edges = np.concatenate([[-1], marks, [len(flat)]])
            self._add(hashes[some], np.diff(edges) - 1, np.delete(flat, marks))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray):
        """Hash, start and end of the pieces of all texts that are not odd, in order, whether bare, and the bounds of texts."""
        starts, ends, bounds = kernel.word_spans(data, offsets)
        row = kernel.rows_of(bounds)
        if odd.any():
            keep = ~odd[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        stop = _ends_in_stop(data, starts, ends)
        ends = ends - stop
        hashes = kernel.span_hashes(kernel.prefix_sums(data), starts, ends)
        bare = np.zeros(len(starts), dtype=bool)
        at = [starts, ends[stop]]
        values = [hashes, np.where(data[ends[stop]] == 0x2C, _COMMA, _DOT)]
        if self.lead:
            bare = (starts == offsets[row]) | (data[np.maximum(starts - 1, 0)] == 10)
            values[0] = np.where(bare, hashes ^ _AT_START, hashes)
            feeds = np.flatnonzero(data == 10)
            feeds = feeds[~odd[np.searchsorted(offsets, feeds, side="right") - 1]]
            at.append(feeds)
            values.append(np.full(len(feeds), _FEED))
        places = np.concatenate(at)
        order = np.argsort(places, kind="stable")
        places = places[order]
        none = np.zeros(len(places) - len(starts), dtype=np.int64)
        last = np.concatenate([ends, none])[order]
        bare = np.concatenate([bare, none.astype(bool)])[order]
        return np.concatenate(values)[order], places, last, bare, np.searchsorted(places, offsets)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset of each text plus the end."""
        data, offsets = kernel.text_bytes(column)
        odd = unusual(data, offsets)
        hashes, starts, ends, bare, bounds = self._pieces(data, offsets, odd)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        number = self.table.find(kinds)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.table.size + len(new) > REMEMBERED:
                self._forget()
                number = self.table.find(kinds)
                new = np.flatnonzero(number < 0)
            own = first[new]
            raw = data.tobytes()
            self._learn(kinds[new], [raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], bare[own])
            number[new] = self.table.find(kinds[new])
        which = number[which]
        self.met[: self.table.size] += np.bincount(which, minlength=self.table.size)
        flat = self._gather(which)
        offsets = np.concatenate([[0], np.cumsum(self.count[which])])[bounds]
        rows = np.flatnonzero(odd)
        if not len(rows):
            return flat, offsets
        texts = column.take(pa.array(rows)).to_pylist()
        whole = dict(zip(rows.tolist(), self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True))
        parts = [np.asarray(whole[r].ids, dtype=np.uint32) if r in whole else flat[offsets[r] : offsets[r + 1]] for r in range(len(odd))]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    larger[: len(array)] = array
    return larger


_loaded: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, lead: bool) -> Vocabulary:
    """The vocabulary of this worker process."""
    if (path, lead) not in _loaded:
        _loaded[path, lead] = Vocabulary(path, lead)
    return _loaded[path, lead]


def with_end(flat: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after every text."""
    n = len(offsets) - 1
    out = np.empty(len(flat) + n, dtype=np.uint32)
    new = offsets + np.arange(n + 1)
    ends = new[1:] - 1
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep], out[ends] = flat, end
    return out, new


def encoded_slices(batches, path: str, lead: bool, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of rows with its ids, end ids included, and their offsets; a null text is empty."""
    model = vocabulary(path, lead)
    for batch in kernel.slices(batches, "text", 1 << 20):
        flat, offsets = model.encode(pc.fill_null(batch.column("text"), ""))
        yield batch, *with_end(flat, offsets, end)
