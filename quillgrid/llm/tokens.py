"""Token ids of whole texts with a public tokenizer file, part by part through a bounded cache.

The tokenizer file states its own steps: normal form C, white space to spaces, lower case, then a split
into contractions, runs of letters, single digits and runs of anything else, each of which BPE encodes on
its own. Words of ASCII and Latin-1 letters are cut into those parts here, for a whole buffer at once, and
each distinct part is encoded by the library's model. Any other word goes through the library as it is.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

#: Most cached parts in a Python worker; a full cache is emptied, results do not change.
CACHE_PARTS = 500_000
#: Bytes of text that are cut into parts at once.
SEGMENT = 1 << 21

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER

_loaded: dict[str, _Parts] = {}
common._cleaners["tokens"] = _loaded.clear


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE spells each byte as a printable character: itself, or U+0100 onward in byte order."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in itself]
    return {b: 0x100 + rest.index(b) if b in rest else b for b in range(256)}


class _Parts:
    """part -> place of its ids in one array."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def places(self, parts: list[str], odd: np.ndarray) -> np.ndarray:
        """Where the ids of each of ``parts`` (distinct) are; new ones are encoded, ``odd`` ones by the whole tokenizer."""
        get = self.place.get
        out = np.fromiter((get(p, -1) for p in parts), dtype=np.int64, count=len(parts))
        new = np.flatnonzero(out < 0)
        if len(new) and len(self.place) + len(new) > CACHE_PARTS and self.place:
            self.clear()
            return self.places(parts, odd)
        ids, sizes = array("I"), []
        tokenize, letters = self.model.tokenize, self.letters
        for i in new.tolist():
            part, before = parts[i], len(ids)
            if odd[i]:
                ids.extend(self.tokenizer.encode(part, add_special_tokens=False).ids)
            else:
                spelt = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
                ids.extend([t.id for t in tokenize(spelt)])
            sizes.append(len(ids) - before)
            self.place[part] = len(self.size) + len(sizes) - 1
        if len(new):
            out[new] = len(self.size) + np.arange(len(new))
            size = np.asarray(sizes, dtype=np.int64)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, dtype="<u4")])
        return out

    def segment(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of a piece of a buffer, and for each part its first byte and how many ids it has; ``starts``: where texts begin."""
        first, parts, odd = cut(raw, starts)
        coded = parts.dictionary_encode()
        index = np.asarray(coded.indices, dtype=np.int64)
        is_odd = np.zeros(len(coded.dictionary), dtype=bool)
        is_odd[index[odd]] = True
        place = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), is_odd)[index]
        n = self.size[place]
        at = np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[at], first, n


def cut(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The parts of a buffer: first byte, text (lower-cased), and which are odd words, left whole and as they are.

    A word is odd if it has a byte of no ASCII or Latin-1 letter, ASCII digit or sign, or could name a special token.
    """
    kind = _CLASS[raw]
    low = raw + ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
    lead = np.flatnonzero(raw == 0xC3)
    if len(lead):
        after = raw[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        low[lead[letter & (after <= 0x9E)] + 1] += np.uint8(0x20)
    ink = kind != _SPACE
    word = ink.copy()
    word[1:] &= ~ink[:-1]
    starts = starts[starts < len(raw)]
    word[starts] = ink[starts]
    begin = word | (ink & (kind == _DIGIT))
    begin[1:] |= ink[1:] & (kind[1:] != kind[:-1])
    strange = np.flatnonzero(kind == _ODD)
    named = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) > 1 else strange[:0]
    odd = np.zeros(0, dtype=np.int64)
    if len(strange) or len(named):
        at = np.flatnonzero(word)
        own = np.unique(np.searchsorted(at, np.concatenate([strange, named]), side="right") - 1)
        odd = at[own]
        gap = np.flatnonzero(~ink | word)
        stop = np.append(gap, len(raw))[np.searchsorted(gap, odd, side="right")]
        cover = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(cover, odd, 1)
        np.add.at(cover, stop, -1)
        inside = np.cumsum(cover[:-1]) > 0
        begin &= ~inside
        begin[odd] = True
        low[inside] = raw[inside]
    else:
        inside = None
    quote = np.flatnonzero((raw == 0x27) & begin)
    if len(quote):
        ahead = np.concatenate([low, np.zeros(3, np.uint8)])
        plain = np.concatenate([(kind == _LETTER) & ~word if inside is None else (kind == _LETTER) & ~word & ~inside, np.zeros(3, bool)])
        if inside is not None:
            quote = quote[~inside[quote]]
        quote = quote[plain[quote + 1]]
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        pair &= plain[quote + 2]
        begin[quote[short | pair] + 1] = False
        for some, n in ((quote[short], 2), (quote[pair], 3)):
            begin[some[plain[some + n]] + n] = True
    first = np.flatnonzero(begin)
    before = np.concatenate([[0], np.cumsum(ink, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)])
    ends = np.append(before[first], before[-1])
    text = low[ink].tobytes()
    if ends[-1] < 1 << 31:
        parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
    else:
        parts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(text))
    flags = np.zeros(len(first), dtype=bool)
    flags[np.searchsorted(first, odd)] = True
    return first, parts, flags


def _segments(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about SEGMENT bytes that end before a space or where a text begins; a longer word is one piece."""
    lo = 0
    while lo < len(raw):
        hi = min(lo + SEGMENT, len(raw))
        if hi < len(raw):
            edge = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            spaces = np.flatnonzero(_CLASS[raw[lo + 1 : hi]] == _SPACE)
            hi_ = max(edge, lo + 1 + int(spaces[-1]) if len(spaces) else 0)
            while hi_ <= lo:
                spaces = np.flatnonzero(_CLASS[raw[hi : hi + SEGMENT]] == _SPACE)
                after = int(offsets[np.searchsorted(offsets, hi, side="left")])
                hi_ = min(after, hi + int(spaces[0])) if len(spaces) else after if after <= hi + SEGMENT else lo
                hi = min(hi + SEGMENT, len(raw))
            hi = hi_
        yield lo, hi
        lo = hi


def encode(texts: pa.Array | list[str | None], path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has; ``end_id`` follows each text. Null counts as empty.

    This tokenizer drops white space and never joins what white space separates.
    """
    if path not in _loaded:
        _loaded[path] = _Parts(path)
    cache = _loaded[path]
    raw, offsets = common.buffer_of(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    found = [np.zeros(0, dtype="<u4")]
    for lo, hi in _segments(raw, offsets):
        a, b = np.searchsorted(offsets, [lo, hi], side="left")
        ids, first, n = cache.segment(raw[lo:hi], offsets[a:b] - lo)
        row = np.searchsorted(offsets, first + lo, side="right") - 1
        if len(row):
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            counts[row[head]] += np.add.reduceat(n, head)
        found.append(ids)
    ids = np.concatenate(found)
    if end_id is None:
        return ids, counts
    out = np.full(len(ids) + len(counts), end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def encoded(batch: pa.RecordBatch, path: str, end_id: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, ids and counts of a batch (doc_id, text), a few megabytes of text at a time."""
    common.enter("tokens")
    for lo, hi in common.slices(batch.column(1), SEGMENT):
        ids, counts = encode(batch.column(1).slice(lo, hi - lo), path, end_id)
        yield batch.column(0).slice(lo, hi - lo), ids, counts
        ids = counts = None
