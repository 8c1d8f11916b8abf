"""Token ids of many texts from a tokenizer file, for use inside tasks.

Some places are token boundaries whatever stands around them: between a character that is not white space
and a space, tab or line end after it, and between a Latin letter and an ASCII sign other than an apostrophe,
either way round. The byte-level pre-tokenizer never joins across them, and what stands before them does not
change the tokens after them. Texts are therefore cut there by array operations on their bytes, each
distinct piece is encoded once by the library, and ids are put together by array gathers. Texts with unusual
white space or with the strings of added tokens are encoded whole.

Pieces of up to ``LONGEST`` bytes are told apart by 64-bit hashes of their bytes, longer ones are encoded each time.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

from . import words as W

#: White space other than the ASCII kind, and control characters that some definitions count as white space.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Distinct pieces that a Python worker remembers; what comes later is encoded each time. Bytes of the longest one.
REMEMBER, LONGEST = 1 << 19, 64

_SPACE, _LETTER, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _SIGN


@cache
def tokenizer(path: str):
    """The library's tokenizer for a byte-level BPE ``.json`` file without normalizer or white-space stripping."""
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
        raise ValueError("only byte-level BPE tokenizers with the common pattern and without normalizer are supported")
    return Tokenizer.from_file(path)


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which serves all its tasks."""
    return Encoder(path)


def _whole(data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Numbers of the texts that are not cut."""
    found = []
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        second, third = np.append(data, [0, 0])[lead + 1], np.append(data, [0, 0])[lead + 2]
        first = data[lead]
        unusual = (first < 0x20) | ((first == 0xC2) & np.isin(second, (0x85, 0xA0))) | ((first == 0xE1) & np.isin(second, (0x9A, 0xA0)))
        unusual |= (first == 0xE2) & (((second == 0x80) & ((third < 0x90) | (third > 0xA7) & (third < 0xB0))) | ((second == 0x81) & (third > 0x9E) & (third < 0xB0)))
        unusual |= ((first == 0xE3) & (second == 0x80) & (third == 0x80)) | ((first == 0xEF) & (second == 0xBB) & (third == 0xBF))
        found += lead[unusual].tolist()
    raw = data.tobytes()
    for a in added:
        at = raw.find(a)
        while at >= 0:
            found.append(at)
            at = raw.find(a, at + 1)
    return np.unique(np.searchsorted(offsets, np.array(found, np.int64), "right") - 1)


def piece_starts(data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Where the pieces of all texts (UTF-8 bytes one after another) begin; ``added`` are the strings of added tokens."""
    n = len(data)
    kind = _KIND[data]
    # Letters from 00C0 to 00FF have two bytes.
    at = np.flatnonzero(data == 0xC3)
    after = np.append(data, 0)[at + 1]
    at = at[(after >= 0x80) & (after != 0x97) & (after != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    before, now = kind[:-1], kind[1:]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = (now != before) & ((now == _SPACE) | ((now == _SIGN) & (before == _LETTER)) | ((now == _LETTER) & (before == _SIGN)))
    for i in _whole(data, offsets, added).tolist():
        begins[offsets[i] : offsets[i + 1]] = False
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Remembers the ids of pieces; ``codes`` turns texts into numbers of pieces, ``start`` and ``count`` lead to their ids."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # Hashes of the pieces that are remembered, in order, and their numbers.
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.count, self.closes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode ``pieces`` and give them numbers after those that are remembered."""
        got = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int32, len(got))
        known = len(self.hash)  # what came after them was of the last call
        used, more = (int(self.start[known - 1] + self.count[known - 1]) if known else 0), int(count.sum())
        if used + more > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used // 2, more), np.uint32)])
        self.ids[used : used + more] = np.fromiter(chain.from_iterable(got), np.uint32, more)
        self.start = np.concatenate([self.start[:known], used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count[:known], count])
        self.closes = np.concatenate([self.closes[:known], np.fromiter((p[-1] in b".!?\n" for p in pieces), bool, len(pieces))])
        return np.arange(known, known + len(pieces), dtype=np.int32)

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts (UTF-8 bytes one after another), and the number of pieces of each text. Valid until the next call."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        start = piece_starts(data, offsets, self.added)
        end = np.append(start[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(W._BYTE[data] * W._power(W._BASE, n)[:n], out=total[1:])
        h = W.mix((total[end] - total[start]) * W._power(W._INVERSE, n)[start])
        del total
        long_ = np.flatnonzero(end - start > LONGEST)
        h[long_] = np.arange(len(long_), dtype=np.uint64)  # of their own: never remembered
        names, first, of = np.unique(h, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.hash, names), max(0, len(self.hash) - 1))
        number = np.full(len(names), -1, np.int64)
        if len(self.hash):
            hit = self.hash[spot] == names
            number[hit] = self.number[spot[hit]]
        number[of[long_]] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            keep = (end - start)[first[new]] <= LONGEST
            new, kept = np.concatenate([new[keep], new[~keep]]), int(keep.sum())
            raw = data.tobytes()
            number[new] = self._add([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            if len(self.hash) + kept <= REMEMBER:
                every, numbers = np.concatenate([self.hash, names[new[:kept]]]), np.concatenate([self.number, number[new[:kept]].astype(np.int32)])
                order = np.argsort(every, kind="stable")
                self.hash, self.number = every[order], numbers[order]
        return number[of], np.diff(np.searchsorted(start, offsets))
