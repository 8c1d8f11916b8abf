"""A minimal acyclic transducer from words to token ids, as a flat file that workers map into memory.

States that accept the same endings are one state. Each transition carries how many words come before those that
pass through it, so the outputs along a word add up to the word's number in byte order, which leads to its ids.
Transitions lie in one array by row displacement: the one of a state for a byte is at the state's base plus the
byte, if its owner is that state.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import cache

import numpy as np

from . import words as W


def minimal_automaton(words: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bool]]:
    """(byte, next state, words before) of each state's transitions, and whether it ends a word; the last state is the first one.

    ``words`` are distinct and in byte order. A state is frozen once no later word can pass through it, and is
    then looked up among those that are there already.
    """
    edges: list[list[tuple[int, int, int]]] = []
    final: list[bool] = []
    count: list[int] = []
    known: dict[tuple, int] = {}
    path: list[tuple[int, list[tuple[int, int]], list[bool]]] = [(-1, [], [False])]

    def freeze(depth: int) -> None:
        while len(path) > depth:
            byte, out, ends = path.pop()
            key = (ends[0], *out)
            if key not in known:
                known[key] = len(edges)
                before, own = int(ends[0]), []
                for b, to in out:
                    own.append((b, to, before))
                    before += count[to]
                edges.append(own)
                final.append(ends[0])
                count.append(before)
            if path:
                path[-1][1].append((byte, known[key]))

    last = b""
    for word in words:
        same = len(os.path.commonprefix([word, last]))
        freeze(same + 1)
        for byte in word[same:]:
            path.append((byte, [], [False]))
        path[-1][2][0] = True
        last = word
    freeze(0)
    return edges, final


def _displaced(edges: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Base of each state; and owner, next state and output of each place."""
    size, step = 2 * sum(map(len, edges)) + 1024, 4096
    table, used = np.full((3, size), -1, np.int32), np.zeros(size + step, bool)
    base, free = np.zeros(len(edges), np.int32), 256
    for state in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
        own = edges[state]
        if not own:
            continue
        least, at, fits = own[0][0], free, False
        while len(own) > 1 and not fits:  # the first places where all bytes are free
            if at + step + 256 > len(used):
                used, table = np.concatenate([used, np.zeros(size, bool)]), np.concatenate([table, np.full((3, size), -1, np.int32)], axis=1)
            ok = ~used[at : at + step]
            for b, _, _ in own[1:]:
                ok &= ~used[at + b - least : at + b - least + step]
            fits, at = bool(ok.any()), at + int(ok.argmax()) if ok.any() else at + step
        base[state] = at - least
        for b, to, before in own:
            used[at - least + b] = True
            table[:, at - least + b] = state, to, before
        while used[free]:
            free += 1
    return base, table[:, : int(np.flatnonzero(table[0] >= 0).max(initial=0)) + 257]


def compile_lexicon(ids: dict[bytes, list[int]]) -> bytes:
    """The transducer of the words of ``ids`` with their token ids."""
    words = sorted(ids)
    edges, final = minimal_automaton(words)
    base, table = _displaced(edges)
    first = np.concatenate([[0], np.cumsum([len(ids[w]) for w in words])])
    parts = [base, *table, np.array(final, np.int32), first, np.array([i for w in words for i in ids[w]])]
    longest = max(map(len, words), default=0)
    head = np.array([len(edges) - 1, longest, *map(len, parts)], np.int32)
    return b"".join(np.ascontiguousarray(p, np.int32).tobytes() for p in (head, *parts))


class Lexicon:
    """A compiled transducer over an array of 32-bit numbers, which may be mapped from a file."""

    def __init__(self, raw: np.ndarray):
        self.root, self.longest, *sizes = raw[:9].tolist()
        ends = 9 + np.cumsum(sizes)
        self.base, self.owner, self.next, self.before, self.final, self.first, self.ids = (raw[b - n : b] for n, b in zip(sizes, ends.tolist(), strict=True))

    def __len__(self) -> int:
        return len(self.first) - 1

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of the word at each place of ``data``, -1 if it is not in the lexicon. All words take a step at once."""
        number = np.full(len(start), -1, np.int64)
        alive = np.flatnonzero(size <= self.longest)
        state, total, depth = np.full(len(alive), self.root, np.int32), np.zeros(len(alive), np.int64), 0
        while len(alive):
            over = size[alive] == depth
            ends = over & (self.final[state] == 1)
            number[alive[ends]] = total[ends]
            going = ~over
            alive, state, total = alive[going], state[going], total[going]
            place = self.base[state] + data[start[alive] + depth]
            ok = self.owner[place] == state
            place, alive = place[ok], alive[ok]
            state, total, depth = self.next[place], total[ok] + self.before[place], depth + 1
        return number


@cache
def _mapped(path: str) -> Lexicon:
    return Lexicon(np.memmap(path, np.int32, "r"))


def mapped_lexicon(raw: bytes, folder: str) -> Lexicon:
    """The lexicon as a file of ``folder``, which the Python workers of an executor share, mapped into memory."""
    path = os.path.join(folder, f"lexicon-{hashlib.sha256(raw).hexdigest()[:32]}")
    if not os.path.exists(path):
        own = f"{path}-{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(raw)
        os.replace(own, path)
    return _mapped(path)


def spread(lexicon: Lexicon, number: np.ndarray, more: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each word) of words by their numbers. Those from the lexicon's size on lead to ``more_ids`` by ``more``, their first ids and the end."""
    first = np.concatenate([lexicon.first[:-1], len(lexicon.ids) + more]).astype(np.int64)
    count = first[number + 1] - first[number]
    return np.concatenate([lexicon.ids, more_ids])[W.ranges(first[number], count)], count
