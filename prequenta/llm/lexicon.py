"""Minimal acyclic transducer over a word list, as flat arrays that can be memory-mapped.

Built incrementally from sorted keys: states with the same future are shared, so common suffixes
are stored once. Each arc carries how many words sort before its target's words within the
state, so walking a word adds up to its number; that number finds its outputs.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np

MAGIC = 8  # int64 fields of the header


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Serialise (key, output ids) pairs; of repeated keys the first is kept."""
    entries = dict(reversed([(w, ids) for w, ids in words]))
    keys = sorted(entries)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[list[tuple[int, int]]] = []

    def freeze(node: list) -> int:
        final, children = node
        signature = (final, tuple(children))
        if signature not in register:
            register[signature] = len(arcs)
            finals.append(final)
            arcs.append(list(children))
        return register[signature]

    path: list[list] = [[False, []]]  # unfinished states: [final, [(byte, state)]]
    last = b""
    for key in keys:
        shared = 0
        while shared < min(len(key), len(last)) and key[shared] == last[shared]:
            shared += 1
        for i in range(len(last), shared, -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(key) - shared)]
        path[-1][0] = True
        last = key
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], freeze(path.pop())))
    root = freeze(path[0])

    count = np.zeros(len(arcs), np.int64)
    first, label, target, before = [0], [], [], []
    for state, (final, out) in enumerate(zip(finals, arcs, strict=True)):  # targets come before their sources
        n = int(final)
        for byte, to in out:
            label.append(byte)
            target.append(to)
            before.append(n)
            n += int(count[to])
        count[state] = n
        first.append(len(label))
    outputs = [entries[k] for k in keys]
    starts = np.cumsum([0, *map(len, outputs)])
    flat = [x for ids in outputs for x in ids]
    parts = [first, finals, label, target, before, starts, flat]
    header = [root, *map(len, parts)]
    return b"".join(np.asarray(p, np.int64).tobytes() for p in (header, *parts))


class Lexicon:
    """A compiled lexicon, mapped from a file that needs no name while it is open."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = np.frombuffer(self._map, np.int64)
        sizes = view[1:MAGIC]
        ends = MAGIC + np.cumsum(sizes)
        parts = [view[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        self._root = int(view[0])
        first, self._final, label, self._target, self._before, self._starts, self._ids = map(memoryview, parts)
        # One search in C finds the arc of a byte; the table of bytes is an eighth of the mapped one.
        self._first, self._label = first, np.asarray(label, np.int64).astype(np.uint8).tobytes()

    def get(self, key: bytes) -> list[int] | None:
        """The output ids of a word, or None."""
        state, number = self._root, 0
        first, find, target, before = self._first, self._label.find, self._target, self._before
        for byte in key:
            arc = find(byte, first[state], first[state + 1])
            if arc < 0:
                return None
            number += before[arc]
            state = target[arc]
        if not self._final[state]:
            return None
        return list(self._ids[self._starts[number] : self._starts[number + 1]])
