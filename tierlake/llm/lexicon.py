"""A minimal acyclic transducer from byte strings to token ids, built on the driver and memory-mapped by the workers.

The automaton shares prefixes and suffixes of its words. Each transition carries a number; their sum along a word is
the word's place in sorted order, which leads to its ids.
"""

from __future__ import annotations

import numpy as np


def build(words: list[bytes], ids: list[tuple[int, ...]]) -> bytes:
    """Compiles distinct sorted ``words`` and their ids to one block of bytes that ``Lexicon`` reads in place."""
    registered: dict[tuple, int] = {}
    finals: list[int] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registered:
            registered[key] = len(finals)
            finals.append(node[0])
            arcs.append(key[1])
        return registered[key]

    path: list[list] = [[0, []]]  # open nodes of the last word: final or not, settled arcs
    last = b""
    for word in words:
        common = 0
        for a, b in zip(word, last):
            if a != b:
                break
            common += 1
        for depth in range(len(last), common, -1):
            child = settle(path.pop())
            path[-1][1].append((last[depth - 1], child))
        path += [[0, []] for _ in range(len(word) - common)]
        path[-1][0] = 1
        last = word
    for depth in range(len(last), 0, -1):
        child = settle(path.pop())
        path[-1][1].append((last[depth - 1], child))
    root = settle(path.pop())

    held = [0] * len(finals)  # words that can be read from a state; children are settled before their parents
    keys, to, add = [], [], []
    for state, out in enumerate(arcs):
        n = finals[state]
        for byte, child in out:
            keys.append((state << 8) | byte)
            to.append(child)
            add.append(n)
            n += held[child]
        held[state] = n
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    parts = [np.array([root, len(keys), len(finals), len(words), len(flat), max(map(len, words), default=0)], np.int64), ends, np.array(keys, np.int64), np.array(to, np.int32), np.array(add, np.int32), flat.astype(np.int32), np.array(finals, np.uint8)]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reads what ``build`` made from a buffer, without copying it."""

    def __init__(self, buffer: np.ndarray):
        self.root, arcs, states, words, ids, self.longest = (int(x) for x in buffer[:48].view(np.int64))
        at = 48
        for name, kind, n in (("ends", np.int64, words + 1), ("keys", np.int64, arcs), ("to", np.int32, arcs), ("add", np.int32, arcs), ("flat", np.int32, ids), ("finals", np.uint8, states)):
            size = np.dtype(kind).itemsize * n
            setattr(self, name, buffer[at : at + size].view(kind))
            at += size

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def places(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The place of each byte string data[start : start + len] in the lexicon, -1 for unseen ones; all walk side by side."""
        place = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), self.root, np.int64)
        walking = np.flatnonzero((lens > 0) & (lens <= self.longest))
        place[(lens == 0) | (lens > self.longest)] = -1
        if not len(self.keys):
            return np.full(len(starts), -1, np.int64)
        for depth in range(self.longest):
            if not len(walking):
                break
            key = (state[walking] << 8) | data[starts[walking] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            place[walking[~found]] = -1
            walking, arc = walking[found], arc[found]
            state[walking] = self.to[arc]
            place[walking] += self.add[arc]
            done = lens[walking] == depth + 1
            ended = walking[done]
            place[ended[self.finals[state[ended]] == 0]] = -1
            walking = walking[~done]
        return place
