"""Many patterns of one shape held against a text at once: two literals with marks between them and a third within reach.

Such a pattern (``the[ ,.\\n]+cat.{0,20}sat``) can only match where a run of marks stands, once for each run. The patterns
are one trie: from a run of marks the first literal is walked backward, then the second forward, then the third from each
place in reach. All runs of many texts are walked together, a character at a time, as arrays. What it finds is what the
patterns find on their own, and no text is matched twice for two patterns that begin alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quern.functions.regex import MARKS

#: What literals may be made of, in lower case, after what begins the second and the third; its places are the trie's symbols, in the order of bytes. OTHER is in none.
ALPHABET = "+-0123456789abcdefghijklmnopqrstuvwxyz"
SECOND, THIRD, OTHER = 0, 1, 63

#: The longest pattern in symbols, and the farthest reach.
LONGEST, REACH = 120, 64

#: Characters that are walked together.
PIECE = 1 << 20

#: What no dot matches.
BREAKS = (0x0A, 0x0D, 0x85, 0x2028, 0x2029)

#: Between texts, where no match goes.
_CUT = "\U0010ffff"


def chain(pattern: str) -> tuple[str, str] | None:
    """(kind, the literals as a path of the trie) of a pattern of this shape, else None. The kind has the marks and the reach."""
    if "(" in pattern or "|" in pattern:
        return None
    words, joints = [""], []
    for op, arg in re._parser.parse(pattern):  # noqa: SLF001
        if str(op) == "LITERAL":
            words[-1] += chr(arg).lower() if arg < 128 else _CUT
        elif str(op) == "MAX_REPEAT":
            joints.append(arg)
            words.append("")
        else:
            return None
    if len(joints) != 2 or not all(words) or not set("".join(words)) <= set(ALPHABET[2:]) or sum(map(len, words)) > LONGEST - 2:
        return None
    (least, most, marks), (lo, hi, dot) = joints
    plain = [x for op, arg in marks for x in (arg if str(op) == "IN" else [(op, arg)])]
    if least != 1 or most < 2**31 or len(marks) != 1 or not all(str(op) == "LITERAL" and arg < 128 and chr(arg) in MARKS for op, arg in plain):
        return None
    if len(dot) != 1 or str(dot[0][0]) != "ANY" or hi > REACH:
        return None
    return f"{lo} {hi} {' '.join(map(str, sorted({arg for _, arg in plain})))}", words[0][::-1] + "+" + words[1] + "-" + words[2]


#: Symbols of a path's bytes, and of a text's characters in either case.
_PATH = np.full(256, OTHER, np.uint8)
for _at, _c in enumerate(ALPHABET):
    _PATH[ord(_c)] = _at
_SYMBOL = _PATH.copy()
_SYMBOL[[ord("+"), ord("-")]] = OTHER
_SYMBOL[ord("A") : ord("Z") + 1] = _PATH[ord("a") : ord("z") + 1]


class Chains:
    """The trie of patterns of one kind. ``ids`` are the patterns' numbers; patterns that differ in case have one path."""

    def __init__(self, kind: str, paths: list[str], ids: np.ndarray):
        self.lo, self.hi, *marks = map(int, kind.split())
        self.marks = np.zeros(256, bool)
        self.marks[marks] = True
        known, own = np.unique(np.array([p.encode() for p in paths]), return_inverse=True)
        order = np.argsort(own, kind="stable")
        self.ids = np.asarray(ids, np.int64)[order]
        self.first = np.searchsorted(own[order], np.arange(len(known) + 1))
        rows = known.view(np.uint8).reshape(len(known), -1)
        size, path = (rows != 0).sum(1), _PATH[rows]
        # rows that agree up to a place follow one another there, and so do a node's children by their symbols
        differs = np.ones(path.shape, bool)
        differs[1:] = np.logical_or.accumulate(path[1:] != path[:-1], axis=1)
        masks, bases, ends = [np.zeros(1, np.uint64)], [np.zeros(1, np.int32)], [np.full(1, -1, np.int32)]
        node, total = np.zeros(len(path), np.int64), 1
        for depth in range(int(size.max(initial=0))):
            rest = np.flatnonzero(size > depth)
            new = differs[rest, depth]
            at = np.flatnonzero(new)
            above, symbol = node[rest[at]] - (total - len(masks[-1])), path[rest[at], depth].astype(np.uint64)
            np.bitwise_or.at(masks[-1], above, np.uint64(1) << symbol)
            firsts = np.flatnonzero(np.diff(above, prepend=-1))
            bases[-1][above[firsts]] = total + firsts
            node[rest] = total + np.cumsum(new) - 1
            masks.append(np.zeros(len(at), np.uint64))
            bases.append(np.zeros(len(at), np.int32))
            ends.append(np.full(len(at), -1, np.int32))
            done = rest[size[rest] == depth + 1]
            ends[-1][node[done] - total] = done
            total += len(at)
        self.mask, self.base, self.end = map(np.concatenate, (masks, bases, ends))

    def step(self, state: np.ndarray, symbol: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the states that go on by the symbol, where they go)."""
        mask, symbol = self.mask[state], np.uint64(symbol) if isinstance(symbol, int) else symbol
        on = np.flatnonzero(mask >> symbol & np.uint64(1))
        mask, symbol = mask[on], symbol[on] if symbol.ndim else symbol
        return on, self.base[state[on]] + np.bitwise_count(mask & ((np.uint64(1) << symbol) - np.uint64(1)))

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, number of the pattern) of each pattern that occurs in a text, by text."""
        code = np.frombuffer((_CUT + _CUT.join(texts) + _CUT * (self.hi + 2)).encode("utf-32-le"), np.uint32)
        cut = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        low = np.minimum(code, 255).astype(np.uint8)
        symbol, mark = _SYMBOL[low].astype(np.uint64), self.marks[low]
        stop = np.isin(code, BREAKS)
        stop[cut] = stop[cut[-1] :] = True
        edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        begin, after = edge[::2], edge[1::2]
        run, state, back = np.arange(len(begin)), np.zeros(len(begin), np.int32), begin - 1
        second = []
        while len(run):
            on, to = self.step(state, SECOND)
            second.append((after[run[on]], to))
            on, state = self.step(state, symbol[back])
            run, back = run[on], back[on] - 1
        third = []
        at, state = map(np.concatenate, zip(*second)) if second else (run, state)
        while len(at):
            on, to = self.step(state, THIRD)
            third.append((at[on], to))
            on, state = self.step(state, symbol[at])
            at = at[on] + 1
        at, state = map(np.concatenate, zip(*third)) if third else (at, state)
        tried = [(at[:0], state[:0])]
        for far in range(self.hi + 1):
            if far >= self.lo:
                on, to = self.step(state, symbol[at])
                tried.append((at[on] + 1, to))
            on = np.flatnonzero(~stop[at])
            at, state = at[on] + 1, state[on]
        at, state = map(np.concatenate, zip(*tried))
        pairs = [np.zeros(0, np.int64)]
        while len(at):
            path = self.end[state]
            done = np.flatnonzero(path >= 0)
            pairs.append((np.searchsorted(cut, at[done] - 1, "right") - 1) * (len(self.first) - 1) + path[done])
            on, state = self.step(state, symbol[at])
            at = at[on] + 1
        text, path = np.divmod(np.unique(np.concatenate(pairs)), max(len(self.first) - 1, 1))
        many = self.first[path + 1] - self.first[path]
        place = np.repeat(self.first[path] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(text, many), self.ids[place]


def search(batches: Iterator[pa.RecordBatch], chains: Chains) -> Iterator[pa.RecordBatch]:
    """(__k, __ps) of batches (__k, __t): the patterns of each text that has any."""
    for batch in batches:
        texts = [t.decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (held == 0 or held + len(texts[stop]) <= PIECE):
                held += len(texts[stop]) + 1
                stop += 1
            text, ids = chains.found(texts[start:stop])
            own, first = np.unique(text, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + start)), lists], names=["__k", "__ps"])
            start = stop
