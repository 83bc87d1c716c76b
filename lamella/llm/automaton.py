"""Deterministic automata over bytes: subset construction, minimisation, transition arrays.

Patterns are read by the standard library's regular-expression parser; literals, classes, alternation, groups
and greedy repeats of ASCII characters are understood, in either case under ``(?i:...)``. Everything else is refused.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def chars(self, at: int, what: frozenset) -> int:
        self.step[at] = (what, end := self.state())
        end_ = self.state()
        self.eps[end].append(end_)
        return end_

    def add(self, tree, at: int, fold: bool, back: bool) -> int:
        """Thread ``tree`` from state ``at``; returns the state after it. ``back``: for reversed input."""
        for op, arg in reversed(list(tree)) if back else list(tree):
            if op is C.LITERAL:
                at = self.chars(at, _cases({arg}, fold))
            elif op is C.IN:
                at = self.chars(at, _members(arg, fold))
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I, back)
            elif op is C.BRANCH:
                end = self.state()
                for way in arg[1]:
                    self.eps[at].append(start := self.state())
                    self.eps[self.add(way, start, fold, back)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, fold, back)
                if high is C.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.eps[at] += [loop, end]
                    self.eps[self.add(body, loop, fold, back)] += [loop, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        at = self.add(body, at, fold, back)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"patterns may not use {op}")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _cases(codes: set, fold: bool) -> frozenset:
    if max(codes) > 127:
        raise ValueError("patterns are ASCII")
    return frozenset(c for x in codes for c in ({x, ord(chr(x).lower()), ord(chr(x).upper())} if fold else {x}))


def _members(items, fold: bool) -> frozenset:
    codes: set = set()
    for op, arg in items:
        if op is C.LITERAL:
            codes.add(arg)
        elif op is C.RANGE:
            codes |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"classes may not use {op}")
    return _cases(codes, fold)


class Dfa:
    """``table[state, byte]`` is the next state, ``accepts[state]`` the bits of the rules that end there.
    State 0 is where it starts; ``dead`` is the state that nothing leaves, or -1."""

    def __init__(self, patterns: list[str], anchored: bool, back: bool = False) -> None:
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for rule, pattern in enumerate(patterns):
            nfa.eps[root].append(start := nfa.state())
            ends[nfa.add(parser.parse(pattern), start, False, back)] = 1 << rule
        begin = nfa.closure([root])
        # subset construction over classes of bytes that no pattern tells apart
        sets = list(dict.fromkeys(s[0] for s in nfa.step if s))
        kind = np.array([hash(tuple(b in s for s in sets)) for b in range(256)])
        _, first, byte_class = np.unique(kind, return_index=True, return_inverse=True)
        number, todo, table = {begin: 0}, [begin], []
        while todo:
            now, row = todo.pop(0), []
            for b in first:
                after = {s[1] for x in now if (s := nfa.step[x]) and int(b) in s[0]}
                nxt = nfa.closure(after | (set() if anchored else {root}))
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            table.append(row)
        t = np.array(table, dtype=np.int32)
        accepts = np.array([sum(ends[x] for x in s if x in ends) for s in number], dtype=np.int64)
        # minimisation: split classes until states of one class go to the same classes on every byte
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([part, part[t]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        # number classes: the start first, accepting ones last, so that one comparison tells a hit
        firsts = np.unique(part, return_index=True)[1]
        order = sorted(range(len(firsts)), key=lambda c: (accepts[firsts[c]] != 0, c != part[0], c))
        new = np.empty(len(order), dtype=np.int32)
        new[order] = np.arange(len(order))
        self.accepts = accepts[firsts[order]]
        self.table = new[part[t[firsts[order]]]][:, byte_class]
        self.hits_from = int((self.accepts == 0).sum())
        self.start = int(new[part[0]])
        still = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = still[0] if still else -1
        self.rows = self.table.tolist()

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        rows, state, found = self.rows, self.start, -1
        for p in range(at, len(data)):
            state = rows[state][data[p]]
            if state == self.dead:
                break
            if state >= self.hits_from:
                found = p + 1
        return found

    def earliest(self, data: bytes, end: int, least: int) -> int:
        """For a reversed automaton: the least start >= ``least`` of a match that ends at ``end``, or -1."""
        rows, state, found = self.rows, self.start, -1
        for p in range(end - 1, least - 1, -1):
            state = rows[state][data[p]]
            if state == self.dead:
                break
            if state >= self.hits_from:
                found = p
        return found


def hits(dfa: Dfa, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass of ``dfa`` over every byte of ``texts``: (text, position after the byte, rule bits) of each hit, in order.

    Texts advance in step, longest first, so one array look-up moves all of them by a byte; the last few of very
    long texts go on alone from the state they have reached.
    """
    n = np.array([len(x) for x in texts], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    size, data = n[order], np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    flat, floor = (dfa.table.astype(np.int32) * 256).ravel(), dfa.hits_from * 256
    state = np.full(len(texts), dfa.start * 256, dtype=np.int32)
    found: list[tuple] = []
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # texts longer than p
    p = 0
    while p < len(live) and live[p] >= 16:
        k = live[p]
        state[:k] = flat[state[:k] + data[start[:k] + p]]
        at = np.flatnonzero(state[:k] >= floor)
        if len(at):
            found.append((order[at], np.full(len(at), p + 1), dfa.accepts[state[at] >> 8]))
        p += 1
    rows, accepts = dfa.rows, dfa.accepts
    for lane in range(live[p] if p < len(live) else 0):
        s, where, bits = int(state[lane]) >> 8, [], []
        for q, b in enumerate(texts[order[lane]][p:], p + 1):
            s = rows[s][b]
            if s >= dfa.hits_from:
                where.append(q)
                bits.append(accepts[s])
        if where:
            found.append((np.full(len(where), order[lane]), np.array(where), np.array(bits)))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    text, pos, bits = (np.concatenate([x[i] for x in found]) for i in range(3))
    by = np.lexsort((pos, text))
    return text[by], pos[by], bits[by]
