"""One deterministic automaton for many byte regexes, run over many positions at once.

Rules are parsed, joined into one nondeterministic automaton that may start
anywhere, made deterministic by subset construction and minimised by partition
refinement.  The result is a transition array over byte classes, with the rules
that end in each state.

A buffer is cut into lanes that step together.  Each lane first assumes the
state after a line break; where its predecessor ends in another one, it is run
again until both runs agree; a state that goes on through many lanes (a long run
of one kind) is carried through them together.  So the result is that of a single pass.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import count

import numpy as np

#: Rounds in which all lanes that began wrongly are run again.
TURNS = 4


class _Parser:
    """Literals, \\xHH, [sets], groups, |, ?, *, + and {m}, {m,}, {m,n}."""

    def __init__(self, pattern: str, nfa: _Nfa) -> None:
        self.p, self.i, self.nfa = pattern, 0, nfa

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        if self.p[self.i] == "x":
            self.i += 3
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(self.p[self.i - 1])

    def either(self):
        found = [self.row()]
        while self.peek() == "|":
            self.i += 1
            found.append(self.row())
        return found[0] if len(found) == 1 else ("or", found)

    def row(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("row", found)

    def repeated(self):
        one = self.one()
        while self.peek() in ("?", "*", "+", "{"):
            c = self.p[self.i]
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                self.i = end + 1
            one = ("times", one, least, most)
        return one

    def one(self):
        if self.peek() == "(":
            self.i += 1
            found = self.either()
            self.i += 1
            return found
        if self.peek() != "[":
            return ("set", frozenset([self.byte()]))
        self.i += 1
        no = self.peek() == "^"
        self.i += no
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.byte()
            found |= set(range(low, high + 1))
        self.i += 1
        return ("set", frozenset(set(range(256)) - found if no else found))


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
        elif kind == "row":
            end = start
            for x in node[1]:
                end = self.add(x, end)
        elif kind == "or":
            end = self.state()
            for x in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(x, begin)].append(end)
        else:
            _, inner, least, most = node
            at = start
            for _ in range(least):
                at = self.add(inner, at)
            if most is None:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                return loop
            end = self.state()
            self.empty[at].append(end)
            for _ in range(most - least):
                at = self.add(inner, at)
                self.empty[at].append(end)
        return end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Automaton:
    """next[state * classes + kind[byte]] is a state times ``classes``; ends[state] has a bit for each rule."""

    kind: np.ndarray
    next: np.ndarray
    ends: np.ndarray
    classes: int
    start: int

    def hits(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a rule ends (its last byte), in order, and which rules.

        ``data`` is taken to follow a line break; a line break must lead to the start state.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, self.ends.dtype)
        lanes = min(lanes, len(data))
        steps = -(-len(data) // lanes)
        whole = np.full(lanes * steps, 10, np.uint8)
        whole[: len(data)] = data
        columns = np.ascontiguousarray(self.kind[whole].reshape(lanes, steps).T)
        states = np.empty((steps, lanes), np.int32)
        now = np.full(lanes, self.start, np.int32)
        for t in range(steps):
            np.take(self.next, now + columns[t], out=now)
            states[t] = now
        assumed = np.full(lanes, self.start, np.int32)
        for turn in count():
            begin = np.concatenate([[self.start], states[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(begin != assumed)
            if not len(lane):
                break
            if turn >= TURNS:
                self._carry(columns, states, assumed, int(lane[0]), int(begin[lane[0]]))
                continue
            assumed = begin
            now = begin[lane]
            for t in range(steps):
                now = self.next[now + columns[t, lane]]
                other = now != states[t, lane]
                lane, now = lane[other], now[other]
                if not len(lane):
                    break
                states[t, lane] = now
        found = self.ends[states // self.classes] if self.classes > 1 else self.ends[states]
        t, lane = np.nonzero(found)
        at = lane * steps + t
        order = np.argsort(at, kind="stable")
        return at[order], found[t, lane][order]

    def _carry(self, columns: np.ndarray, states: np.ndarray, assumed: np.ndarray, lane: int, state: int) -> None:
        """Takes a state through lanes that end in it again, more of them at a time, and through the first one that doesn't."""
        many = 8
        while lane < states.shape[1]:
            own = np.arange(lane, min(lane + many, states.shape[1]))
            now, made = np.full(len(own), state, np.int32), np.empty((len(states), len(own)), np.int32)
            for t in range(len(states)):
                now = self.next[now + columns[t, own]]
                made[t] = now
            other = np.flatnonzero(now != state)
            good = int(other[0]) + 1 if len(other) else len(own)
            states[:, own[:good]], assumed[own[:good]] = made[:, :good], state
            if len(other):
                return
            lane, many = lane + good, 2 * many


def compiled(patterns: list[str]) -> Automaton:
    """The minimal automaton that tells, at each byte, which patterns have a match ending there."""
    nfa = _Nfa()
    root = nfa.state()
    finals = []
    for p in patterns:
        begin = nfa.state()
        nfa.empty[root].append(begin)
        finals.append(nfa.add(_Parser(p, nfa).either(), begin))
    sets = {s for moves in nfa.moves for s, _ in moves}
    by_byte = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(by_byte))}
    kind = np.array([kinds[x] for x in by_byte], np.int32)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(kinds))]

    start = nfa.closed([root])
    reach = [[frozenset().union(*(nfa.closed([x]) for got, x in moves if b in got)) for b in sample] for moves in nfa.moves]
    moving = [s for s, moves in enumerate(nfa.moves) if moves]
    useful = frozenset(moving) | frozenset(finals)
    start &= useful
    number, todo, table = {start: 0}, deque([start]), []
    while todo:
        here = todo.popleft()
        line = []
        steps = [reach[s] for s in here if nfa.moves[s]]
        for k in range(len(sample)):
            to = start.union(*(x[k] for x in steps)) & useful
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            line.append(number[to])
        table.append(line)
    move = np.array(table)
    ends = np.array([sum(1 << k for k, f in enumerate(finals) if f in s) for s in number], np.uint8)
    block = np.unique(ends, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    n = len(kinds)
    return Automaton(kind, (block[move[first]] * n).astype(np.int32).ravel(), ends[first], n, int(block[0]) * n)
