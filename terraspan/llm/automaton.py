"""Regular expressions compiled into one minimal deterministic automaton over bytes, run over many lanes at once.

Patterns are parsed by Python's own regex parser; literals, classes, groups,
alternation and greedy repeats are supported. Subset construction works on byte
classes (bytes that no rule tells apart share a column); partition refinement then
merges equivalent states.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_parser = re._parser


class _Graph:
    """Nondeterministic automaton: empty moves and moves on byte sets."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def parse(self, tree, at: int, fold: bool, backwards: bool) -> int:
        """Add the parsed ``tree`` behind node ``at``; returns its end."""
        for kind, arg in reversed(list(tree)) if backwards else tree:
            at = self._item(str(kind), arg, at, fold, backwards)
        return at

    def _item(self, kind: str, arg, at: int, fold: bool, backwards: bool) -> int:
        if kind in ("LITERAL", "NOT_LITERAL", "IN"):
            end = self.node()
            self.moves[at].append((_bytes(kind, arg, fold), end))
            return end
        if kind == "SUBPATTERN":
            return self.parse(arg[3], at, fold, backwards)
        if kind == "BRANCH":
            end = self.node()
            for choice in arg[1]:
                self.empty[self.parse(choice, self._after(at), fold, backwards)].append(end)
            return end
        if kind == "MAX_REPEAT":
            low, high, body = arg
            for _ in range(low):
                at = self.parse(body, at, fold, backwards)
            end = self.node()
            if high == _parser.MAXREPEAT:
                loop = self._after(at)
                self.empty[self.parse(body, loop, fold, backwards)].append(loop)
                self.empty[loop].append(end)
                return end
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.parse(body, self._after(at), fold, backwards)
                self.empty[at].append(end)
            return end
        raise ValueError(f"unsupported regex part {kind}")

    def _after(self, at: int) -> int:
        node = self.node()
        self.empty[at].append(node)
        return node

    def closure(self, nodes) -> frozenset[int]:
        seen, stack = set(nodes), list(nodes)
        while stack:
            for n in self.empty[stack.pop()]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return frozenset(seen)


def _bytes(kind: str, arg, fold: bool) -> frozenset[int]:
    if kind == "LITERAL":
        chosen = {arg}
    elif kind == "NOT_LITERAL":
        chosen = set(range(255)) - {arg}
    else:
        chosen, negated = set(), False
        for what, value in arg:
            if str(what) == "NEGATE":
                negated = True
            elif str(what) == "LITERAL":
                chosen.add(value)
            elif str(what) == "RANGE":
                chosen.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"unsupported class {what}")
        if negated:
            chosen = set(range(255)) - chosen
    if fold:
        letters = {b for b in chosen if chr(b).isascii() and chr(b).isalpha()}
        chosen |= {b ^ 32 for b in letters}
    return frozenset(chosen)


@dataclass
class Automaton:
    """``table`` holds row offsets: the next row is ``table[row + column_of[byte]]``; byte 255 leads to the start."""

    column_of: np.ndarray
    table: np.ndarray
    accepts: np.ndarray  # bits of the rules matched, by state
    width: int
    dead: int  # row that never matches again, -1 if there is none

    def run(self, buffer: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Rules matched after each byte. The buffer is cut into lanes that step together.

        Every lane is first run from the start state; where the lane before ends
        elsewhere, the lane is run again until it meets the states already found.
        """
        n = len(buffer)
        lanes = max(1, min(lanes, n // 64))
        steps = -(-n // lanes) if n else 0
        columns = np.full(lanes * steps, self.column_of[255], np.int32)
        columns[:n] = self.column_of[buffer]
        columns = np.ascontiguousarray(columns.reshape(lanes, steps).T)
        states = np.empty((steps, lanes), np.int32)
        row = np.zeros(lanes, np.int32)
        for step in range(steps):
            row = self.table[row + columns[step]]
            states[step] = row
        if steps:
            self._settle(columns, states)
        return self.accepts[states.T.reshape(-1)[:n] // self.width]

    def _settle(self, columns: np.ndarray, states: np.ndarray) -> None:
        entered = np.zeros(states.shape[1], np.int32)
        while True:
            entry = np.concatenate(([0], states[-1, :-1])).astype(np.int32)
            wrong = np.flatnonzero(entry != entered)
            if not len(wrong):
                return
            entered = entry
            row = entry[wrong]
            for step in range(len(states)):
                row = self.table[row + columns[step, wrong]]
                open_ = row != states[step, wrong]
                wrong, row = wrong[open_], row[open_]
                if not len(wrong):
                    break
                states[step, wrong] = row


def compile_rules(patterns: list[str], fold: list[bool], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """One automaton for all rules. ``anywhere``: a match may start at any byte; ``backwards``: rules are reversed."""
    graph = _Graph()
    start = graph.node()
    ends: dict[int, int] = {}
    for bit, (pattern, folded) in enumerate(zip(patterns, fold)):
        first = graph._after(start)
        ends[graph.parse(_parser.parse(pattern), first, folded, backwards)] = 1 << bit
    classes = _byte_classes({s for moves in graph.moves for s, _ in moves})
    width = int(classes.max()) + 1
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(width)]
    origin = graph.closure([start])
    closures: dict[int, frozenset[int]] = {}
    by_node = [[[t for s, t in moves if b in s] for b in samples] for moves in graph.moves]
    numbers, todo, rows = {origin: 0}, [origin], []
    for nodes in todo:
        row = []
        for column in range(width):
            if column == int(classes[255]):
                row.append(0)
                continue
            targets = set(origin) if anywhere else set()
            for node in nodes:
                for t in by_node[node][column]:
                    if t not in closures:
                        closures[t] = graph.closure([t])
                    targets |= closures[t]
            key = frozenset(targets)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            row.append(numbers[key])
        rows.append(row)
    accepts = np.array([sum(bit for end, bit in ends.items() if end in nodes) for nodes in todo], np.uint32)
    table, accepts = _minimal(np.array(rows, np.int32), accepts)
    others = [c for c in range(width) if c != int(classes[255])]
    dead = [i for i in range(len(table)) if not accepts[i] and (table[i, others] == i).all()]
    flat = (table * width).reshape(-1).astype(np.int32)
    return Automaton(classes.astype(np.int32), flat, accepts, width, dead[0] * width if dead else -1)


def _byte_classes(sets: set[frozenset[int]]) -> np.ndarray:
    ordered = sorted(map(sorted, sets))
    marks = np.zeros((256, len(ordered) + 1), bool)
    for i, chosen in enumerate(ordered):
        marks[list(chosen), i] = True
    marks[255, -1] = True  # the separator has a class of its own
    return np.unique(marks, axis=0, return_inverse=True)[1].reshape(-1)


def _minimal(rows: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; the start keeps number 0."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        _, refined = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    order = np.argsort([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    block = rank[block]
    first = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    return block[rows[first]], accepts[first]
