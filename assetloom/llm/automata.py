"""Probabilistic automata from sample strings, by merging states of their prefix tree."""

from __future__ import annotations

import math
from collections import Counter, deque

#: Least probability of a symbol or an end that an automaton has not seen in a state.
UNSEEN = 1e-4
#: Symbols that strings may have, besides their end; each is as likely where nothing is known.
SYMBOLS = 67


class Automaton:
    """A deterministic automaton with counts; ``rows[s]`` maps a symbol to (target, count).

    One further observation of each state is shared out evenly to all symbols
    and the end, so an automaton of few strings, or of none, is near to even
    odds and needs no rule of its own.
    """

    def __init__(self, rows: list[dict[str, tuple[int, int]]], stops: list[int]):
        self.rows = rows
        self.stops = stops
        self.lengths: tuple[int, int] = (0, 0)
        self.samples = 0
        self.step = []
        for row, stop in zip(rows, stops):
            total = sum(c for _, c in row.values()) + stop + 1
            new = max(UNSEEN, 1 / total / SYMBOLS)
            self.step.append(({a: (t, math.log(c / total)) for a, (t, c) in row.items()}, math.log(max(stop / total, new)), math.log(new)))

    def log_likelihood(self, text: str) -> float:
        """Log-probability of the string; unseen symbols stay in their state at its price."""
        state, total, step = 0, 0.0, self.step
        for symbol in text:
            known, _, price = step[state]
            state, gain = known.get(symbol, (state, price))
            total += gain
        return total + step[state][1]


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge prefix-tree states whose outgoing frequencies pass Hoeffding's bound.

    States are tried in breadth-first order against those already kept, the
    oldest first; a merge folds the subtrees together. The samples should be
    a bounded list: the tree has a state for each distinct prefix.
    """
    child: list[dict[str, int]] = [{}]
    passed, stops = [0], [0]
    via: list[Counter] = [Counter()]
    for text in sorted(samples):
        state = 0
        passed[0] += 1
        for symbol in text:
            if symbol not in child[state]:
                child[state][symbol] = len(child)
                child.append({})
                passed.append(0)
                stops.append(0)
                via.append(Counter())
            via[state][symbol] += 1
            state = child[state][symbol]
            passed[state] += 1
        stops[state] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def near(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(x: int, y: int) -> bool:
        todo = [(x, y)]
        while todo:
            p, q = todo.pop()
            n, m = passed[p], passed[q]
            if not n or not m:
                continue
            if not near(stops[p], n, stops[q], m):
                return False
            for symbol in via[p].keys() | via[q].keys():
                if not near(via[p][symbol], n, via[q][symbol], m):
                    return False
                if symbol in child[p] and symbol in child[q] and child[p][symbol] != child[q][symbol]:
                    if passed[child[q][symbol]] > 1:  # a single string is compatible with anything
                        todo.append((child[p][symbol], child[q][symbol]))
        return True

    def fold(into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            passed[p] += passed[q]
            stops[p] += stops[q]
            via[p].update(via[q])
            for symbol, target in child[q].items():
                if symbol in child[p]:
                    todo.append((child[p][symbol], target))
                else:
                    child[p][symbol] = target

    kept, waiting = [0], deque((0, a) for a in sorted(child[0]))
    known, queued = {0}, set(waiting)
    while waiting:
        source, symbol = waiting.popleft()
        queued.discard((source, symbol))
        state = child[source][symbol]
        if state in known:
            continue
        more = []
        for old in kept:
            if compatible(old, state):
                child[source][symbol] = old
                fold(old, state)
                more = [(k, a) for k in kept for a in sorted(child[k]) if child[k][a] not in known and (k, a) not in queued]
                break
        else:
            kept.append(state)
            known.add(state)
            more = [(state, a) for a in sorted(child[state])]
        waiting.extend(more)
        queued.update(more)
    number = {s: i for i, s in enumerate(kept)}
    rows = [{a: (number[t], via[s][a]) for a, t in child[s].items() if t in number} for s in kept]
    made = Automaton(rows, [stops[s] for s in kept])
    sizes = sorted(map(len, samples)) or [0]
    made.lengths, made.samples = (sizes[0], sizes[-1]), len(samples)
    return made
