"""States of a finite automaton at every position, by an associative scan of its transition functions."""

from __future__ import annotations

import numpy as np

#: Positions that one lane composes before the totals of the lanes are scanned in turn.
WIDTH = 64


class TransitionScan:
    """Each symbol is a function from states to states; functions compose, so prefixes can be scanned.

    The functions that symbols generate form a small monoid. It is closed once: from then on a function is a
    number and composing two is one table lookup.
    """

    def __init__(self, functions: np.ndarray):
        states = functions.shape[1]
        found = {tuple(range(states)): 0}
        order = [tuple(range(states))]
        generators = [tuple(map(int, f)) for f in functions]
        for f in generators:
            if f not in found:
                found[f] = len(order)
                order.append(f)
        at = 0
        while at < len(order):
            for g in generators:
                both = tuple(g[s] for s in order[at])
                if both not in found:
                    found[both] = len(order)
                    order.append(both)
            at += 1
        self.size = len(order)
        self.apply = np.array(order, np.uint8)
        self.of_symbol = np.array([found[g] for g in generators], np.uint16)
        after = np.array([[found[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
        self.compose = after.ravel()

    def states(self, symbols: np.ndarray, start: int = 0) -> np.ndarray:
        """The state after each symbol."""
        return self._scan(self.of_symbol[symbols], start)

    def _scan(self, functions: np.ndarray, start: int) -> np.ndarray:
        n = len(functions)
        lanes = -(-n // WIDTH)
        padded = np.zeros(lanes * WIDTH, np.uint16)
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(lanes, WIDTH).T)
        for j in range(1, WIDTH):
            columns[j] = self.compose.take(columns[j - 1].astype(np.uint32) * self.size + columns[j])
        totals = columns[-1]
        enter = np.empty(lanes, np.uint8)
        enter[0] = start
        if lanes > 1:
            enter[1:] = self._scan(totals[:-1], start) if lanes > WIDTH else self._few(totals[:-1], start)
        states = self.apply.shape[1]
        flat = self.apply.ravel()
        out = np.empty((WIDTH, lanes), np.uint8)
        for j in range(WIDTH):
            out[j] = flat.take(columns[j].astype(np.uint32) * states + enter)
        return np.ascontiguousarray(out.T).ravel()[:n]

    def _few(self, functions: np.ndarray, state: int) -> np.ndarray:
        out = np.empty(len(functions), np.uint8)
        for n, f in enumerate(functions):
            state = out[n] = self.apply[f, state]
        return out
