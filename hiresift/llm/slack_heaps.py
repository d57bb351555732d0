"""Binary min-heaps held as arrays, whose changes are made to many places at once."""

from __future__ import annotations

import numpy as np


def at_most(keys: np.ndarray, limit: float) -> np.ndarray:
    """Places of all keys that do not exceed the limit: walks down from the root and no further than they go."""
    found, front = [], np.arange(min(1, len(keys)))
    while len(front):
        front = front[keys[front] <= limit]
        found.append(front)
        front = np.concatenate([2 * front + 1, 2 * front + 2])
        front = front[front < len(keys)]
    return np.concatenate(found) if found else front


def _with_ancestors(places: np.ndarray) -> np.ndarray:
    levels = [places]
    while len(places):
        places = np.unique((places[places > 0] - 1) // 2)
        levels.append(places)
    return np.unique(np.concatenate(levels))


def _sink(keys: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
    """Restore the order below the places, which hold all their ancestors: level by level, the deepest first."""
    levels = np.frexp(places + 1.0)[1]
    for level in range(int(levels.max(initial=0)), 0, -1):
        at = places[levels == level]
        while len(at):
            child = 2 * at + 1
            at, child = at[child < len(keys)], child[child < len(keys)]
            right = np.minimum(child + 1, len(keys) - 1)
            child = np.where(keys[right] < keys[child], right, child)
            lower = keys[child] < keys[at]
            at, child = at[lower], child[lower]
            keys[at], keys[child] = keys[child], keys[at]
            items[at], items[child] = items[child], items[at]
            at = child


def exchange(
    keys: np.ndarray, items: np.ndarray, holes: np.ndarray, new_keys: np.ndarray, new_items: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The heap without what stands at the holes and with the new elements.

    Holes are filled with new elements first, then with the last ones of the heap;
    only subtrees under a changed place are put in order again.
    """
    before, after = len(keys), len(keys) - len(holes) + len(new_keys)
    open_ = np.zeros(max(before, after), bool)
    open_[holes] = True
    open_[before:] = True
    tail = np.arange(after, before)
    tail = tail[~open_[tail]]
    places = np.flatnonzero(open_[:after])
    grown_keys, grown_items = np.empty(after, keys.dtype), np.empty(after, items.dtype)
    kept = min(before, after)
    grown_keys[:kept], grown_items[:kept] = keys[:kept], items[:kept]
    grown_keys[places] = np.concatenate([new_keys, keys[tail]])
    grown_items[places] = np.concatenate([new_items, items[tail]])
    _sink(grown_keys, grown_items, _with_ancestors(places))
    return grown_keys, grown_items
