"""Edit distances with a limit: lower bounds first, then few edits by diagonals, then the table as bits."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the pieces whose counts bound the distance from below, and letters of the shorter text from which they are counted.
PIECE, COUNTED = 6, 200
#: Edits up to which diagonals are followed; their work grows with the square of the edits, that of the table with the texts.
WAVES = 200


def at_least(a: str, b: str, q: int = PIECE) -> int:
    """A lower bound of the distance: lengths, and pieces of ``q`` letters, of which an edit takes at most ``q`` away."""
    bound = abs(len(a) - len(b))
    if min(len(a), len(b)) < max(q, COUNTED):
        return bound
    left, right = (Counter(x[i : i + q] for i in range(len(x) - q + 1)) for x in (a, b))
    return max(bound, -(-max((left - right).total(), (right - left).total()) // q))


def distance_within(a: str, b: str, limit: int) -> int | None:
    """Levenshtein's distance if it is ``limit`` at most, else None."""
    if limit < 0 or at_least(a, b) > limit:
        return None
    head, tail, short = 0, 0, min(len(a), len(b))
    if short:
        head = _run(a, b, 0, 0)
        tail = min(_run(a[::-1], b[::-1], 0, 0), short - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return max(len(a), len(b))  # lengths are within the limit
    found = _by_diagonals(a, b, min(limit, WAVES))
    return found if found is not None or limit <= WAVES else _by_bits(a, b, limit)


def _by_diagonals(a: str, b: str, limit: int) -> int | None:
    """How far along ``a`` each diagonal gets with 0, 1, 2, ... edits, until the last one gets to the end. Diagonal k: the place in ``b`` less that in ``a``."""
    gap, none, base = len(b) - len(a), -2, limit + 1
    furthest = [none] * (2 * limit + 3)
    for edits in range(limit + 1):
        left, fresh = limit - edits, [none] * len(furthest)
        for k in range(max(-edits, gap - left), min(edits, gap + left) + 1):
            i = base + k
            at = max(furthest[i] + 1, furthest[i - 1], furthest[i + 1] + 1) if edits else 0
            at = min(at, len(a), len(b) - k)
            if at < 0 or at + k < 0:
                continue
            fresh[i] = at + _run(a, b, at, at + k)
        if edits >= abs(gap) and fresh[base + gap] >= len(a):
            return edits
        furthest = fresh
    return None


def _run(a: str, b: str, i: int, j: int) -> int:
    """Letters that agree from ``i`` and ``j`` on, by slices that double and then halve."""
    n, step, most = 0, 1, min(len(a) - i, len(b) - j)
    while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    while step:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step //= 2
    return n


def _by_bits(a: str, b: str, limit: int) -> int | None:
    """A column of the table at a time as the bits of two whole numbers, rises and falls along ``a``; ends where what is left of ``b`` cannot bring the distance down to the limit."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every, last, rises, falls, score = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for j, c in enumerate(b, 1):
        here = where.get(c, 0)
        level = ((here & rises) + rises ^ rises) | here
        up, down = falls | every & ~(level | rises), rises & level
        score += bool(up & last) - bool(down & last)
        if score - (len(b) - j) > limit:
            return None
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls = down | every & ~(here | falls | up), up & (here | falls)
    return score


def within(a: Column, b: Column, limit: Column) -> Column:
    """The distance of two columns where it is at most ``limit`` (a whole number), else null. Lengths come first; then only a band of the table is made."""
    bound = F.greatest(limit.cast("int"), F.lit(0))
    fits = F.abs(F.length(a) - F.length(b)) <= limit
    found = F.when(fits, F.call_function("levenshtein", a, b, bound))
    return F.when((found >= 0) & (found <= limit), found)
