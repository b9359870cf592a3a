"""The linear grouping scheme of operator 13, on a histogram of lengths.

Everything here works on how many pieces there are of each length, never on the pieces:
time and memory depend on the length of a sequence and not on the data.

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up
   to the longest of its group, so a few sizes with many pieces each remain.
2. The best mix of configurations (ways to fill a sequence with those sizes) is a linear
   programme with one row per group. Its columns are made as they are needed: the duals
   price the groups, and a knapsack finds the most valuable configuration. Each
   configuration is used its whole number of times.
3. Actual lengths of the groups take the places of the rounded ones.
4. Large pieces that the whole numbers left over, and then the small ones, go by best fit,
   longest first, into the room that rounding and filling left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np

GROUPS = 128
# Lengths above a share of a sequence are large. Where small pieces abound few large ones
# are best and the first share is enough; without them more lengths must be mixed well.
LARGE_SHARES = (1 / 2, 1 / 3, 1 / 5)
# Columns made at most; the mix is feasible after any number of them.
MOST_COLUMNS = 600


@dataclass
class Pattern:
    """``count`` sequences that each hold ``n`` pieces of a length, for (length, n)."""

    entries: tuple[tuple[int, int], ...]
    count: int

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.entries)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Groups of nearly equal cardinality as [length, count] runs, longest first; those
    with the same longest length are one."""
    total = sum(counts.values())
    ends = [total * (g + 1) // groups for g in range(groups)]
    out: list[list[list[int]]] = [[]]
    seen = place = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while place < groups - 1 and seen == ends[place]:
                place += 1
                if out[-1] and out[-1][0][0] != length:
                    out.append([])
            some = min(left, ends[place] - seen)
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1][1] += some
            else:
                out[-1].append([length, some])
            seen, left = seen + some, left - some
    return [group for group in out if group]


def best_configuration(sizes: list[int], prices: np.ndarray, room: int) -> np.ndarray:
    """How many of each size the most valuable filling of ``room`` holds."""
    best = np.zeros(room + 1)
    choices = []
    for _ in range(room // min(sizes)):
        better, choice = best.copy(), np.full(room + 1, -1)
        for number, (size, price) in enumerate(zip(sizes, prices)):
            value = best[: room + 1 - size] + price
            gains = value > better[size:] + 1e-12
            better[size:][gains] = value[gains]
            choice[size:][gains] = number
        choices.append(choice)
        best = better
    counts, at = np.zeros(len(sizes), np.int64), room
    for choice in reversed(choices):
        if choice[at] >= 0:
            counts[choice[at]] += 1
            at -= sizes[choice[at]]
    return counts


def configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[list[int], int]]:
    """(counts per size, times) of a near-optimal mix, in whole times that together hold
    no more of any size than ``demand``."""
    columns = np.diag([room // size for size in sizes]).astype(float)
    wanted = np.array(demand, float)
    for _ in range(MOST_COLUMNS):
        prices = np.linalg.solve(columns.T, np.ones(len(sizes)))
        entering = best_configuration(sizes, prices, room)
        if entering @ prices <= 1 + 1e-7:
            break
        times = np.linalg.solve(columns, wanted)
        change = np.linalg.solve(columns, entering.astype(float))
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = entering
    times = np.linalg.solve(columns, wanted)
    left, out = list(demand), []
    for column, time in sorted(zip(columns.T, times), key=lambda c: -c[1]):
        counts = [int(round(c)) for c in column]
        whole = min([int(time + 1e-6)] + [l // c for l, c in zip(left, counts) if c])
        if whole > 0:
            out.append((counts, whole))
            left = [l - whole * c for l, c in zip(left, counts)]
    return out


def draw(group: list[list[int]], count: int) -> list[list[int]]:
    """Takes the first ``count`` lengths of a group's runs out of it."""
    out = []
    while count:
        some = min(count, group[0][1])
        out.append([group[0][0], some])
        count -= some
        group[0][1] -= some
        if not group[0][1]:
            group.pop(0)
    return out


def substituted(
    groups: list[list[list[int]]], mix: list[tuple[list[int], int]]
) -> list[Pattern]:
    """Patterns of actual lengths; takes what they hold out of the groups."""
    out = []
    for counts, times in mix:
        slots = [draw(groups[g], times) for g, n in enumerate(counts) for _ in range(n)]
        while slots[0]:
            some = min(runs[0][1] for runs in slots)
            held: dict[int, int] = {}
            for runs in slots:
                held[runs[0][0]] = held.get(runs[0][0], 0) + 1
                runs[0][1] -= some
                if not runs[0][1]:
                    runs.pop(0)
            out.append(Pattern(tuple(held.items()), some))
    return out


def best_fit(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Adds pieces, longest first, each to the fullest sequence with room for it. Many
    equal sequences or pieces are handled at once, with the result of one by one."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(pattern)

    for pattern in patterns:
        put(pattern, capacity - pattern.used)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, pattern = capacity, Pattern((), left)
            each = room // length
            full = min(pattern.count, left // each)
            if full:
                put(Pattern((*pattern.entries, (length, each)), full), room - each * length)
            left -= full * each
            rest = pattern.count - full
            if rest and 0 < left < each:
                put(Pattern((*pattern.entries, (length, left)), 1), room - left * length)
                left, rest = 0, rest - 1
            if rest and pattern.entries:
                put(Pattern(pattern.entries, rest), room)
    return [pattern for some in by_room.values() for pattern in some]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer: by the sum of lengths, and by those over half a sequence."""
    total = sum(length * n for length, n in counts.items())
    over_half = sum(n for length, n in counts.items() if 2 * length > capacity)
    return max(-(-total // capacity), over_half)


def grouped(
    counts: dict[int, int], capacity: int, share: float, groups: int
) -> list[Pattern]:
    """The scheme with lengths above ``share`` of a sequence as large ones."""
    large = {n: c for n, c in counts.items() if c and capacity * share < n < capacity}
    others = {n: c for n, c in counts.items() if c and n not in large and n < capacity}
    full = [Pattern(((capacity, 1),), counts[capacity])] if counts.get(capacity) else []
    patterns: list[Pattern] = []
    if large:
        runs = linear_groups(large, min(groups, sum(large.values())))
        sizes = [group[0][0] for group in runs]
        demand = [sum(n for _, n in group) for group in runs]
        patterns = substituted(runs, configurations(sizes, demand, capacity))
        for group in runs:
            for length, n in group:
                others[length] = others.get(length, 0) + n
    return full + best_fit(patterns, others, capacity)


def pack_lengths(
    counts: dict[int, int], capacity: int, groups: int = GROUPS
) -> list[Pattern]:
    """Patterns that together hold exactly ``counts[length]`` pieces of each length: of
    the scheme's results for the shares above the one with the fewest sequences."""
    least = least_sequences(counts, capacity)
    best: list[Pattern] = []
    fewest = None
    for share in LARGE_SHARES:
        patterns = grouped(counts, capacity, share, groups)
        total = sum(pattern.count for pattern in patterns)
        if fewest is None or total < fewest:
            best, fewest = patterns, total
        if fewest == least:
            break
    return best
