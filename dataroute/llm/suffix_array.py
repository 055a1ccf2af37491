"""Suffix arrays by linear grouping, after Baier's two-phase construction.

Phase one sorts suffixes into groups by their Lyndon prefix, the longest Lyndon word that
each begins with. Groups are processed from the greatest down. A suffix of the group at
hand extends the prefix of the nearest suffix before it in a smaller group, its previous
smaller one; so these move into a group of their own right above their old one, higher
the more suffixes of the group extend them. Phase two walks the array as it comes out:
behind every suffix put in place the one before it in the text, and the chain of that
one's previous smaller ones, take the next places of their groups. No ranks are renamed
and nothing is sorted but the first symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of ``symbols`` in rising order.

    The last symbol must be smaller than all others.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]).tolist()
    members = [part.tolist() for part in np.split(order, begins[1:])]
    which = np.empty(n, np.int64)
    which[order] = np.repeat(np.arange(len(members)), np.diff([*begins, n]))
    group, previous = which.tolist(), [-1] * n
    # Groups form a list by rank; ids are given as groups arise.
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    size = [len(x) for x in members]
    done = bytearray(n + 1)  # the entry for place -1 stays 0
    final = []

    def move(found: list[int], old: int) -> None:
        """Put suffixes of the group ``old`` into a new one right above it."""
        if size[old] == len(found):
            return
        new = len(members)
        members.append(found)
        size.append(len(found))
        size[old] -= len(found)
        above = upper[old]
        lower.append(old)
        upper.append(above)
        lower[above] = new
        upper[old] = new
        for place in found:
            group[place] = new

    now = len(members) - 1
    while now >= 0:
        own = members[now]
        if len(own) != size[now]:
            own = [place for place in own if group[place] == now]
        if len(own) == 1:
            place = own[0]
            final.append(own)
            done[place] = 1
            before = place - 1
            while done[before]:
                before = previous[before]
            previous[place] = before
            if before >= 0:
                old = group[before]
                if size[old] > 1:
                    move([before], old)
        elif own:
            final.append(own)
            for place in own:
                done[place] = 1
            extended: list[int] = []
            times: list[int] = []
            last = -1
            for place in own:
                before = place - 1
                while done[before]:
                    before = previous[before]
                previous[place] = before
                if before >= 0:
                    if before == last:
                        times[-1] += 1
                    else:
                        extended.append(before)
                        times.append(1)
                        last = before
            if extended:
                for level in range(max(times), 0, -1):
                    split: dict[int, list[int]] = {}
                    for place, count in zip(extended, times):
                        if count == level:
                            split.setdefault(group[place], []).append(place)
                    for old, found in split.items():
                        move(found, old)
        now = lower[now]

    final.reverse()
    start = 0
    slot = [0] * len(members)
    for own in final:
        slot[group[own[0]]] = start
        start += len(own)
    array = [0] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # place -1 ends a chain
    array[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        place = array[k] - 1
        while not placed[place]:
            placed[place] = 1
            own = group[place]
            at = slot[own]
            array[at] = place
            slot[own] = at + 1
            place = previous[place]
    return np.array(array, np.int64)
