"""Brute-force versions that the tests hold the operators against."""

from __future__ import annotations

import regex


def shingles(text: str, n: int = 3) -> set:
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard_pairs(texts: dict[int, str], threshold: float, n: int = 3) -> dict[tuple[int, int], float]:
    """All pairs of at least ``threshold``, by comparing every text with every other that shares a shingle."""
    sets = {i: shingles(t, n) for i, t in texts.items() if t}
    posted: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        for s in sets[i]:
            posted.setdefault(s, []).append(i)
    common: dict[tuple[int, int], int] = {}
    for ids in posted.values():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                common[ids[x], ids[y]] = common.get((ids[x], ids[y]), 0) + 1
    found = {}
    for (a, b), both in common.items():
        j = both / (len(sets[a]) + len(sets[b]) - both)
        if j >= threshold:
            found[a, b] = j
    return found


def groups(pairs, ids) -> dict[int, int]:
    """Smallest id of each id's connected component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}
