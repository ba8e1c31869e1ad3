"""A grouping genetic algorithm for packing many items of few sizes.

A chromosome is a multiset of bins: ``{sizes of one bin: how many such bins}``. Items of
one size are alike, so its length depends on the number of sizes, never on that of items.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter

Bins = dict[tuple[int, ...], int]


def best_fit(bins: Bins, counts: dict[int, int], capacity: int, order: list[int] | None = None) -> Bins:
    """``bins`` with the items of ``counts`` added, each to the fullest bin that holds it, largest sizes first."""
    spare: dict[int, Counter] = {}
    levels: list[int] = []

    def put(sizes: tuple[int, ...], n: int) -> None:
        left = capacity - sum(sizes)
        if left not in spare:
            spare[left] = Counter()
            insort(levels, left)
        spare[left][sizes] += n

    for sizes, n in bins.items():
        put(sizes, n)
    for s in order or sorted(counts, reverse=True):
        c = counts.get(s, 0)
        while c:
            i = bisect_left(levels, s)
            if i == len(levels):
                sizes, have, room = (), c, capacity
            else:
                room = levels[i]
                sizes, have = next(iter(spare[room].items()))
            each = room // s
            n = min(have, c // each)
            n, each = (n, each) if n else (1, c)
            c -= n * each
            if sizes:
                if have == n:
                    del spare[room][sizes]
                    if not spare[room]:
                        del spare[room]
                        levels.pop(i)
                else:
                    spare[room][sizes] = have - n
            put(tuple(sorted(sizes + (s,) * each, reverse=True)), n)
    out: Counter = Counter()
    for found in spare.values():
        out.update(found)
    return dict(out)


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Smaller is better: bins, then bins of mixed fill before evenly filled ones."""
    return sum(bins.values()), -sum(n * (sum(sizes) / capacity) ** 2 for sizes, n in bins.items())


def _keep(wanted: list[tuple[tuple[int, ...], int]], left: dict[int, int]) -> Bins:
    """As many of the ``wanted`` bins, in order, as the items ``left`` allow; takes those items out."""
    out: Bins = {}
    for sizes, n in wanted:
        need = Counter(sizes)
        n = min([n, *(left.get(s, 0) // k for s, k in need.items())])
        if n > 0:
            out[sizes] = out.get(sizes, 0) + n
            for s, k in need.items():
                left[s] -= n * k
    return out


def crossover(one: Bins, two: Bins, counts: dict[int, int], capacity: int, dice: random.Random) -> Bins:
    """Whole well-filled bins of ``two`` go into ``one``; bins of ``one`` that would hold an item twice go out, and
    their other items are put back by best fit."""
    full = sorted(two.items(), key=lambda x: (-sum(x[0]), dice.random()))
    injected, share = [], dice.uniform(0.2, 0.8)
    for sizes, n in full:
        if sum(sizes) >= capacity - 2 and dice.random() < share:
            injected.append((sizes, n if n == 1 else dice.randint(1, n)))
    left = dict(counts)
    child = _keep(injected, left)
    for sizes, n in _keep(sorted(one.items(), key=lambda x: -sum(x[0])), left).items():
        child[sizes] = child.get(sizes, 0) + n
    return best_fit(child, {s: n for s, n in left.items() if n}, capacity)


def mutate(bins: Bins, capacity: int, dice: random.Random) -> Bins:
    """The worst-filled bins and a few others are emptied, and their items put back by best fit."""
    kept: Bins = {}
    loose: Counter = Counter()
    for sizes, n in bins.items():
        out = n if sum(sizes) < 0.97 * capacity else (min(n, 1) if dice.random() < 0.02 else 0)
        if n > out:
            kept[sizes] = n - out
        for s in sizes if out else ():
            loose[s] += out
    order = sorted(loose, key=lambda s: -s * dice.uniform(0.9, 1.1))
    return best_fit(kept, loose, capacity, order)


def first_generation(counts: dict[int, int], capacity: int, members: int, seed: int) -> list[Bins]:
    """The first by plain best fit decreasing, the others with sizes in a slightly other order."""
    dice = random.Random(seed)
    out = [best_fit({}, counts, capacity)]
    while len(out) < members:
        out.append(best_fit({}, counts, capacity, sorted(counts, key=lambda s: -s * dice.uniform(0.85, 1.15))))
    return out


def evolve(population: list[Bins], counts: dict[int, int], capacity: int, generations: int, seed: int) -> list[Bins]:
    """A population of the same size after ``generations``; stops early at the least number of bins possible."""
    dice, size = random.Random(seed), len(population)
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda b: fitness(b, capacity))
        if fitness(population[0], capacity)[0] <= least:
            break
        parents = population[: max(2, size // 2)]
        children = [crossover(*dice.sample(parents, 2), counts, capacity, dice) for _ in range(size)] if len(parents) > 1 else []
        population += [mutate(child, capacity, dice) if dice.random() < 0.3 else child for child in children]
        population = sorted(population, key=lambda b: fitness(b, capacity))[:size]
    return sorted(population, key=lambda b: fitness(b, capacity))
