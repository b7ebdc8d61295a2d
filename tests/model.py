"""A sequential flood for tests: cells in ascending order, components merged as they meet."""

import math

from corrie.functions.index import offsets
from corrie.meta import GridMeta


def neighbours(meta, lin, name):
    index = meta.index(lin)
    for pos, code, step in offsets(meta, name):
        to = [i + d for i, d in zip(index, step)]
        if all(0 <= i < n for i, n in zip(to, meta.shape)):
            yield pos, code, meta.linear(to)


def order_key(e, lin):
    return (e, 0 if e == 0 and math.copysign(1, e) < 0 else 1, lin)


class Flood:
    def __init__(self, values, name):
        self.meta = GridMeta(tuple("abcdefg"[: values.ndim]), values.shape)
        flat = values.ravel()
        self.label, self.parent, self.basins, self.merges = [-1] * flat.size, [65535] * flat.size, [], []
        group, members = {}, {}
        for lin in sorted((i for i in range(flat.size) if not math.isnan(flat[i])), key=lambda i: order_key(float(flat[i]), i)):
            own = None
            for _, code, n in neighbours(self.meta, lin, name):
                if n not in group:
                    continue
                if own is None:
                    own = group[n]
                    self.label[lin], self.parent[lin] = own, code
                elif group[n] != own:
                    low, high = min(own, group[n]), max(own, group[n])
                    self.merges.append((lin, n, float(flat[lin]), low, high, own))
                    for c in members[high]:
                        group[c] = low
                    members[low] += members.pop(high)
                    own = low
            if own is None:
                own = len(self.basins)
                self.basins.append((lin, float(flat[lin])))
                self.label[lin] = own
                members[own] = []
            group[lin] = own
            members[own].append(lin)


def minimax(values, name, a, b):
    """Energy of the lowest pass between two cells, by growing the set of allowed cells."""
    meta, flat = GridMeta(tuple("abcdefg"[: values.ndim]), values.shape), values.ravel()
    for level in sorted({float(x) for x in flat if not math.isnan(x)}):
        if max(flat[a], flat[b]) > level:
            continue
        seen, todo = {a}, [a]
        while todo:
            for _, _, n in neighbours(meta, todo.pop(), name):
                if n not in seen and flat[n] <= level:
                    seen.add(n)
                    todo.append(n)
        if b in seen:
            return level
    return None
