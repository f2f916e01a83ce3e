"""Deep-shallow sorting of suffixes to a bounded depth.

To the shallow depth, multikey quicksort with characters of eight bytes: a group of suffixes that agree so far is split by
a pivot into those whose next character is less, equal and greater; equal ones go on to the character after it. All groups
take their step together, and small groups are sorted by the character at once. Groups that still agree at the shallow
depth are ordered by a blind trie, whose inner nodes hold only the depth at which their suffixes first differ."""

from __future__ import annotations

import numpy as np

CHARACTER, SMALL = 8, 1 << 14


def characters(data: bytes) -> np.ndarray:
    """The eight bytes from each place of data on, as one number, the first byte in its highest bits; a view."""
    return np.ndarray(len(data) - CHARACTER + 1, ">u8", data, 0, (1,))


class BlindTrie:
    """Strings of one length in order; equal strings share a leaf. Inner nodes are [depth, {byte: child}], leaves numbers of strings."""

    def __init__(self, first: bytes) -> None:
        self.strings: list[bytes] = [first]
        self.root: list | int = 0

    def insert(self, s: bytes) -> int:
        # Blindly down to some leaf, then its string tells where s differs, if it does.
        node = self.root
        while isinstance(node, list):
            child = node[1].get(s[node[0]])
            node = next(iter(node[1].values())) if child is None else child
        other = self.strings[node]
        bits = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        if not bits:
            return node
        leaf = len(self.strings)
        self.strings.append(s)
        depth = len(s) - (bits.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = leaf
            return leaf
        new = [depth, {other[depth]: node, s[depth]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new
        return leaf

    def ordered(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def _shallow(data: np.ndarray, starts: np.ndarray, head: np.ndarray, depth: int, small: int) -> np.ndarray:
    """Multikey quicksort: the order, with head marking where its groups begin (changed in place)."""
    order, level = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    while True:
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(starts)))
        todo = (size > 1) & (level[begin] < depth)
        if not todo.any():
            return order
        number = np.repeat(np.arange(len(begin)), size)
        at = np.flatnonzero(todo[number])
        own = number[at]
        key = data[starts[order[at]] + level[at]].astype(np.uint64)
        # Groups of one character throughout are in order.
        unlike = np.zeros(len(begin), bool)
        unlike[own[1:][(own[1:] == own[:-1]) & (key[1:] != key[:-1])]] = True
        level[at] += CHARACTER
        if not unlike.any():
            continue
        todo &= unlike
        still = unlike[own]
        at, own, key = at[still], own[still], key[still]
        split = (todo & (size > small))[own]
        if split.any():
            big = np.flatnonzero(todo & (size > small))
            first = np.searchsorted(at, begin[big])
            a, b, c = key[first], key[first + size[big] // 2], key[first + size[big] - 1]
            pivot = np.zeros(len(begin), np.uint64)
            pivot[big] = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
            some = pivot[own[split]]
            key[split] = (key[split] >= some).astype(np.uint64) + (key[split] > some)
        by = np.lexsort((key, own))
        order[at], key = order[at][by], key[by]
        # Of a group that was split, only the suffixes that have the pivot go on by a character.
        level[at[split & (key != 1)]] -= CHARACTER
        head[at[1:]] |= (own[1:] == own[:-1]) & (key[1:] != key[:-1])


def sort(data: bytes, starts: np.ndarray, depth: int, shard: np.ndarray | None = None, shallow: int = 32, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(order, groups): the suffixes at starts, of each shard by itself, in order of their first depth bytes, and for each place in that order the number of its group of suffixes that agree in all of these.

    Suffixes have depth bytes at least; shard, if given, ascends."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shallow = min(shallow, depth // CHARACTER * CHARACTER)
    eight = characters(data + bytes(CHARACTER))
    head = np.ones(len(starts), bool)
    head[1:] = False if shard is None else shard[1:] != shard[:-1]
    order = _shallow(eight, starts, head, shallow, small)
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(starts)))
    if depth > shallow and (size > 1).any():
        # The first suffix of a group is its trie's first leaf. Those that end on it are found for all groups together.
        tied = np.flatnonzero(np.repeat(size > 1, size))
        first = np.repeat(begin, size)[tied]
        same = np.ones(len(tied), bool)
        for k in (*range(shallow, depth - CHARACTER + 1, CHARACTER), depth - CHARACTER):
            same &= eight[starts[order[tied]] + k] == eight[starts[order[first]] + k]
        for lo in np.unique(first[~same]).tolist():
            hi = lo + int(size[np.searchsorted(begin, lo)])
            own = starts[order[lo:hi]].tolist()
            trie = BlindTrie(data[own[0] + shallow : own[0] + depth])
            leaves = np.array([trie.insert(data[s + shallow : s + depth]) for s in own])
            rank = np.empty(len(trie.strings), np.int64)
            rank[trie.ordered()] = np.arange(len(rank))
            by = np.argsort(rank[leaves], kind="stable")
            order[lo:hi] = order[lo:hi][by]
            leaves = leaves[by]
            head[lo + 1 : hi] = leaves[1:] != leaves[:-1]
    return order, np.cumsum(head) - 1
