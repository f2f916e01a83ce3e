"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word holds a selector in its upper 4 bits and 60 bits of values. The selector says how many values of how many
bits the word has; selector 15 says that the next word is one value of up to 64 bits as it is (the escape)."""

from __future__ import annotations

import numpy as np

# Fixed values: (values in a word, bits of each), by selector. Selectors 0 and 1 are runs of zeros.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE_AT = 60  # values of more bits are escaped
# The escape takes selector 1's place, and selector 1's run of 120 zeros is given up for it.
ESCAPE = 1


_SMALL = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    top = int(values.max())
    if top < 1 << 16:
        return _SMALL[values.astype(np.uint16)]
    out = np.zeros(len(values), np.uint8)
    for shift in range(0, top.bit_length(), 16):
        part = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        out = np.where(part > 0, _SMALL[part] + np.uint8(shift), out)
    return out


def encode(values: np.ndarray) -> bytes:
    """The words of the values, little-endian. Each word takes as many values as fit, from left to right."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return b""
    bits = _bits(values)
    take = np.zeros(n, np.uint8)  # the selector of a word that begins here
    wide = int(bits.max())
    todo = np.ones(n, bool)
    narrowest = int(bits.min())
    for selector, (count, width) in enumerate(SELECTORS):
        if selector == ESCAPE or width < narrowest or count > n:
            continue
        if width < wide and int((bits <= width).sum()) < count:
            continue
        m, reach = bits, 1
        while reach * 2 <= count:
            m = np.maximum(m[:-reach], m[reach:])
            reach *= 2
        if reach < count:
            m = np.maximum(m[: len(m) - (count - reach)], m[count - reach :])
        fits = np.zeros(n, bool)
        fits[: len(m)] = m <= width
        new = todo & fits
        take[new] = selector
        todo &= ~new
        if width >= wide and count == 1:
            break
    take[todo] = ESCAPE
    counts = np.array([c for c, _ in SELECTORS])
    counts[ESCAPE] = 1
    step, starts, at = counts[take].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = take[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(chosen == ESCAPE)[:-1]))  # an escape takes two words
    out = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), "<u8")
    for selector in np.unique(chosen):
        own = chosen == selector
        first, where = starts[own], place[own]
        if selector == ESCAPE:
            out[where] = np.uint64(ESCAPE) << np.uint64(60)
            out[where + 1] = values[first]
            continue
        count, width = SELECTORS[selector]
        word = np.full(len(first), np.uint64(selector) << np.uint64(60))
        if width:
            for j in range(count):
                word |= values[first + j] << np.uint64(j * width)
        out[where] = word
    return out.tobytes()


def decode(raw: bytes, n: int) -> np.ndarray:
    """The n values of encode(values)."""
    words = np.frombuffer(raw, "<u8")
    if not len(words):
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # What follows an escape is a value, whatever its upper bits are.
    if (selectors == ESCAPE).any():
        head, at, marks = np.ones(len(words), bool), 0, np.flatnonzero(selectors == ESCAPE).tolist()
        for i in marks:
            if i >= at:
                head[i + 1], at = False, i + 2
    else:
        head = np.ones(len(words), bool)
    places = np.flatnonzero(head)
    selectors = selectors[places]
    counts = np.array([c for c, _ in SELECTORS])
    counts[ESCAPE] = 1
    begin = np.concatenate(([0], np.cumsum(counts[selectors])))
    out = np.zeros(int(begin[-1]), np.uint64)
    for selector in np.unique(selectors):
        own = selectors == selector
        where, first = places[own], begin[:-1][own]
        if selector == ESCAPE:
            out[first] = words[where + 1]
            continue
        count, width = SELECTORS[selector]
        if width:
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[first + j] = (words[where] >> np.uint64(j * width)) & mask
    return out[:n]
