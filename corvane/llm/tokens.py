"""Token ids of whole texts, as the tokenizers library gives them, with a memory of the pieces met before.

The pre-tokenizers of these vocabularies cut a text into pieces whose ids don't depend on each other. Texts of Latin-1
characters are cut here for many texts at once with numpy, by the classes of characters; a piece is encoded by the library's
model when it is first met and known by a 64-bit hash afterwards (of a million remembered pieces two meet with a chance of 3e-8, and the later
one would get the ids of the first). Other texts, and those that hold the string of an added
token such as <|endoftext|>, go to the library whole."""

from __future__ import annotations

import array

import numpy as np

from .common import prefix_hash, spans

SPACE, LETTER, NUMBER, OTHER = range(4)
# Unicode's white space, letters and numbers within Latin-1.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
CLASS[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
#: Letters that an apostrophe takes along: one of the first, or two that begin so.
SHORT, LONG = np.zeros(256, bool), np.zeros((256, 256), bool)
SHORT[list(b"stmd")] = True
for _x in (b"re", b"ve", b"ll"):
    LONG[_x[0], _x[1]] = True



def _written() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of each Latin-1 character: printable bytes as themselves, others as characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


WRITTEN = _written()
#: Pieces that are remembered (some 200 bytes each), beyond which the memory starts anew; characters that are cut at once.
REMEMBERED, AT_ONCE = 400_000, 1 << 20


def pieces(data: np.ndarray, offs: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts of Latin-1 bytes.

    With spaces, a piece is a run of letters, of numbers or of others with the space before it, if there is one, or white
    space: all of a run but its last character, that character if it isn't a space, or all at the end of a text. Else
    pieces are runs of letters, single numbers and runs of others, without white space. Either way an apostrophe alone
    takes the letters of SHORT and LONG along."""
    kind = CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    new = first.copy()
    new[1:-1] |= kind[1:] != kind[:-1]
    inner = np.append(kind, OTHER)
    quote = np.flatnonzero((data[:-1] == 39) & new[:-2] & new[1:-1] & ~first[1:-1] & (kind[1:] == LETTER)) if len(data) > 1 else np.zeros(0, np.int64)
    if spaces:
        # Where a white-space run ends before another run of its text.
        end = np.flatnonzero(new[1:-1] & ~first[1:-1] & (kind[:-1] == SPACE)) + 1
        new[end - 1] = True
        attached = end[data[end - 1] == 0x20]
        new[attached] = False
        quote = quote[new[quote]]
    else:
        new[:-1] |= kind == NUMBER
    if len(quote):
        padded = np.append(data, [0, 0])
        two = LONG[padded[quote + 1], padded[quote + 2]] & ~first[quote + 2]
        one = SHORT[padded[quote + 1]]
        taken = quote[one | two]
        after = taken + np.where(one[one | two], 2, 3)
        new[taken + 1] = False
        after = after[inner[after] == LETTER]
        new[after[after < len(data)]] = True
    start = np.flatnonzero(new[:-1])
    stop = np.append(start[1:], len(data))
    if not spaces:
        solid = kind[start] != SPACE
        start, stop = start[solid], stop[solid]
    return start, stop


class Encoder:
    """encode(texts): the ids of each text as the bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lowers = self.tokenizer.normalizer is not None
        #: The strings that the library makes one id of, wherever they stand in a text.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.begin, self.count = array.array("H"), array.array("I"), array.array("B")

    def _learn(self, hashes: list[int], strings: list[str]) -> None:
        known, tokenize = self.known, self.tokenizer.model.tokenize
        for h, x in zip(hashes, strings, strict=True):
            ids = [t.id for t in tokenize(x.translate(WRITTEN))]
            if len(ids) > 255:
                self.long[h] = ids
                ids = []
            known[h] = len(self.begin)
            self.begin.append(len(self.pool))
            self.count.append(len(ids))
            self.pool.extend(ids)

    def _some(self, texts: list[bytes]) -> list[bytes]:
        import pandas as pd

        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start, stop = pieces(data, offs, not self.lowers)
        if not len(start):
            return [b""] * len(texts)
        codes, unique = pd.factorize(spans(prefix_hash(data), start, stop))
        if len(self.known) + len(unique) > REMEMBERED:
            self._forget()
        self.long: dict[int, list[int]] = {}
        unique = unique.tolist()
        at = [self.known.get(h, -1) for h in unique]
        missing = [k for k, x in enumerate(at) if x < 0]
        if missing:
            example = np.empty(len(unique), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            own = example[missing]
            self._learn([unique[k] for k in missing], [joined[a:b].decode("latin-1") for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)])
            for k in missing:
                at[k] = self.known[unique[k]]
        slot = np.array(at)[codes]
        count = np.frombuffer(self.count, np.uint8)[slot].astype(np.int64)
        ends = np.cumsum(count)
        where = np.repeat(np.frombuffer(self.begin, np.uint32)[slot].astype(np.int64) - (ends - count), count) + np.arange(int(ends[-1]))
        raw = np.frombuffer(self.pool, np.uint16)[where].astype("<u4").tobytes() if len(where) else b""
        cuts = np.concatenate(([0], ends))[np.searchsorted(start, offs)].tolist()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.long:  # pieces of over 255 ids: their texts go to the library whole
            text_of = np.searchsorted(offs, start[np.isin(codes, [k for k, h in enumerate(unique) if h in self.long])], "right") - 1
            for i in np.unique(text_of).tolist():
                out[i] = self._whole([texts[i].decode("latin-1")])[0]
            for h in self.long:
                del self.known[h]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some, places, held = [], [], 0

        def done() -> None:
            nonlocal some, places, held
            for i, ids in zip(places, self._some(some), strict=True):
                out[i] = ids
            some, places, held = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.added):
                out[i] = self._whole([text])[0]
                continue
            try:
                some.append((text.lower() if self.lowers else text).encode("latin-1"))
            except UnicodeEncodeError:
                out[i] = self._whole([text])[0]
                continue
            places.append(i)
            held += len(text)
            if held >= AT_ONCE:
                done()
        if some:
            done()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python process and vocabulary; the library's threads stay off, as Spark runs a task on each core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
