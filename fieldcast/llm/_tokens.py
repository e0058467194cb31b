"""Token ids of many texts, with each distinct piece encoded once."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from fieldcast.llm._bytes import BASE, U64, byte_values, mix, powers, text_bytes

#: distinct pieces a worker remembers, about 60 bytes each
REMEMBERED = 1_500_000
#: words encoded in one call
JOINED = 256
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UNSURE = _BLANK.copy()  # or taken for a blank by some
_UNSURE[0x1C:0x20] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_SECOND = np.zeros(256, bool)  # behind 0xC3: a letter's second byte
_SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


def load(path: str):
    """The tokenizer of a file, by its path or its name among the public ones."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))


def _rows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches in a row, and the start of each (one more at the end)."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(at[-1]) + np.repeat(starts - at[:-1], n)], at


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each stretch."""
    back = powers(len(raw) + 1, pow(BASE, -1, 1 << 64))[starts]
    out = []
    for seed in (21, 22):
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(byte_values(seed)[raw] * powers(len(raw)), out=total[1:])
        out.append(mix((total[ends] - total[starts]) * back))
    return out


def _inner_cuts(raw: np.ndarray) -> np.ndarray:
    """Before which bytes a word may be cut once more: between a letter (ASCII or
    Latin-1) and an ASCII mark, and at a single line end beside either. What is
    encoded together never crosses these; only an apostrophe may take the letters
    behind it."""
    letter, mark, line = _LETTER[raw], _MARK[raw], raw == 0x0A
    two = np.zeros(len(raw), bool)
    two[:-1] = (raw[:-1] == 0xC3) & _SECOND[raw[1:]]
    begins, ends = letter | two, letter.copy()
    ends[1:] |= two[:-1]
    out = np.zeros(len(raw), bool)
    out[1:] = ((ends[:-1] & mark[1:]) | (mark[:-1] & (raw[:-1] != 0x27) & begins[1:])
               | ((ends | mark)[:-1] & line[1:]) | (line[:-1] & (begins | mark)[1:]))
    return out


def _odd(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where blanks stand side by side or at a text's border, are not ASCII, or
    a special token may begin."""
    n = len(raw)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = _BLANK[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    odd = blank[1:-1] & (blank[:-2] | blank[2:] | cut[:-1] | cut[1:])
    after = np.append(raw[1:], np.uint8(0))
    odd |= (raw == 0x3C) & (after == 0x7C)
    lead = np.flatnonzero(_WIDE[raw])
    b = np.append(raw, np.zeros(2, np.uint8))
    x, y, z = b[lead], b[lead + 1], b[lead + 2]
    space = (((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A))
             | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
             | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80)))
    return np.concatenate([np.flatnonzero(odd), lead[space]])


class Encoder:
    """Ids of texts, as the tokenizer alone gives them.

    The tokenizers in use cut a text before a blank that stands between two
    other characters, and encode what lies between two cuts by itself. So a text
    is split there, each distinct piece is encoded once, and the pieces' ids are
    put in a row. A new piece is cut once more at its marks and line ends, since
    its words alone are mostly known or will be met again. A text in which blanks
    stand otherwise, or with marks of special tokens, is one piece. Pieces are told
    apart by 128 bits.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.separator: tuple[str, int] | None = None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, U64), np.empty(0, U64)
        self.slot = np.empty(0, np.int64)
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def _separator(self) -> tuple[str, int]:
        """A text of one id that no word before or after it changes, and that id."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        samples = ["a", " b", " 1", ".", " (", "'s", " \u00e9", "\u65e5"]
        for sep in ("\n", " \x01 "):
            own = ids(sep)
            if len(own) == 1 and ids(sep.join(samples)) == [
                    i for k, t in enumerate(samples) for i in [*(own if k else []), *ids(t)]]:
                return sep, own[0]
        return "", -1

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many each has.

        Single words are joined by a separator, many to a text: a call costs more
        than a word's merges. Where a word has the separator's id itself, the whole
        text is done word by word, as are pieces of several words.
        """
        if self.separator is None:
            self.separator = self._separator()
        sep, mark = self.separator
        blanks = np.concatenate([[0], np.cumsum(_UNSURE[raw])])
        size = ends - starts
        lead = raw[starts] == 0x20
        single = (plain & bool(sep) & (size < 256) & (size > lead)
                  & (blanks[ends] - blanks[starts] == lead))
        a, b = starts[single], ends[single]
        gap = np.frombuffer(sep.encode(), np.uint8)
        step = b - a + len(gap)
        at = np.concatenate([[0], np.cumsum(step)])
        joined = np.empty(at[-1], np.uint8)
        data, inner = _rows(raw, a, b)
        joined[np.arange(len(data)) + np.repeat(at[:-1] - inner[:-1], b - a)] = data
        joined[(at[1:] - len(gap))[:, None] + np.arange(len(gap))] = gap
        text = joined.tobytes()
        cuts = [*range(0, len(a), JOINED), len(a)]
        groups = [text[at[i]:at[j] - len(gap)].decode() for i, j in zip(cuts[:-1], cuts[1:])]
        found, sizes = [], []
        for i, j, e in zip(cuts[:-1], cuts[1:], self.tokenizer.encode_batch_fast(
                groups, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == mark)
            if len(cut) == j - i - 1:
                n = np.diff(cut, prepend=-1, append=len(ids)) - 1
                ids = ids[ids != mark]
            else:
                ids, n = self._each([text[at[k]:at[k + 1] - len(gap)].decode() for k in range(i, j)])
            found.append(ids)
            sizes.append(n)
        if not single.all():
            text = raw.tobytes()
            ids, n = self._each([text[x:y].decode() for x, y in zip(
                starts[~single].tolist(), ends[~single].tolist())])
            found.append(ids)
            sizes.append(n)
        ids, n = np.concatenate(found), np.concatenate(sizes)
        # back into the order of the pieces
        order = np.argsort(np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)]))
        upto = np.cumsum(n)
        return _rows(ids, (upto - n)[order], upto[order])[0], n[order]

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.checks = np.insert(self.checks, where, checks[order])
        self.slot = np.insert(self.slot, where, len(self.at) - 1 + order)
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or belongs, and whether it is there."""
        where = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        there[inside] = self.keys[where[inside]] == keys[inside]
        return where, there

    def _learn(self, keys: np.ndarray, checks: np.ndarray, raw: np.ndarray, at: np.ndarray,
               plain: np.ndarray) -> bool:
        """Adds new pieces; False, and nothing is added, if two of their parts have one hash."""
        cut = _inner_cuts(raw) & np.repeat(plain, np.diff(at))
        cut[at[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        own, other = _hashes(raw, starts, ends)
        parts, first, which = np.unique(own, return_index=True, return_inverse=True)
        where, there = self._known(parts)
        if not (np.array_equal(other[first][which], other)
                and np.array_equal(self.checks[where[there]], other[first][there])):
            return False
        new = first[~there]
        rows = np.searchsorted(starts, at)
        if len(new):
            piece = np.searchsorted(at, starts[new], "right") - 1
            self._add(own[new], other[new], *self._encode(raw, starts[new], ends[new], plain[piece]))
        many = np.diff(rows) > 1
        if many.any():
            flat, upto = self._ids(np.searchsorted(self.keys, parts)[which])
            ids, of = _rows(flat, upto[rows[:-1][many]], upto[rows[1:][many]])
            self._add(keys[many], checks[many], ids, np.diff(of))
        return True

    def _ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces in a row, and the start of each piece's."""
        slot = self.slot[found]
        return _rows(self.ids, self.at[slot], self.at[slot + 1])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the start of each text's (one more at
        the end). A null or empty text has none."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        raw, at = text_bytes(col)
        whole = np.zeros(len(col), bool)
        whole[np.searchsorted(at, _odd(raw, at), "right") - 1] = True
        gaps = np.flatnonzero((raw == 0x20) & ~np.repeat(whole, np.diff(at)))
        starts = np.sort(np.concatenate([at[:-1][np.diff(at) > 0], gaps]), kind="stable")
        ends = np.append(starts[1:], len(raw))
        hashes = _hashes(raw, starts, ends)
        keys, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
        checks = hashes[1][first]
        new = ~self._known(keys)[1]
        learnt = True
        if new.any():
            at_new = starts[first[new]]
            plain = ~whole[np.searchsorted(at, at_new, "right") - 1]
            learnt = self._learn(keys[new], checks[new], *_rows(raw, at_new, ends[first[new]]), plain)
        found = np.searchsorted(self.keys, keys)
        if not (learnt and np.array_equal(self.checks[found], checks)
                and np.array_equal(checks[which], hashes[1])):  # two pieces of one hash
            ids, n = self._each([t or "" for t in col.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(n)])
        flat, upto = self._ids(found[which])
        return flat, upto[np.searchsorted(starts, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
