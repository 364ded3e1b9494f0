"""T25 of many pieces with their references at once: a sign of a piece is the set of its places in the reference, as bits."""

from __future__ import annotations

import numpy as np

#: Longest reference: difflib leaves out frequent signs of longer ones. Signs that are looked at together, and the longest piece.
MOST, ROWS, LONGEST = 199, 1 << 15, 1 << 18
_LOW = np.array([(1 << i) - 1 for i in range(65)], np.uint64)
_ONE, _TOP = np.uint64(1), np.uint64(63)
_places: np.ndarray | None = None


def _some(v: np.ndarray) -> np.ndarray:
    return (v[0] | v[1]) != 0 if len(v) == 2 else v.any(axis=0)


def _below(ends: np.ndarray, words: int) -> np.ndarray:
    """The bits below each end."""
    return _LOW[np.clip(ends[None, :] - 64 * np.arange(words)[:, None], 0, 64)]


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _longest(at: np.ndarray, v: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``n`` items its longest common run, the first of equal ones: length, index of the last sign, bit of the last place."""
    size, end, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((len(v), n), np.uint64)
    next_ = np.append(at[1:] == at[:-1] + 1, False)
    idx, cur, k = np.arange(len(at)), v, 1
    while len(idx):
        f = _firsts(item[idx])
        own = item[idx[f]]
        size[own], end[own], last[:, own] = k, idx[f], cur[:, f]
        go = np.flatnonzero(next_[idx])
        idx, c = idx[go] + 1, cur[:, go]
        moved = c << _ONE
        moved[1:] |= c[:-1] >> _TOP
        moved &= v[:, idx]
        go = np.flatnonzero(_some(moved))
        idx, cur, k = idx[go], moved[:, go], k + 1
    word = (last != 0).argmax(axis=0)
    x = last[word, np.arange(n)]
    return size, end, word * 64 + np.frexp((x & (~x + _ONE)).astype(float))[1] - 1


def _raise(best: np.ndarray, v: np.ndarray, piece: np.ndarray, length: np.ndarray, doc: np.ndarray, refs: np.ndarray) -> None:
    """Raises ``best`` of each document to its greatest ratio; a piece whose open parts can't lift it above that is left."""
    total, matched = length + refs[doc], np.zeros(len(length), np.int64)

    def alive(open_: np.ndarray) -> np.ndarray:
        return 2.0 * (matched + open_) / total > best[doc]

    at = np.flatnonzero(_some(v))
    at = at[alive(np.minimum(np.bincount(piece[at], minlength=len(length)), refs[doc]))[piece[at]]]
    v, owner = v[:, at], piece[at]
    f = _firsts(owner) if len(at) else at
    item, owner = np.cumsum(np.bincount(f, minlength=len(at))) - 1, owner[f]
    low, high = np.zeros(len(owner), np.int64), refs[doc[owner]]
    while len(at):
        size, end, bit = _longest(at, v, item, len(owner))
        matched += np.bincount(owner, size, len(length)).astype(np.int64)
        np.maximum.at(best, doc[owner], 2.0 * matched[owner] / total[owner])
        stop = at[end]
        right, left = at > stop[item], at <= (stop - size)[item]
        v = v & np.where(right[None, :], ~_below(bit + 1, len(v))[:, item], _below(bit + 1 - size, len(v))[:, item])
        go = np.flatnonzero((right | left) & _some(v))
        if not len(go):
            return
        at, v, key = at[go], v[:, go], 2 * item[go] + right[go]
        f = _firsts(key)
        parent, side = key[f] // 2, key[f] % 2 == 1
        count = np.diff(np.append(f, len(key)))
        low, high = np.where(side, (bit + 1)[parent], low[parent]), np.where(side, high[parent], (bit + 1 - size)[parent])
        owner = owner[parent]
        keep = alive(np.bincount(owner, np.minimum(count, high - low), len(length)))[owner]
        rows = np.repeat(keep, count)
        at, v = at[rows], v[:, rows]
        item, owner, low, high = np.repeat(np.arange(keep.sum()), count[keep]), owner[keep], low[keep], high[keep]


def best_ratios(pieces: list, references: list[str], floors: list[float]) -> np.ndarray:
    """For each reference of 1 to ``MOST`` signs the greatest T25 of its pieces, none longer than ``LONGEST``; its floor, if none is greater."""
    global _places
    if _places is None:
        _places = np.zeros((4, 0x110000), np.uint64)  # only what is written takes memory
    best, refs = np.array(floors, float), np.array([len(r) for r in references], np.int64)
    words = 2 if len(refs) == 0 or refs.max() <= 128 else 4
    signs, lengths, docs, n = [], [], [], 0

    def look() -> None:
        nonlocal signs, lengths, docs, n
        if signs:
            length = np.array(lengths, np.int64)
            _raise(best, np.concatenate(signs, axis=1), np.repeat(np.arange(len(length)), length + 1), length, np.array(docs, np.int64), refs)
        signs, lengths, docs, n = [], [], [], 0

    def add(i: int, part: list[str]) -> None:
        nonlocal n
        codes = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        v = _places[:words, codes]
        v[:, np.cumsum([len(p) + 1 for p in part]) - 1] = 0  # nothing runs on from piece to piece
        signs.append(v)
        lengths.extend(len(p) for p in part)
        docs.extend([i] * len(part))
        n += len(codes)

    for i, (own, r) in enumerate(zip(pieces, references, strict=True)):
        b = np.frombuffer(r.encode("utf-32-le", "surrogatepass"), np.uint32)
        for j, x in enumerate(b):
            _places[j // 64, x] |= _ONE << np.uint64(j % 64)
        part, size = [], 0
        for p in own:
            if 2.0 * min(len(p), len(r)) / (len(p) + len(r)) > best[i]:
                part.append(p)
                size += len(p) + 1
                if n + size >= ROWS:
                    add(i, part)
                    look()
                    part, size = [], 0
        if part:
            add(i, part)
        _places[:, b] = 0
    look()
    return best
