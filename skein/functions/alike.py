"""Weighted ratios of many pairs of names on arrays: which can reach one by their characters and subsequences, and the ratios.

With lengths of a ratio under 1.5 the weighted ratio is that of the names, 95 % of that of their sorted tokens, or 95 % of
that of their sets of tokens. A ratio r over lengths la and lb allows (1 - r)(la + lb) insertions and deletions, and each
changes the count of one character by one. With other lengths it is a share of the best ratio of the shorter name with a
part of the longer one, or of 100 if they have a token in common. A ratio r of s characters with a part has r / (2 - r) of
them in common, so that only so many can be missing in the longer name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

import pyarrow as pa

from skein.functions.fuzzy import weighted_ratio

#: Classes of characters whose counts are compared; a signature has two bits for each: one or more, and two or more.
CLASSES = 32
#: Pairs looked at together, and names on either side of a tile.
PAIRS, TILE = 1 << 18, (32, 4096)
#: What the ratio of sorted tokens and of sets of tokens counts, and that of a part of a name up to 8 times as long, and longer.
TURNED, PART, SHORT_PART, LONGEST = 0.95, 0.9, 0.6, 8
TINY = 1e-9
BITS = 64
#: Places of characters of names that are held at once.
TABLE = 1 << 23
#: Tokens of a name that are held as numbers; names with more are compared by their sets.
TOKENS = 16


class Names:
    """Names with what bounds their ratios."""

    def __init__(self, names: list[str]):
        self.names = names
        n = len(names)
        split = [x.split() for x in names]
        self.tokens = [list(dict.fromkeys(t)) for t in split]
        self.length = np.array([len(x) for x in names], np.int64)
        # Blanks of another kind, or more of them, than sorted tokens have; those, or tokens that repeat.
        self.odd = np.array([" ".join(t) != x for x, t in zip(names, split)], bool)
        self.again = self.odd | np.array([len(s) < len(t) for s, t in zip(self.tokens, split)], bool)
        self.plain, self.sorted = _codes([x[:BITS] for x in names]), _codes([" ".join(sorted(t))[:BITS] for t in split])
        # All distinct tokens as numbers: in the order of names, and of the numbers.
        self.first = np.r_[0, np.cumsum([len(t) for t in self.tokens], dtype=np.int64)]
        self.flat = np.fromiter((hash(x) or 1 for t in self.tokens for x in t), np.int64, self.first[-1])
        owner = np.repeat(np.arange(n), np.diff(self.first))
        order = np.argsort(self.flat, kind="stable")
        self.keys, self.having = self.flat[order], owner[order]
        # The first of them as a table with their lengths.
        place = np.arange(len(self.flat)) - self.first[owner]
        own, shape = place < TOKENS, (n, max(1, min(TOKENS, int(np.diff(self.first).max(initial=0)))))
        self.ids, self.sizes = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.ids[owner[own], place[own]] = self.flat[own]
        self.sizes[owner[own], place[own]] = np.fromiter((len(x) for t in self.tokens for x in t), np.int64, len(self.flat))[own]
        self.number = np.diff(self.first)
        self.counts, self.bits = _signatures(["".join(t) for t in split])
        self.set_bits = _signatures(["".join(t) for t in self.tokens])[1] if self.again.any() else self.bits


def _signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each class texts have, and two bits for each class."""
    counts = np.zeros((len(texts), CLASSES), np.int32)
    for start in range(0, max(map(len, texts), default=0), BITS):
        held = np.array([k for k, x in enumerate(texts) if len(x) > start])
        codes = _codes([texts[k][start : start + BITS] for k in held]).astype(np.int64)
        kinds = np.where((codes >= 48) & (codes < 58), codes - 22, codes - 97) % CLASSES
        for k in range(codes.shape[1]):
            seen = np.flatnonzero(codes[:, k])
            counts[held[seen], kinds[seen, k]] += 1
    shift = np.arange(CLASSES, dtype=np.uint64)
    return counts, ((counts > 0).astype(np.uint64) << shift).sum(1, dtype=np.uint64) | ((counts > 1).astype(np.uint64) << (shift + np.uint64(CLASSES))).sum(1, dtype=np.uint64)


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of each text as numbers, filled up with 0."""
    width = max(map(len, texts), default=0) or 1
    if any("\0" in x for x in texts):
        texts = [x.replace("\0", "\U0010ffff") for x in texts]
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def common_length(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``left[i]`` and ``right[j]``, rows of at most 64 characters filled up with 0 (Hyyrö, 2004)."""
    (own, row), (others, column) = (np.unique(x, return_inverse=True) for x in (i, j))
    letters = np.unique(np.r_[left[own].ravel(), right[others].ravel(), np.zeros(1, left.dtype)])
    if len(i) > 1024 and len(own) * len(letters) > TABLE:
        half = len(i) // 2
        return np.concatenate([common_length(left, right, i[:half], j[:half]), common_length(left, right, i[half:], j[half:])])
    a, b = np.searchsorted(letters, left[own]), np.ascontiguousarray(np.searchsorted(letters, right[others]).T)
    kind = np.uint32 if left.shape[1] <= 32 else np.uint64
    places, rows = np.zeros((len(own), len(letters)), kind), np.arange(len(own))
    for k in range(left.shape[1]):
        places[rows, a[:, k]] |= kind(1 << k)
    places[:, 0] = 0
    places, base = places.ravel(), row * len(letters)
    state = np.full(len(i), ~kind(0))
    for k in range(right.shape[1]):
        hit = state & places[base + b[k][column]]
        state = (state + hit) | (state - hit)
    return np.bitwise_count(~state).astype(np.int64)


def _ratio(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`indel_ratio` of ``left[i]`` and ``right[j]``, rows of at most 64 characters."""
    sizes = lambda x, k: np.count_nonzero(x, axis=1)[k] if len(k) > len(x) else np.count_nonzero(x[k], axis=1)
    both = sizes(left, i) + sizes(right, j)
    return np.where(both > 0, 200.0 * common_length(left, right, i, j) / np.maximum(both, 1), 100.0)


def _partial(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """:func:`partial_ratio` of rows of characters, at most 64 filled up with 0; ``short`` is not the longer one, and not empty."""
    n, (letters, coded) = len(short), np.unique(np.concatenate([short.ravel(), long.ravel(), np.zeros(1, short.dtype)]), return_inverse=True)
    if n > 1 and n * len(letters) > TABLE:
        return np.concatenate([_partial(short[: n // 2], long[: n // 2]), _partial(short[n // 2 :], long[n // 2 :])])
    a, b = coded[: short.size].reshape(short.shape), coded[short.size : -1].reshape(long.shape)
    size, whole, rows = np.count_nonzero(short, axis=1), np.count_nonzero(long, axis=1), np.arange(n)
    widest, best = int(size.max(initial=0)), np.zeros(n)

    def walk(a: np.ndarray, b: np.ndarray, starts: range) -> None:
        places = np.zeros((n, len(letters)), np.uint64)
        for k in range(widest):
            places[rows, a[:, k]] |= np.uint64(1 << k)
        places[:, 0] = 0
        for t in starts:
            state = np.full(n, ~np.uint64(0))
            for k in range(min(widest, b.shape[1] - t)):
                hit = state & places[rows, np.where(k < size, b[:, t + k], 0)]
                state = (state + hit) | (state - hit)
                if t == 0:  # the beginnings of the longer one
                    np.maximum(best, np.where(k + 1 < size, 200.0 * np.bitwise_count(~state) / (size + k + 1), 0.0), out=best)
            np.maximum(best, 200.0 * np.bitwise_count(~state) / (2 * size), out=best)

    walk(a, b, range(int((whole - size).max(initial=0)) + 1))
    turned = lambda x, l: np.where(np.arange(x.shape[1]) < l[:, None], np.take_along_axis(x, (l[:, None] - 1 - np.arange(x.shape[1])) % x.shape[1], 1), 0)
    walk(turned(a, size), turned(b, whole), range(1))
    return best


def _met(a: Names, b: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the first tokens of ``a[i]`` those of ``b[j]`` have too."""
    own, other = a.ids[i], b.ids[j]
    out = np.zeros(own.shape, bool)
    for y in range(other.shape[1]):
        out |= own == other[:, y, None]
    return out & (own != 0)


def promising(a: Names, b: Names, i: np.ndarray, j: np.ndarray, percent: float, shared: np.ndarray) -> np.ndarray:
    """Whether the names of ``a[i]`` and ``b[j]`` can have a weighted ratio of ``percent``; ``shared`` tells which pairs have a token in common."""
    la, lb = a.length[i], b.length[j]
    small, both, far = np.minimum(la, lb), la + lb, 2 * np.maximum(la, lb) >= 3 * np.minimum(la, lb)
    allowed, strict = 1 - percent / 100, 1 - percent / 100 / TURNED
    out = np.zeros(len(i), bool)
    part = np.where(np.maximum(la, lb) <= LONGEST * small, PART, SHORT_PART)
    out[far & shared & (100 * TURNED * part >= percent - TINY)] = True
    left = np.flatnonzero(far & ~out & (100 * part >= percent - TINY))
    if len(left):
        turned = np.where(la[left] <= lb[left], 1, -1)[:, None]
        more = turned * (a.counts[i[left]] - b.counts[j[left]])
        least = percent / 100 / part[left]
        odd = a.odd[i[left]] | b.odd[j[left]]  # sorted tokens can be shorter, and the other name's the shorter ones
        lack = np.where(odd, np.minimum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)), np.maximum(more, 0).sum(1))
        out[left[lack <= (1 - least / (2 - least)) * np.where(odd, both[left], small[left]) + TINY]] = True
    left = np.flatnonzero(~out & (~far | (percent <= 80)))
    apart = np.abs(a.counts[i[left]] - b.counts[j[left]]).sum(1)
    again = a.again[i[left]] | b.again[j[left]]
    good = (shared[left] | again) & (apart <= strict * both[left] + TINY)
    k = np.flatnonzero(again & ~good)
    good[k] = np.bitwise_count(a.set_bits[i[left[k]]] ^ b.set_bits[j[left[k]]]) <= strict * both[left[k]] + TINY
    k = np.flatnonzero(shared[left] & ~good)
    x, y = i[left[k]], j[left[k]]
    # Sets of tokens: all that is common against all of either name.
    met = _met(a, b, x, y)
    common, number = (a.sizes[x] * met).sum(1) + met.sum(1) - 1, met.sum(1)
    ends = np.minimum(a.sizes[x].sum(1) + a.number[x], b.sizes[y].sum(1) + b.number[y]) - 1
    many = (a.number[x] > TOKENS) | (b.number[y] > TOKENS)
    good[k] |= many | (number == a.number[x]) | (number == b.number[y]) | (200 * TURNED * common >= (percent - TINY) * (common + ends))
    out[left[good]] = True
    rest = ~good & (apart <= allowed * both[left] + TINY)
    left, apart = left[rest], apart[rest]
    # Names that are too long for a word of bits are left to the ratio.
    long = np.maximum(la, lb)[left] > BITS
    out[left[long]] = True
    left, apart = left[~long], apart[~long]
    hit = _ratio(a.plain[:, :BITS], b.plain[:, :BITS], i[left], j[left]) >= percent - TINY
    out[left[hit]] = True
    left = left[~hit & (apart <= strict * both[left] + TINY)]
    out[left] = TURNED * _ratio(a.sorted[:, :BITS], b.sorted[:, :BITS], i[left], j[left]) >= percent - TINY
    return out


def tiled(a: Names, b: Names | None, percent: float, edits: float = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, j of all pairs of a name of ``a`` and one of ``b``, or of ``a`` alone, that can have a weighted ratio of ``percent``.

    Both sides are in the order of length. Tokens in common are looked up, and signatures are compared for all pairs with
    lengths that allow the ratio; what that leaves is looked at in full. ``edits`` decides nothing any more.
    """
    same, b = b is None, b or a
    (rows, columns), allowed, strict = TILE, 1 - percent / 100, 1 - percent / 100 / TURNED
    widest = np.inf if 100 * SHORT_PART >= percent - TINY else LONGEST
    least = percent / 100 / PART
    lacking = 1 - least / (2 - least) if least <= 1 + TINY else -1
    low, high = (np.searchsorted(b.keys, a.flat, side) for side in ("left", "right"))
    any_again = a.again.any() or b.again.any()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def full() -> tuple[np.ndarray, np.ndarray]:
        i, j, shared = (np.concatenate([f[k] for f in found]) for k in range(3))
        found.clear()
        good = promising(a, b, i, j, percent, shared)
        return i[good], j[good]

    for p in range(0, len(a.names), rows):
        own, start = slice(p, p + rows), p if same else 0
        short, long = a.length[own][0], a.length[own][-1]
        at = slice(a.first[p], a.first[min(p + rows, len(a.names))])
        each = high[at] - low[at]
        row = np.repeat(np.arange(p, min(p + rows, len(a.names))), a.number[own]) - p
        shared = np.zeros((len(a.length[own]), len(b.names)), bool)
        if each.any():
            shared[np.repeat(row, each), b.having[np.repeat(low[at] - np.cumsum(each) + each, each) + np.arange(each.sum())]] = True
        shared[:, :start] = False
        close = shared.copy()

        def mark(shortest: float, longest: float, test, start=start, own=own, close=close) -> None:
            first, last = np.searchsorted(b.length, [shortest - TINY, longest + TINY])
            for q in range(max(start, first), last, columns):
                other = slice(q, min(q + columns, last))
                close[:, other] |= test(own, other)

        # A ratio needs lengths that are near enough.
        near = (1 + allowed) / max(1 - allowed, TINY)
        mark(short / near, long * near, lambda own, other, long=long: np.bitwise_count(a.bits[own, None] ^ b.bits[None, other]) <= int(allowed * (long + b.length[other][-1]) + TINY))
        if any_again:
            mark(short / 1.5, long * 1.5, lambda own, other, long=long: (a.again[own, None] | b.again[None, other]) & (np.bitwise_count(a.set_bits[own, None] ^ b.set_bits[None, other]) <= int(strict * (long + b.length[other][-1]) + TINY)))
        if lacking >= 0:
            if any_again:
                mark(short / widest, long * widest, lambda own, other: a.odd[own, None] | b.odd[None, other])
            mark(short * 1.5, long * widest, lambda own, other, long=long: np.bitwise_count(a.bits[own, None] & ~b.bits[None, other]) <= int(lacking * long + TINY))
            mark(short / widest, long / 1.5, lambda own, other: np.bitwise_count(~a.bits[own, None] & b.bits[None, other]) <= int(lacking * b.length[other][-1] + TINY))
        at = np.flatnonzero(close)
        i, j = at // close.shape[1] + p, at % close.shape[1]
        kept = i < j if same else slice(None)
        found.append((i[kept], j[kept], shared.ravel()[at][kept]))
        if sum(len(f[0]) for f in found) > PAIRS:
            yield full()
    if found:
        yield full()


def scores(own: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`weighted_ratio` of names ``i`` and ``j`` of ``own``, none of them empty."""
    out, small, large = np.zeros(len(i)), np.minimum(own.length[i], own.length[j]), np.maximum(own.length[i], own.length[j])
    far = 2 * large >= 3 * small
    slow = (large > BITS) | (far & (own.odd[i] | own.odd[j]))
    for k in np.flatnonzero(slow).tolist():
        out[k] = weighted_ratio(own.names[i[k]], own.names[j[k]])
    shared = _met(own, own, i, j).any(1)
    for k in np.flatnonzero(~slow & ((own.number[i] > TOKENS) | (own.number[j] > TOKENS))).tolist():
        shared[k] = not set(own.tokens[i[k]]).isdisjoint(own.tokens[j[k]])
    plain, turned = own.plain[:, :BITS], own.sorted[:, :BITS]
    parts = np.flatnonzero(far & ~slow)
    out[parts] = _part_scores(own, plain, turned, i[parts], j[parts], shared[parts])
    fast = np.flatnonzero(~far & ~slow)
    i, j = i[fast], j[fast]
    ends, sets = _ratio(plain, plain, i, j), _ratio(turned, turned, i, j)
    ordered = sets.copy()
    # The pairs with a token in common or repeated; other sets of tokens are what is sorted.
    other = shared[fast] | own.again[i] | own.again[j]
    # Sets of tokens begin with what is common, which is a prefix of both sides.
    held = {k: frozenset(own.tokens[k]) for k in np.unique(np.r_[i[other], j[other]]).tolist()}
    prefix, left, right, at = [], [], [], []
    for k, p, q in zip(np.flatnonzero(other).tolist(), i[other].tolist(), j[other].tolist()):
        p, q = held[p], held[q]
        both = p & q
        if both and (p <= q or q <= p):
            sets[k] = 100.0
        else:
            prefix.append(len(" ".join(both))), left.append(" ".join(sorted(p - q))), right.append(" ".join(sorted(q - p))), at.append(k)
    if at:
        l, r = _codes(left), _codes(right)
        both, nl, nr = np.array(prefix), np.count_nonzero(l, axis=1), np.count_nonzero(r, axis=1)
        start = np.where(both > 0, both + 1, 0)
        ratio = 200.0 * (start + common_length(l, r, np.arange(len(at)), np.arange(len(at)))) / np.maximum(2 * start + nl + nr, 1)
        ratio[start + nl + nr == 0] = 100.0
        sets[at] = np.where(both > 0, np.maximum(ratio, 200.0 * both / (2 * both + 1 + np.minimum(nl, nr))), ratio)
    out[fast] = np.maximum(ends, TURNED * np.maximum(ordered, sets))
    return out


def _part_scores(own: Names, plain: np.ndarray, turned: np.ndarray, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """:func:`scores` of names with lengths of a ratio of 1.5 or more."""
    i, j = np.where(own.length[i] <= own.length[j], i, j), np.where(own.length[i] <= own.length[j], j, i)
    part = np.where(own.length[j] <= LONGEST * own.length[i], PART, SHORT_PART)
    out = np.maximum(_ratio(plain, plain, i, j), np.where(shared, TURNED * part * 100.0, 0.0))
    # Beside a token in common a part counts only if more than 95 % of it are alike.
    lack = np.maximum(own.counts[i] - own.counts[j], 0).sum(1)
    left = np.flatnonzero(~shared | (lack <= (1 - TURNED / (2 - TURNED)) * own.length[i] + TINY))
    out[left] = np.maximum(out[left], part[left] * _partial(plain[i[left]], plain[j[left]]))
    left = np.flatnonzero(~shared)
    out[left] = np.maximum(out[left], TURNED * part[left] * _partial(turned[i[left]], turned[j[left]]))
    return out


def score_matrix(names: list[str]) -> np.ndarray:
    """:func:`weighted_ratio` of all pairs of names, 0 on the diagonal."""
    n, own, (i, j) = len(names), Names(names), np.triu_indices(len(names), 1)
    out = np.zeros((n, n))
    for x in range(0, len(i), PAIRS):
        p, q = i[x : x + PAIRS], j[x : x + PAIRS]
        out[p, q] = out[q, p] = scores(own, p, q)
    return out


def scored(percent: float):
    """For ``mapInArrow`` over a, b: a, b, score of the pairs with a weighted ratio of at least ``percent``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pa.chunked_array([batch["a"], batch["b"]]).combine_chunks().dictionary_encode()
            at = coded.indices.to_numpy()
            found = scores(Names(coded.dictionary.to_pylist()), at[: batch.num_rows], at[batch.num_rows :])
            good = pa.array(found >= percent)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(good), batch["b"].filter(good), pa.array(found).filter(good)], ["a", "b", "score"])

    return kept
