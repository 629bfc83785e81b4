"""Suffix arrays by induced sorting and permuted common prefixes, in array operations.

The induced sort visits buckets in character order.  Neighbouring buckets that
induce nothing into each other are handled in one step, whatever the size of
the alphabet; a bucket that induces into itself is handled in rounds, one per
repetition of its character.  Suffixes come in exactly the order of a scan one
by one.  The leftmost smaller substrings are named by rank, and the reduced
text, less names that stand once and decide nothing, is sorted by the same
function again until all names differ.
"""

from __future__ import annotations

import numpy as np

#: Buckets tried in one step at most.
WIDEST = 4096


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the empty suffix at the end is the smallest)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # last place of each run but the final one
    rises = text[change + 1] > text[change]
    ends = np.r_[change, n - 1]
    return np.repeat(np.r_[rises, False], np.diff(np.r_[-1, ends]))


def _spread(found: np.ndarray, chars: np.ndarray, order: np.ndarray, at: np.ndarray, step: int) -> None:
    """Append ``found`` to the buckets of ``chars``, in order, moving the buckets' ends by ``step``."""
    turn = chars.argsort(kind="stable")
    chars = chars[turn]
    if len(chars) < 256:
        head = chars.searchsorted(chars)
    else:
        new = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        head = np.zeros(len(chars), np.int64)
        head[new] = new
        head = np.maximum.accumulate(head)
    place = np.arange(len(chars)) - head  # among those of its bucket
    place = at[chars] + place if step > 0 else at[chars] - place
    order[place] = found[turn]
    at[chars] = place + step  # of equal buckets the last one stays


def _clear(chars: np.ndarray, targets: np.ndarray, end: int) -> int:
    """End of the longest run of buckets whose sources induce only beyond the run.

    ``chars`` (ascending) are the buckets of the sources, ``targets`` those
    they induce into; a run that passes a source must end before all targets
    up to it.
    """
    if not len(chars):
        return end
    least = np.minimum.accumulate(targets)
    inside = least <= chars
    k = int(inside.argmax())
    if not inside[k]:
        return min(end, int(least[-1]))
    return int(chars[k]) if k == 0 else min(int(chars[k]), int(least[k - 1]))


def _placed(sources: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sources have a suffix before them of the type in ``keep``, and these suffixes; ``keep`` ends with False, for the source 0."""
    before = sources - 1
    has = keep[before]
    return has, before[has]


def _induced(text: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from an order of the leftmost smaller ones."""
    n, alphabet = len(text), len(heads)
    order = np.full(n, -1, np.int64)
    small = np.append(small, False)
    large = ~small
    large[n] = False
    # Larger suffixes, buckets upwards: each suffix places the one before it at the head of that one's bucket.
    at = heads.copy()
    seeds = lms[np.argsort(text[lms], kind="stable")]
    seed_ends = np.searchsorted(text[seeds], np.arange(alphabet), side="right")
    if large[n - 1]:  # the end of the text, before everything else
        _spread(np.array([n - 1]), text[n - 1 :], order, at, 1)
    c, width = 0, 1
    while c < alphabet:
        end = min(c + width, alphabet)
        held = order[heads[c] : tails[end - 1] + 1]
        held = held[held >= 0]
        own = seeds[seed_ends[c - 1] if c else 0 : seed_ends[end - 1]]
        sources = np.concatenate([held, own]) if len(own) else held
        if end - c > 1 and len(held) and len(own):  # of each bucket the larger suffixes, then the seeds
            sources = sources[np.argsort(text[sources], kind="stable")]
        has, before = _placed(sources, large)
        chars, targets = text[sources[has]], text[before]
        upto = _clear(chars, targets, end)
        if upto > c:
            before = before[: chars.searchsorted(upto)]
            if len(before):
                _spread(before, text[before], order, at, 1)
            width = min(2 * width, WIDEST) if upto == end else max(1, upto - c)
            c = upto
            continue
        done = heads[c]  # the bucket's own suffixes come in rounds
        while done < at[c]:
            now = int(at[c])
            _, before = _placed(order[done:now], large)
            if len(before):
                _spread(before, text[before], order, at, 1)
            done = now
        _, before = _placed(seeds[seed_ends[c - 1] if c else 0 : seed_ends[c]], large)
        if len(before):
            _spread(before, text[before], order, at, 1)
        c += 1
    # Smaller suffixes, buckets downwards, from the tails.
    at = tails.copy()
    c, width = alphabet - 1, 1
    while c >= 0:
        low = max(c - width + 1, 0)
        sources = order[heads[low] : tails[c] + 1][::-1]
        sources = sources[sources >= 0]
        has, before = _placed(sources, small)
        chars, targets = text[sources[has]].astype(np.int64), text[before].astype(np.int64)
        upto = -_clear(-chars, -targets, -low + 1)  # the same upside down: buckets c, c - 1, ..., upto + 1
        if upto < c:
            before = before[: np.searchsorted(-chars, -upto)]
            if len(before):
                _spread(before, text[before], order, at, -1)
            width = min(2 * width, WIDEST) if upto == low - 1 else max(1, c - upto)
            c = upto
            continue
        done = tails[c]
        while done > at[c]:
            now = int(at[c])
            _, before = _placed(order[now + 1 : done + 1][::-1], small)
            if len(before):
                _spread(before, text[before], order, at, -1)
            done = now
        rest = order[heads[c] : at[c] + 1][::-1]
        _, before = _placed(rest[rest >= 0], small)
        if len(before):
            _spread(before, text[before], order, at, -1)
        c -= 1
    return order


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of leftmost-smaller substrings given their sorted order; equal substrings share a rank."""
    n = len(text)
    where = np.full(n, -1, np.int64)
    where[lms] = np.arange(len(lms))
    length = np.r_[lms[1:], n] - lms + 1
    size = length[where[ordered]]
    new = np.ones(len(ordered), bool)
    i = np.flatnonzero((size[1:] == size[:-1]) & (ordered[1:] + size[1:] <= n) & (ordered[:-1] + size[:-1] <= n))
    k = 0
    while len(i):
        same = text[ordered[i] + k] == text[ordered[i + 1] + k]
        i = i[same]
        k += 1
        ended = size[i] <= k
        new[i[ended] + 1] = False
        i = i[~ended]
    rank = np.cumsum(new) - 1
    names = np.empty(len(lms), np.int64)
    names[where[ordered]] = rank
    return names, int(rank[-1]) + 1


def _ranked(names: np.ndarray, distinct: int) -> np.ndarray:
    """Suffix array of a reduced text of ``distinct`` names.

    No comparison goes beyond a name that stands only once, so of a run of such
    names the first alone can decide one; the others are left out of the text
    that is sorted by inducing, and take the places of their names.
    """
    single = np.bincount(names, minlength=distinct)[names] == 1
    if single.all():
        return np.argsort(names)
    kept = np.flatnonzero(~single | np.r_[False, ~single[:-1]])
    own = np.zeros(distinct, np.int64)
    own[names[kept]] = 1
    among = kept[suffix_array((np.cumsum(own) - 1)[names[kept]])]
    order = np.concatenate([np.flatnonzero(single), among[~single[among]]])
    return order[np.argsort(names[order], kind="stable")]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of an array of small non-negative integers, in order.

    A suffix that is a prefix of another comes first.  An empty text gives an
    empty array.
    """
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    alphabet = int(text.max()) + 1
    small = _smaller_than_next(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(text, minlength=alphabet)
    tails = np.cumsum(counts) - 1
    heads = tails - counts + 1
    narrow = text.astype(np.uint16 if alphabet < 1 << 16 else np.uint32, copy=False)
    if len(lms) > 1:
        rough = _induced(narrow, small, heads, tails, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        names, distinct = _names(text, lms, rough[is_lms[rough]])
        lms = lms[_ranked(names, distinct)]
    return _induced(narrow, small, heads, tails, lms)


def permuted_lcp(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in ``order``, by text position, up to ``cap``.

    Only positions that a different character precedes than their predecessor
    (irreducible ones) are compared character by character; at every other place
    the value is one less than at the place before.  Values that reach
    ``cap`` stay there, which is exact for any test against a smaller bound.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] <= 0) | (text[:-1] != text[phi[1:] - 1])
    at = np.flatnonzero(fresh & (phi >= 0))
    other, k = phi[at], 0
    while len(at) and k < n:
        inside = (at + k < n) & (other + k < n)
        at, other = at[inside], other[inside]
        same = text[at + k] == text[other + k]
        at, other = at[same], other[same]
        k += 1
        lcp[at] = k
        if k >= cap:  # what goes on beyond the cap is only needed where a later place depends on it
            deep = np.r_[~fresh[1:], False][at]
            at, other = at[deep], other[deep]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    whole = lcp[lead] - (np.arange(n) - lead)
    return np.minimum(np.where(fresh, lcp, np.maximum(whole, 0)), cap)
