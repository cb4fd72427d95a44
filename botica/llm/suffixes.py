"""Suffix arrays by two-stage sorting, and the prefixes that neighbours share.

Only suffixes smaller than their successors are sorted directly. Each other suffix
follows from its successor: a scan over the buckets of first bytes, in order, hands
every suffix found to the bucket of the byte before it. Both steps work on whole
arrays; order is settled as far as ``depth`` bytes, suffixes alike so far stay together.
"""

from __future__ import annotations

import numpy as np


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros after the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for j in range(min(8, n)):
        count = -(-(n - j) // 8)
        out[j::8] = padded[j : j + 8 * count].view(">u8")
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    up = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(ends, prepend=-1))


def direct(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in order of what stands there, as far as ``depth`` bytes."""
    if not len(at):
        return at
    key = word[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    done = 8
    while done < depth:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        group = np.cumsum(new[tied]).astype(np.uint64)
        after = at[tied] + done
        inside = after < len(word)
        five = np.zeros(len(tied), dtype=np.uint64)
        five[inside] = word[after[inside]] >> np.uint64(24)
        key = (group << np.uint64(40)) | five
        order = np.argsort(key)
        at[tied], key = at[tied][order], key[order]
        new[tied] = np.append(True, key[1:] != key[:-1])
        done += 5
    return at


def suffix_array(text: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """All places of the text, by their suffixes as far as ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    up = rising(text)
    sorted_up = direct(word, np.flatnonzero(up), depth)
    cuts = np.searchsorted(text[sorted_up], np.arange(257))
    # How many bytes of one kind end at each place.
    run = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, text[1:] != text[:-1]), np.arange(n), 0)) + 1
    handed: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The last suffix follows the empty one.
    handed[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own_up = sorted_up[cuts[c] : cuts[c + 1]]
        if not handed[c] and not len(own_up):
            continue
        bucket = own_up
        if handed[c]:
            # Where the same byte stands before them too, those suffixes come after, once for each such byte.
            ends = np.concatenate(handed[c])
            handed[c] = []
            many = run[ends]
            back = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            falling = (np.repeat(ends, many) - back)[np.argsort(back, kind="stable")]
            bucket = np.concatenate([falling, own_up])
        out.append(bucket)
        prior = bucket[bucket > 0] - 1
        first = text[prior]
        prior, first = prior[first > c], first[first > c]
        if len(prior):
            order = np.argsort(first, kind="stable")
            prior = prior[order]
            bounds = np.searchsorted(first[order], np.arange(c + 1, 257))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                handed[c + 1 + k].append(prior[bounds[k] : bounds[k + 1]])
    return np.concatenate(out)


def shared(word: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the order but the first, the bytes it shares with the one before, up to ``most``."""
    a, b = order[:-1], order[1:]
    got = np.zeros(len(a), dtype=np.int64)
    padded = np.concatenate([word, np.zeros(most + 8, dtype=np.uint64)])
    alive = np.arange(len(a))
    for at in range(0, most, 8):
        differ = padded[a[alive] + at] ^ padded[b[alive] + at]
        same = differ == 0
        # Zero bytes at the high end of what differs.
        top = differ[~same]
        high = np.zeros(len(top), dtype=np.int64)
        for shift in (32, 16, 8):
            wide = (top >> np.uint64(64 - shift)) == 0
            high += np.where(wide, shift // 8, 0)
            top = np.where(wide, top << np.uint64(shift), top)
        got[alive[~same]] = at + high
        alive = alive[same]
    got[alive] = most
    return np.minimum(got, most)
