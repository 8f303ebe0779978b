"""Weighted shingles of texts, their ProbMinHash signatures and exact similarity.

Everything works on batches of texts with numpy: no step loops over words.
"""

from __future__ import annotations

import numpy as np

from .decontaminate import FOLD

SHINGLE_WORDS = 5
U64 = np.uint64
#: The multiplier of the polynomial word hash, and what undoes it modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all words, in their order.

    Words are runs of 0-9, a-z and everything from U+0080 on, after A-Z are
    lowered; a null text has none.
    """
    folded = [x.encode().translate(FOLD) + b" " if x else b" " for x in texts]
    sizes = np.fromiter(map(len, folded), dtype=np.int64, count=len(folded))
    data = np.frombuffer(b"".join(folded), dtype=np.uint8)
    word = data != 32
    edges = np.diff(np.concatenate([[0], word.view(np.int8)]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(data.astype(U64) * _powers(BASE, len(data)), dtype=U64)])
    hashes = mixed((sums[ends] - sums[begins]) * _powers(UNDO, len(data))[begins] + (ends - begins).astype(U64)) if len(begins) else np.zeros(0, dtype=U64)
    return np.searchsorted(np.cumsum(sizes), begins, side="right"), hashes


def shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, shingle hashes and weights, ordered by text and hash.

    Words are runs of 0-9, a-z and everything from U+0080 on, after A-Z are
    lowered.  A weight is how often a text has the shingle.  A text of fewer
    words, but not none, has one shingle of all its words; a null has none.
    """
    text_of, hashes = hashed_words(texts)
    n_words = np.bincount(text_of, minlength=len(texts))
    place = np.arange(len(hashes)) - (np.cumsum(n_words) - n_words)[text_of]
    left = n_words[text_of] - place
    total = np.zeros(len(hashes), dtype=U64)
    for k in range(size):
        part = np.zeros(len(hashes), dtype=U64)
        part[: max(0, len(hashes) - k)] = hashes[k:]
        part[left <= k] = 0
        total = (total ^ part) * U64(0xD6E8FEB86659FD93)
        total ^= total >> U64(29)
    starts = (place == 0) | (left >= size)
    found, owner = mixed(total[starts]), text_of[starts]
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], found[at], np.diff(np.append(at, len(found)))


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """For each text and register, the shingle that arrives there first.

    Each shingle is a Poisson process with its weight as rate; each arrival goes
    to a random register, and the same shingle draws alike in all texts.  So two
    texts agree in a register with the probability Jaccard of their weights.
    Arrival by arrival, a shingle is dropped as soon as it comes later than the
    latest first arrival of its text.  Texts without a shingle keep zeros.
    """
    first = np.full(n_texts * registers, np.inf)
    who = np.zeros(n_texts * registers, dtype=U64)
    latest = np.full(n_texts, np.inf)
    text, item, rate, time = owner, hashes, weights.astype(np.float64), np.zeros(len(owner))
    arrival = 0
    while len(text):
        arrival += 1
        draw = mixed(item + U64(arrival * 0xA0761D6478BD642F % (1 << 64)))
        time = time - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        alive = time < latest[text]
        text, item, rate, time, draw = text[alive], item[alive], rate[alive], time[alive], draw[alive]
        at = text * registers + (mixed(draw) % U64(registers)).astype(np.int64)
        better = time < first[at]
        at, when, what = at[better], time[better], item[better]
        np.minimum.at(first, at, when)
        won = when == first[at]
        who[at[won]] = what[won]
        touched = np.unique(at[won] // registers)
        latest[touched] = first.reshape(n_texts, registers)[touched].max(axis=1)
    return who.reshape(n_texts, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key a band, over equally many registers."""
    rows = signature.shape[1] // bands
    total = np.zeros((len(signature), bands), dtype=U64)
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for k in range(rows):
        total = mixed(total + parts[:, :, k] + U64(k + 1))
    return mixed(total + np.arange(1, bands + 1, dtype=U64)).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets, each given by sorted hashes and weights.

    Sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i).  The inner sum
    depends on the ratio of i's weights alone, and few ratios occur.
    """
    (ah, aw), (bh, bw) = a, b
    if not len(ah) or not len(bh):
        return 0.0
    at = np.searchsorted(bh, ah)
    at[at == len(bh)] = 0
    both = bh[at] == ah
    x, y = aw[both].astype(np.float64), bw[at[both]].astype(np.float64)
    only_a, only_b = aw.sum() - x.sum(), bw.sum() - y.sum()
    ratios, which = np.unique(x / y, return_inverse=True)
    mass = np.bincount(which, weights=x, minlength=len(ratios))
    return float(sum(m / (only_a + r * only_b + np.maximum(x, r * y).sum()) for r, m in zip(ratios.tolist(), mass.tolist(), strict=True)))
