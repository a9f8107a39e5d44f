"""PartEnum signatures (Arasu, Ganti, Kaushik 2006) for a Jaccard threshold.

Sets are put in size bands. For a tag (a band, joined with the upper end of
the band below it) two linked sets differ in at most ``k`` elements. The
element domain is cut by hash range into ``n1`` groups of ``n2`` parts: some
group holds at most ``k2`` of the differing elements, so the two sets agree on
at least ``n2 - k2`` parts of it. One signature per (tag, group, subset of
``n2 - k2`` parts) therefore loses no link.

A subset that holds none of a set's elements says nothing, and unlike sets share
it. With ``slack`` more groups than needed, linked sets agree in at least
``g`` groups instead of one; a set with an empty subset in fewer than ``g``
groups leaves those signatures out, since in one of the agreeing groups the
subset agreed on holds elements of it, and so the same ones of the other set.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from riskweave.llm.shingles import mix64

_U = np.uint64


@dataclass
class PartEnum:
    num: int = 90                    # threshold = num / den
    den: int = 100
    k2: int = 1
    n2: int = 3
    width: int = 3                   # a band spans a size factor of (den / num) ** width
    slack: float = 1.0               # groups, as a multiple of the fewest that lose no link
    _lows: list[int] = field(default_factory=lambda: [1])

    def band(self, size: int) -> int:
        """Index of the size band that holds ``size``."""
        while self._lows[-1] <= size:
            self._lows.append(self._high(self._lows[-1]) + 1)
        return bisect_right(self._lows, size) - 1

    def _high(self, low: int) -> int:
        return max(low, low * self.den ** self.width // self.num ** self.width)

    def differing(self, band: int) -> int:
        """Most elements in which two linked sets of a tag can differ."""
        self.band(self._lows[-1] if band >= len(self._lows) else 1)
        high = self._high(self._lows[band])
        return 2 * high * (self.den - self.num) // (self.den + self.num)

    def tags(self, size: int) -> list[int]:
        """The set's own band, and the next one if its smallest sets can link to it."""
        b = self.band(size)
        low = self._high(self._lows[b]) + 1
        return [b, b + 1] if self.den * size >= self.num * low else [b]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures (int64) of a sorted distinct hash array. A tag whose sets
        link only when equal (k = 0) gives none: equal sets are merged before."""
        out = []
        with np.errstate(over="ignore"):
            cum = np.zeros(len(s) + 1, dtype=np.uint64)
            np.cumsum(mix64(s ^ _U(0xD1342543DE82EF95)), out=cum[1:])
            for tag in self.tags(len(s)) if len(s) else []:
                self.band(self._high(self._lows[tag]) + 1)
                k = self.differing(tag)
                if k == 0:
                    continue
                n1 = int(np.ceil(-(-(k + 1) // (self.k2 + 1)) * self.slack))
                agreeing = n1 - k // (self.k2 + 1)
                n = n1 * self.n2
                part = ((s >> _U(32)) * _U(n)) >> _U(32)      # monotone in s: parts are runs of s
                cut = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
                sums = mix64(cum[cut[1:]] - cum[cut[:-1]]).reshape(n1, self.n2)
                where = mix64(np.arange(n1, dtype=np.uint64) + _U(tag << 32))
                held = np.diff(cut).reshape(n1, self.n2) > 0
                subsets = list(combinations(range(self.n2), self.n2 - self.k2))
                full = np.stack([held[:, subset].any(axis=1) for subset in subsets])
                every = (~full).any(axis=0).sum() >= agreeing
                for j, subset in enumerate(subsets):
                    v = where + mix64(np.full(1, j, dtype=np.uint64))
                    for p in subset:
                        v = mix64(v ^ sums[:, p])
                    out.append(v if every else v[full[j]])
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, dtype=np.int64)
