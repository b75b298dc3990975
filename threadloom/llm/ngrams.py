"""Hashed n-grams of many texts at once, as numpy arrays over their characters."""

from __future__ import annotations

_P = 0x01000193
_lut = None


def _classes():
    """A class for each 16-bit character: 0 blank, 1 lower, 2 upper, 3 digit, 4 other letter, 5 to 12 the rest."""
    global _lut
    import numpy as np

    if _lut is None:
        lut = np.zeros(1 << 16, np.uint8)
        for c in range(1 << 16):
            s = chr(c)
            lut[c] = 0 if s.isspace() or c == 0 else 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s.isalpha() else 5 + c % 8
        _lut = lut
    return _lut


def mixed(h, bits: int):
    import numpy as np

    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


class Characters:
    """Characters of texts, one blank before each and one after the last; blanks are all character 32."""

    def __init__(self, texts: list[str], lower: bool):
        import numpy as np

        texts = [t or "" for t in texts]
        if lower:
            texts = [t.lower() for t in texts]
        flat = " " + " ".join(texts) + " "
        self.codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.kinds = _classes()[np.minimum(self.codes, 0xFFFF)]
        self.blank = self.kinds == 0
        self.codes[self.blank] = 32
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        #: Where each text begins; the blank before it belongs to it.
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)])

    def grams(self, orders, bits: int):
        """(order, bucket of the gram at each position, whether it counts) without blanks inside."""
        import numpy as np

        c, n = self.codes, len(self.codes)
        h, inner = c.copy(), np.ones(n, bool)
        for k in range(1, max(orders)):
            if n <= k:
                return
            h = h[: n - k] * np.uint32(_P) + c[k:]
            inner = inner[: n - k]
            if k > 1:
                inner = inner & ~self.blank[k - 1 : n - 1][: n - k]
            if k + 1 in orders:
                # A gram may begin and end with a blank, but is more than that.
                yield k + 1, mixed(h + np.uint32(k), bits), inner & ~(self.blank[: n - k] & self.blank[k:]) & (inner if k > 1 else ~self.blank[: n - k])

    def words(self):
        """(first character, past the last) of each word, and the number of words before each text."""
        import numpy as np

        b = self.blank
        first = np.flatnonzero(b[:-1] & ~b[1:]) + 1
        past = np.flatnonzero(~b[:-1] & b[1:]) + 1
        return first, past, np.searchsorted(first, self.starts)

    def shapes(self, first, past):
        """A code for the shape of each word: its cases, its ends, its size, whether it repeats the last word."""
        import numpy as np

        n = len(first)
        if not n:
            return np.zeros(0, np.uint32)
        inside = ~self.blank
        at = np.arange(len(self.codes)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(self.codes)]))
        h = self.codes * np.uint32(0x9E3779B1) + at.astype(np.uint32) * np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h[~inside] = 0
        word = np.add.reduceat(h, first)
        same = np.r_[False, word[1:] == word[:-1]]
        low = np.add.reduceat((self.kinds == 1).astype(np.uint32), first) > 0
        size = past - first
        code = self.kinds[first].astype(np.uint32)
        for x, base in ((low, 2), (self.kinds[past - 1], 16), (self.kinds[np.maximum(past - 2, first)], 16), (np.digitize(size, (2, 4, 8, 24)), 8), (same, 2)):
            code = code * np.uint32(base) + x.astype(np.uint32)
        return code
