"""Byte-pair merging of many short pieces at once.

All pieces of a length class form the rows of a matrix of token ids. In every round each row applies the
merge of lowest rank among its neighbours, leftmost first, and only the two pairs beside the new token are
ranked again; rows without a merge left are done. This gives the ids that merging piece by piece gives.
"""

from __future__ import annotations

import numpy as np

#: Widths of the length classes in bytes; longer pieces are left to the caller.
WIDTHS = (6, 8, 10, 12, 16, 24)
NO_RANK = np.int32(2**31 - 1)


class MergeTable:
    """Merges of a byte-level vocabulary. end: suffix that marks the last symbol of a piece."""

    def __init__(self, model: dict, alphabet: dict[str, int], end: str | None = None):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.first[b], self.last[b] = vocab[c], vocab[c + (end or "")]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NO_RANK)

    def encode(self, pieces: list[bytes]) -> list[bytes | None]:
        """Ids of each piece as little-endian u32; None for pieces longer than the last class."""
        out: list[bytes | None] = [None] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for at in range(0, len(rows), 1 << 15):
                some = rows[at : at + (1 << 15)].tolist()
                ids, n = self._merge(b"".join([pieces[i].ljust(width, b"\0") for i in some]), length[some], width)
                data, step, n = ids.tobytes(), 4 * width, (4 * n).tolist()
                for k, i in enumerate(some):
                    out[i] = data[k * step : k * step + n[k]]
        return out

    def _merge(self, data: bytes, n: np.ndarray, width: int):
        raw = np.frombuffer(data, np.uint8).reshape(-1, width)
        row, n = np.arange(len(raw)), n.copy()
        ids = self.first[raw]
        ids[row, n - 1] = self.last[raw[row, n - 1]]
        ranks = np.full(ids.shape, NO_RANK, np.int32)
        for j in range(width - 1):
            live = np.flatnonzero(n > j + 1)
            ranks[live, j] = self.rank(ids[live, j], ids[live, j + 1])
        done, count = ids.copy(), n.copy()
        columns = np.arange(width)
        while len(row):
            j = ranks.argmin(1)
            local = np.arange(len(row))
            best = ranks[local, j]
            going = best != NO_RANK
            if not going.all():
                over = ~going
                done[row[over]], count[row[over]] = ids[over], n[over]
                row, ids, ranks, n, j, best = row[going], ids[going], ranks[going], n[going], j[going], best[going]
                local = np.arange(len(row))
                if not len(row):
                    break
            take = np.minimum(columns + (columns > j[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[local, j] = self.made[best]
            n = n - 1
            ranks[local, n - 1] = NO_RANK
            has = j < n - 1
            ranks[local[has], j[has]] = self.rank(ids[local[has], j[has]], ids[local[has], j[has] + 1])
            has = j > 0
            ranks[local[has], j[has] - 1] = self.rank(ids[local[has], j[has] - 1], ids[local[has], j[has]])
        return done, count
