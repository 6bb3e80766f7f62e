"""A cuckoo filter over 16-byte keys: four 16-bit fingerprints a bucket, each in one of
two buckets, so that keys can be deleted again. Queries are vectorised."""

from __future__ import annotations

import numpy as np

from .words import U, mix

SLOTS = 4
KICKS = 500


class Full(Exception):
    """No place was found; the shard has to be built anew with more buckets."""


class CuckooFilter:
    def __init__(self, table: np.ndarray) -> None:
        self.table = table  # buckets x SLOTS of fingerprints, 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of distinct keys."""
        size = len(keys)
        while True:
            try:
                made = cls.sized(size)
                made.insert(keys)
                return made
            except Full:
                size = max(8, size * 2)

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(keys), U).reshape(-1, 2)
        mask = U(len(self.table) - 1)
        prints = (raw[:, 1] % U(65535) + U(1)).astype(np.uint16)
        first = mix(raw[:, 0].copy()) & mask
        return prints, first.astype(np.int64), ((first ^ mix(prints.astype(U))) & mask).astype(np.int64)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return int((U(bucket) ^ mix(np.array([fingerprint], U))[0]) & U(len(self.table) - 1))

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        table = self.table
        dice = np.random.default_rng(len(keys))
        for fp, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = fp
                    break
            else:
                bucket = a
                for _ in range(KICKS):
                    slot = int(dice.integers(SLOTS))
                    fp, table[bucket, slot] = int(table[bucket, slot]), fp
                    bucket = self._other(bucket, fp)
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = fp
                        break
                else:
                    raise Full

    def delete(self, keys: list[bytes]) -> None:
        """Take out keys that are in the filter."""
        if not keys:
            return
        for fp, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == fp)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def contains(self, keys: list[bytes]) -> np.ndarray:
        """False: surely not in the filter. True: in it, but for about 1 in 8,000."""
        if not keys:
            return np.zeros(0, bool)
        prints, a, b = self._places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)
