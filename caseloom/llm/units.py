"""Ids of many texts from the ids of their distinct units, each found once and remembered in flat arrays."""

from __future__ import annotations

from itertools import chain

import numpy as np


class UnitMemory:
    """Subclasses say how a text parts into units that are encoded on their own, and how new units are encoded."""

    #: Units remembered per worker process; when full the memory starts anew.
    remember = 150_000

    def __init__(self):
        self.forget()

    def parts(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, units: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """The units in the order of their ids, chunks of ids, and the number of ids of each unit."""
        raise NotImplementedError

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parted = [self.parts(t) for t in texts]
        own = dict.fromkeys(chain.from_iterable(parted))
        new = [u for u in own if u not in self.number]
        if len(self.number) + len(new) > self.remember:
            self.forget()
            new = list(own)
        if new:
            units, chunks, size = self.learn(new)
            base, total = len(self.flat), np.cumsum(size)
            self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
            self.flat = np.concatenate([self.flat, *chunks])
            if len(size) != len(new) or len(self.flat) - base != (total[-1] if len(total) else 0):
                raise ValueError("the units part in another way than expected")
            self.start, self.size = np.concatenate([self.start, base + total - size]), np.concatenate([self.size, size])
        known = self.number
        return [self.together(np.fromiter(map(known.__getitem__, us), dtype=np.int64, count=len(us))) for us in parted]

    def together(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.start[numbers] - (ends - sizes), sizes)
        return self.flat[np.arange(total) + shift]
