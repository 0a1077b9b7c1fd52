"""What keeps the memory of a worker bounded: slices of batches, and values remembered by text."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices_by_size(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``most`` bytes together, or one larger text."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), "i8"))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Memo(dict):
    """Values by text. All are forgotten once their texts hold more than ``most`` characters together.

    A word counts ``EACH`` characters more than it has, for what is kept besides its text.
    """

    EACH = 24

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.held = 0

    def learn(self, wanted: Iterable[str], values: Callable[[list[str]], Iterable[Any]], step: int = 10_000) -> None:
        """Have a value for every text of ``wanted``; ``values`` gives those of a list of new texts, in order."""
        wanted = set(wanted)
        new = list(wanted - self.keys())
        size = sum(map(len, new)) + self.EACH * len(new)
        if self and self.held + size > self.most:
            self.clear()
            self.held = 0
            new = list(wanted)
            size = sum(map(len, new)) + self.EACH * len(new)
        for start in range(0, len(new), step):
            part = new[start : start + step]
            self.update(zip(part, values(part), strict=True))
        self.held += size


class Recalled(dict):
    """Values by key, each made by ``make`` when it is first asked for by ``[]``.

    Keys are kept in two generations of about ``most`` each: after :meth:`age` has begun a new one, keys asked for
    again are taken over from the one before and the others are forgotten with it. So common keys stay.
    """

    def __init__(self, make: Callable[[Hashable], Any], most: int):
        super().__init__()
        self.make = make
        self.most = most
        self.before: dict = {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        """Begin a new generation once this one is full."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
