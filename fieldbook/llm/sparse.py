"""Sparse matrices in compressed rows (CSR), built by hand, and their product row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    """``columns[starts[i]:starts[i + 1]]`` are the columns of row i, ascending, and ``values`` what stands there."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.starts))

    def transposed(self) -> Csr:
        """Counting sort by column; within a column the rows stay in order."""
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, self.row_numbers()[order], self.values[order], self.rows)


def incidence(starts: np.ndarray, columns: np.ndarray, width: int) -> Csr:
    return Csr(starts, columns, np.ones(len(columns), dtype=np.int64), width)


def spans(ends: np.ndarray, width: int) -> Csr:
    """Incidence of consecutive tokens and the bytes they cover: token i covers ``ends[i - 1]`` to ``ends[i]``."""
    return incidence(np.concatenate([[0], ends]), np.arange(width), width)


def row_work(a: Csr, b: Csr) -> np.ndarray:
    """Products that each row of a·b takes (the symbolic half of Gustavson's method). Without two ways from a row to a column, its entries."""
    each = np.diff(b.starts)[a.columns]
    total = np.concatenate([[0], np.cumsum(each)])
    return total[a.starts[1:]] - total[a.starts[:-1]]


def products(a: Csr, b: Csr, most: int = 1 << 20) -> Iterator[tuple[int, Csr]]:
    """a·b by Gustavson's rows: (first row, the rows from there), so many rows at a time as take ``most`` products, one at least.

    Row i of the product is the sum of the rows k of b for the entries (i, k) of a; equal columns are added up.
    """
    upto = np.concatenate([[0], np.cumsum(row_work(a, b))])
    row = 0
    while row < a.rows:
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + most, side="right")) - 1)
        first, last = a.starts[row], a.starts[stop]
        inner, value = a.columns[first:last], a.values[first:last]
        each = b.starts[inner + 1] - b.starts[inner]
        of = np.repeat(np.repeat(np.arange(stop - row), np.diff(a.starts[row : stop + 1])), each)
        begin = np.cumsum(each) - each
        at = np.arange(each.sum()) + np.repeat(b.starts[inner] - begin, each)
        key, part = of * b.width + b.columns[at], np.repeat(value, each) * b.values[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, part = key[order], part[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(part, new) if len(new) else part
        starts = np.searchsorted(key[new] // max(1, b.width), np.arange(stop - row + 1))
        yield row, Csr(starts, key[new] % max(1, b.width), sums, b.width)
        row = stop
