"""Tables of a fixed number of slots, filled by Spark, that tasks look hashes up in.

A slot is the leading bits of a hash. The size depends on a parameter only, never on the data, so a table may be
gathered and broadcast. What it says of a hash is an upper bound: other hashes can share the slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(parts: DataFrame, slots_bits: int) -> np.ndarray:
    """Put rows of (part, values) together: part k holds the k-th run of slots, all runs of equal length."""
    table = np.zeros(1 << slots_bits, dtype=np.uint8)
    for row in parts.toLocalIterator(prefetchPartitions=True):
        values = np.frombuffer(bytes(row["values"]), dtype=np.uint8)
        table[row["part"] * len(values) : (row["part"] + 1) * len(values)] = values
    return table


def present(hashes: DataFrame, column: str, slots_bits: int = 24, part_bits: int = 6) -> np.ndarray:
    """1 in the slots of the hashes' two keys (see ``both_slots``), else 0."""
    width = slots_bits - part_bits
    top = F.shiftrightunsigned(column, 64 - slots_bits)
    second = F.shiftrightunsigned(F.shiftleft(column, slots_bits), 64 - slots_bits)
    slots = hashes.select(F.explode(F.array(top, second)).alias("slot")).distinct()
    slots = slots.select(F.shiftright("slot", width).cast("int").alias("part"), F.col("slot").bitwiseAND((1 << width) - 1).alias("at"))

    def run(rows: pa.Table) -> pa.Table:
        values = np.zeros(1 << width, dtype=np.uint8)
        values[rows["at"].to_numpy()] = 1
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "values": pa.array([values.tobytes()], pa.binary())})

    return gathered(slots.groupBy("part").applyInArrow(run, "part int, values binary"), slots_bits)


def both_slots(h: np.ndarray, slots_bits: int = 24) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - slots_bits), (h << np.uint64(slots_bits)) >> np.uint64(64 - slots_bits)
