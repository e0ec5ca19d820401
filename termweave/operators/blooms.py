"""A Bloom filter as a small table: which keys may be among many, asked before anything is shuffled.

A block is a row of LANES numbers of 32 bits; a key sets one bit in each lane of one block. So the filter is made by one
aggregate, of as many rows as it has blocks, and asking is one join with broadcast blocks whose condition looks at the bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
#: Bits for each key: about one in 300 of other keys passes.
BITS = 12
#: Blocks that are broadcast at most, about 80 bytes each in memory. More keys than that hold make more others pass, and lose none.
BLOCKS = 1_000_000


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("long")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * k).bitwiseAND(31).cast("int")) for k in range(LANES)]


def bloom(keys: DataFrame, key: str, n: int, most: int = BLOCKS) -> DataFrame:
    """block, lane0, ...: the filter of about n keys. blocks isn't stored: it follows from n, see may_hold."""
    blocks = _blocks(n, most)
    set_ = [F.bit_or(b).alias(f"lane{k}") for k, b in enumerate(_bits(F.col(key)))]
    return keys.filter(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block")).agg(*set_)


def _blocks(n: int, most: int) -> int:
    return max(1, min(most, n * BITS // (32 * LANES) + 1))


def may_hold(rows: DataFrame, key: str, filter_: DataFrame, n: int, most: int = BLOCKS) -> DataFrame:
    """The rows whose key may be among the n of the filter: all whose key is, and a few others."""
    set_ = reduce(lambda a, b: a & b, [F.col(f"lane{k}").bitwiseAND(b) != 0 for k, b in enumerate(_bits(F.col(key)))])
    return rows.join(F.broadcast(filter_), (F.col("block") == _block(F.col(key), _blocks(n, most))) & set_, "left_semi")
