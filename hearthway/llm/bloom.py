"""Blocked Bloom filters of bounded size, built by Spark and probed in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is eight 64-bit words, one cache line; a key sets one bit in each word.
WORDS = 8
#: The filter never exceeds this size, however many rules there are: beyond it more keys pass, and the join drops them.
MAX_BLOCKS = 1 << 18
KEYS_A_BLOCK = 32


class BlockedBloom:
    """A blocked Bloom filter over 64-bit hashes: one block and one bit in each of its words for each key."""

    def __init__(self, words: np.ndarray):
        self.words = words  # uint64, blocks x WORDS

    @classmethod
    def build(cls, keys: DataFrame, key: str, hashed: bool = False) -> BlockedBloom:
        """From the distinct keys of a DataFrame; at most MAX_BLOCKS rows of 64 bytes reach the driver.

        ``hashed``: the keys are 64-bit hashes themselves, else they are passed as ``xxhash64`` of the key.
        """
        hashed = keys.select((F.col(key) if hashed else F.xxhash64(key)).alias("h")).distinct()
        count = hashed.count()
        blocks = max(1, min(MAX_BLOCKS, -(-count // KEYS_A_BLOCK)))
        rows = hashed.mapInPandas(_masks(blocks), ", ".join(["block long", *(f"w{i} long" for i in range(WORDS))]))
        merged = rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        words = np.zeros((blocks, WORDS), dtype=np.uint64)
        for r in merged.toLocalIterator():
            words[r[0]] = np.array(r[1:], dtype=np.int64).view(np.uint64)
        return cls(words)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = _spots(hashes, len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers, and the words to set or test in a block: one bit in each of its words."""
    h = _mixed(hashes.astype(np.int64).view(np.uint64))
    block = (h % np.uint64(blocks)).astype(np.int64)
    bits = _mixed(h)[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))
    return block, np.uint64(1) << (bits & np.uint64(63))


def _masks(blocks: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, masks = _spots(batch["h"].to_numpy(), blocks)
            yield pd.DataFrame({"block": block} | {f"w{i}": masks[:, i].view(np.int64) for i in range(WORDS)})

    return run
