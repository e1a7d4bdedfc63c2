"""Similarity joins without pair tables: hot groups in block pairs, links as counts and spanning forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, node: str, blocks: Column) -> DataFrame:
    """Copies every row of a group cut into ``blocks`` blocks to the block pairs it belongs to.

    Adds ``_home``, ``_i`` and ``_j`` (``_i <= _j``, one of them is ``_home``). Two rows of a group meet in
    exactly one pair of blocks, and a group of one block is not copied.
    """
    home = F.pmod(F.xxhash64(F.lit("block"), node), F.col("_blocks"))
    spread = df.withColumn("_blocks", F.greatest(F.lit(1), blocks.cast("long"))).withColumn("_home", home)
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return spread.withColumns({"_i": F.least("_home", "_other"), "_j": F.greatest("_home", "_other")}).drop("_other", "_blocks")


def meeting(group: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs of a block-pair group are its own: a boolean upper triangle."""
    home = group["_home"]
    own = np.triu(np.ones((len(home), len(home)), bool), 1)
    if group["_i"][0] != group["_j"][0]:
        own &= home[:, None] != home[None, :]
    return own


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each position's component under the pairs ``a``, ``b``."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Links:
    """Collects what groups tell about their linked nodes: rows linked to each, and the node it hangs on in the forest."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, nodes: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = forest(len(nodes), a, b)
        seen = np.flatnonzero(links)
        self.parts.append((nodes[seen], links[seen], nodes[root[seen]]))
        self.rows += len(seen)

    def take(self) -> pd.DataFrame:
        node, links, root = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in range(3))
        self.parts, self.rows = [], 0
        return pd.DataFrame({"node": node, "links": links, "root": root})
