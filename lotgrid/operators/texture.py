"""Grey-level co-occurrence texture.

Each square tile is handed to one task with a margin of neighbouring cells, so a
group is bounded by the tile size whatever the raster size, and every cell is
shuffled about once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("asm", "contrast", "dissimilarity", "entropy", "homogeneity")
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1))


def window_texture(values: np.ndarray, present: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Measures for every cell of ``values`` at least k away from the border.

    Pairs lie inside the (2k+1)-square window and count in both orders; the
    measures of the four directions are averaged.  Pairs with a missing cell are
    left out.
    """
    h, w = values.shape
    oh, ow = h - 2 * k, w - 2 * k
    sums = {m: np.zeros((oh, ow)) for m in MEASURES}
    used = np.zeros((oh, ow))
    for di, dj in DIRECTIONS:
        firsts, seconds, valid = [], [], []
        for i in range(0, 2 * k + 1 - di):
            for j in range(max(0, -dj), 2 * k + 1 - max(0, dj)):
                a = (slice(i, i + oh), slice(j, j + ow))
                b = (slice(i + di, i + di + oh), slice(j + dj, j + dj + ow))
                ok = present[a] & present[b]
                for p, q in ((a, b), (b, a)):
                    firsts.append(values[p])
                    seconds.append(values[q])
                    valid.append(ok)
        first, second, ok = np.stack(firsts), np.stack(seconds), np.stack(valid)
        code = np.where(ok, first.astype(np.int64) * 65536 + second, -1)
        total = ok.sum(axis=0)
        share = 1.0 / np.maximum(total, 1)
        # multiplicity of each pair in its window: n_ij repeated n_ij times in the stack
        count = (code[:, None] == code[None, :]).sum(axis=1)
        gap = np.abs(first.astype(float) - second)
        prob = count * share
        parts = {
            "asm": prob,
            "contrast": gap * gap,
            "dissimilarity": gap,
            "entropy": -np.log(np.where(ok, prob, 1.0)),
            "homogeneity": 1.0 / (1.0 + gap * gap),
        }
        for m, v in parts.items():
            sums[m] += np.where(ok, v, 0.0).sum(axis=0) * share
        used += total > 0
    return {m: np.where(used > 0, s / np.maximum(used, 1), np.nan) for m, s in sums.items()}


def glcm_texture(pixels: DataFrame, band: str, *, k: int = 1, tile: int = 128) -> DataFrame:
    """Texture of one band: (prow, pcol) and the five measures."""

    def tiles(index):
        """The cell's own tile and any neighbour whose margin it falls in."""
        own = F.floor(index / tile)
        return F.array_distinct(F.array(F.floor((index - k) / tile), own, F.floor((index + k) / tile)))

    spread = (
        pixels.select("prow", "pcol", F.col(band).cast("int").alias("v"))
        .withColumn("ti", F.explode(tiles(F.col("prow"))))
        .withColumn("tj", F.explode(tiles(F.col("pcol"))))
    )

    def one_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile, int(key[1]) * tile
        i = pdf["prow"].to_numpy() - top + k
        j = pdf["pcol"].to_numpy() - left + k
        values = np.zeros((tile + 2 * k, tile + 2 * k), dtype=np.int64)
        present = np.zeros(values.shape, dtype=bool)
        values[i, j] = pdf["v"].to_numpy()
        present[i, j] = True
        inner = present[k : tile + k, k : tile + k]
        oi, oj = np.nonzero(inner)
        # A strip of rows at a time keeps the pair stack small.
        strips = [
            window_texture(values[s : min(s + 16, tile) + 2 * k], present[s : min(s + 16, tile) + 2 * k], k) for s in range(0, tile, 16)
        ]
        out = {"prow": oi + top, "pcol": oj + left}
        for m in MEASURES:
            out[m] = np.concatenate([s[m] for s in strips])[oi, oj]
        return pd.DataFrame(out)

    schema = "prow int, pcol int, " + ", ".join(f"{m} double" for m in MEASURES)
    cells = spread.groupBy("ti", "tj").applyInPandas(one_tile, schema)
    return cells.select("prow", "pcol", *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in MEASURES])
