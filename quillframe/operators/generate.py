"""Lines from a pluggable sampler: attempts planned and judged as rows, words side by side, tiles cropped.

A sampler is `sample(text, tokens, seed) -> gray array` (ink dark on white); its model is loaded once a partition, by
the function that makes it. Nothing here decides how many attempts there are or which one stays: that is the plan of
`quality.retry_plan`, the rules of `quality.judge` and the choice of `quality.best_attempt`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import WORD_LIMIT
from quillframe.sources import png

from . import kernels, quality, raster

Sampler = Callable[[str, int, int | None], np.ndarray]
#: Rounds of attempts: the plan never has more for a line.
ROUNDS = 3
INK = "w int, n_pixels long, n_ink long, ink_w int, n_left long"


def ink_of(gray: np.ndarray) -> tuple[int, int, int, int, int]:
    """The columns of raster.ink_metrics for one array."""
    dark = gray < raster.DARK
    columns = np.flatnonzero(dark.any(0))
    left = max(1, gray.shape[1] * 15 // 100)
    return gray.shape[1], dark.size, int(dark.sum()), int(np.ptp(columns)) + 1 if len(columns) else 0, int(dark[:, :left].sum())


def drawn(attempts: DataFrame, make: Callable[[], Sampler], key: list[str]) -> DataFrame:
    """attempts (key, attempt, text, tokens, attempt_seed) with image binary and its ink; make() is called once a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = make()
        for f in frames:
            grays = [sample(t, int(n), None if pd.isna(s) else int(s)) for t, n, s in zip(f.text, f.tokens, f.attempt_seed)]
            ink = pd.DataFrame([ink_of(g) for g in grays], columns=[c.split()[0] for c in INK.split(", ")])
            yield pd.concat([f.reset_index(drop=True), ink], axis=1).assign(image=[png.encode(kernels.thicken(g)) for g in grays])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema)
    return attempts.mapInPandas(run, f"{kinds}, {INK}, image binary")


def checked_lines(lines: DataFrame, make: Callable[[], Sampler], key: list[str], ceiling: int = 128) -> DataFrame:
    """lines (key, text, seed) with image binary, attempt and reason: the attempt that stays, its strokes thickened.

    A round draws the next attempt of every line that none was good enough for yet, so attempts that are not needed
    are never drawn. Texts are taken as they are; a null seed stays null.
    """
    plan = quality.retry_plan(lines.select(*key, "text", "seed", F.lit(ceiling).alias("ceiling"))).drop("ceiling", "seed")
    rounds: list[DataFrame] = []
    for k in range(ROUNDS):
        due = plan.where(F.col("attempt") == k)
        if rounds:
            due = due.join(rounds[-1].where(~F.col("ok")).select(*key), key, "left_semi")
        # Each round is drawn once; a lost executor costs drawing its part again, with the same seeds.
        rounds.append(quality.judge(drawn(due, make, key)).persist(StorageLevel.DISK_ONLY))
    tried = rounds[0].unionByName(rounds[1]).unionByName(rounds[2])
    scored = tried.withColumn("score", F.col("n_ink") / F.col("n_pixels") * F.greatest("ink_w", F.lit(1)))
    best = quality.best_attempt(scored, key).select(*key, "attempt")
    return lines.join(tried.join(best, [*key, "attempt"]).select(*key, "image", "attempt", "reason"), key)


def word_line(sample: Sampler, words: list[str], seed: int | None = None) -> np.ndarray:
    """Words, each sampled on its own up to the word limit, side by side; seeds follow the words' places."""
    cut = [w[:WORD_LIMIT] for w in words]
    seeds = [None] * len(cut) if seed is None else range(seed, seed + len(cut))
    return kernels.concat_words([sample(w, len(w), s) for w, s in zip(cut, seeds)])


def tile_line(sample: Sampler, text: str, seed: int | None = None) -> np.ndarray:
    """One tile of fixed width, cropped to the line."""
    return kernels.crop_line(sample(text, kernels.TILE_MOST // 8, seed), text)
