"""Quality rules of generated lines, token budgets and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import digit_heavy, visible_length

# Bounds of the token budget.
FLOOR, CEILING = 64, 256


def verdict(w: Column, n_pixels: Column, n_ink: Column, ink_w: Column, n_left: Column, nchar: Column) -> Column:
    """Why a line is bad, or `ok`: the first rule that fires."""
    dens = n_ink / n_pixels
    shown = F.format_string("%.4f", dens)
    return (
        F.when(dens < 0.008, F.concat(F.lit("near_empty dens="), shown))
        .when(n_ink == 0, "no_ink")
        .when(2 * ink_w < F.greatest(F.lit(48), 7 * F.least(nchar, F.lit(8))), F.concat(F.lit("too_narrow ink_w="), ink_w.cast("string"), F.lit(" nchar="), nchar.cast("string")))
        .when((w >= 400) & (dens < 0.04) & (100 * n_left > 85 * F.greatest(F.lit(1), n_ink)), F.concat(F.lit("left_truncated dens="), shown, F.lit(" w="), w.cast("string")))
        .when((w >= 700) & (dens < 0.035), F.concat(F.lit("sparse_wide dens="), shown, F.lit(" w="), w.cast("string")))
        .otherwise("ok")
    )


def judge(metrics: DataFrame, text: str = "text") -> DataFrame:
    """metrics with nchar, reason and ok."""
    reason = verdict(*[F.col(c) for c in ("w", "n_pixels", "n_ink", "ink_w", "n_left")], visible_length(text))
    return metrics.withColumn("nchar", visible_length(text)).withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok")


def line_tokens(ceiling: Column, text: Column) -> Column:
    """The floor holds against smaller ceilings too."""
    need = 16 + 12 * F.greatest(F.lit(1), F.length(text))
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), ceiling, need)).cast("int")


def first_tokens(ceiling: Column, text: Column) -> Column:
    """Texts of mostly digits start higher."""
    t = line_tokens(ceiling, text)
    return F.when(digit_heavy(text), F.least(F.lit(CEILING), F.greatest(t, F.least(ceiling, F.lit(96))))).otherwise(t).cast("int")


def next_tokens(t: Column) -> Column:
    return F.least(F.lit(CEILING), F.greatest(t + 32, F.floor(t * 3 / 2).cast("int"))).cast("int")


def attempts(text: Column) -> Column:
    """Attempts in all when the first one fails."""
    return F.when(digit_heavy(text), 3).otherwise(2)


def retry_plan(lines: DataFrame, ceiling: str = "ceiling", text: str = "text", seed: str = "seed") -> DataFrame:
    """One row for each attempt that a line may take: attempt (from 0), tokens, attempt_seed (null stays null)."""
    t0 = first_tokens(F.col(ceiling), F.col(text))
    plan = lines.withColumn("tokens", F.array(t0, next_tokens(t0), next_tokens(next_tokens(t0))))
    out = plan.select("*", F.posexplode(F.slice("tokens", F.lit(1), attempts(F.col(text)))).alias("attempt", "budget"))
    return out.drop("tokens").withColumnRenamed("budget", "tokens").withColumn("attempt_seed", F.col(seed) + F.col("attempt"))


def best_attempt(tried: DataFrame, key: list[str]) -> DataFrame:
    """Of each line's attempts in order, the one that stays: a later one replaces the kept one if it is ok or scores
    higher, and nothing follows one that is ok. Columns attempt, ok, score (density times ink width).

    What stays is the first ok attempt, or else the highest score, ties to the earlier.
    """
    order = F.struct(F.col("ok").cast("int").alias("fine"), F.when(F.col("ok"), -F.col("attempt")).otherwise(F.col("score")).alias("by"), (-F.col("attempt")).alias("early"), "score")
    best = tried.groupBy(*key).agg(F.max(order).alias("b"))
    return best.select(*key, (-F.col("b.early")).alias("attempt"), (F.col("b.fine") == 1).alias("ok"), F.col("b.score").alias("score"))


def failures(rules: DataFrame, key: str, rule: str = "rule") -> DataFrame:
    """(key, failures string): which rules failed and how often, by name; counted first, so that no group is gathered."""
    counted = rules.where(F.col(rule) != "ok").groupBy(key, rule).agg(F.count(F.lit(1)).alias("n"))
    each = F.concat_ws(" x ", F.col(rule), F.col("n").cast("string"))
    return counted.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(each)), ",").alias("failures"))
