"""Pairs, styles and jobs as tables: jobs are an append-only event log whose latest rows are the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The default style's transcription and id, and the job's statuses in order.
DEFAULT_STYLE_TEXT, DEFAULT_STYLE = "An erratic some-CAPS", "default"
NEXT = {"queued": ["calling_modal", "error"], "calling_modal": ["stamping", "error"], "stamping": ["done", "error"]}


def content_id(content: Column, length: int = 10) -> Column:
    """An id that repeats for the same content, in place of a random one."""
    return F.substring(F.sha2(content, 256), 1, length)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last event, ties by all other columns; partial aggregation leaves one row a key and task."""
    rest = [c for c in events.columns if c not in (key, order)]
    s = events.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("s"))
    return s.select(key, F.col(f"s.{order}").alias(order), *[F.col(f"s.{c}").alias(c) for c in rest])


def merge_patches(events: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins for each column: the latest value that is not null."""
    cols = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(
        F.max(order).alias(order), *[F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in cols]
    )


def transitions(events: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """events with previous and valid: whether the status may follow the one before it."""
    previous = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    valid = F.when(F.col("previous").isNull(), F.col(status) == "queued").otherwise(F.lit(False))
    for before, after in NEXT.items():
        valid = F.when(F.col("previous") == before, F.col(status).isin(after)).otherwise(valid)
    return events.withColumn("previous", previous).withColumn("valid", valid)


def backfill_styles(styles: DataFrame) -> DataFrame:
    """Blank transcriptions: the default text for the default style, empty for others."""
    blank = F.trim(F.coalesce("style_text", F.lit(""))) == ""
    return styles.withColumn("style_text", F.when(blank, F.when(F.col("id") == DEFAULT_STYLE, DEFAULT_STYLE_TEXT).otherwise("")).otherwise(F.col("style_text")))


def active_style(settings: DataFrame, styles: DataFrame) -> DataFrame:
    """The setting's style, or the default one if the setting's has no transcription and the default has."""
    has = styles.select(F.col("id").alias("active_style_id"), (F.trim(F.coalesce("style_text", F.lit(""))) != "").alias("ready"))
    default = styles.where(F.col("id") == DEFAULT_STYLE).agg(F.coalesce(F.max(F.trim(F.coalesce("style_text", F.lit(""))) != ""), F.lit(False)).alias("default_ready"))
    out = settings.join(has, "active_style_id", "left").join(F.broadcast(default))  # one aggregated row
    use = F.col("default_ready") & ~F.coalesce("ready", F.lit(False))
    return out.select(*[c for c in settings.columns if c != "active_style_id"], F.when(use, DEFAULT_STYLE).otherwise(F.col("active_style_id")).alias("active_style_id"))


def style_image(styles: DataFrame, prepared: Column) -> DataFrame:
    return styles.withColumn("image_path", F.coalesce(F.when(prepared, F.col("prepared_path")), F.col("path")))


def job_tokens(steps: Column, max_new_tokens: Column) -> Column:
    """The older name wins where both are given; 128 where neither is."""
    return F.coalesce(steps, max_new_tokens, F.lit(128))


def enabled_lines(cells: DataFrame) -> DataFrame:
    """Cells to write, blank texts as one space; a missing flag counts as enabled."""
    blank = F.col("text").isNull() | (F.col("text") == "")
    return cells.where(F.coalesce("enabled", F.lit(True))).withColumn("text", F.when(blank, " ").otherwise(F.col("text")))


def override_cells(cells: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """cells with the columns that a patch sets (those not null) taken from it."""
    cols = [c for c in patches.columns if c not in key]
    p = patches.select(*key, *[F.col(c).alias(f"__{c}") for c in cols])
    return cells.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in cells.columns])


CELL = "struct<id:string,page:int,bbox:array<double>,text:string,enabled:boolean>"


def cells_to_json(cells: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, cells string): a job's cells as the JSON array of the interface, in order."""
    cell = F.struct("id", "page", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "enabled")
    kept = F.transform(F.array_sort(F.collect_list(F.struct(*order, cell.alias("cell")))), lambda c: c["cell"])
    return cells.groupBy(group).agg(F.to_json(kept).alias("cells"))


def cells_from_json(jobs: DataFrame, group: str, column: str = "cells") -> DataFrame:
    """Cells out of JSON: missing text is empty, a missing flag is enabled."""
    parsed = jobs.select(group, F.posexplode(F.from_json(column, f"array<{CELL}>")).alias("ord", "c"))
    box = lambda i, name: F.try_element_at("c.bbox", F.lit(i + 1)).alias(name)
    return parsed.select(
        group, "ord", "c.id", "c.page", *[box(i, k) for i, k in enumerate(("x0", "y0", "x1", "y1"))],
        F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"),
    )


def missing_files(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    return required.join(present, key, "left_anti")


def first_existing(candidates: DataFrame, present: DataFrame, group: str) -> DataFrame:
    """(group, path): the candidate of least priority that is present; null if none is."""
    there = candidates.join(present.select("path").withColumn("there", F.lit(True)), "path", "left")
    return there.groupBy(group).agg(F.min(F.when(F.col("there"), F.struct("priority", "path")))["path"].alias("path"))


def upsert_first(rows: DataFrame, newer: DataFrame, key: str, order: str) -> DataFrame:
    """newer rows before older ones, one for each key."""
    both = newer.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy("__new", order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def update_style_texts(styles: DataFrame, patches: DataFrame) -> DataFrame:
    """styles with the transcriptions of patches (id, style_text), stripped. A blank one fails, and so does an unknown id."""
    text = F.trim(F.coalesce("new_text", F.lit("")))
    given = patches.select(F.col("id").alias("of"), F.col("style_text").alias("new_text"), F.lit(True).alias("given"))
    both = styles.join(given, F.col("id") == F.col("of"), "full")
    fault = F.when(F.col("id").isNull(), F.concat(F.lit("no such id: "), "of")).when(F.col("given") & (text == ""), F.lit("style_text is required"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).when(F.col("given"), text).otherwise(F.col("style_text"))
    return both.withColumn("style_text", checked).where("coalesce(style_text, id) is not null").select(*styles.columns)


def activate(settings: DataFrame, styles: DataFrame, wanted: str = "wanted") -> DataFrame:
    """settings with the wanted style active (null: as it was); a style that is not there fails."""
    known = styles.select(F.col("id").alias("__id")).withColumn("__there", F.lit(True))
    out = settings.join(known, F.col(wanted) == F.col("__id"), "left")
    fault = F.col(wanted).isNotNull() & F.col("__there").isNull()
    chosen = F.when(fault, F.raise_error(F.concat(F.lit("no such id: "), wanted)).cast("string")).otherwise(F.coalesce(wanted, "active_style_id"))
    return out.withColumn("active_style_id", chosen).select(*settings.columns)


def cell_counts(cells: DataFrame, key: str) -> DataFrame:
    """(key, cells, enabled): a missing flag counts as enabled."""
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"))


def error_excerpt(error: Column, most: int = 800) -> Column:
    return F.substring(error, 1, most)


def upload_buckets(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, template, synthetic, upload, reset): where the two files of each pair stand after its events (side, action).

    A side is empty, pending with a file chosen, saving once both are chosen, stored once both are saved; only then is there an
    upload. reset: the last event chose or cleared a file, so that cells and jobs of the pair no longer count.
    """
    last = events.groupBy(key).agg(
        *[F.max(F.when(F.col("side") == s, F.struct(order, "action")))["action"].alias(f"last_{s}") for s in ("template", "synthetic")],
        F.max(F.struct(order, "action"))["action"].alias("last"),
    )
    chosen = lambda s: F.coalesce(F.col(f"last_{s}").isin("choose", "save"), F.lit(False))
    saved = lambda s: F.coalesce(F.col(f"last_{s}") == "save", F.lit(False))
    both = chosen("template") & chosen("synthetic")
    bucket = lambda s: F.when(~chosen(s), "empty").when(~both, "pending").when(saved(s), "stored").otherwise("saving").alias(s)
    return last.select(key, bucket("template"), bucket("synthetic"), (saved("template") & saved("synthetic")).alias("upload"), F.col("last").isin("choose", "clear").alias("reset"))
