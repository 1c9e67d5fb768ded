"""Queries of the form operators over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import geometry as G
from quillframe.functions import text as T
from quillframe.operators import batch, detect, kernels, quality, raster, state
from quillframe.sources import pairs, sinks

from . import oracles
from .fixtures import Inputs

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def color_classify(i: Inputs) -> DataFrame:
    c = F.col("color")
    spans = i.synth().unionByName(i.tmpl())
    return spans.groupBy(
        "color", G.is_blue(c).alias("is_blue"), G.is_near_black(c).alias("is_near_black"),
        F.shiftright(c, 16).bitwiseAND(255).alias("r"), F.shiftright(c, 8).bitwiseAND(255).alias("g"), c.bitwiseAND(255).alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def blue_fills(i: Inputs) -> DataFrame:
    return detect.blue_spans(i.synth())


def _texts(name: str, f) -> None:
    QUERIES[name] = lambda i: i.texts().select("id", f("text").alias("out"))


for _n, _f in (
    ("sanitize_form", T.sanitize_form), ("sanitize_line", T.sanitize_line), ("sanitize_word", T.sanitize_word), ("sanitize_tile", T.sanitize_tile),
    ("norm_labels", T.norm), ("strip_thousands", T.strip_thousands), ("rewrite_scientific", T.rewrite_scientific),
    ("digit_heavy", lambda c: T.digit_heavy(T.sanitize_line(c))), ("visible_length", T.visible_length), ("safe_name", T.safe_name), ("basename", T.basename),
    ("split_chunks", lambda c: F.array_join(T.split_chunks(T.sanitize_form(c)), "|")), ("word_chunks", lambda c: F.array_join(T.word_chunks(c), "|")),
):
    _texts(_n, _f)


@query
def left_anchor(i: Inputs) -> DataFrame:
    return detect.left_anchor(detect.blue_spans(i.synth()), i.synth(), "ord")


@query
def label_instances(i: Inputs) -> DataFrame:
    return detect.label_instances(i.tmpl(), True)


@query
def instance_index(i: Inputs) -> DataFrame:
    anchors = detect.left_anchor(detect.blue_spans(i.synth()), i.synth(), "ord")
    return detect.instance_index(anchors, detect.label_instances(i.synth(), False), "ord").select("pair_id", "page", "ord", "label", "i")


@query
def map_to_template(i: Inputs) -> DataFrame:
    return detect.map_to_template(detect.blue_spans(i.synth()), i.synth(), i.tmpl(), i.pages(), "ord")


@query
def merge_spans(i: Inputs) -> DataFrame:
    return detect.merge_spans(detect.blue_spans(i.synth()))


@query
def emit_cells(i: Inputs) -> DataFrame:
    tall = F.col("y0") + F.when(F.col("ord") % 4 == 0, 40).otherwise(F.col("ord") % 12)
    text = F.concat_ws(" ", F.col("text"), F.when(F.col("ord") % 3 == 0, F.lpad(F.col("pair_id").cast("string"), 30, "ab cd/ef ")))
    return detect.emit_cells(i.synth().withColumn("y1", tall).withColumn("text", text), "ord")


@query
def dedupe_cells(i: Inputs) -> DataFrame:
    shifted = i.synth().unionByName(i.synth().withColumn("x0", F.col("x0") + 0.5).withColumn("y0", F.col("y0") - 0.5).withColumn("ord", F.col("ord") + 100000))
    return detect.dedupe_cells(shifted, ["ord"])


@query
def cell_ids(i: Inputs) -> DataFrame:
    return detect.number_cells(i.synth(), ["ord"]).select("pair_id", "page", "ord", "id")


@query
def detect_cells(i: Inputs) -> DataFrame:
    return detect.detect_cells(i.synth(), i.tmpl(), i.pages())


@query
def diff_stats(i: Inputs) -> DataFrame:
    return detect.diff_stats(i.synth(), i.tmpl(), i.pages())


@query
def shared_pages(i: Inputs) -> DataFrame:
    return detect.shared_pages(i.synth().select("pair_id", "page").distinct(), i.pages().join(i.tmpl().select("pair_id", "page").distinct(), ["pair_id", "page"]))


@query
def template_has_match(i: Inputs) -> DataFrame:
    return detect.template_has_match(i.synth(), i.tmpl())


@query
def iou_pairs(i: Inputs) -> DataFrame:
    return detect.overlaps(i.synth(), i.tmpl())


@query
def overlay_rects(i: Inputs) -> DataFrame:
    cells = i.synth().withColumn("id", F.concat(F.lit("c"), F.col("ord").cast("string"))).withColumn("enabled", F.col("ord") % 5 != 0)
    return sinks.overlay_rects(cells)


@query
def stamp_layout(i: Inputs) -> DataFrame:
    cell = {k: F.col(k) for k in detect.RECT}
    w, h = 20 + (F.col("ord") * 37 + F.col("pair_id")) % 700, 8 + F.col("pair_id") % 60
    return i.synth().select("pair_id", "page", "ord", *[v.alias(k) for k, v in G.stamp_layout(cell, w, h).items()])


@query
def pair_listing(i: Inputs) -> DataFrame:
    n = i.table("supplier").select(F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, "_TEMPLATE.pdf").when(F.col("s_suppkey") % 3 == 1, "_B_TEMPLATE.pdf").otherwise(".pdf")).alias("name"))
    c = i.table("customer").select(
        F.concat(F.lit("Supplier#"), F.lpad(((F.col("c_custkey") % 100) + 1).cast("string"), 9, "0"), F.when(F.col("c_custkey") % 2 == 0, "_B_").otherwise("_"), F.col("c_custkey").cast("string"),
                 F.when(F.col("c_custkey") % 7 == 0, ".PDF").otherwise("_EXECUTED_synthetic.pdf")).alias("name"))
    return pairs.match_pairs(n.unionByName(c))


@query
def pdf_names(i: Inputs) -> DataFrame:
    c = i.table("customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".PDF").when(F.col("c_custkey") % 3 == 0, ".pdf").otherwise(".png")).alias("name"))
    return c.where(pairs.is_pdf(F.col("name")))


@query
def invert_dark(i: Inputs) -> DataFrame:
    return raster.invert_dark(i.pixels())


@query
def row_profile(i: Inputs) -> DataFrame:
    return raster.row_profile(i.pixels())


@query
def column_profile(i: Inputs) -> DataFrame:
    return raster.column_profile(i.pixels())


@query
def smooth_profile(i: Inputs) -> DataFrame:
    return raster.smooth_profile(raster.row_profile(i.pixels()))


@query
def densest_band(i: Inputs) -> DataFrame:
    return raster.densest_band(i.pixels())


@query
def ink_bbox(i: Inputs) -> DataFrame:
    return raster.ink_bbox(i.pixels())


@query
def crop_extent(i: Inputs) -> DataFrame:
    return raster.crop_extent(i.pixels())


@query
def densest_window(i: Inputs) -> DataFrame:
    return raster.densest_window(i.pixels(), 16)


@query
def ink_metrics(i: Inputs) -> DataFrame:
    return raster.ink_metrics(i.pixels())


@query
def qa_verdict(i: Inputs) -> DataFrame:
    n_left = F.floor(F.col("n_ink") * F.col("left_pct") / 100).cast("long")
    m = i.metrics()
    reason = quality.verdict(m["w"], m["n_pixels"], m["n_ink"], m["ink_w"], n_left, m["nchar"])
    return m.select("id", "pk", "sk", F.regexp_extract(reason, "^[a-z_]+", 0).alias("rule"), (reason == "ok").alias("ok"))


@query
def alpha_lut(i: Inputs) -> DataFrame:
    return i.spark.range(256).select(F.col("id").cast("int").alias("v"), G.ink_alpha(F.col("id")).alias("alpha"))


@query
def token_budget(i: Inputs) -> DataFrame:
    t = i.texts().select("id", T.sanitize_line("text").alias("text"), (16 + F.col("id") % 241).cast("int").alias("ceiling"))
    return t.select("id", quality.line_tokens(F.col("ceiling"), F.col("text")).alias("line"), quality.first_tokens(F.col("ceiling"), F.col("text")).alias("first"))


@query
def retry_plan(i: Inputs) -> DataFrame:
    t = i.texts().select("id", T.sanitize_line("text").alias("text"), (16 + F.col("id") % 241).cast("int").alias("ceiling"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("seed"))
    return quality.retry_plan(t).select("id", "attempt", "tokens", "attempt_seed")


@query
def best_attempt(i: Inputs) -> DataFrame:
    m = i.metrics().select((F.col("id") % 1000 * 1000 + F.col("pk") % 1000).alias("line"), "id", "pk", "sk", "n_ink", "n_pixels", "ink_w")
    tried = m.groupBy("line").agg(F.sum("n_ink").alias("a"), F.sum("ink_w").alias("b"), F.sum("sk").alias("c"))
    rows = tried.select("line", F.posexplode(F.array("a", "b", "c")).alias("attempt", "score")).withColumn("ok", (F.col("score") + F.col("attempt")) % 4 == 0)
    return quality.best_attempt(rows, ["line"])


@query
def line_scores(i: Inputs) -> DataFrame:
    m = i.metrics()
    return m.select("id", "pk", "sk", (m["n_ink"] / m["n_pixels"] * F.greatest(m["ink_w"], F.lit(1))).alias("score"))


@query
def failure_list(i: Inputs) -> DataFrame:
    m = i.metrics()
    reason = quality.verdict(m["w"], m["n_pixels"], m["n_ink"], m["ink_w"], F.lit(0), m["nchar"])
    return quality.failures(m.select((m["pk"] % 100).alias("job"), F.regexp_extract(reason, "^[a-z_]+", 0).alias("rule")), "job")


@query
def batch_chunks(i: Inputs) -> DataFrame:
    return batch.chunked(i.lines(), workers=3).select("job_id", "i", "chunk_id", "start", "pos", batch.line_seed(F.col("seed"), F.col("start"), F.col("pos")).alias("line_seed"))


def _letters(frames):
    for f in frames:
        yield f.assign(image=[kernels.block_letters(t, None if s != s or s is None else int(s)) for t, s in zip(f.text, f.line_seed)])[["job_id", "i", "image"]]


@query
def generate_gather(i: Inputs) -> DataFrame:
    from quillframe.sources.png import width_height

    done = batch.generate(i.lines(), _letters, "job_id long, i int, image binary")
    w, h = width_height(F.col("image"))
    return done.select("job_id", "i", "text", w.alias("w"), h.alias("h"))


@query
def zip_cells(i: Inputs) -> DataFrame:
    cells = detect.blue_spans(i.synth()).select(F.col("pair_id").alias("job_id"), (F.col("page") * 100000 + F.col("ord")).alias("ord"), F.col("text").alias("cell"))
    return batch.zip_by_position(cells, i.lines().select("job_id", "i", F.col("text").alias("line")), "job_id", "ord", "i")


@query
def valley_crop(i: Inputs) -> DataFrame:
    return raster.valley_crop(i.pixels(), 2)


@query
def thicken_ink(i: Inputs) -> DataFrame:
    return raster.thicken(i.pixels())


@query
def ink_edges(i: Inputs) -> DataFrame:
    return raster.laplacian(i.pixels())


@query
def job_latest(i: Inputs) -> DataFrame:
    return state.latest(i.jobs(), "job_id", "seq")


@query
def job_patches(i: Inputs) -> DataFrame:
    return state.merge_patches(i.jobs(), "job_id", "seq")


@query
def job_transitions(i: Inputs) -> DataFrame:
    return state.transitions(i.jobs().withColumn("status", F.when((F.col("job_id") % 7 == 0) & (F.col("seq") == 1), "done").otherwise(F.col("status"))), "job_id", "seq").select("job_id", "seq", "status", "previous", "valid")


def _styles(i: Inputs) -> DataFrame:
    c = i.table("customer")
    sid = F.when(F.col("c_custkey") == 1, "default").otherwise(F.concat(F.lit("s"), F.col("c_custkey").cast("string")))
    return c.select(sid.alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "  ").alias("style_text"),
                    F.concat(F.lit("raw/"), "c_name").alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("prepared/"), "c_name")).alias("prepared_path"))


@query
def style_backfill(i: Inputs) -> DataFrame:
    return state.backfill_styles(_styles(i)).select("id", "style_text")


@query
def active_style(i: Inputs) -> DataFrame:
    settings = i.table("customer").select("c_custkey", F.concat(F.lit("s"), (F.col("c_custkey") % 500).cast("string")).alias("active_style_id"))
    return state.active_style(settings, state.backfill_styles(_styles(i)))


@query
def style_image(i: Inputs) -> DataFrame:
    return state.style_image(_styles(i), F.lit(True)).select("id", "image_path")


@query
def style_upsert(i: Inputs) -> DataFrame:
    c = i.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    newer = c.where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.upper("c_name"))
    return state.upsert_first(c, newer, "c_custkey", "c_nationkey").select("c_custkey", "c_name")


@query
def job_tokens(i: Inputs) -> DataFrame:
    o = i.table("orders")
    steps = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 200).cast("int"))
    tokens = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 200).cast("int"))
    return o.select("o_orderkey", state.job_tokens(steps, tokens).alias("tokens"))


@query
def content_ids(i: Inputs) -> DataFrame:
    return i.table("part").select("p_partkey", state.content_id(F.col("p_name").cast("binary"), 12).alias("id"))


def _cells(i: Inputs) -> DataFrame:
    return i.synth().select(
        "pair_id", "page", "ord", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_c"), F.col("ord").cast("string")).alias("id"), *detect.RECT,
        F.when(F.col("ord") % 11 != 0, F.col("text")).alias("text"), F.when(F.col("ord") % 4 != 0, F.col("ord") % 3 != 0).alias("enabled"),
    )


@query
def enabled_lines(i: Inputs) -> DataFrame:
    return state.enabled_lines(_cells(i)).select("pair_id", "id", "text")


@query
def cell_overrides(i: Inputs) -> DataFrame:
    patches = _cells(i).where("x0 >= 160").select("pair_id", "id", F.upper("text").alias("text"), F.when(F.col("page") == 0, F.lit(False)).alias("enabled"))
    return state.override_cells(_cells(i), patches, ["pair_id", "id"]).select("pair_id", "id", "text", "enabled")


@query
def cells_json(i: Inputs) -> DataFrame:
    jobs = state.cells_to_json(_cells(i), "pair_id", ["page", "ord"])
    return state.cells_from_json(jobs, "pair_id").select("pair_id", "ord", "id", "page", *detect.RECT, "text", "enabled")


@query
def missing_files(i: Inputs) -> DataFrame:
    p = i.table("part").select(F.concat_ws("/", "p_brand", "p_name").alias("name"), "p_partkey", "p_size")
    return state.missing_files(p, p.where("p_size > 20 and p_partkey % 3 = 0").select("name").distinct(), ["name"])


@query
def style_updates(i: Inputs) -> DataFrame:
    styles = state.backfill_styles(_styles(i))
    patches = i.table("customer").where("c_custkey % 5 = 2").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit(" ")).alias("style_text"))
    return state.update_style_texts(styles, patches).select("id", "style_text")


@query
def style_activation(i: Inputs) -> DataFrame:
    c = i.table("customer").where("c_custkey > 1")
    settings = c.select("c_custkey", F.lit("default").alias("active_style_id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("s"), F.col("c_custkey").cast("string"))).alias("wanted"))
    return state.activate(settings, _styles(i)).select("c_custkey", "active_style_id")


@query
def upload_buckets(i: Inputs) -> DataFrame:
    e = i.table("events")
    side = F.when(F.col("event_id") % 2 == 0, "template").otherwise("synthetic")
    action = F.when(F.col("event_id") % 7 < 3, "choose").when(F.col("event_id") % 7 < 6, "save").otherwise("clear")
    return state.upload_buckets(e.select("user_id", "event_id", side.alias("side"), action.alias("action")), "user_id", "event_id")


@query
def cell_counts(i: Inputs) -> DataFrame:
    return state.cell_counts(_cells(i), "pair_id")


@query
def error_excerpt(i: Inputs) -> DataFrame:
    return i.jobs().select("job_id", "seq", state.error_excerpt(F.repeat("error", F.lit(90))).alias("shown"))


@query
def first_existing(i: Inputs) -> DataFrame:
    c = i.table("customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("priority"), F.col("c_name").alias("path"), "c_acctbal")
    return state.first_existing(c.drop("c_acctbal"), c.where("c_acctbal < 0").select("path"), "grp")


@query
def job_previews(i: Inputs) -> DataFrame:
    return sinks.preview_names(i.lines().withColumn("i", F.col("i").cast("int"))).select("job_id", "i", "file")


@query
def glyph_lookup(i: Inputs) -> DataFrame:
    glyphs = i.table("nation").select(F.chr(F.lit(97) + F.col("n_nationkey") % 26).alias("ch"), F.col("n_nationkey").alias("glyph"))
    chars = i.table("part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("pos", "ch")).where("ch <> ''")
    return chars.join(F.broadcast(glyphs), "ch", "left").select("p_partkey", "pos", "ch", "glyph")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in QUERIES}
