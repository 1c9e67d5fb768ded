"""Finding filled fields: typed spans of a filled form are matched to places on its blank template.

Spans are rows (pair_id, page, ord, text, x0, y0, x1, y1, color); ord is the order of extraction, which all ties
follow. Every operator works on all pages of all pairs at once. What depends on a page as a whole is worked out on
the page's spans as one array: spans are dealt by (pair_id, page) once, and merging, anchors, occurrences and places on
the template follow in the same stage. A page, not a document, is the unit that is gathered; its text is normalised
span by span before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.geometry import field_rect, iou, is_blue, is_near_black, round_tenth
from quillframe.functions.text import HARD_LIMIT, SOFT_LIMIT, norm, sanitize_form, split_chunks

# Tolerances in points.
MERGE_GAP, ANCHOR_Y, ANCHOR_X, MATCH_TOL, LINE_GAP = 14.0, 8.0, 4.0, 3.0, 2.0
RECT = ("x0", "y0", "x1", "y1")
PAGE = ["pair_id", "page"]


def rect(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in RECT}


def shared_pages(synth_pages: DataFrame, tmpl_pages: DataFrame) -> DataFrame:
    """Pages that both documents of a pair have, with the template's rectangle."""
    return synth_pages.select(*PAGE).join(tmpl_pages, PAGE)


def blue_spans(spans: DataFrame) -> DataFrame:
    return spans.where(is_blue(F.col("color")) & (F.trim("text") != ""))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once a row: filters on them stay above, instead of repeating them below."""
    packed = F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", packed.alias("__once")).select(*df.columns, *[F.col(f"__once.{k}").alias(k) for k in columns])


def shown(c="text") -> Column:
    return F.trim(c) != ""


def merge_order() -> Column:
    return F.struct(round_tenth(F.col("y0")).alias("ry"), "x0", "ord", "y0", "x1", "y1", "text")


def label_item() -> Column:
    """A span that is not blue, as an element of its page's array."""
    return F.struct("y0", "x0", "ord", "x1", "y1", norm("text").alias("label"), shown().alias("shown"), is_near_black(F.col("color")).alias("black"), "text")


def continues(last: Column, s: Column) -> Column:
    same_line = (F.abs(s["y0"] - last["y0"]) < 4) & (F.abs(s["y1"] - last["y1"]) < 6)
    close = s["x0"] <= last["x1"] + MERGE_GAP
    stacked = (s["y0"] <= last["y1"] + 6) & (s["y0"] >= last["y0"] - 2) & ~((s["x1"] < last["x0"] - 4) | (s["x0"] > last["x1"] + 4))
    return (same_line & close) | stacked


def merged(pages: DataFrame, spans: str = "spans") -> DataFrame:
    """A row for each group of a page's sorted spans, with grp, its box and text; other columns of pages stay.

    In reading order each span joins the first group whose last member it continues, on the same line or stacked
    under it. That depends on the order, so a page is folded; the fold holds the last member of each group, and the
    group of each span so far.
    """
    of = {f.name: f.dataType for f in pages.schema}[spans].elementType.simpleString()
    start = F.struct(F.array().cast(f"array<{of}>").alias("last"), F.array().cast("array<int>").alias("grp"))

    def place(acc: Column, s: Column) -> Column:
        hit = F.array_position(F.transform(acc["last"], lambda g: continues(g, s)), True).cast("int")
        moved = F.transform(acc["last"], lambda g, i: F.when(i + 1 == hit, s).otherwise(g))
        return F.when(hit > 0, F.struct(moved.alias("last"), F.concat(acc["grp"], F.array(hit)).alias("grp"))).otherwise(
            F.struct(F.concat(acc["last"], F.array(s)).alias("last"), F.concat(acc["grp"], F.array((F.size(acc["last"]) + 1).cast("int"))).alias("grp"))
        )

    keep = [c for c in pages.columns if c != spans]
    folded = once(pages, fold=F.aggregate(spans, start, place))
    each = folded.select("*", F.arrays_zip(F.col(spans).alias("s"), F.col("fold.grp").alias("g")).alias("zipped"))
    own = F.filter("zipped", lambda z: z["g"] == F.col("grp") + 1)
    groups = each.select("*", F.posexplode_outer("fold.last").alias("grp", "__last")).where("grp is not null")
    groups = once(groups.select(*keep, "grp", "zipped"), members=F.transform(own, lambda z: z["s"])).drop("zipped")
    ordered = F.sort_array(F.transform("members", lambda m: F.struct(m["y0"], m["x0"], m["ord"], m["text"])))
    joined = F.array_join(F.transform(ordered, lambda m: m["text"]), " ")
    end = lambda f, k: f(F.transform("members", lambda m: m[k]))
    box = {k: end(F.array_min, k) - 1 for k in ("x0", "y0")} | {k: end(F.array_max, k) + 1 for k in ("x1", "y1")}
    groups = once(groups, **box, joined=joined).drop("members")
    return once(groups, text=sanitize_form("joined")).drop("joined").where("text <> ''")


def merge_spans(spans: DataFrame) -> DataFrame:
    """(pair_id, page, grp, x0, y0, x1, y1, text): adjacent spans merged into cells, by greedy first fit."""
    return merged(spans.groupBy(*PAGE).agg(F.sort_array(F.collect_list(merge_order())).alias("spans")))


def label_pages(spans: DataFrame) -> DataFrame:
    """(pair_id, page, labels): the spans of each page that are not blue."""
    labels = spans.where(~is_blue(F.col("color")))
    return labels.groupBy(*PAGE).agg(F.collect_list(label_item()).alias("labels"))


def anchored(fills: DataFrame, labels: str = "labels") -> DataFrame:
    """fills with anchor: the rightmost of the page's labels that is left of the fill and on its row, or null."""
    near = F.filter(
        labels, lambda s: s["shown"] & (F.abs(s["y0"] - F.col("y0")) <= ANCHOR_Y) & (s["x1"] < F.col("x0") - ANCHOR_X)
    )
    item = lambda s: F.struct(s["x1"], (-s["ord"]).alias("rank"), s["text"], s["label"], s["x0"], s["y0"], s["y1"])
    return once(fills, anchor=F.array_max(F.transform(near, item)))


def left_anchor(fills: DataFrame, spans: DataFrame, key: str = "grp") -> DataFrame:
    """Each fill with the rightmost span that is not blue, left of it and on its row; fills without one drop out."""
    found = anchored(fills.select(*PAGE, key, "x0", "y0").join(label_pages(spans), PAGE)).where("anchor is not null")
    return found.select(*PAGE, key, (-F.col("anchor.rank")).alias("a_ord"), F.col("anchor.text").alias("a_text"), *[F.col(f"anchor.{k}").alias(f"a_{k}") for k in RECT])


def occurrences(labels: Column, near_black_first: bool) -> Column:
    """Of equal labels, the occurrences from top to bottom: array<struct<y0,x0,ord,x1,y1>>.

    near_black_first: only near-black spans, unless there are none. Spans within 2 points of the last one kept are
    the same occurrence; that is a fold, as what is kept decides what follows.
    """
    item = lambda s: F.struct(s["y0"], s["x0"], s["ord"], s["x1"], s["y1"])
    black = F.filter(labels, lambda s: s["black"])
    chosen = F.when(F.size(black) > 0, black).otherwise(labels) if near_black_first else labels
    return F.aggregate(F.sort_array(F.transform(chosen, item)), F.array().cast("array<struct<y0:double,x0:double,ord:bigint,x1:double,y1:double>>"), keep_apart)


def label_instances(spans: DataFrame, near_black_first: bool) -> DataFrame:
    """(pair_id, page, label, i, x0, y0, x1, y1): the occurrences of each label of a page."""
    labels = spans.where(~is_blue(F.col("color"))).select(*PAGE, label_item().alias("s")).where("s.label <> ''")
    every = labels.groupBy(*PAGE, F.col("s.label").alias("label")).agg(F.collect_list("s").alias("same"))
    found = once(every, found=occurrences(F.col("same"), near_black_first))
    return found.select(*PAGE, "label", F.posexplode_outer("found").alias("i", "s")).select(*PAGE, "label", "i", *[F.col(f"s.{k}").alias(k) for k in RECT])


def keep_apart(kept: Column, s: Column) -> Column:
    # null for the empty array that the fold starts with
    last = F.try_element_at(kept, F.lit(-1))
    again = (F.abs(last["y0"] - s["y0"]) < 2) & (F.abs(last["x0"] - s["x0"]) < 2)
    return F.when(F.coalesce(again, F.lit(False)), kept).otherwise(F.concat(kept, F.array(s)))


def nearest(found: Column, x0: Column, y0: Column) -> Column:
    """The occurrence at a place, or the nearest by y, then x: struct<far,dy,dx,i,x0,y0>, null if there is none."""

    def item(s: Column, i: Column) -> Column:
        dy, dx = F.abs(s["y0"] - y0), F.abs(s["x0"] - x0)
        exact = (dy < MATCH_TOL) & (dx < MATCH_TOL)
        return F.struct((~exact).alias("far"), F.when(~exact, dy).alias("dy"), F.when(~exact, dx).alias("dx"), i.alias("i"), s["x0"].alias("x0"), s["y0"].alias("y0"))

    return F.array_min(F.transform(found, item))


def instance_index(anchors: DataFrame, instances: DataFrame, key: str = "grp") -> DataFrame:
    """(pair_id, page, key, label, i, s_x0, s_y0): the occurrence that an anchor is, or the nearest by y, then x."""
    a = anchors.withColumn("label", norm("a_text")).where("label <> ''").select(*PAGE, key, "label", "a_x0", "a_y0")
    found = instances.groupBy(*PAGE, "label").agg(F.sort_array(F.collect_list(F.struct("i", "x0", "y0"))).alias("found"))
    m = nearest(F.col("found"), F.col("a_x0"), F.col("a_y0"))
    return once(a.join(found, [*PAGE, "label"]), m=m).select(*PAGE, key, "label", F.col("m.i").alias("i"), F.col("m.x0").alias("s_x0"), F.col("m.y0").alias("s_y0"))


def placed(fills: DataFrame, tmpl: DataFrame, pages: DataFrame) -> DataFrame:
    """fills (with labels, their page's array) of the shared pages with label, and field: the rectangle on the template, or null.

    A fill goes to its label's occurrence on the template that has the number of its anchor among the occurrences on its own page, moved by the
    labels' distance. label is null without an anchor, and empty for one of which nothing is left when it is normalised.
    """
    there = pages.select(*PAGE, F.col("x0").alias("p_x0"), F.col("x1").alias("p_x1")).join(label_pages(tmpl).withColumnRenamed("labels", "t_labels"), PAGE, "left")
    found = anchored(fills.join(there, PAGE)).withColumn("label", F.col("anchor.label"))
    same = lambda c: F.filter(c, lambda s: s["label"] == F.col("label"))
    found = once(found, mine=occurrences(same("labels"), False))
    found = once(found, at=F.when(F.col("label") != "", nearest(F.col("mine"), F.col("anchor.x0"), F.col("anchor.y0"))))
    found = once(found, theirs=same(F.coalesce("t_labels", F.array().cast(found.schema["t_labels"].dataType))))
    found = once(found, to=F.when(F.col("label") != "", F.get(occurrences(F.col("theirs"), True), F.col("at.i"))))
    dx, dy = F.col("to.x0") - F.col("at.x0"), F.col("to.y0") - F.col("at.y0")
    moved = {"x0": F.col("x0") + dx, "y0": F.col("y0") + dy, "x1": F.col("x1") + dx, "y1": F.col("y1") + dy}
    field = field_rect(moved, F.col("to.y1") - F.col("to.y0"), F.col("p_x0"), F.col("p_x1"))
    box = F.when(F.col("to").isNotNull(), F.struct(*[v.alias(k) for k, v in field.items()]))
    return found.drop("labels", "t_labels", "anchor", "mine", "theirs").withColumn("field", box)


def fields_of(placed_fills: DataFrame, key: str = "grp") -> DataFrame:
    return placed_fills.where("to is not null").select(*PAGE, key, "text", *[F.col(f"field.{k}").alias(k) for k in RECT])


def map_to_template(fills: DataFrame, synth: DataFrame, tmpl: DataFrame, pages: DataFrame, key: str = "grp") -> DataFrame:
    """Each fill at its place on the template; fills without an anchor or a counterpart drop out."""
    return fields_of(placed(fills.select(*PAGE, key, "text", *RECT).join(label_pages(synth), PAGE), tmpl, pages), key)


def emit_cells(fields: DataFrame, order: str = "grp") -> DataFrame:
    """(pair_id, page, order, part, x0, y0, x1, y1, text): fields as cells of bounded text, stacked where it was split.

    Texts over 48 characters and rectangles under 2 points give no cell.
    """
    height = F.col("y1") - F.col("y0")
    usable = fields.where((F.col("text") != "") & (F.col("x1") - F.col("x0") >= 2) & (height >= 2) & (F.length("text") <= HARD_LIMIT))
    split = once(usable, chunks=split_chunks("text")).withColumn("n", F.size("chunks"))
    stacks = (F.col("n") > 1) & (height >= F.col("n") * 10.0 + (F.col("n") - 1) * LINE_GAP)
    whole = F.when(F.length("text") <= SOFT_LIMIT, F.col("text")).otherwise(F.rtrim(F.substring("text", 1, SOFT_LIMIT)))
    parts = once(split, parts=F.when(stacks, F.col("chunks")).otherwise(F.array(whole))).withColumn("n", F.size("parts"))
    line = (height - (F.col("n") - 1) * LINE_GAP) / F.col("n")
    top = F.when(F.col("n") == 1, F.col("y0")).otherwise(F.col("y0") + F.col("part") * (line + LINE_GAP))
    return parts.select("*", F.posexplode_outer("parts").alias("part", "piece")).select(
        *PAGE, order, "part", "x0", top.alias("y0"), "x1", F.when(F.col("n") == 1, F.col("y1")).otherwise(top + line).alias("y1"), F.col("piece").alias("text")
    )


def dedupe_cells(cells: DataFrame, order: list[str]) -> DataFrame:
    """The first of cells with the same page, rounded rectangle (half to even) and text."""
    w = Window.partitionBy(*PAGE, *[F.rint(k) for k in RECT], "text").orderBy(*order)
    return cells.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def number_cells(cells: DataFrame, order: list[str]) -> DataFrame:
    """cells with id `p{page}_c{i}`, i counted over all pages of a pair."""
    w = Window.partitionBy("pair_id").orderBy("page", *order)
    return cells.withColumn("id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_c"), (F.row_number().over(w) - 1).cast("string")))


def placed_fills(synth: DataFrame, tmpl: DataFrame, pages: DataFrame) -> DataFrame:
    """The merged fills of the shared pages, with label and field as `placed` has them; spans are dealt by page once."""
    blue = is_blue(F.col("color"))
    fill, label = F.when(blue & shown(), merge_order()), F.when(~blue, label_item())
    whole = synth.groupBy(*PAGE).agg(F.sort_array(F.collect_list(fill)).alias("spans"), F.collect_list(label).alias("labels"))
    return placed(merged(whole).where("x1 - x0 >= 2 and y1 - y0 >= 2"), tmpl, pages)


def detect_cells(synth: DataFrame, tmpl: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, page, id, x0, y0, x1, y1, text, enabled): the cells to write on each template."""
    cells = dedupe_cells(emit_cells(fields_of(placed_fills(synth, tmpl, pages))), ["grp", "part"])
    return number_cells(cells, ["grp", "part"]).select(*PAGE, "id", *RECT, "text", F.lit(True).alias("enabled"))


def diff_stats(synth: DataFrame, tmpl: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, page, merged, kept, skipped_no_anchor, skipped_overflow) of each shared page."""
    has_label, has_field = F.coalesce(F.col("label") != "", F.lit(False)), F.col("to").isNotNull()
    stats = placed_fills(synth, tmpl, pages).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("merged"), F.count_if(has_field).alias("kept"), F.count_if(~has_label).alias("skipped_no_anchor"),
        F.count_if(has_label & ~has_field).alias("skipped_overflow"),
    )
    return pages.select(*PAGE).join(stats, PAGE, "left").fillna(0, ["merged", "kept", "skipped_no_anchor", "skipped_overflow"])


def template_has_match(synth: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Spans of synth that the template already shows: same text near by, or boxes that overlap enough."""
    s = synth.select(*PAGE, "ord", norm("text").alias("sn"), *[F.col(k).alias(f"s_{k}") for k in RECT])
    t = tmpl.select(*PAGE, norm("text").alias("tn"), *RECT).where("tn <> ''")
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    dx, dy = mid("x0", "x1") - mid("s_x0", "s_x1"), mid("y0", "y1") - mid("s_y0", "s_y1")
    over = iou(rect("s_"), rect())
    close = (F.col("sn") == F.col("tn")) & (dx * dx + dy * dy < 24.0 * 24.0)
    overlap = (over >= 0.15) & (F.contains("tn", "sn") | F.contains("sn", "tn"))
    # Matches lie within a band of 64 points of y, so a page is joined by bands, not as a product.
    band = lambda y: F.floor(y / 64).cast("long")
    sb = s.where("sn <> ''").withColumn("band", F.explode(F.sequence(band(F.col("s_y0")) - 1, band(F.col("s_y1")) + 1)))
    tb = t.withColumn("band", F.explode(F.sequence(band(F.col("y0")), F.greatest(band(F.col("y0")), band(F.col("y1"))))))
    hit = sb.join(tb, [*PAGE, "band"]).where(close | overlap | (over >= 0.35)).select(*PAGE, "ord").distinct()
    return hit.unionByName(s.where("sn = ''").select(*PAGE, "ord"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, page, s_ord, t_ord, iou) of the boxes of a page that overlap: joined by bands of y, each pair in the band where its overlap begins."""
    band = lambda y: F.floor(y / 64).cast("long")
    bands = lambda a, b: F.explode(F.sequence(band(F.col(a)), F.greatest(band(F.col(a)), band(F.col(b)))))
    s = left.select(*PAGE, F.col("ord").alias("s_ord"), *[F.col(k).alias(f"s_{k}") for k in RECT]).withColumn("band", bands("s_y0", "s_y1"))
    t = right.select(*PAGE, F.col("ord").alias("t_ord"), *RECT).withColumn("band", bands("y0", "y1"))
    first = band(F.greatest("s_y0", "y0")) == F.col("band")
    return s.join(t, [*PAGE, "band"]).where(first).select(*PAGE, "s_ord", "t_ord", iou(rect("s_"), rect()).alias("iou")).where("iou > 0")
