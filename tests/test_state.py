import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import generate, quality
from quillframe.sources import png, state_store


def test_state_document(spark, tmp_path):
    empty = state_store.load_state(spark, str(tmp_path / "none.json"))
    assert empty["styles"].first().style_text == "An erratic some-CAPS" and empty["settings"].first().active_style_id == "default" and empty["jobs"].count() == 0
    doc = {"active_style_id": "s1", "styles": {"s1": {"id": "s1", "name": "n", "path": "p", "style_text": None}}, "pairs": {}, "jobs": {"j": {"id": "j", "status": "queued", "cells": [{"id": "p0_c0", "page": 0, "bbox": [1, 2, 3, 4], "text": "x"}]}}}
    (tmp_path / "state.json").write_text(json.dumps(doc))
    tables = state_store.load_state(spark, str(tmp_path / "state.json"))
    assert {r.id: r.style_text for r in tables["styles"].collect()} == {"s1": "", "default": "An erratic some-CAPS"}
    assert tables["settings"].first().active_style_id == "default"
    row = state_store.snapshot(tables).first()
    assert row.jobs["j"].cells[0].bbox == [1, 2, 3, 4] and set(row.styles) == {"s1", "default"}
    state_store.save_state(tables, str(tmp_path / "log"))
    state_store.save_state(tables, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log" / "styles")).count() == 4
    again = state_store.load_state(spark, str(tmp_path / "log"))
    # The default style is as old as the plan that makes it.
    rows = lambda state: {t: sorted(map(str, df.drop("created_at").collect())) for t, df in state.items()}
    assert rows(again) == rows(tables)
    later = again | {"jobs": again["jobs"].withColumn("status", F.lit("done")), "settings": again["settings"].withColumn("active_style_id", F.lit("s1"))}
    state_store.save_state(later, str(tmp_path / "log"))
    last = state_store.load_state(spark, str(tmp_path / "log"))
    assert [r.status for r in last["jobs"].collect()] == ["done"] and last["settings"].first().active_style_id == "s1" and last["jobs"].columns == tables["jobs"].columns


def test_style_updates_fail_as_stated(spark):
    from quillframe.operators import state

    styles = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, style_text string")
    patch = lambda *rows: spark.createDataFrame(list(rows), "id string, style_text string")
    assert {r.id: r.style_text for r in state.update_style_texts(styles, patch(("a", " new "))).collect()} == {"a": "new", "b": "y"}
    for rows, fault in ((("a", "  "), "required"), (("a", None), "required"), (("zz", "t"), "no such id")):
        with pytest.raises(Exception, match=fault):
            state.update_style_texts(styles, patch(rows)).collect()
    settings = spark.createDataFrame([("a", "b"), ("a", None)], "active_style_id string, wanted string")
    assert sorted(r.active_style_id for r in state.activate(settings, styles).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="no such id"):
        state.activate(settings.withColumn("wanted", F.lit("zz")), styles).collect()


def test_registering(spark):
    pair = spark.createDataFrame([("a", b"t", b"s"), ("b", b"t", b"s")], "name string, template binary, synthetic binary")
    assert state_store.register_pairs(pair).select("id").distinct().count() == 1
    with pytest.raises(Exception, match="empty"):
        state_store.register_pairs(spark.createDataFrame([("a", b"", b"s")], pair.schema)).collect()
    with pytest.raises(Exception, match="required"):
        state_store.add_styles(spark.createDataFrame([("a", b"x", "  ")], "name string, content binary, style_text string")).collect()
    jobs = spark.createDataFrame([("p", "[]", 64, None, 5), ("p", "[]", None, None, None)], "pair_id string, cells string, max_new_tokens int, steps int, seed long")
    assert [r.max_new_tokens for r in state_store.create_jobs(jobs).collect()] == [64, 128]
    with pytest.raises(Exception, match="tokens"):
        state_store.create_jobs(jobs.withColumn("steps", F.lit(8))).collect()
    with pytest.raises(Exception, match="no such id"):
        state_store.by_id(spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1,), (2,)], "id int")).collect()


def test_prepared_styles(spark):
    ink = np.full((40, 90), 255, np.uint8)
    ink[10:30, 10:80] = 0
    rows = state_store.prepare_styles(spark.createDataFrame([("a", png.encode(ink)), ("b", b"no"), ("c", None)], "id string, content binary")).orderBy("id").collect()
    assert png.decode(bytes(rows[0].prepared)).shape[0] == 64 and rows[1].error == rows[2].error == "Invalid PNG"


def test_checked_lines(spark):
    """Later attempts are drawn for lines that fail only, with more tokens and the next seed; the best one stays."""

    def sampler():
        """Writes nothing until it gets enough tokens; the seed shows in the width."""

        def sample(text, tokens, seed):
            a = np.full((64, 300 + (seed or 0)), 255, np.uint8)
            if tokens >= 140 or text == "plain":
                a[20:40, 10:200] = 0
            elif text == "faint":
                a[20, 10 : 10 + tokens] = 0
            return a

        return sample

    rows = [(1, 0, "10000", 7), (1, 1, "ab", None), (1, 2, "plain", 5), (2, 0, "faint", 0)]
    lines = spark.createDataFrame(rows, "job_id long, i int, text string, seed long")
    got = {(r.job_id, r.i): (r.attempt, r.reason.split()[0], png.decode(bytes(r.image))) for r in generate.checked_lines(lines, sampler, ["job_id", "i"]).collect()}
    assert {k: v[:2] for k, v in got.items()} == {(1, 0): (1, "ok"), (1, 1): (0, "near_empty"), (1, 2): (0, "ok"), (2, 0): (1, "near_empty")}
    assert got[1, 0][2].shape[1] == 308 and got[1, 2][2].shape[1] == 305 and got[1, 0][2].min() <= 40
    assert generate.checked_lines(lines.limit(0), sampler, ["job_id", "i"]).count() == 0
    draw = lambda text, tokens, seed: np.full((64, 300), 255, np.uint8)
    assert generate.word_line(draw, ["a", "b"], 1).shape == (64, 608)
    assert generate.tile_line(draw, "ab").shape[0] <= 64


def test_checked_lines_take_attempts_in_order(spark):
    """Against trying one line after the other by the columns' plan."""
    r = np.random.default_rng(1)
    lines = spark.createDataFrame([(k, "".join(r.choice(list("0123456789a"), 6)), int(r.integers(0, 90))) for k in range(60)], "i int, text string, seed long")

    def make():
        def sample(text, tokens, seed):
            a, g = np.full((64, 320), 255, np.uint8), np.random.default_rng(seed * 1000 + tokens)
            a[: g.integers(1, 40), : g.integers(1, 120)] = 0
            return a

        return sample

    got = {x.i: x.attempt for x in generate.checked_lines(lines, make, ["i"]).collect()}
    plan = quality.retry_plan(lines.withColumn("ceiling", F.lit(128))).collect()
    rows = [(x.i, x.attempt, x.text, *generate.ink_of(make()(x.text, x.tokens, x.attempt_seed))) for x in plan]
    judged = quality.judge(spark.createDataFrame(rows, f"i int, attempt int, text string, {generate.INK}")).collect()
    for i, attempt in got.items():
        mine = sorted((x for x in judged if x.i == i), key=lambda x: x.attempt)
        kept = mine[0]
        for x in mine[1:]:
            if not kept.ok and (x.ok or x.n_ink / x.n_pixels * max(1, x.ink_w) > kept.n_ink / kept.n_pixels * max(1, kept.ink_w)):
                kept = x
        assert attempt == kept.attempt


def test_ink_of_an_array_is_the_pixels_ink(spark):
    """One array's ink against the operator over pixels."""
    from quillframe.operators import raster

    r = np.random.default_rng(0)
    images = [np.where(r.random((9, int(w))) < p, 0, 255).astype(np.uint8) for w, p in ((3, 0.5), (40, 0.1), (41, 0.0), (7, 1.0))]
    pixels = [(k, y, x, int(a[y, x])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    got = raster.ink_metrics(spark.createDataFrame(pixels, "img_id long, y int, x int, v int")).collect()
    assert {x.img_id: tuple(x)[1:] for x in got} == {k: generate.ink_of(a) for k, a in enumerate(images)}
