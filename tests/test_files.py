import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import batch, detect, kernels
from quillframe.sources import pairs, pdf, png, sinks
from quillframe.streaming.status import job_status_stream


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 2), (5, 7, 3), (5, 7, 4), (1, 1)])
def test_png_round_trip(shape):
    a = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    assert (png.decode(png.encode(a)) == a).all()


def test_png_faults(spark):
    with pytest.raises(ValueError):
        png.decode(b"no picture")
    df = spark.createDataFrame([(png.encode(np.zeros((3, 9), np.uint8)),), (b"x",), (None,)], "c binary").select("c", png.png_decode("c").alias("p"), png.width_height(F.col("c"))[0].alias("w"))
    got = df.collect()
    assert (got[0].p.h, got[0].p.w, got[0].w) == (3, 9, 9) and got[1].p.h is None


def document(labels):
    return pdf.write_simple([[(40, 50 + 30 * i, 10, t, (0, 0, 0)) for i, t in enumerate(labels)]])


def test_pdf_spans_and_stamp(tmp_path, spark):
    doc = pdf.write_simple([[(40, 100, 10, "Name (full)", (0, 0, 0)), (160, 100, 10, "Ada", (37 / 255, 99 / 255, 235 / 255))], [(10, 20, 8, "two", (0, 0, 0))]])
    s = pdf.spans(doc)
    assert [(x[0], x[2], x[7]) for x in s] == [(0, "Name (full)", 0), (0, "Ada", 2450411), (1, "two", 0)]
    assert abs(s[0][3] - 40) < 0.01 and abs(s[0][6] - 102) < 0.01
    out = pdf.stamp(doc, [(0, (10, 10, 50, 30), np.full((4, 8, 4), 128, np.uint8))])
    assert out.startswith(doc) and [x[2] for x in pdf.spans(out)] == ["Name (full)", "Ada", "two"] and b"/SMask" in out
    (tmp_path / "a.pdf").write_bytes(doc)
    assert pdf.read_spans(spark, str(tmp_path)).count() == 3
    spark.dataSource.register(pdf.PdfSpans)
    assert spark.read.format("pdf_spans").load(str(tmp_path)).count() == 3
    assert pairs.list_files(spark, str(tmp_path / "none")).count() == 0


def test_pdf_object_streams_and_composite_fonts():
    """Pages and fonts in an object stream, two-byte codes with ToUnicode ranges, widths of both kinds; later objects win."""
    import zlib

    cmap = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00E9> <00660069>] endbfrange"
    text = b"BT 0 0 1 rg /F0 10 Tf 1 0 0 1 40 700 Tm <00100011000300200021> Tj ET"
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 9 0 R/Resources<</Font<</F0 4 0 R>>>>>>",
             4: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[5 0 R]/ToUnicode 8 0 R>>", 5: b"<</Type/Font/Subtype/CIDFontType2/DW 500/W[16 [600 700] 32 33 800]>>"}
    body, head = b"", []
    for n, b in inner.items():
        head.append(b"%d %d" % (n, len(body)))
        body += b + b" "
    first = b" ".join(head) + b" "
    pack = lambda raw, extra=b"": b"<<%s/Filter/FlateDecode/Length 1>>\nstream\n%s\nendstream" % (extra, zlib.compress(raw))
    objs = {9: pack(text), 8: pack(cmap), 7: pack(first + body, b"/Type/ObjStm/N 5/First %d" % len(first))}
    doc = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objs.items())
    ((page, order, shown, x0, y0, x1, y1, color),) = pdf.spans(doc)
    assert (page, order, shown, color) == (0, 0, "AB éfi", 255) and abs(x0 - 40) < 1e-6 and abs(x1 - (40 + 10 * (0.6 + 0.7 + 0.5 + 0.8 + 0.8))) < 1e-6
    later = doc + b"9 0 obj\n%s\nendobj\n" % pack(text.replace(b"<00100011000300200021>", b"<0012>"))
    assert [s[2] for s in pdf.spans(later)] == ["C"] and pdf.page_rects(doc) == [(0.0, 0.0, 612.0, 792.0)]


def test_detect_from_files(spark, tmp_path):
    blue = (37 / 255, 99 / 255, 235 / 255)
    filled = pdf.write_simple([[(40, 100, 10, "Name", (0, 0, 0)), (160, 100, 10, "Ada", blue), (40, 140, 10, "Name", (0, 0, 0)), (160, 140, 10, "Bob", blue)]])
    blank = pdf.write_simple([[(45, 105, 10, "Name", (0, 0, 0)), (45, 145, 10, "Name", (0, 0, 0))]])
    kind = "pair_id long, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, color int"
    frame = lambda d: spark.createDataFrame([(1, *s) for s in pdf.spans(d)], kind)
    pages = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(pdf.page_rects(blank))], "pair_id long, page int, x0 double, y0 double, x1 double, y1 double")
    cells = detect.detect_cells(frame(filled), frame(blank), pages).orderBy("id").collect()
    assert [(c.id, c.text) for c in cells] == [("p0_c0", "Ada"), ("p0_c1", "Bob")] and abs(cells[0].x0 - 164) < 0.01
    template = spark.createDataFrame([(1, blank)], "pair_id long, content binary")
    image = kernels.block_letters("Ada", 3)
    placed = spark.createDataFrame([(1, 0, 0, 164.0, 90.0, 200.0, 110.0, 80, 40, image)], "pair_id long, ord int, page int, px0 double, py0 double, px1 double, py1 double, px_w int, px_h int, png binary")
    out = bytes(sinks.stamp_documents(template, placed).first().content)
    assert out.startswith(blank) and len(pdf.spans(out)) == 2


def test_kernels():
    white = np.full((64, 200), 255, np.uint8)
    a = white.copy()
    a[5:12, 10:180] = 0
    a[30:50, 10:180] = 0
    assert kernels.densest_band(a).shape[0] == 20 + 4 * 2 + 4
    assert kernels.crop_ink(a).shape == (53, 178) and (kernels.crop_ink(white) == white).all()
    assert kernels.prepare_style(a).shape[0] == 64 and kernels.prepare_tile_style(a).shape == (64, max(512, kernels.prepare_tile_style(a).shape[1]))
    assert kernels.style_tensor(a).shape == (1, 3, 64, 200) and kernels.style_tensor(white).max() == 1
    t = kernels.thicken(np.where(np.eye(5, dtype=bool), 100, 255).astype(np.uint8))
    assert t[0, 1] == 255 or t[0, 1] == 40
    assert kernels.concat_words([]).shape == (64, 32) and kernels.concat_words([white, white]).shape == (64, 408)
    assert kernels.resize_area(white, 50, 16).shape == (16, 50)
    dark = np.zeros((10, 10), np.uint8)
    assert kernels.white_ground(dark).mean() == 255
    assert kernels.edges(white).max() == 0
    two = white.copy()
    two[20:40, 5:60] = 0
    two[20:40, 120:180] = 0
    assert kernels.crop_line(two, "ab").shape[1] < 80 and kernels.crop_line(white).shape == white.shape
    assert kernels.ink_rgba(dark)[0, 0].tolist() == [37, 99, 235, 255]
    assert kernels.glyph_tensor("ab", {"a": np.ones((16, 16), np.float32)})[0].max() == 0


def test_generate(spark):
    lines = spark.createDataFrame([(1, i, f"t{i}", 5) for i in range(11)] + [(2, 0, "x", None)], "job_id long, i int, text string, seed long")
    size = batch.chunked(lines).where("job_id = 1").groupBy("chunk_id").count().collect()
    assert len(size) == 6

    def echo(frames):
        for f in frames:
            yield pd.DataFrame({"job_id": f.job_id, "i": f.i, "out": f.text + ":" + f.line_seed.fillna(-1).astype(int).astype(str)})

    got = {(r.job_id, r.i): r.out for r in batch.generate(lines, echo, "job_id long, i int, out string").collect()}
    assert got[(1, 0)] == "t0:5" and got[(1, 3)] == f"t3:{5 + 2 + 17}" and got[(2, 0)] == "x:-1" and len(got) == 12

    def loses(frames):
        for f in frames:
            yield pd.DataFrame({"job_id": f.job_id, "i": f.i, "out": f.text}).iloc[1:]

    with pytest.raises(Exception, match="no generated image"):
        batch.generate(lines, loses, "job_id long, i int, out string").collect()


def test_status_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, 0, "queued"), (1, 1, "done"), (2, 0, "queued")], "job_id long, seq int, status string")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = job_status_stream(stream).writeStream.outputMode("complete").format("memory").queryName("job_status").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.job_id, r.status) for r in spark.table("job_status").collect()} == {(1, "done"), (2, "queued")}


def test_written_files(spark, tmp_path):
    from quillframe.sources import state_store

    image = png.encode(np.zeros((3, 4), np.uint8))
    lines = spark.createDataFrame([(7, 0, image), (7, 11, image)], "job_id long, i int, image binary")
    got = sinks.write_files(sinks.preview_files(lines), str(tmp_path)).collect()
    assert {r.path for r in got} == {"jobs/7/000.png", "jobs/7/011.png"} and (tmp_path / "jobs/7/011.png").read_bytes() == image
    pair = spark.createDataFrame([("a", b"t", b"s")], "name string, template binary, synthetic binary")
    row = state_store.register_pairs(pair).first()
    assert {r.path for r in sinks.write_files(state_store.pair_files(pair), f"file://{tmp_path}").collect()} == {row.template_path, row.synthetic_path}
    assert (tmp_path / row.synthetic_path).read_bytes() == b"s" and not list(tmp_path.rglob("*.part"))
    styles = spark.createDataFrame([("n.png", image, "t")], "name string, content binary, style_text string")
    assert sinks.write_files(state_store.style_files(styles), str(tmp_path)).first().path == state_store.add_styles(styles).first().path
    with pytest.raises(Exception, match="can't write"):
        sinks.write_files(spark.createDataFrame([("../x", b"1")], "path string, content binary"), str(tmp_path)).collect()
