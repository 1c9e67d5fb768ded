"""Writing results: stamped PDFs, line previews, overlays and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import to_pixels
from quillframe.operators import kernels

from . import pdf, png

# Overlay colours of enabled and other cells.
ENABLED, DISABLED = (37, 99, 235), (160, 160, 160)


def stamp_documents(templates: DataFrame, placed: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, content binary): each template with its images stamped.

    templates: (key, content). placed: (key, ord, page, px0, py0, px1, py1, px_w, px_h, png). A document's images are
    gathered in one task, as one document is one file.
    """

    def run(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({key: [], "content": []})
        images = []
        for r in right.sort_values("ord").itertuples():
            rgba = kernels.crop_alpha(kernels.ink_rgba(kernels.flatten(png.decode(r.png))))
            planes = [kernels.resize_area(rgba[:, :, i], int(r.px_w), int(r.px_h)) for i in range(4)]
            images.append((int(r.page), (r.px0, r.py0, r.px1, r.py1), np.dstack(planes)))
        return pd.DataFrame({key: [k[0]], "content": [pdf.stamp(bytes(left.content.iloc[0]), images)]})

    kind = templates.schema[key].dataType.simpleString()
    return templates.groupBy(key).cogroup(placed.groupBy(key)).applyInPandas(run, f"{key} {kind}, content binary")


def preview_names(lines: DataFrame, order: str = "i") -> DataFrame:
    return lines.withColumn("file", F.concat(F.format_string("%03d", F.col(order)), F.lit(".png")))


def overlay_rects(cells: DataFrame) -> DataFrame:
    """cells as pixel rectangles with their colour."""
    color = lambda i: F.when(F.col("enabled"), ENABLED[i]).otherwise(DISABLED[i])
    return cells.select(
        "pair_id", "page", "id", *[to_pixels(F.col(k)).alias(f"px_{k}") for k in ("x0", "y0", "x1", "y1")],
        *[color(i).alias(c) for i, c in enumerate("rgb")],
    )


def draw_overlay(h: int, w: int, rects: pd.DataFrame, line: int = 2) -> bytes:
    """A white page with the outlines of overlay_rects."""
    out = np.full((h, w, 3), 255, np.uint8)
    for r in rects.itertuples():
        rgb, (x0, y0, x1, y1) = (r.r, r.g, r.b), (max(0, r.px_x0), max(0, r.px_y0), r.px_x1, r.px_y1)
        out[y0 : y0 + line, x0:x1] = out[max(y0, y1 - line) : y1, x0:x1] = rgb
        out[y0:y1, x0 : x0 + line] = out[y0:y1, max(x0, x1 - line) : x1] = rgb
    return png.encode(out)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's content to its path below root and return (path, bytes) of what was written.

    root is a folder that all executors reach (a mount, or an address that Arrow opens). A file appears whole or not at
    all, and a task that runs again writes the same file again. Paths that leave the root, and null contents, fail.
    """

    def run(frames):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for f in frames:
            for p, c in zip(f[path], f[content]):
                if c is None or p.startswith("/") or ".." in p.split("/"):
                    raise ValueError(f"can't write {p}")
                target = f"{base}/{p}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(bytes(c))
                store.move(part, target)
            yield pd.DataFrame({"path": f[path], "bytes": [len(c) for c in f[content]]})

    return files.select(path, content).mapInPandas(run, "path string, bytes long")


def preview_files(lines: DataFrame, folder: str = "job_id", order: str = "i", image: str = "image") -> DataFrame:
    """(path, content) of the line previews of each job: numbered PNGs in the job's folder."""
    named = preview_names(lines, order)
    return named.select(F.concat(F.lit("jobs/"), F.col(folder).cast("string"), F.lit("/"), "file").alias("path"), F.col(image).alias("content"))
