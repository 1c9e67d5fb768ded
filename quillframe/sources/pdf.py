"""Text spans out of simple PDF files, and images stamped into them (pure Python, uncompressed or Flate streams).

Content streams are read for text operators (Tf Td TD Tm T* Tj TJ ' " Tc Tw TL) and colours (rg g k). Objects may lie in
object streams; fonts may be simple or composite (two-byte codes), their texts come from ToUnicode where there is one, and
glyph widths from Widths or W, else half an em or DW. Files are rewritten by an incremental update. Encryption and
predefined encodings of composite fonts without ToUnicode are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TOKEN = re.compile(
    rb"\s*(?:%[^\r\n]*\s*)*(?:(?P<name>/[^\s/\[\]()<>{}%]*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<open>\[|<<)|(?P<close>\]|>>)"
    rb"|(?P<str>\()|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<op>[A-Za-z'\"*][A-Za-z0-9'\"*]*))"
)
SPAN_SCHEMA = "pair_id long, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, color int"


def objects(pdf: bytes) -> dict[int, bytes]:
    """The latest body of each object number; those in object streams count from where their stream lies."""
    out: dict[int, bytes] = {}
    for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", pdf, re.S):
        out[int(m[1])] = m[2]
        if re.search(rb"/Type\s*/ObjStm", m[2].partition(b"stream")[0]):
            data, first = stream_of(m[2]), int(after(m[2], rb"/First") or 0)
            head = [int(x) for x in data[:first].split()]
            ends = [first + x for x in head[3::2]] + [len(data)]
            for number, start, end in zip(head[::2], head[1::2], ends):
                out[number] = data[first + start : end]
    return out


def stream_of(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]


class Font:
    """How a font's codes read and how wide they are, in parts of the font size."""

    def __init__(self, objs: dict[int, bytes], body: bytes):
        self.size, self.text, self.width, self.usual = 1, {}, {}, 0.5
        for r in refs(after(body, rb"/ToUnicode")):
            self.text = unicode_of(stream_of(objs.get(r, b"")))
        if re.search(rb"/Subtype\s*/Type0", body):
            below = next((objs[r] for r in refs(after(body, rb"/DescendantFonts")) if r in objs), b"")
            self.size, self.usual = 2, float(after(below, rb"/DW") or 1000) / 1000
            self.width = composite_widths(below, objs)
        else:
            first = int(after(body, rb"/FirstChar") or 0)
            found = after(body, rb"/Widths")
            found = next((objs.get(r, b"") for r in refs(found)), found)
            self.width = {first + i: float(x) / 1000 for i, x in enumerate(re.findall(rb"[\d.]+", found))}

    def codes(self, raw: bytes):
        """(text, width, is a space) of each code."""
        for i in range(0, len(raw) - self.size + 1, self.size):
            code = int.from_bytes(raw[i : i + self.size], "big")
            plain = raw[i : i + 1].decode("cp1252", "replace") if self.size == 1 else "\ufffd"
            yield self.text.get(code, plain), self.width.get(code, self.usual), self.size == 1 and code == 32


def unicode_of(cmap: bytes) -> dict[int, str]:
    """Texts by code of a ToUnicode map."""
    word = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(c, 16): word(t) for c, t in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[([^\]]*)\])", part):
            codes = range(int(low, 16), int(high, 16) + 1)
            if each:
                out |= dict(zip(codes, map(word, re.findall(rb"<([0-9A-Fa-f\s]*)>", each))))
            else:
                text = word(to)
                out |= {c: text[:-1] + chr(ord(text[-1]) + i) for i, c in enumerate(codes) if text}
    return out


def composite_widths(body: bytes, objs: dict[int, bytes]) -> dict[int, float]:
    """Widths by code of a W array: `first [w ...]` and `first last w` in turn."""
    m = re.search(rb"/W\s*(\[|\d+\s+\d+\s+R)", body)
    if not m:
        return {}
    text = body[m.end() :] if m[1] == b"[" else objs.get(refs(m[1])[0], b"").partition(b"[")[2]
    out, plain = {}, []
    for t in re.finditer(rb"\[([^\]]*)\]|[\d.]+|\]", text):
        if t[0] == b"]":
            break
        if t[1] is not None:
            out |= {int(plain[-1]) + i: float(w) / 1000 for i, w in enumerate(t[1].split())}
            plain = []
            continue
        plain.append(float(t[0]))
        if len(plain) == 3:
            out |= dict.fromkeys(range(int(plain[0]), int(plain[1]) + 1), plain[2] / 1000)
            plain = []
    return out


def refs(text: bytes) -> list[int]:
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", text)]


def after(body: bytes, key: bytes) -> bytes:
    m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R|[^/>\s]+)", body)
    return m[1] if m else b""


def page_objects(objs: dict[int, bytes]) -> list[int]:
    root = next((n for n, b in objs.items() if re.search(rb"/Type\s*/Catalog", b)), None)
    if root is None:
        return []
    out, seen = [], set()

    def walk(n: int) -> None:
        if n in seen or n not in objs:
            return
        seen.add(n)
        if re.search(rb"/Type\s*/Pages", objs[n]):
            for kid in refs(after(objs[n], rb"/Kids")):
                walk(kid)
        else:
            out.append(n)

    for n in refs(after(objs[root], rb"/Pages")):
        walk(n)
    return out


def media_box(objs: dict[int, bytes], page: int) -> tuple[float, float, float, float]:
    n, seen = page, set()
    while n in objs and n not in seen:
        seen.add(n)
        if box := re.findall(rb"[-\d.]+", after(objs[n], rb"/MediaBox")):
            return tuple(map(float, box[:4]))
        n = next(iter(refs(after(objs[n], rb"/Parent"))), -1)
    return (0.0, 0.0, 612.0, 792.0)


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(m[0], 8) & 255)
                at += len(m[0])
            else:
                e = data[at : at + 1]
                out += b"" if e in (b"\n", b"\r") else plain.get(e, e)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes):
    at, stack = 0, []
    while m := TOKEN.match(data, at):
        at, kind = m.end(), m.lastgroup
        if kind == "op":
            yield m["op"].decode(), stack
            stack = []
        elif kind == "num":
            stack.append(float(m["num"]))
        elif kind == "str":
            text, at = literal(data, at)
            stack.append(text)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"][1:-1])
            stack.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "name":
            stack.append(m["name"].decode())


def spans(pdf: bytes) -> list[tuple]:
    """(page, ord, text, x0, y0, x1, y1, color) of each text shown; y from the top; blank texts are dropped."""
    objs, out = objects(pdf), []
    for p, n in enumerate(page_objects(objs)):
        _, bottom, _, top = media_box(objs, n)
        fonts = {}
        res = objs[n] + b"".join(objs.get(r, b"") for r in refs(after(objs[n], rb"/Resources")))
        for name, ref in re.findall(rb"/([A-Za-z0-9_.+-]+)\s+(\d+)\s+0\s+R", res):
            body = objs.get(int(ref), b"")
            if b"/Font" in body:
                fonts["/" + name.decode()] = Font(objs, body)
        data = b"\n".join(stream_of(objs.get(r, b"")) for r in refs(after(objs[n], rb"/Contents")))
        plain = Font(objs, b"")
        font, size, lead, tc, tw, color = plain, 1.0, 0.0, 0.0, 0.0, 0
        tm = line = np.eye(3)
        ctm, saved, order = np.eye(3), [], 0

        def show(parts) -> None:
            nonlocal tm, order
            text, x = "", 0.0
            for s in parts:
                if isinstance(s, float):
                    x -= s / 1000 * size
                    continue
                for part, wide, space in font.codes(s):
                    x += wide * size + tc + (tw if space else 0)
                    text += part
            a = np.array([0, -0.2 * size, 1]) @ tm @ ctm
            z = np.array([x, 0.8 * size, 1]) @ tm @ ctm
            if text.strip():
                xs, ys = sorted((a[0], z[0])), sorted((top - a[1], top - z[1]))
                out.append((p, order, text.strip(), float(xs[0]), float(ys[0]), float(xs[1]), float(ys[1]), color))
                order += 1
            tm = np.array([[1, 0, 0], [0, 1, 0], [x, 0, 1]]) @ tm

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = np.array([[1, 0, 0], [0, 1, 0], [x, y, 1]]) @ line

        matrix = lambda v: np.array([[v[0], v[1], 0], [v[2], v[3], 0], [v[4], v[5], 1]])
        for op, v in tokens(data):
            if op == "q":
                saved.append((ctm, color))
            elif op == "Q" and saved:
                ctm, color = saved.pop()
            elif op == "cm":
                ctm = matrix(v) @ ctm
            elif op == "BT":
                tm = line = np.eye(3)
            elif op == "Tf":
                font, size = fonts.get(v[0], plain), v[1]
            elif op in ("Tc", "Tw", "TL"):
                tc, tw, lead = (v[0] if op == "Tc" else tc), (v[0] if op == "Tw" else tw), (v[0] if op == "TL" else lead)
            elif op in ("Td", "TD"):
                lead = -v[1] if op == "TD" else lead
                move(v[0], v[1])
            elif op == "Tm":
                tm = line = matrix(v)
            elif op == "T*":
                move(0, -lead)
            elif op in ("Tj", "TJ"):
                show(v)
            elif op in ("'", '"'):
                if op == '"':
                    tw, tc = v[0], v[1]
                move(0, -lead)
                show(v[-1:])
            elif op in ("rg", "g", "k"):
                rgb = v if op == "rg" else v * 3 if op == "g" else [(1 - x) * (1 - v[3]) for x in v[:3]]
                r, g, b = (int(round(255 * x)) for x in rgb)
                color = r << 16 | g << 8 | b
        del bottom
    return out


def stamp(pdf: bytes, images: list[tuple[int, tuple[float, float, float, float], np.ndarray]]) -> bytes:
    """pdf with RGBA images over its pages: (page, rectangle from the top left, pixels), by an incremental update."""
    objs = objects(pdf)
    order, number, new = page_objects(objs), max(objs, default=0), {}
    by_page: dict[int, list] = {}
    for page, box, pixels in images:
        by_page.setdefault(page, []).append((box, pixels))
    for page, items in sorted(by_page.items()):
        n, ops, names = order[page], [], []
        top = media_box(objs, n)[3]
        for (x0, y0, x1, y1), pixels in items:
            h, w = pixels.shape[:2]
            for data, space, extra in ((pixels[:, :, 3], b"/DeviceGray", b""), (pixels[:, :, :3], b"/DeviceRGB", b"/SMask %d 0 R" % (number + 1))):
                number += 1
                raw = zlib.compress(np.ascontiguousarray(data).tobytes())
                new[number] = b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace%s/BitsPerComponent 8/Filter/FlateDecode/Length %d%s>>\nstream\n%s\nendstream" % (w, h, space, len(raw), extra, raw)
            names.append(b"/Qf%d %d 0 R" % (number, number))
            ops.append(b"q %.4f 0 0 %.4f %.4f %.4f cm /Qf%d Do Q" % (x1 - x0, y1 - y0, x0, top - y1, number))
        number += 1
        body = b"\n".join(ops)
        new[number] = b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body)
        page_body = objs[n]
        own = refs(after(page_body, rb"/Contents"))
        page_body = re.sub(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", b"", page_body)
        contents = b"/Contents[" + b" ".join(b"%d 0 R" % r for r in [*own, number]) + b"]"
        resources = refs(after(page_body, rb"/Resources"))
        if resources:
            holder, inner = resources[0], objs[resources[0]]
            new[holder] = re.sub(rb"<<", b"<</XObject<<" + b"".join(names) + b">>", inner, count=1)
        elif b"/Resources" in page_body:
            page_body = re.sub(rb"/Resources\s*<<", b"/Resources<</XObject<<" + b"".join(names) + b">>", page_body, count=1)
        else:
            contents += b"/Resources<</XObject<<" + b"".join(names) + b">>>>"
        new[n] = re.sub(rb"<<", b"<<" + contents, page_body, count=1)
    out, offsets = bytearray(pdf if pdf.endswith(b"\n") else pdf + b"\n"), {}
    for n, body in sorted(new.items()):
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body.strip())
    at = len(out)
    before = re.findall(rb"startxref\s+(\d+)", pdf)
    root = re.search(rb"/Root\s+(\d+\s+\d+\s+R)", pdf)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(offsets.items()))
    out += b"trailer\n<</Size %d/Root %s%s>>\nstartxref\n%d\n%%%%EOF\n" % (number + 1, root[1] if root else b"1 0 R", b"/Prev " + before[-1] if before else b"", at)
    return bytes(out)


def read_spans(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, page, ord, text, x0, y0, x1, y1, color) of all PDF files under a path; files are read by Spark."""
    import pandas as pd

    cols = ["page", "ord", "text", "x0", "y0", "x1", "y1", "color"]

    def run(frames):
        for f in frames:
            rows = [(p, *s) for p, c in zip(f.path, f.content) for s in spans(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", *cols])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, color int")


class PdfSpans(DataSource):
    """`spark.read.format("pdf_spans").load(folder)` for local files: one partition for each file."""

    @classmethod
    def name(cls):
        return "pdf_spans"

    def schema(self):
        return "path string, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, color int"

    def reader(self, schema):
        return PdfSpansReader(self.options["path"])


class PdfSpansReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def partitions(self):
        from pathlib import Path

        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.pdf")) if p.is_dir() else [p])]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for s in spans(f.read()):
                yield (partition.value, *s)


def write_simple(pages: list[list[tuple[float, float, float, str, tuple[float, float, float]]]], size=(612, 792)) -> bytes:
    """A PDF of single texts: for each page (x, y of the baseline from the top, font size, text, rgb)."""
    bodies, kids = {1: b"", 2: b"", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b"600 " * 95 + b"]>>"}, []
    for texts in pages:
        n = len(bodies) + 1
        ops = []
        for x, y, s, text, (r, g, b) in texts:
            safe = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            ops.append(b"BT %.6g %.6g %.6g rg /F1 %.6g Tf 1 0 0 1 %.6g %.6g Tm (%s) Tj ET" % (r, g, b, s, x, size[1] - y, safe))
        raw = zlib.compress(b"\n".join(ops))
        bodies[n] = b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(raw), raw)
        bodies[n + 1] = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Contents %d 0 R/Resources<</Font<</F1 3 0 R>>>>>>" % (*size, n)
        kids.append(n + 1)
    bodies[1] = b"<</Type/Catalog/Pages 2 0 R>>"
    bodies[2] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for n in sorted(bodies):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, bodies[n])
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))


def page_rects(pdf: bytes) -> list[tuple[float, float, float, float]]:
    objs = objects(pdf)
    return [(a, 0.0, c, d - b) for a, b, c, d in (media_box(objs, n) for n in page_objects(objs))]


def with_names(spans_df: DataFrame) -> DataFrame:
    return spans_df.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
