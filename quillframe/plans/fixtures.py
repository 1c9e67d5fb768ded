"""Inputs derived from the given tables by formulas that any SQL engine evaluates alike (whole numbers and halves)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import ship

BASE = """base as (select l_orderkey pair_id, cast(l_linenumber % 2 as int) page,
  row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 r,
  l_partkey pk, l_suppkey sk, p_type, p_name, case when l_orderkey % 13 = 0 then 14 else 24 end pitch
  from {lineitem} join {part} on l_partkey = p_partkey),
b as (select *, cast(40 + pitch * r as double) + cast(sk % 3 as double) / 2 y from base)"""

SECOND = """concat(cast(100 + pk % 900 as string), ',', lpad(cast(sk % 1000 as string), 3, '0'),
  case pk % 3 when 0 then ' 2.5×10³' when 1 then '/a b/c' else '' end)"""

#: The spans of a row: what is missing is null.
SYNTH = (
    "with " + BASE + ", f as (select *, " + SECOND + """ f2, cast(160 + 6 * length(p_name) + pk % 24 as double) fx,
  y + cast(pk % 4 as double) / 2 fy from b),
s as (select *, case n when 0 then p_type when 1 then p_name else f2 end as text, case n when 0 then cast(36 as double) when 1 then cast(160 as double) else fx end x0,
  case when n = 2 then fy else y end y0 from f{each 0 1 2} where n = 1 or n = 0 and pk % 17 <> 0 or n = 2 and pk % 2 = 0)
select pair_id, page, cast(3 * r + n as bigint) ord, text, x0, y0, x0 + 6 * length(text) x1, y0 + 10 y1,
  case when n > 0 then 2450411 when sk % 7 = 0 then 8421504 else 1118481 end color from s"""
)
TMPL = (
    "with " + BASE + """
select pair_id, page, cast(r as bigint) ord, p_type as text, cast(36 + pair_id % 5 - 2 as double) x0, y + (pair_id % 7) - 3 y0,
  cast(36 + pair_id % 5 - 2 + 6 * length(p_type) as double) x1, y + (pair_id % 7) - 3 + 10 y1,
  case when pk % 19 = 0 then null when pair_id % 11 = 0 or sk % 7 = 0 then 8421504 else 1118481 end color
from b where not (pair_id % 3 = 0 and r >= 2)"""
)
PAGES = "with " + BASE + """
select distinct pair_id, page, cast(0 as double) x0, cast(0 as double) y0, cast(case when pair_id % 10 = 0 then 360 else 612 end as double) x1,
  cast(792 as double) y1 from b"""

TEXTS = """
select p_partkey id, case p_partkey % 12
  when 0 then concat('“', p_name, '”') when 1 then concat(p_name, ' 5 x 100') when 2 then concat('2.21×10¹³ ', p_name)
  when 3 then concat('1,234,567,890 ', p_name) when 4 then concat(p_name, '/a b/', p_type) when 5 then concat('  ', p_name, ' – ', p_type, ' <b>°µ ')
  when 6 then concat(p_type, ' ', p_name, ' ', p_type, ' ', p_name, ' ', p_brand) when 7 then concat(cast(p_partkey as string), ',', lpad(cast(p_size as string), 3, '0'))
  when 8 then concat('3x10^', cast(p_size as string), ' ^ ', chr(123), p_type, chr(125)) when 9 then ' ' when 10 then concat(p_name, '/', p_brand)
  else concat(p_type, '-', p_name, '-supercalifragilisticexpialidocious/', p_brand) end as text
from {part}
union all select 1000000 + doc_id, text from {documents}"""

IMAGE = """select vec_id {div} 16 img_id, cast(vec_id % 16 as int) y, x, cast(case when (vec_id {div} 16) % 5 = 0 then 255 - v0 else v0 end as int) v
from (select vec_id, x, case when (vec_id {div} 16) % 2 = 0 and vec_id % 16 between 6 and 11 then 255
  else 255 - cast(least(255, greatest(0, floor(600 * cast(e as double)))) as int) end v0 from p) q"""

METRICS = """
select l_orderkey * 10 + l_linenumber id, l_partkey pk, l_suppkey sk, cast(64 + (l_partkey * 7) % 900 as int) w,
  cast(64 * (64 + (l_partkey * 7) % 900) as bigint) n_pixels,
  cast((64 * (64 + (l_partkey * 7) % 900)) * (1 + (l_suppkey * 13 + l_linenumber) % 60) / {int_div} as bigint) n_ink,
  cast(1 + (l_partkey * 3 + l_suppkey) % 120 as int) ink_w, cast(1 + l_partkey % 9 as int) nchar, cast(80 + l_suppkey % 21 as int) left_pct
from {lineitem}"""

JOBS = """
select o_orderkey job_id, cast(n as int) seq, case when n = 3 and o_orderstatus = 'P' then 'error'
  when n = 0 then 'queued' when n = 1 then 'calling_modal' when n = 2 then 'stamping' else 'done' end status,
  case when n = 3 and o_orderstatus = 'P' then concat('failed ', cast(o_custkey as string)) end error
from {orders}{each 0 1 2 3}"""

LINES = """
select l_orderkey job_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 i,
  p_name as text, case when l_orderkey % 4 = 0 then null else cast(l_orderkey % 1000 as bigint) end seed
from {lineitem} join {part} on l_partkey = p_partkey"""


def each(sql: str, as_sql: str) -> str:
    """Rows repeated for some numbers n, in the words of an engine."""
    return re.sub(r"\{each ([0-9 ]+)\}", lambda m: as_sql.format(", ".join(m[1].split())), sql)


def duck(sql: str) -> str:
    """A fixture as DuckDB text."""
    sql = each(sql, ", (select unnest([{}]) n) k")
    for t in ("lineitem", "part", "orders", "documents"):
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{div}", "//")


class Inputs:
    """The fixtures as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = ship(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **more: str) -> DataFrame:
        text = each(text, " lateral view explode(array({})) k as n")
        names = [t for t in ("lineitem", "part", "orders", "documents") if "{" + t + "}" in text]
        return self.spark.sql(text, **{t: self.table(t) for t in names})

    def synth(self) -> DataFrame:
        return self.sql(SYNTH)

    def tmpl(self) -> DataFrame:
        return self.sql(TMPL)

    def pages(self) -> DataFrame:
        return self.sql(PAGES)

    def texts(self) -> DataFrame:
        return self.sql(TEXTS)

    def pixels(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
        return self.spark.sql("with p as (select * from {e}) " + IMAGE.replace("{div}", "div"), e=e)

    def metrics(self) -> DataFrame:
        return self.sql(METRICS.replace("/ {int_div}", "div 1000"))

    def jobs(self) -> DataFrame:
        return self.sql(JOBS)

    def lines(self) -> DataFrame:
        return self.sql(LINES)


DUCK = {
    "spans_synth": duck(SYNTH), "spans_tmpl": duck(TMPL), "page_rects": duck(PAGES), "texts": duck(TEXTS),
    "pixels": "with p as (select vec_id, cast(x as int) - 1 x, embedding[x] e from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) x from embeddings) z) " + duck(IMAGE),
    "metrics": duck(METRICS).replace("/ {int_div}", "// 1000"), "jobs": duck(JOBS), "lines": duck(LINES),
}


def with_duck(*names: str) -> str:
    """`with` clauses of fixtures, to which a query adds its own."""
    return "with " + ", ".join(f"{n} as ({DUCK[n]})" for n in names)
