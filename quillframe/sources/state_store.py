"""The state document as tables: reading and migrating it, registering pairs and styles, creating and updating jobs,
and the snapshot that the interface shows. Writes append to logs; nothing is overwritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.operators import kernels, state

from . import png

STYLE = "struct<id:string,name:string,path:string,prepared_path:string,style_text:string,created_at:string>"
PAIR = "struct<id:string,name:string,template_path:string,synthetic_path:string,source:string,created_at:string>"
JOB = (
    "struct<id:string,status:string,pair_id:string,pair_name:string,template_path:string,synthetic_path:string,"
    f"cells:array<{state.CELL}>,max_new_tokens:int,steps:int,seed:bigint,created_at:string,updated_at:string,error:string,result_pdf:string>"
)
DOCUMENT = f"active_style_id string, styles map<string,{STYLE}>, pairs map<string,{PAIR}>, jobs map<string,{JOB}>"
TABLES = ("styles", "pairs", "jobs")


def now() -> Column:
    """UTC as the document writes it."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def default_document(spark: SparkSession) -> DataFrame:
    style = F.struct(
        F.lit(state.DEFAULT_STYLE).alias("id"), F.lit("representative_text.png").alias("name"), F.lit("default/representative_text.png").alias("path"),
        F.lit(None).cast("string").alias("prepared_path"), F.lit(state.DEFAULT_STYLE_TEXT).alias("style_text"), now().alias("created_at"),
    )
    return spark.range(1).select(
        F.lit(state.DEFAULT_STYLE).alias("active_style_id"), F.create_map(F.lit(state.DEFAULT_STYLE), style).alias("styles"),
        F.create_map().cast(f"map<string,{PAIR}>").alias("pairs"), F.create_map().cast(f"map<string,{JOB}>").alias("jobs"),
    )


def tables_of(document: DataFrame) -> dict[str, DataFrame]:
    """settings, styles, pairs and jobs of a state document, migrated: the default style is there, blank transcriptions
    are filled, the active style has one."""
    out = {t: document.select(F.explode(F.coalesce(t, F.create_map().cast(document.schema[t].dataType))).alias("key", "value")).select("value.*") for t in TABLES}
    missing = default_document(document.sparkSession).select(F.explode("styles").alias("key", "value")).select("value.*").join(out["styles"].select("id"), "id", "left_anti")
    out["styles"] = state.backfill_styles(out["styles"].unionByName(missing.select(out["styles"].columns)))
    settings = document.select(F.coalesce("active_style_id", F.lit(state.DEFAULT_STYLE)).alias("active_style_id"))
    return out | {"settings": state.active_style(settings, out["styles"])}


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the document at path, or of the logs that save_state wrote there; the default state if there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return tables_of(default_document(spark))
    if not fs.getFileStatus(p).isDirectory():
        return tables_of(spark.read.schema(DOCUMENT).option("multiLine", True).json(path))
    logs = {name: spark.read.parquet(f"{path}/{name}") for name in (*TABLES, "settings")}
    out = {name: state.latest(logs[name], "id", "written_at").drop("written_at").select(*[c for c in logs[name].columns if c != "written_at"]) for name in TABLES}
    last = logs["settings"].agg(F.max(F.struct("written_at", "active_style_id")).alias("s"))
    return out | {"settings": last.select("s.active_style_id")}


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of the document's shape: what the interface shows."""
    parts = [tables["settings"].select("active_style_id").limit(1)]
    for t in TABLES:
        whole = F.struct(*tables[t].columns)
        parts.append(tables[t].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").alias("key"), whole.alias("value"))))).alias(t)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Append each table to its log under path, with the time of writing; load_state reads the last rows of each id back."""
    for name, df in tables.items():
        df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/{name}")


def required(c, what: str) -> Column:
    """c stripped, or a failure if that leaves nothing."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.raise_error(F.lit(f"{what} is required")).cast("string"))


def register_pairs(uploads: DataFrame) -> DataFrame:
    """Pair rows of uploads (name, template binary, synthetic binary); empty files fail; the same files get the same id."""
    whole = lambda c: F.when(F.octet_length(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is empty")).cast("binary"))
    pid = state.content_id(F.concat(whole("template"), whole("synthetic")))
    return uploads.select(
        pid.alias("id"), "name", F.concat(F.lit("pairs/"), pid, F.lit("/template.pdf")).alias("template_path"),
        F.concat(F.lit("pairs/"), pid, F.lit("/synthetic.pdf")).alias("synthetic_path"), F.lit("upload").alias("source"), now().alias("created_at"),
    )


def add_styles(uploads: DataFrame) -> DataFrame:
    """Style rows of uploads (name, content binary, style_text); blank transcriptions fail."""
    sid = state.content_id(F.col("content"))
    return uploads.select(
        sid.alias("id"), "name", F.concat(F.lit("styles/"), sid, F.lit("/"), "name").alias("path"), F.lit(None).cast("string").alias("prepared_path"),
        required("style_text", "style_text").alias("style_text"), now().alias("created_at"),
    )


def pair_files(uploads: DataFrame) -> DataFrame:
    """(path, content) of the files of registered pairs, for sinks.write_files."""
    pid = state.content_id(F.concat("template", "synthetic"))
    each = F.explode(F.array(F.struct(F.lit("template").alias("side"), F.col("template").alias("content")), F.struct(F.lit("synthetic").alias("side"), F.col("synthetic").alias("content"))))
    return uploads.select(pid.alias("id"), each.alias("f")).select(F.concat_ws("/", F.lit("pairs"), "id", F.concat("f.side", F.lit(".pdf"))).alias("path"), F.col("f.content").alias("content"))


def style_files(uploads: DataFrame) -> DataFrame:
    return uploads.select(F.concat_ws("/", F.lit("styles"), state.content_id(F.col("content")), "name").alias("path"), "content")


PREPARED = T.StructType([T.StructField("prepared", T.BinaryType()), T.StructField("error", T.StringType())])


def prepare_styles(styles: DataFrame) -> DataFrame:
    """styles (id, content binary, …) with prepared binary and error string: one bad image stops no other."""
    columns = styles.columns

    def run(frames):
        for f in frames:
            out = []
            for c in f.content:
                try:
                    out.append((png.encode(kernels.prepare_style(png.decode(None if c is None else bytes(c)))), None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield f.assign(prepared=[p for p, _ in out], error=[e for _, e in out])

    return styles.mapInPandas(run, T.StructType([*styles.schema.fields, *PREPARED.fields])).select(*columns, "prepared", "error")


def create_jobs(requests: DataFrame) -> DataFrame:
    """First events of jobs: requests (pair_id, cells json string, max_new_tokens, steps, seed); 16 to 256 tokens."""
    tokens = state.job_tokens(F.col("steps"), F.col("max_new_tokens"))
    bounded = F.when(tokens.between(16, 256), tokens).otherwise(F.raise_error(F.lit("tokens are not within 16 and 256")).cast("int"))
    jid = state.content_id(F.concat_ws("|", "pair_id", "cells", F.col("seed").cast("string")).cast("binary"), 12)
    return requests.select(jid.alias("job_id"), F.lit(0).alias("seq"), F.lit("queued").alias("status"), "pair_id", "cells", bounded.alias("max_new_tokens"), "seed", now().alias("updated_at"))


def by_id(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the wanted keys; a key that is missing fails."""
    found = wanted.join(rows.withColumn("__there", F.lit(True)), key, "left")
    there = F.coalesce("__there", F.raise_error(F.concat(F.lit("no such id: "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(there).drop("__there")
