"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text. A text goes to the language whose
dictionary makes it smallest; where that is narrow, as whole bytes make it for short texts, the sizes of its words, each
compressed alone, count too. A margin over the second smallest that is narrow still is a rejection.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small

#: The model's bounds: labelled rows for each language, bytes of each of them, bytes of a dictionary. A row's bytes come
#: from windows of so many characters, dealt evenly over its whole text.
ROWS_PER_LANGUAGE, DICTIONARY_BYTES, WINDOWS, WINDOW_CHARS = 400, 64_000, 4, 48
#: Times as many rows as the model takes that a threshold on their hash lets through, on average.
SPARE = 4
BLOCK = 16_384
#: Matches of four bytes and small tables: syllables count, and starting a text is cheap.
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False
)
#: Least lead, as a part of the second smallest size, to be accepted; fewer letters are always rejected.
MIN_MARGIN, MIN_LETTERS = 0.004, 4
NOISE = re.compile(r"[\W\d_]+")


def squeezed(text: str) -> bytes:
    """Lower-cased words parted by single spaces: shouting, digits and symbols tell nothing of the language."""
    return NOISE.sub(" ", text.lower()).encode("utf-8", "replace")


def sampled(text: F.Column) -> F.Column:
    """The whole text if it is short, else windows from its beginning to its end."""
    step = (F.char_length(text) - WINDOW_CHARS) / (WINDOWS - 1)
    parts = [F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(WINDOW_CHARS)) for i in range(WINDOWS)]
    return F.when(F.char_length(text) <= WINDOWS * WINDOW_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, from at most ROWS_PER_LANGUAGE rows each, those with the least hash of their id.

    A threshold on the hash, from the counts of rows by language, leaves a few times as many rows, so that no task gets more
    of a language whatever its share. Rows with null text, lang or id are not used; rows of one id count one by one, ties go by text;
    other columns are ignored. No usable rows give an empty model, which answers `und`.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid"))
    usable = labelled.where("text is not null and lang is not null and doc_id is not null")
    usable = usable.select(F.col("lang").cast("string").alias("lang"), hashed.alias("h"), F.col("text").cast("string").alias("text"))
    counts = usable.groupBy("lang").count()
    few = F.pmod("h", F.col("count")) < SPARE * ROWS_PER_LANGUAGE
    chosen = usable.join(small(counts), "lang").where(few).select("lang", "h", sampled(F.col("text")).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ROWS_PER_LANGUAGE).drop("r")
    by: dict[str, list[tuple]] = {}
    for r in rows.collect():
        by.setdefault(r.lang, []).append((r.h, r.text))
    model = {}
    for lang, texts in sorted(by.items()):
        # Each row gives an equal share, so that no long row fills the dictionary.
        share = max(64, DICTIONARY_BYTES // len(texts))
        model[lang] = b" ".join(squeezed(t)[:share] for _, t in sorted(texts))[:DICTIONARY_BYTES]
    return {k: v for k, v in model.items() if len(v) >= 8}


@lru_cache(maxsize=2)
def encoders(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=PARAMETERS)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMETERS)))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language or und, score 0 to 1, rejected). Score: the lead over the second smallest size, as a part of it.

    und: null texts and texts without a letter (digits, fractions and numerals of any script are none). Languages whose sizes are
    equal to the end are told apart by name only, and such texts are rejected; so is anything under MIN_LETTERS bytes of letters.
    """
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data, tools = squeezed(text), encoders(model)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in tools]

    def found():
        order = sorted((n, lang) for n, (lang, _) in zip(sizes, tools))
        return order[0][1], (order[1][0] - order[0][0]) / order[1][0] if len(order) > 1 else 1.0

    lang, lead = found()
    if lead < MIN_MARGIN:
        words = Counter(data.split())
        sizes = [n + sum(k * len(c.compress(w)) for w, k in words.items()) for n, (_, c) in zip(sizes, tools)]
        lang, lead = found()
    return lang, lead, lead < MIN_MARGIN or len(data) - data.count(b" ") < MIN_LETTERS


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred string, score double, rejected boolean) for each row of docs; nothing but its whole text is looked at.

    Repeated rows and null ids stay; other columns, whatever their names, are ignored; no rows give no rows.
    """
    frozen = tuple(sorted(model.items()))
    held = docs.sparkSession.sparkContext.broadcast(frozen)

    def run(batches):
        m = held.value
        for b in sliced(batches):
            found = [classify(t, m) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = [pa.array(x, k) for x, k in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()))]
            rest = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            names = [f.name for f in b.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *columns], [*names, "lang_pred", "score", "rejected"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """The rows of docs whose language is not rejected, with all their columns; null and empty texts go."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))

    def run(batches):
        m = held.value
        for b in sliced(batches):
            i = b.schema.get_field_index("text")
            keep = [not classify(t, m)[2] for t in b.column(i).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op6_language_id(docs: DataFrame) -> DataFrame:
    """Predictions of a model learned from the rows that are not held out. A null doc_id is not held out, nor learned from."""
    model = fit(docs.where(fold() != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
