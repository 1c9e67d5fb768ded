"""Text functions as Column expressions: sanitising, normalising, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Superscript digits, and the sign map of the sanitisers in order.
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
SIGNS, PLAIN = "×–—’‘“”°µμ\n\t", "x--''\"\" uu  "
SCIENTIFIC = r"(\d+(?:\.\d+)?)\s*[xX×]\s*10\s*[\^¹]?[\s]*([0-9¹²³⁴⁵⁶⁷⁸⁹⁰]+)"
THOUSANDS = r"(?<=\d),(?=\d{3}(\D|$))"
SOFT_LIMIT, HARD_LIMIT, WORD_LIMIT = 24, 48, 9
# The characters that the word model and the tile model write.
WORD_CHARACTERS = " !\"#%&'()*+,-./0123456789:;?ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
TILE_CHARACTERS = " !\"#&'()*+,-./0123456789:;?ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
#: Private-use marks around a part that is still to be rewritten.
OPEN, CLOSE = chr(0xE000), chr(0xE001)


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_superscripts(c) -> Column:
    return F.translate(column(c), SUPERSCRIPTS, DIGITS)


def rewrite_scientific(c) -> Column:
    """`2.5×10³` to `2.5 x 10e3`; the exponent is whatever digits follow, as the pattern reads them."""
    plain = F.translate(column(c), OPEN + CLOSE, "")
    marked = F.regexp_replace(plain, "(?U)" + SCIENTIFIC, f"$1 x 10e{OPEN}$2{CLOSE}")
    parts = F.transform(F.split(marked, f"[{OPEN}{CLOSE}]"), lambda p, i: F.when(i % 2 == 1, ascii_superscripts(p)).otherwise(p))
    # Most texts have no power of ten and skip the pattern.
    return F.when(F.contains(plain, F.lit("10")), F.array_join(parts, "")).otherwise(plain)


def strip_thousands(c) -> Column:
    return F.when(F.contains(column(c), F.lit(",")), F.regexp_replace(column(c), "(?U)" + THOUSANDS, "")).otherwise(column(c))


def outside(characters: str) -> str:
    """A pattern of all characters but these."""
    return "[^" + "".join(f"\\{ch}" if ch in "\\]^-[&" else ch for ch in characters) + "]"


def _tidy(c: Column, drop: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, drop, ""), " {2,}", " "))


def sanitize_form(c) -> Column:
    """Form text to printable ASCII; null stays null, nothing left is an empty string."""
    rewritten = strip_thousands(F.replace(rewrite_scientific(c), F.lit("^"), F.lit("")))
    return _tidy(F.translate(rewritten, SIGNS + "<>", PLAIN), r"[^\x20-\x7E]")


def sanitize_line(c) -> Column:
    """As sanitize_form, but angle brackets stay, carriage returns are spaces, nothing left is `_`."""
    rewritten = strip_thousands(F.replace(rewrite_scientific(c), F.lit("^"), F.lit("")))
    out = _tidy(F.translate(rewritten, SIGNS + "\r", PLAIN + " "), r"[^\x20-\x7E]")
    return F.when(out == "", "_").otherwise(out)


def sanitize_word(c) -> Column:
    """To the charset of the word model; nothing left is `_`."""
    out = _tidy(F.translate(column(c), SIGNS + "^<>", PLAIN), outside(WORD_CHARACTERS))
    return F.when(out == "", "_").otherwise(out)


def sanitize_tile(c) -> Column:
    """To the charset of the tile model; nothing left is a space."""
    out = _tidy(F.translate(column(c), SIGNS + "^", PLAIN), outside(TILE_CHARACTERS))
    return F.when(out == "", " ").otherwise(out)


def norm(c) -> Column:
    return F.lower(sanitize_form(c))


def cuts(c: Column, limit: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / limit).cast("int")), lambda i: F.substring(c, i * limit + 1, F.lit(limit)))


def split_chunks(c, limit: int = SOFT_LIMIT) -> Column:
    """Pieces of at most `limit` characters: at slashes if they all fit, else words packed in order."""
    text = F.trim(column(c))
    parts = F.filter(F.transform(F.split(text, "/"), lambda p: F.trim(p)), lambda p: p != "")
    slashes = F.contains(text, F.lit("/")) & (F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) <= limit)
    words = F.filter(F.split(F.replace(text, F.lit("/"), F.lit(" / ")), " "), lambda w: w != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("chunks"), F.lit("").alias("cur"))

    def add(acc, w):
        flushed = F.when(acc["cur"] == "", acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(acc["cur"])))
        trial = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        state = lambda chunks, cur: F.struct(chunks.alias("chunks"), cur.alias("cur"))
        return (
            F.when(F.length(w) > limit, state(F.concat(flushed, cuts(w, limit)), F.lit("")))
            .when(F.length(trial) <= limit, state(acc["chunks"], trial))
            .otherwise(state(flushed, w))
        )

    def finish(acc):
        return F.when(acc["cur"] == "", acc["chunks"]).otherwise(F.concat(acc["chunks"], F.array(acc["cur"])))

    packed = F.aggregate(words, start, add, finish)
    packed = F.when(F.size(packed) > 0, packed).otherwise(F.array(F.substring(text, 1, limit)))
    short = F.length(text) <= limit
    return (
        F.when(short & slashes & (F.length(text) >= 12), parts)
        .when(short, F.array(text))
        .when(slashes, parts)
        .otherwise(packed)
    )


def word_chunks(c, limit: int = WORD_LIMIT) -> Column:
    """One piece for each word of the sanitised text, long words cut; short texts stay whole."""
    text = sanitize_word(c)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    out = F.flatten(F.transform(words, lambda w: cuts(w, limit)))
    return F.when(F.length(text) <= limit, F.array(text)).when(F.size(out) > 0, out).otherwise(F.array(F.lit("_")))


def digit_heavy(c) -> Column:
    """At least 0.7 of the letters and digits are digits; false without any."""
    alnum = F.length(F.regexp_replace(column(c), r"[^\p{L}\p{N}]", ""))
    digits = F.length(F.regexp_replace(column(c), r"[^\p{Nd}]", ""))
    return (alnum > 0) & (10 * digits >= 7 * alnum)


def visible_length(c) -> Column:
    return F.greatest(F.lit(1), F.length(F.replace(column(c), F.lit(" "), F.lit(""))))


def basename(c) -> Column:
    return F.regexp_extract(column(c), r"([^/\\]*)$", 1)


def safe_name(c) -> Column:
    return F.translate(column(c), ", /", "c__")
