"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, scheme marks, identifier cues). At each
anchor a deterministic local parser expands to the boundaries and validates. Base kinds are the leftmost
non-overlapping matches of their fixed patterns; url, iban, account and secret are added by the method.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
KINDS = BASE + ADDED
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CREDENTIALS = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s/?#\"'<>]+")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:no\.?|nr\.?|number|id))?[ :#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/\-]{16,})")
PASSWORD = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,64})")
#: Identifier cues, each looked for in lower case, upper case and capitalised.
CUES = {
    "iban": "iban",
    "account": "account", "acct": "account", "ssn": "account", "passport": "account", "konto": "account",
    "token": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret",
    "password": "password", "passwd": "password", "pwd": "password",
}


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for ch in "0123456789":
        a.add_word(ch, ("number", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def password_ok(text: str) -> bool:
    """Long, or letters with something else among them: a plain word after the cue is no password."""
    return len(text) >= 16 or any(map(str.isalpha, text)) and not text.isalpha()


#: What follows a cue: its pattern, what it must satisfy, and the kind that it is.
PARSERS = {
    "iban": (IBAN, iban_ok, "iban"), "account": (ACCOUNT, bool, "account"), "secret": (SECRET, bool, "secret"),
    "password": (PASSWORD, password_ok, "secret"),
}


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    done = dict.fromkeys(("email", "ip", "card", "phone", "run", *ADDED), 0)
    for last, (kind, n) in anchors().iter(text):
        at = last - n + 1
        if kind == "number":
            if at < done["run"]:
                continue
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                    out["ip"].append(m.span())
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            end = at + 1
            while end < len(text) and text[end] in DIGITS:
                end += 1
            done["run"] = end
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "url":
            start = at
            while start > done["url"] and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := CREDENTIALS.match(text, at)):
                out["url"].append((start, m.end()))
                done["url"] = m.end()
        else:
            pattern, holds, kind = PARSERS[kind]
            m = pattern.match(text, last + 1)
            if m and m.start(1) >= done[kind] and holds(m[1]):
                out[kind].append(m.span(1))
                done[kind] = m.end(1)
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the earlier, longer one counts."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:
                at = e
            continue
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>, masked) for each row; a null text is empty and stays null when masked.

    Whole texts of any length are read; spans are in code points, and those of different kinds may overlap. Repeated rows and null
    ids stay; other columns, whatever their names, are ignored; no rows give no rows.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            found = [find(t) for t in texts]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)
            clean = pa.array([masked(t, x) if x else t for t, x in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), spans, clean], ["doc_id", "spans", "masked"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>, masked string"
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text (and n_chars, if there, counted anew); all rows and columns stay."""
    schema = docs.schema

    def run(batches):
        for b in sliced(batches):
            i = b.schema.get_field_index("text")
            texts = b.column(i).to_pylist()
            clean = [masked(t, x) if t and (x := find(t)) else t for t in texts]
            b = b.set_column(i, b.schema.field(i), pa.array(clean, b.schema.field(i).type))
            if (j := b.schema.get_field_index("n_chars")) >= 0:
                b = b.set_column(j, b.schema.field(j), pa.array([None if t is None else len(t) for t in clean], b.schema.field(j).type))
            yield b

    return docs.mapInArrow(run, schema)


def op10_pii(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row, as find_pii finds them; null and empty texts have none."""
    spans = F.col("spans")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda s: F.array_join(F.transform(s, text), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return find_pii(docs).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
