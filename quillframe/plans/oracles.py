"""The catalogue's queries as DuckDB SQL, written independently of the DataFrame plans."""

from __future__ import annotations

from .fixtures import DUCK, with_duck

SUP, DIG = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
SIGNS, PLAIN = "×–—’‘“”°µμ\n\t", "x--''''\"\" uu  "
SCI = r"(\d+(?:\.\d+)?)\s*[xX×]\s*10\s*[\^¹]?[\s]*([0-9¹²³⁴⁵⁶⁷⁸⁹⁰]+)"
BLUE = "coalesce((color & 255) / 255.0::double > 0.35 and (color & 255) / 255.0::double > ((color >> 16) & 255) / 255.0::double + 0.08 and (color & 255) / 255.0::double > ((color >> 8) & 255) / 255.0::double + 0.05, false)"
BLACK = "coalesce(greatest((color >> 16) & 255, (color >> 8) & 255, color & 255) / 255.0::double < 0.35, true)"


def sci(c: str) -> str:
    marked = f"regexp_replace({c}, '{SCI}', '\\1 x 10e' || chr(57344) || '\\2' || chr(57345), 'g')"
    parts = f"string_split(replace({marked}, chr(57345), chr(57344)), chr(57344))"
    return f"array_to_string(list_transform({parts}, lambda p, i: case when i % 2 = 0 then translate(p, '{SUP}', '{DIG}') else p end), '')"


def tidy(c: str, drop: str = r"[^\x20-\x7E]") -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{drop}', '', 'g'), ' {{2,}}', ' ', 'g'), ' ')"


def thousands(name: str, source: str, c: str, out: str) -> str:
    """Two clauses: the commas of source.c between thousands are gone in name.out."""
    keep = "case when i = 1 or (regexp_matches(parts[i - 1], '[0-9]$') and regexp_matches(p, '^[0-9]{3}([^0-9]|$)')) then p else ',' || p end"
    return (
        f"{name}p as (select *, string_split({c}, ',') parts from {source}), "
        f"{name} as (select * exclude (parts), array_to_string(list_transform(parts, lambda p, i: {keep}), '') {out} from {name}p)"
    )


def form(name: str, source: str, c: str = "text", out: str = "san") -> str:
    """Clauses that add the form sanitiser's result to source as name."""
    return (
        f"{name}a as (select *, replace({sci(c)}, '^', '') z from {source}), {thousands(name + 'b', name + 'a', 'z', 'zz')}, "
        f"{name} as (select * exclude (z, zz), {tidy(f'''translate(zz, '{SIGNS}<>', '{PLAIN}')''')} {out} from {name}b)"
    )


def line(name: str, source: str, c: str = "text", out: str = "san") -> str:
    t = tidy(f"translate(zz, '{SIGNS}' || chr(13), '{PLAIN} ')")
    return (
        f"{name}a as (select *, replace({sci(c)}, '^', '') z from {source}), {thousands(name + 'b', name + 'a', 'z', 'zz')}, "
        f"{name} as (select * exclude (z, zz), case when {t} = '' then '_' else {t} end {out} from {name}b)"
    )


WORD = tidy(f"translate(text, '{SIGNS}^<>', '{PLAIN}')", r"[^\x20-\x7E]|[$<=>@\[\\\]^`{|}~]")
TILE = tidy(f"translate(text, '{SIGNS}^', '{PLAIN}')", r"[^\x20-\x7E]|[$%<=>@\[\\\]^`{|}~]")
TEXTS = with_duck("texts")


def split(name: str, source: str, c: str, out: str = "chunks") -> str:
    """Clauses that add the list of a text's pieces of at most 24 characters."""
    cut = "list_transform(range(0, (length(x.cur) - 1) // 24 + 1), lambda k: substring(x.cur, k * 24 + 1, 24))"
    flushed = "case when a.cur = '' then a.chunks else list_append(a.chunks, a.cur) end"
    trial = "case when a.cur = '' then x.cur else a.cur || ' ' || x.cur end"
    step = (
        f"case when length(x.cur) > 24 then {{'chunks': list_concat({flushed}, {cut}), 'cur': ''}} "
        f"when length({trial}) <= 24 then {{'chunks': a.chunks, 'cur': {trial}}} else {{'chunks': {flushed}, 'cur': x.cur}} end"
    )
    start = "[{'chunks': []::varchar[], 'cur': ''}]"
    return (
        f"{name}a as (select *, trim({c}, ' ') t, list_filter(list_transform(string_split(trim({c}, ' '), '/'), lambda p: trim(p, ' ')), lambda p: p <> '') ps, "
        f"list_filter(string_split(replace(trim({c}, ' '), '/', ' / '), ' '), lambda w: w <> '') ws from {source}), "
        f"{name}b as (select *, contains(t, '/') and len(ps) > 1 and len(list_filter(ps, lambda p: length(p) > 24)) = 0 sl, "
        f"list_reduce(list_concat({start}, list_transform(ws, lambda w: {{'chunks': []::varchar[], 'cur': w}})), lambda a, x: {step}) st from {name}a), "
        f"{name}c as (select *, case when st.cur = '' then st.chunks else list_append(st.chunks, st.cur) end pk from {name}b), "
        f"{name} as (select * exclude (t, ps, ws, sl, st, pk), case when length(t) <= 24 and sl and length(t) >= 12 then ps when length(t) <= 24 then [t] "
        f"when sl then ps when len(pk) > 0 then pk else [substring(t, 1, 24)] end {out} from {name}c)"
    )


SPANS = with_duck("spans_synth", "spans_tmpl", "page_rects")
SYNTH, TMPL = with_duck("spans_synth"), with_duck("spans_tmpl")
# Labels of the fixtures are plain, so that lower case is their normal form.
NORM = "lower(trim(regexp_replace(text, ' {2,}', ' ', 'g'), ' '))"


def anchors(fills: str, key: str) -> str:
    return (
        f"an0 as (select f.pair_id, f.page, f.{key}, s.ord a_ord, s.text a_text, s.x0 a_x0, s.y0 a_y0, s.x1 a_x1, s.y1 a_y1, "
        f"row_number() over (partition by f.pair_id, f.page, f.{key} order by s.x1 desc, s.ord) n from {fills} f join spans_synth s "
        f"on f.pair_id = s.pair_id and f.page = s.page and not {BLUE.replace('color', 's.color')} and trim(s.text) <> '' "
        f"and abs(s.y0 - f.y0) <= 8 and s.x1 < f.x0 - 4), anchors as (select * exclude (n) from an0 where n = 1)"
    )


def instances(name: str, spans: str, black_first: bool) -> str:
    keep = f"({BLACK} or not bool_or({BLACK}) over (partition by pair_id, page, {NORM}))" if black_first else "true"
    apart = "abs(a[-1].y0 - x[1].y0) < 2 and abs(a[-1].x0 - x[1].x0) < 2"
    return (
        f"{name}0 as (select pair_id, page, {NORM} as label, y0, x0, ord, x1, y1, {keep} ok from {spans} where not {BLUE}), "
        f"{name}1 as (select pair_id, page, label, list([{{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1}}] order by y0, x0, ord) l from {name}0 where ok and label <> '' group by all), "
        f"{name}2 as (select pair_id, page, label, list_reduce(l, lambda a, x: case when {apart} then a else list_concat(a, x) end) k from {name}1), "
        f"{name} as (select pair_id, page, label, cast(u - 1 as int) i, k[u].x0 x0, k[u].y0 y0, k[u].x1 x1, k[u].y1 y1 from (select *, unnest(range(1, len(k) + 1)) u from {name}2) q)"
    )


def mapped(fills: str, key: str) -> str:
    return (
        f"{anchors(fills, key)}, {instances('si', 'spans_synth', False)}, {instances('ti', 'spans_tmpl', True)}, "
        f"at0 as (select a.*, s.label, s.i, s.x0 s_x0, s.y0 s_y0, row_number() over (partition by a.pair_id, a.page, a.{key} order by "
        "case when abs(s.y0 - a.a_y0) < 3 and abs(s.x0 - a.a_x0) < 3 then 0 else 1 end, "
        "case when abs(s.y0 - a.a_y0) < 3 and abs(s.x0 - a.a_x0) < 3 then 0 else abs(s.y0 - a.a_y0) end, "
        "case when abs(s.y0 - a.a_y0) < 3 and abs(s.x0 - a.a_x0) < 3 then 0 else abs(s.x0 - a.a_x0) end, s.i) n "
        f"from anchors a join si s on a.pair_id = s.pair_id and a.page = s.page and s.label = {NORM.replace('text', 'a.a_text')}), "
        f"mp as (select f.*, f.x0 + t.x0 - s_x0 mx0, f.y0 + t.y0 - s_y0 my0, f.x1 + t.x0 - s_x0 mx1, f.y1 + t.y0 - s_y0 my1, t.y1 - t.y0 lh, p.x0 px0, p.x1 px1 "
        f"from {fills} f join at0 a on f.pair_id = a.pair_id and f.page = a.page and f.{key} = a.{key} and a.n = 1 "
        "join ti t on t.pair_id = a.pair_id and t.page = a.page and t.label = a.label and t.i = a.i join page_rects p on p.pair_id = f.pair_id and p.page = f.page), "
        "fl0 as (select *, greatest(my1 - my0, lh * 1.15::double, 11) h, (my0 + my1) / 2 cy, greatest(px0, mx0) cx0, least(px1, mx1) cx1 from mp), "
        f"fields as (select pair_id, page, {key}, text, cx0 x0, cy - h / 2 y0, case when cx1 - cx0 < 2 then cx0 + greatest(2, mx1 - mx0) else cx1 end x1, cy + h / 2 y1 from fl0)"
    )


L, X = "g[-1]", "x[1][1]"
JOINS = (
    f"(abs({X}.y0 - {L}.y0) < 4 and abs({X}.y1 - {L}.y1) < 6 and {X}.x0 <= {L}.x1 + 14) or ({X}.y0 <= {L}.y1 + 6 and {X}.y0 >= {L}.y0 - 2 "
    f"and not ({X}.x1 < {L}.x0 - 4 or {X}.x0 > {L}.x1 + 4))"
)
HIT = f"coalesce(list_position(list_transform(a, lambda g: {JOINS}), true), 0)"
# y0 of the fixtures are halves, which rounding to tenths leaves as they are.
MERGED = (
    f"bl as (select * from spans_synth where {BLUE} and trim(text) <> ''), "
    "gl as (select pair_id, page, list([[{'y0': y0, 'x0': x0, 'ord': ord, 'x1': x1, 'y1': y1, 'text': text}]] order by y0, x0, ord) l from bl group by all), "
    f"gr as (select pair_id, page, list_reduce(l, lambda a, x: case when {HIT} > 0 then list_transform(a, lambda g, i: case when i = {HIT} then list_concat(g, x[1]) else g end) else list_concat(a, x) end) k from gl), "
    "gu as (select pair_id, page, cast(u - 1 as int) grp, k[u] m from (select *, unnest(range(1, len(k) + 1)) u from gr) q), "
    "gt as (select pair_id, page, grp, list_min(list_transform(m, lambda s: s.x0)) - 1 x0, list_min(list_transform(m, lambda s: s.y0)) - 1 y0, "
    "list_max(list_transform(m, lambda s: s.x1)) + 1 x1, list_max(list_transform(m, lambda s: s.y1)) + 1 y1, "
    "array_to_string(list_transform(list_sort(list_transform(m, lambda s: {'y0': s.y0, 'x0': s.x0, 'ord': s.ord, 't': s.text})), lambda s: s.t), ' ') txt from gu), "
    + form("gs", "gt", "txt")
    + ", merged as (select pair_id, page, grp, x0, y0, x1, y1, san as text from gs where san <> '')"
)


def emitted(fields: str, order: str) -> str:
    return (
        split("ec", f"(select * from {fields} where text <> '' and x1 - x0 >= 2 and y1 - y0 >= 2 and length(text) <= 48) q", "text")
        + f", ed as (select *, len(chunks) > 1 and y1 - y0 >= len(chunks) * 10.0::double + (len(chunks) - 1) * 2.0::double st from ec), "
        "ee as (select *, case when st then chunks when length(text) <= 24 then [text] else [rtrim(substring(text, 1, 24), ' ')] end ps from ed), "
        "ef as (select *, len(ps) n, unnest(range(1, len(ps) + 1)) u from ee), eg as (select *, (y1 - y0 - (n - 1) * 2.0::double) / n lh, ps[u] piece from ef), "
        f"cells as (select pair_id, page, {order}, cast(u - 1 as int) part, x0, case when n = 1 then y0 else y0 + (u - 1) * (lh + 2.0::double) end y0, x1, "
        "case when n = 1 then y1 else y0 + (u - 1) * (lh + 2.0::double) + lh end y1, piece as text from eg)"
    )


ROUNDED = "round_even(x0, 0), round_even(y0, 0), round_even(x1, 0), round_even(y1, 0)"
PIX = with_duck("pixels")
ROW = "rp as (select img_id, y, count(*) filter (where 255 - v > 40) ink from pixels group by all)"
SMOOTH = (
    ROW + ", hh as (select img_id, max(y) + 1 h from pixels group by all), g as (select img_id, h, case when h < 5 then (h - 1) // 2 else 2 end sh, unnest(range(0, greatest(h, 5))) y from hh), "
    "sp as (select g.img_id, cast(g.y as int) y, coalesce(max(case when rp.y = g.y then ink end), 0) ink, coalesce(sum(case when rp.y between g.y + sh - 4 and g.y + sh then ink end), 0) smooth5 "
    "from g left join rp on g.img_id = rp.img_id group by g.img_id, g.y)"
)
STYLES = (
    "with st as (select case when c_custkey = 1 then 'default' else 's' || c_custkey end id, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then '  ' end style_text, "
    "'raw/' || c_name path, case when c_custkey % 2 = 0 then 'prepared/' || c_name end prepared_path, c_custkey from customer), "
    "bf as (select id, case when trim(coalesce(style_text, '')) = '' then case when id = 'default' then 'An erratic some-CAPS' else '' end else style_text end style_text from st) "
)
CELLS = (
    SYNTH + ", cells as (select pair_id, page, ord, 'p' || page || '_c' || ord id, x0, y0, x1, y1, case when ord % 11 <> 0 then text end as text, "
    "case when ord % 4 <> 0 then ord % 3 <> 0 end enabled from spans_synth) "
)
DIGITY = "length(regexp_replace(san, '[^0-9]', '', 'g')) * 10 >= 7 * length(regexp_replace(san, '[^0-9A-Za-z]', '', 'g')) and regexp_matches(san, '[0-9A-Za-z]')"
BUDGET = (
    TEXTS + ", " + line("s", "texts") + f", c as (select id, san, cast(16 + id % 241 as int) ceiling, {DIGITY} heavy from s), "
    "l as (select *, greatest(64, least(256, ceiling, 16 + 12 * greatest(1, length(san)))) line from c), "
    "f as (select *, case when heavy then least(256, greatest(line, least(ceiling, 96))) else line end first from l) "
)
NEXT = "least(256, greatest({0} + 32, {0} * 3 // 2))"
LINES = with_duck("lines")

SQL = {
    "color_classify": with_duck("spans_synth", "spans_tmpl") + f" select color, {BLUE} is_blue, {BLACK} is_near_black, (color >> 16) & 255 r, (color >> 8) & 255 g, color & 255 b, count(*) n from (select * from spans_synth union all select * from spans_tmpl) q group by all",
    "blue_fills": SYNTH + f" select * from spans_synth where {BLUE} and trim(text) <> ''",
    "sanitize_form": TEXTS + ", " + form("s", "texts") + " select id, san as out from s",
    "sanitize_line": TEXTS + ", " + line("s", "texts") + " select id, san as out from s",
    "sanitize_word": TEXTS + f" select id, case when {WORD} = '' then '_' else {WORD} end as out from texts",
    "sanitize_tile": TEXTS + f" select id, case when {TILE} = '' then ' ' else {TILE} end as out from texts",
    "norm_labels": TEXTS + ", " + form("s", "texts") + " select id, lower(san) as out from s",
    "strip_thousands": TEXTS + ", " + thousands("s", "texts", "text", "san") + " select id, san as out from s",
    "rewrite_scientific": TEXTS + f" select id, {sci('text')} as out from texts",
    "digit_heavy": TEXTS + ", " + line("s", "texts") + f" select id, {DIGITY} as out from s",
    "visible_length": TEXTS + " select id, cast(greatest(1, length(replace(text, ' ', ''))) as int) as out from texts",
    "safe_name": TEXTS + " select id, replace(replace(replace(text, ',', 'c'), ' ', '_'), '/', '_') as out from texts",
    "basename": TEXTS + r" select id, regexp_extract(text, '([^/\\]*)$', 1) as out from texts",
    "split_chunks": TEXTS + ", " + form("s", "texts") + ", " + split("c", "s", "san") + " select id, array_to_string(chunks, '|') as out from c",
    "word_chunks": TEXTS + f", w as (select id, case when {WORD} = '' then '_' else {WORD} end t from texts), c as (select id, t, flatten(list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), "
    "lambda w: list_transform(range(0, (length(w) - 1) // 9 + 1), lambda k: substring(w, k * 9 + 1, 9)))) l from w) select id, case when length(t) <= 9 then t when len(l) > 0 then array_to_string(l, '|') else '_' end as out from c",
    "left_anchor": SYNTH + f", fl as (select * from spans_synth where {BLUE}), {anchors('fl', 'ord')} select * from anchors",
    "label_instances": TMPL + f", {instances('ti', 'spans_tmpl', True)} select * from ti",
    "instance_index": SPANS + f", fl as (select * exclude (color) from spans_synth where {BLUE}), {mapped('fl', 'ord')} select pair_id, page, ord, label, i from at0 where n = 1",
    "map_to_template": SPANS + f", fl as (select * exclude (color) from spans_synth where {BLUE}), {mapped('fl', 'ord')} select * from fields",
    "merge_spans": SYNTH + f", {MERGED} select * from merged",
    "emit_cells": SYNTH + ", src as (select * replace (y0 + case when ord % 4 = 0 then 40 else ord % 12 end as y1, "
    "case when ord % 3 = 0 then text || ' ' || lpad(cast(pair_id as varchar), 30, 'ab cd/ef ') else text end as text) from spans_synth), " + emitted("src", "ord") + " select * from cells",
    "dedupe_cells": SYNTH + f", d as (select * from spans_synth union all select * replace (x0 + 0.5 as x0, y0 - 0.5 as y0, ord + 100000 as ord) from spans_synth), "
    f"n as (select *, row_number() over (partition by pair_id, page, {ROUNDED}, text order by ord) n from d) select * exclude (n) from n where n = 1",
    "cell_ids": SYNTH + " select pair_id, page, ord, 'p' || page || '_c' || (row_number() over (partition by pair_id order by page, ord) - 1) id from spans_synth",
    "detect_cells": SPANS + f", {MERGED}, {mapped('merged', 'grp')}, {emitted('fields', 'grp')}, n as (select *, row_number() over (partition by pair_id, page, {ROUNDED}, text order by grp, part) n from cells) "
    "select pair_id, page, 'p' || page || '_c' || (row_number() over (partition by pair_id order by page, grp, part) - 1) id, x0, y0, x1, y1, text, true enabled from n where n = 1",
    "diff_stats": SPANS + f", {MERGED}, {mapped('merged', 'grp')} select p.pair_id, p.page, count(m.grp) merged, count(f.grp) kept, count(m.grp) filter (where a.grp is null) skipped_no_anchor, "
    "count(m.grp) filter (where a.grp is not null and f.grp is null) skipped_overflow from page_rects p left join merged m on m.pair_id = p.pair_id and m.page = p.page "
    "left join anchors a on a.pair_id = m.pair_id and a.page = m.page and a.grp = m.grp left join fields f on f.pair_id = m.pair_id and f.page = m.page and f.grp = m.grp group by p.pair_id, p.page",
    "shared_pages": SPANS + " select distinct p.* from page_rects p join spans_synth s on s.pair_id = p.pair_id and s.page = p.page join spans_tmpl t on t.pair_id = p.pair_id and t.page = p.page",
    "overlay_rects": SYNTH + " select pair_id, page, 'c' || ord id, cast(trunc(x0 * (200 / 72.0::double)) as int) px_x0, cast(trunc(y0 * (200 / 72.0::double)) as int) px_y0, cast(trunc(x1 * (200 / 72.0::double)) as int) px_x1, "
    "cast(trunc(y1 * (200 / 72.0::double)) as int) px_y1, case when ord % 5 <> 0 then 37 else 160 end r, case when ord % 5 <> 0 then 99 else 160 end g, case when ord % 5 <> 0 then 235 else 160 end b from spans_synth",
    "pair_listing": "with n as (select s_name || case s_suppkey % 3 when 0 then '_TEMPLATE.pdf' when 1 then '_B_TEMPLATE.pdf' else '.pdf' end as name from supplier union all select 'Supplier#' || lpad(cast(c_custkey % 100 + 1 as varchar), 9, '0') "
    "|| case when c_custkey % 2 = 0 then '_B_' else '_' end || c_custkey || case when c_custkey % 7 = 0 then '.PDF' else '_EXECUTED_synthetic.pdf' end from customer), "
    "t as (select name template, replace(name, '_TEMPLATE.pdf', '') stem from n where suffix(name, '_TEMPLATE.pdf')) select stem, template, n.name filled from t join n on starts_with(n.name, stem || '_') "
    "and suffix(n.name, '_EXECUTED_synthetic.pdf') and length(n.name) >= length(stem) + 1 + length('_EXECUTED_synthetic.pdf')",
    "pdf_names": "select * from (select c_custkey, c_name || case when c_custkey % 2 = 0 then '.PDF' when c_custkey % 3 = 0 then '.pdf' else '.png' end as name from customer) q where suffix(lower(name), '.pdf')",
    "invert_dark": PIX + ", w as (select img_id, y, x, case when v > 160 then 255 else v end v from pixels), m as (select img_id, avg(v) < 127 dark from w group by all) select img_id, y, x, case when dark then 255 - v else v end v from w join m using (img_id)",
    "row_profile": PIX + f", {ROW} select * from rp",
    "column_profile": PIX + " select img_id, x, count(*) filter (where 255 - v > 40) ink from pixels group by all",
    "smooth_profile": PIX + f", {SMOOTH} select * from sp",
    "densest_band": PIX + f", {SMOOTH}, o as (select *, smooth5 >= 15 and 20 * smooth5 >= 3 * max(smooth5) over (partition by img_id) o from sp), r as (select *, sum(case when o then 0 else 1 end) over (partition by img_id order by y) r from o), "
    "b as (select img_id, r, min(y) b0, max(y) b1, sum(ink) mass from r where o group by all), n as (select *, count(*) over (partition by img_id) k, row_number() over (partition by img_id order by mass desc, b0) n from b), "
    "t as (select img_id, max(ink) most from rp group by all) select hh.img_id, cast(case when most >= 5 and k > 1 then greatest(0, b0 - 4) else 0 end as int) y0, cast(case when most >= 5 and k > 1 then least(h - 1, b1 + 4) else h - 1 end as int) y1 "
    "from hh join t using (img_id) left join n on n.img_id = hh.img_id and n.n = 1",
    "ink_bbox": PIX + " select img_id, min(x) filter (where v < 200) x0, min(y) filter (where v < 200) y0, max(x) filter (where v < 200) + 1 x1, max(y) filter (where v < 200) + 1 y1 from pixels group by all",
    "crop_extent": PIX + ", a as (select img_id, min(x) filter (where v < 215) a, min(y) filter (where v < 215) b, max(x) filter (where v < 215) c, max(y) filter (where v < 215) d, max(x) + 1 w, max(y) + 1 h from pixels group by all) "
    "select img_id, coalesce(greatest(0, a - 4), 0) x0, coalesce(greatest(0, b - 4), 0) y0, case when c is null then w else least(w, c + 5) end x1, case when d is null then h else least(h, d + 5) end y1 from a",
    "densest_window": PIX + ", c as (select img_id, x, count(*) filter (where 255 - v > 40) ink from pixels group by all), s as (select a.img_id, a.x, sum(b.ink) score from c a join c b on a.img_id = b.img_id and b.x between a.x and a.x + 15 where a.x <= 48 group by all), "
    "n as (select *, row_number() over (partition by img_id order by score desc, x) n from s) select img_id, cast(case when score < 5 then 24 else x end as int) x0, cast(case when score < 5 then 24 else x end + 16 as int) x1 from n where n = 1",
    "ink_metrics": PIX + " select img_id, 64 w, count(*) n_pixels, count(*) filter (where v < 200) n_ink, coalesce(max(x) filter (where v < 200) - min(x) filter (where v < 200) + 1, 0) ink_w, count(*) filter (where v < 200 and x < 9) n_left from pixels group by img_id",
    "qa_verdict": with_duck("metrics") + ", m as (select *, n_ink / n_pixels::double dens, floor(n_ink * left_pct / 100.0) lft from metrics), v as (select *, case when dens < 0.008 then 'near_empty' when n_ink = 0 then 'no_ink' "
    "when ink_w < greatest(24, 3.5 * least(nchar, 8)) then 'too_narrow' when w >= 400 and dens < 0.04 and lft / greatest(1, n_ink) > 0.85 then 'left_truncated' when w >= 700 and dens < 0.035 then 'sparse_wide' else 'ok' end rule from m) "
    "select id, pk, sk, rule, rule = 'ok' ok from v",
    "alpha_lut": "select cast(v as int) v, cast(case when (255 - v) / 255.0::double < 0.05 then 0 else floor(power((255 - v) / 255.0::double, 0.85) * 255) end as int) alpha from range(256) t(v)",
    "token_budget": BUDGET + "select id, cast(line as int) line, cast(first as int) as first from f",
    "retry_plan": BUDGET + f", t as (select id, heavy, first a0, {NEXT.format('first')} a1, {NEXT.format(NEXT.format('first'))} a2 from f), u as (select id, unnest(case when heavy then [a0, a1, a2] else [a0, a1] end) tokens, "
    "unnest(case when heavy then [0, 1, 2] else [0, 1] end) attempt from t) select id, cast(attempt as int) attempt, cast(tokens as int) tokens, case when id % 3 <> 0 then id + attempt end attempt_seed from u",
    "best_attempt": with_duck("metrics") + ", t as (select id % 1000 * 1000 + pk % 1000 line, sum(n_ink) a, sum(ink_w) b, sum(sk) c from metrics group by all), u as (select line, unnest([a, b, c]) score, unnest([0, 1, 2]) attempt from t), "
    "o as (select *, (score + attempt) % 4 = 0 ok from u), r as (select *, row_number() over (partition by line order by ok desc, case when ok then attempt end, case when not ok then score end desc, attempt) n from o) "
    "select line, cast(attempt as int) attempt, ok, cast(score as bigint) score from r where n = 1",
    "batch_chunks": LINES + ", s as (select *, count(*) over (partition by job_id) n from lines), z as (select *, cast(ceil(n / least(3, n)::double) as bigint) sz from s) select job_id, i, i // sz chunk_id, i // sz * sz start, i - i // sz * sz pos, seed + i // sz * sz + 17 * (i - i // sz * sz) line_seed from z",
    "zip_cells": SYNTH + f", lines as ({DUCK['lines']}), a as (select pair_id job_id, page * 100000 + ord as ord, text cell, row_number() over (partition by pair_id order by page * 100000 + ord) k from spans_synth where {BLUE}), "
    "b as (select job_id, i, text line, row_number() over (partition by job_id order by i) k from lines) select a.job_id, a.ord, a.cell, b.i, b.line from a join b on a.job_id = b.job_id and a.k = b.k",
    "job_latest": with_duck("jobs") + ", n as (select *, row_number() over (partition by job_id order by seq desc) n from jobs) select job_id, seq, status, error from n where n = 1",
    "job_patches": with_duck("jobs") + " select job_id, max(seq) seq, arg_max(status, seq) status, max(error) error from jobs group by all",
    "job_transitions": with_duck("jobs") + ", q as (select job_id, seq, case when job_id % 7 = 0 and seq = 1 then 'done' else status end status from jobs), p as (select job_id, seq, status, lag(status) over (partition by job_id order by seq) previous from q) select *, case when previous is null then status = 'queued' "
    "else list_contains(['queued>calling_modal', 'queued>error', 'calling_modal>stamping', 'calling_modal>error', 'stamping>done', 'stamping>error'], previous || '>' || status) end valid from p",
    "style_backfill": STYLES + "select * from bf",
    "active_style": STYLES + ", s as (select c_custkey, 's' || (c_custkey % 500) active_style_id from customer) select c_custkey, case when coalesce(trim(bf.style_text) <> '', false) then active_style_id else 'default' end active_style_id from s left join bf on bf.id = active_style_id",
    "style_image": STYLES + "select id, coalesce(prepared_path, path) image_path from st",
    "style_upsert": "select c_custkey, case when c_mktsegment = 'BUILDING' then upper(c_name) else c_name end c_name from customer",
    "job_tokens": "select o_orderkey, cast(case when o_orderkey % 3 = 0 then o_orderkey % 200 when o_orderkey % 2 = 0 then o_custkey % 200 else 128 end as int) tokens from orders",
    "content_ids": "select p_partkey, substring(sha256(p_name), 1, 12) id from part",
    "enabled_lines": CELLS + "select pair_id, id, case when text is null or text = '' then ' ' else text end as text from cells where coalesce(enabled, true)",
    "cell_overrides": CELLS + "select pair_id, id, case when x0 >= 160 and text is not null then upper(text) else text end as text, case when x0 >= 160 and page = 0 then false else enabled end enabled from cells",
    "cells_json": CELLS + "select pair_id, cast(row_number() over (partition by pair_id order by page, ord) - 1 as int) as ord, id, page, x0, y0, x1, y1, coalesce(text, '') as text, coalesce(enabled, true) enabled from cells",
    "missing_files": "select p_brand || '/' || p_name as name, p_partkey, p_size from part where p_brand || '/' || p_name not in (select p_brand || '/' || p_name from part where p_size > 20 and p_partkey % 3 = 0)",
    "style_updates": STYLES + "select bf.id, case when c_custkey % 5 = 2 and c_custkey <> 1 then upper(c_mktsegment) else bf.style_text end as style_text from bf left join customer on 's' || c_custkey = bf.id",
    "style_activation": "select c_custkey, case when c_custkey % 4 = 0 then 'default' else 's' || c_custkey end active_style_id from customer where c_custkey > 1",
    "upload_buckets": "with e as (select user_id, event_id, event_id % 2 = 0 t, case when event_id % 7 < 3 then 'choose' when event_id % 7 < 6 then 'save' else 'clear' end act from events), "
    "l as (select user_id, arg_max(act, event_id) filter (where t) a, arg_max(act, event_id) filter (where not t) b, arg_max(act, event_id) z from e group by all), "
    "m as (select *, coalesce(a <> 'clear', false) ca, coalesce(b <> 'clear', false) cb from l) select user_id, case when not ca then 'empty' when not cb then 'pending' when a = 'save' then 'stored' else 'saving' end as template, "
    "case when not cb then 'empty' when not ca then 'pending' when b = 'save' then 'stored' else 'saving' end synthetic, coalesce(a = 'save' and b = 'save', false) upload, z <> 'save' reset from m",
    "cell_counts": CELLS + "select pair_id, count(*) cells, sum(case when enabled is null or enabled then 1 else 0 end)::bigint enabled from cells group by all",
    "error_excerpt": with_duck("jobs") + " select job_id, seq, left(repeat(error, 90), 800) shown from jobs",
    "generate_gather": LINES + " select job_id, i, text, cast(12 * greatest(1, length(text)) + 8 as int) w, cast(64 as int) h from lines",
    "thicken_ink": PIX + " select p.img_id, p.y, p.x, case when exists (select 1 from pixels q where q.img_id = p.img_id and q.y in (p.y, p.y - 1) and q.x in (p.x, p.x - 1) and q.v < 200) then least(p.v, 40) else p.v end v from pixels p",
    "ink_edges": PIX + ", s as (select img_id, max(y) h, max(x) w from pixels group by all), n as (select p.*, case when x = 0 then least(1, w) else x - 1 end l, case when x = w then greatest(w - 1, 0) else x + 1 end r, "
    "case when y = 0 then least(1, h) else y - 1 end u, case when y = h then greatest(h - 1, 0) else y + 1 end d from pixels p join s using (img_id)) "
    "select n.img_id, n.y, n.x, abs(2 * (a.v + b.v + c.v + e.v) - 8 * n.v) edge from n join pixels a on a.img_id = n.img_id and a.y = u and a.x = l join pixels b on b.img_id = n.img_id and b.y = u and b.x = r "
    "join pixels c on c.img_id = n.img_id and c.y = d and c.x = l join pixels e on e.img_id = n.img_id and e.y = d and e.x = r",
    "valley_crop": PIX + ", m as (select img_id, avg(v) < 127 low, max(x) + 1 w, max(y) + 1 h from pixels group by all), g as (select img_id, y, x, case when low then 255 - v else v end v from pixels join m using (img_id)), "
    "c as (select img_id, x, sum(case when v < 205 then 1 else 0 end) ink from g group by all), k as (select a.img_id, a.x, sum(b.ink) s from c a join c b on a.img_id = b.img_id and abs(a.x - b.x) <= 3 group by all), "
    "o as (select img_id, x from (select *, max(s) over (partition by img_id) top from k) z where s > 14 and s > 0.15 * top), r as (select img_id, min(x) a, max(x) b from (select *, x - row_number() over (partition by img_id order by x) i from o) z group by img_id, i), "
    "q as (select *, min(a) over (partition by img_id) first, lag(b) over (partition by img_id order by a) before from r), e as (select img_id, first, coalesce(min(before) filter (where a - before > 10 and before - first >= 35), max(b)) last from q group by all), "
    "i as (select img_id, max(ink) most from c group by all), f as (select m.img_id, w, h, most < 2 or first is null as whole, first, least(last, first + least(w, 88) - 1) last from m join i using (img_id) left join e using (img_id)), "
    "x as (select img_id, h, whole, case when whole then 0 else greatest(0, first - 4) end x0, case when whole then w else least(w, last + 5) end x1 from f), "
    "y as (select img_id, h, x0, x1, min(g.y) filter (where v < 205 and not whole) lo, max(g.y) filter (where v < 205 and not whole) hi from x join g using (img_id) where g.x >= x0 and g.x < x1 group by all), "
    "z as (select img_id, x0, x1, coalesce(greatest(0, lo - 4), 0) y0, coalesce(least(h, hi + 5), h) y1 from y) select img_id, x0, y0, x1, y1, sum(v) total from z join g using (img_id) where g.x >= x0 and g.x < x1 and g.y >= y0 and g.y < y1 group by all",
    "first_existing": "select c_nationkey grp, arg_min(c_name, c_custkey) filter (where c_acctbal < 0) path from customer group by all",
    "job_previews": LINES + " select job_id, cast(i as int) i, lpad(cast(i as varchar), 3, '0') || '.png' file from lines",
    "glyph_lookup": "with c as (select p_partkey, unnest(range(1, length(p_name) + 1)) u, p_name from part) select p_partkey, cast(u - 1 as int) pos, substring(p_name, u, 1) ch, n_nationkey glyph from c left join nation on chr(cast(97 + n_nationkey % 26 as int)) = substring(p_name, u, 1)",
}

PAIRED = (
    with_duck("spans_synth", "spans_tmpl")
    + f", j as (select s.pair_id, s.page, s.ord s_ord, t.ord t_ord, {NORM.replace('text', 's.text')} sn, {NORM.replace('text', 't.text')} tn, "
    "least(s.x1, t.x1) - greatest(s.x0, t.x0) w, least(s.y1, t.y1) - greatest(s.y0, t.y0) h, abs((s.x1 - s.x0) * (s.y1 - s.y0)) sa, abs((t.x1 - t.x0) * (t.y1 - t.y0)) ta, "
    "(t.x0 + t.x1) / 2 - (s.x0 + s.x1) / 2 dx, (t.y0 + t.y1) / 2 - (s.y0 + s.y1) / 2 dy from spans_synth s join spans_tmpl t on s.pair_id = t.pair_id and s.page = t.page), "
    "k as (select *, case when w <= 0 or h <= 0 then 0 else w * h / greatest(sa + ta - w * h, 1e-6::double) end iou from j) "
)
SQL["iou_pairs"] = PAIRED + "select pair_id, page, s_ord, t_ord, iou from k where iou > 0"
SQL["template_has_match"] = (
    PAIRED + "select distinct pair_id, page, s_ord as ord from k where sn = tn and sqrt(dx * dx + dy * dy) < 24 or iou >= 0.15::double and (contains(tn, sn) or contains(sn, tn)) or iou >= 0.35::double"
)
SQL["stamp_layout"] = (
    SYNTH + ", a as (select pair_id, page, ord, 20 + (ord * 37 + pair_id) % 700 w, 8 + pair_id % 60 h, x0, y0, x1 - x0 cw, y1 - y0 ch, case when x1 - x0 - 2 >= 2 and y1 - y0 - 2 >= 2 then 1 else 0 end s from spans_synth), "
    "b as (select *, x0 + s tx, y0 + s ty, cw - 2 * s tw, ch - 2 * s th, w / cast(greatest(h, 1) as double) asp from a), c as (select *, greatest(1, th * 0.85::double) nh1 from b), "
    "d as (select *, nh1 * asp > tw * 1.15::double wide from c), e as (select *, case when wide then tw * 1.15::double else nh1 * asp end nw2, case when wide then tw * 1.15::double / greatest(asp, 1e-6::double) else nh1 end nh2 from d), "
    "f as (select *, case when nh2 > th then th else nh2 end nh3, case when nh2 > th then th * asp else nw2 end nw3 from e), g as (select *, greatest(1, nw3) nw, greatest(1, nh3) nh from f) "
    "select pair_id, page, ord, tx px0, ty + greatest(0, (th - nh) / 2) py0, tx + nw px1, ty + greatest(0, (th - nh) / 2) + nh py1, "
    "cast(greatest(1, round_even(nw * 4, 0)) as int) px_w, cast(greatest(1, round_even(nh * 4, 0)) as int) px_h from g"
)
SQL["line_scores"] = with_duck("metrics") + " select id, pk, sk, n_ink / n_pixels::double * greatest(ink_w, 1) score from metrics"
SQL["failure_list"] = (
    with_duck("metrics") + ", v as (select pk % 100 job, case when n_ink / n_pixels::double < 0.008 then 'near_empty' when n_ink = 0 then 'no_ink' when ink_w < greatest(24, 3.5 * least(nchar, 8)) then 'too_narrow' "
    "when w >= 700 and n_ink / n_pixels::double < 0.035 then 'sparse_wide' else 'ok' end r from metrics) select job, string_agg(r || ' x ' || n, ',' order by r) failures from (select job, r, count(*) n from v where r <> 'ok' group by all) c group by all"
)
