"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# every text survives the round trip
ORACLE["p8_roundtrip"] = "select doc_id, length(coalesce(text, ''))::int as n_chars, md5(coalesce(text, '')) as md5 from documents"

# groups are sets of lines all alike, so the lowest line that a line is like names its group
ORACLE["p2_found"] = """
with v as (select distinct book_id, line_id, x_unit x, y_unit y, font_ratio_to_body r from style_lines
  where x_unit is not null and not isnan(x_unit) and y_unit is not null and not isnan(y_unit) and font_ratio_to_body is not null and not isnan(font_ratio_to_body)),
c as (select *, floor(x * 2)::bigint cx, floor(y * 2)::bigint cy from v),
n as (select a.book_id, a.line_id, min(b.line_id) g from c a join (select unnest([-1, 0, 1]) dx) on true join (select unnest([-1, 0, 1]) dy) on true
  join c b on a.book_id = b.book_id and a.cx + dx = b.cx and a.cy + dy = b.cy
  where abs(a.x - b.x) <= 0.5 and abs(a.y - b.y) <= 0.5 and greatest(a.r, b.r) <= 1.05 * least(a.r, b.r) group by all),
o as (select line_id line_id_a, lead(line_id) over (partition by book_id, g order by line_id) line_id_b from n)
select * from o where line_id_b is not null"""

ORACLE["p1_found"] = r"""
select distinct run_id, node_id from segments s join split_limits l using (export_mode)
where len(regexp_extract_all(content_markdown, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > l.max_words"""

_W = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# size, first and last line of every group of two lines or more, the groups as in p2_found
ORACLE["p2_sizes"] = ORACLE["p2_found"].split("o as (")[0].rstrip(",\n ") + """
select book_id, count(*) as size, min(line_id) as first_line, max(line_id) as last_line from n group by book_id, g having count(*) >= 2"""

# what holds of all pieces of a text, wherever they are cut: the first begins at 0, the last ends at the end, each is within the limit, neighbours share the overlap
ORACLE["p1_coverage"] = f"""
select distinct run_id, node_id, len(regexp_extract_all(content_markdown, '{_W}'))::bigint as words, true as whole, true as within, true as shared
from segments join split_limits l using (export_mode) where len(regexp_extract_all(content_markdown, '{_W}')) > l.max_words"""

# statistics that SQL can tell as well
ORACLE["p10_counts"] = r"""
with w as (select doc_id, text, list_filter(string_split(regexp_replace(text, '[\n\t\r\x{a0}\x{3000}]', ' ', 'g'), ' '), lambda x: x <> '') as ws from documents where regexp_matches(text, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')),
c as (select *, list_sum(list_transform(ws, lambda x: length(x))) as chars from w)
select doc_id, len(ws)::int as n_words, round(chars / len(ws), 6) as mean_word_length, round(len(regexp_extract_all(text, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\p{L}\p{N}\p{M}]')) / chars, 6) as symbol_ratio from c"""
