"""DuckDB SQL for the registered core queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["p4_found"] = """
with r as (
  select 0 src, run_id entity_id, content_start_page s, content_end_page e from segments
  union select 1, report_id, start_page, end_page from subsection_report),
v as (select * from r where s is not null and e is not null and e >= s),
m as (select *, max(e) over (partition by src, entity_id order by s, e rows between unbounded preceding and 1 preceding) pe from v),
i as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by src, entity_id order by s, e rows unbounded preceding) g from m),
p as (select src, entity_id, g, min(s) s, max(e) e from i group by all),
n as (select *, lead(s) over (partition by src, entity_id order by s) ns from p)
select entity_id, 'period' kind, s start_page, e end_page from n
union all select entity_id, 'gap', e + 1, ns - 1 from n where ns is not null"""

_PARENTS = """
with recursive base as (
  select distinct run_id, node_id, lower(trim(node_id)) v, lower(trim(parent_id)) named, children_ids from segments),
kids as (select run_id, lower(trim(c)) v, min(lister) lister from (select run_id, v lister, unnest(children_ids) c from base) group by all),
want as (select b.run_id, b.node_id, b.v, coalesce(b.named, k.lister) want from base b left join kids k on b.run_id = k.run_id and b.v = k.v),
link as (select w.run_id, w.node_id, w.v, b.v p from want w left join base b on w.run_id = b.run_id and w.want = b.v),
walk as (
  select run_id, v, node_id root_id, 0 depth, node_id path from link where p is null
  union all select l.run_id, l.v, w.root_id, w.depth + 1, w.path || '/' || l.node_id from link l join walk w on l.run_id = w.run_id and l.p = w.v),
chase as (
  select run_id, v, p cur, 1 n from link where (run_id, v) not in (select run_id, v from walk)
  union all select c.run_id, c.v, l.p, c.n + 1 from chase c join link l on c.run_id = l.run_id and c.cur = l.v
    where c.n <= (select max(k) from (select count(*) k from link group by run_id)))
"""

ORACLE["p5_found"] = _PARENTS + """
select l.run_id, l.node_id,
  case when w.v is not null then w.root_id when exists (select 1 from chase c where c.run_id = l.run_id and c.v = l.v and c.cur = l.v) then 'cycle' else 'below_cycle' end root_id,
  coalesce(w.depth, -1)::int as depth
from link l left join walk w on l.run_id = w.run_id and l.v = w.v"""

ORACLE["p5_paths"] = _PARENTS + """
, up as (
  select run_id, v, p a from link where (run_id, v) in (select run_id, v from walk) and p is not null
  union all select u.run_id, u.v, l.p from up u join link l on u.run_id = l.run_id and u.a = l.v where l.p is not null),
nd as (select run_id, a v, count(*) n from up group by all)
select l.run_id, l.node_id, w.path, w.depth::int as depth, coalesce(nd.n, 0)::bigint n_descendants
from link l join walk w on l.run_id = w.run_id and l.v = w.v left join nd on nd.run_id = l.run_id and nd.v = l.v"""

ORACLE["p5_descendants"] = _PARENTS + """
, up as (
  select run_id, v, p a from link where (run_id, v) in (select run_id, v from walk) and p is not null
  union all select u.run_id, u.v, l.p from up u join link l on u.run_id = l.run_id and u.a = l.v where l.p is not null)
select u.run_id, a.node_id ancestor_id, d.node_id descendant_id
from up u join link a on a.run_id = u.run_id and a.v = u.a join link d on d.run_id = u.run_id and d.v = u.v"""


# ---- the reference's operators ---------------------------------------------------------------

_B = r"[\x00\x01\x08\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\s]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_B}', ' ', 'g'))"


def _words(c: str) -> str:
    return rf"len(regexp_extract_all(coalesce({c}, ''), '\S+'))"


_LINES = f"""
with l as (
  select distinct book_id, line_id, pdf_page, {_norm('text')} as text, x0, y0, x1, y1, page_width, page_height, font_size, height, is_bold
  from style_lines where regexp_matches(text, '[A-Za-z가-힣0-9]') and book_id is not null and pdf_page is not null),
t0 as (select *, case when page_height > 0 then (y0 + y1) / 2 / page_height else 0 end as yr from l),
"""


def _valleys(name: str, source: str, points: int, few: int) -> str:
    """CTEs that end with ``name``: (book_id, cut) at the strict minima of the Gaussian density of ``source`` (book_id, v).

    With at most ``few`` values, or no spread, midpoints of the values; ``few`` 0 gives none then.
    """
    middle = f"select book_id, (v + lead(v) over (partition by book_id order by v)) / 2 as cut from {name}_h"
    return f"""
{name}_h as (select book_id, v, count(*) as c from {source} group by all),
{name}_s as (select book_id, sum(c) as n, count(*) as k, min(v) as lo, max(v) as hi, sum(v * c) / sum(c) as mean from {name}_h group by all),
{name}_q as (select book_id, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from {source} group by all),
{name}_w as (select s.*, 0.9 * least(sqrt((select sum(c * (v - s.mean) ** 2) from {name}_h h where h.book_id = s.book_id) / greatest(n - 1, 1)), (q3 - q1) / 1.34) * pow(n, -0.2) as w from {name}_s s join {name}_q using (book_id)),
{name}_g as (select book_id, i, lo + (hi - lo) * i / {points - 1} as x, w from {name}_w, (select unnest(range(0, {points})) as i) where k > {few} and w > 0 {'' if few else 'and n >= 3'}),
{name}_d as (select g.book_id, i, x, sum(c * exp(-0.5 * ((x - v) / w) ** 2)) as d from {name}_g g join {name}_h h using (book_id) group by all),
{name}_m as (select *, lag(d) over o as pd, lead(d) over o as nd from {name}_d window o as (partition by book_id order by i)),
{name} as (select book_id, x as cut from {name}_m where pd > d and d < nd
  {f'union all select m.book_id, cut from ({middle}) m join {name}_w using (book_id) where cut is not null and (k <= {few} or not w > 0)' if few else ''})"""


_LINES += _valleys("fv", "(select book_id, round(font_size, 2)::double as v from l where font_size is not null)", 2048, 8) + """,
t as (select t0.*, 1 + (select count(*) from fv where fv.book_id = t0.book_id and fv.cut > t0.font_size)::int as tier from t0)
"""

_PLAN = """
with p as (
  select book_id, row_number() over (partition by book_id order by ord, outline_id)::int as ord, title, level, pdf_page, 'existing_outline' as source
  from (select distinct outline_id, book_id, ord, title, level, pdf_page from existing_outline where pdf_page is not null and title is not null)),
tot as (select book_id, max(pdf_page) as total_pages from (select book_id, pdf_page from existing_outline union all select book_id, pdf_page from style_lines union all select book_id, pdf_page from ocr_line_stats union all select book_id, pdf_page from visual_rows)
  where book_id is not null and pdf_page is not null group by all)
"""


def _found(arm: str) -> str:
    return f"""(select book_id, row_number() over (partition by book_id order by pdf_page, source_item_id)::int as ord, title, predicted_level as level, pdf_page
  from (select distinct source_item_id, book_id, title, pdf_page, predicted_level from items where arm = '{arm}' and pdf_page is not null and title is not null and coalesce(category, '') <> 'caption'))"""


_FOUND = f"(select 'vision_pass' as arm, * from {_found('vision_pass')} union all select 'stack_refine', * from {_found('stack_refine')})"

_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace({c}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '–', '-'), '—', '-'), '’', ''''), '“', '"'), '”', '"'), '""" + _B + r"""', ' ', 'g'))),
  '\.{2,}', ' ', 'g'), '[\s.·•_=\-]{4,}', ' ', 'g'), '(^|[^\p{L}\p{N}_])\d{1,4}\s*$', '\1 '), '[^0-9a-z가-힣]+', ' ', 'g'), '\s+', ' ', 'g'))"""


def _key(c: str) -> str:
    return _KEY.replace("{c}", c)


ORACLE["norm_text"] = _LINES + f"select line_id, text, {_words('text')}::int as words from l"
ORACLE["match_keys"] = _PLAN + f"select book_id, ord, {_key('title')} as match_key from p"
def _depth(t: str) -> str:
    dots = f"regexp_extract({t}, '^(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)+)(?:$|[^\\p{{L}}\\p{{N}}\\p{{M}}_])', 1)"
    return rf"""(case when regexp_matches({t}, '(?i)^(chapter|part)\s+\p{{Nd}}+($|[^\p{{L}}\p{{N}}\p{{M}}_])') or regexp_matches({t}, '^제\s*\p{{Nd}}+\s*장') or regexp_matches({t}, '(?i)^appendix\s+[a-z]($|[^\p{{L}}\p{{N}}\p{{M}}_])') then 1
    when {dots} <> '' then len({dots}) - len(replace({dots}, '.', '')) + 1 when regexp_matches({t}, '^\p{{Nd}}+($|[^\p{{L}}\p{{N}}\p{{M}}_])') then 1 end)::int"""


ORACLE["numbering_depths"] = _PLAN + f", n as (select book_id, ord, {_norm('title')} as t from p)" + rf"""
, d as (select *, regexp_extract(t, '^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)($|[^\p{{L}}\p{{N}}\p{{M}}_])', 1) as num from n)
select book_id, ord, {_depth('t')} as depth,
  (case when regexp_matches(t, '^[\p{{Nd}}\s.·\-]+$') then 0 when regexp_matches(t, '(?i)^(chapter|part|appendix)($|[^\p{{L}}\p{{N}}\p{{M}}_])|^제\s*\p{{Nd}}+\s*장($|[^\p{{L}}\p{{N}}\p{{M}}_])') then 1
    when num = '' then -1 else len(num) - len(replace(num, '.', '')) + 1 end)::int as ocr_depth
from d"""
ORACLE["doc_lines"] = f"""
with s as (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as a from documents where text is not null),
u as (select doc_id, unnest(a) as raw, generate_subscripts(a, 1) as n from s),
k as (select doc_id, n, {_norm('raw')} as line from u)
select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as line_no, line from k where line <> ''"""
ORACLE["title_shapes"] = _LINES + f"select line_id from l where length(text) <= 160 and regexp_matches(text, '[A-Za-z가-힣]') and {_words('text')} <= 20"

_MARGIN = r"""
, sl as (select *, case when yr <= 0.12 then 'top' when yr >= 0.88 then 'bottom' end as side,
  case when yr <= 0.12 or yr >= 0.88 then round_even(yr / 0.015, 0)::int end as bucket, lower(text) as key from t),
rep as (select book_id, side, bucket, key, count(*) as count from sl where side is not null group by all having count(*) >= 3),
num as (select book_id, line_id, pdf_page, unnest(regexp_extract_all(text, '\d+')) as r from sl where side is not null),
off as (select distinct book_id, pdf_page, line_id, pdf_page - r::int as "offset" from num where length(r) <= 4 and r::int between 1 and 3000),
runs as (select book_id, "offset", pdf_page, pdf_page - row_number() over (partition by book_id, "offset" order by pdf_page) as island from (select distinct book_id, "offset", pdf_page from off)),
ok as (select book_id, "offset", pdf_page from (select *, count(*) over (partition by book_id, "offset", island) as c from runs) where c >= 2)
"""
ORACLE["repeated_margin_lines"] = _LINES + _MARGIN + "select book_id, side, bucket, key, count from rep"
ORACLE["printed_page_offsets"] = _LINES + _MARGIN + 'select book_id, "offset", pdf_page from ok'
ORACLE["margin_removed_lines"] = _LINES + _MARGIN + """
select book_id, line_id from sl where side is null or (
  (book_id, side, bucket, key) not in (select book_id, side, bucket, key from rep)
  and line_id not in (select off.line_id from off join ok using (book_id, "offset", pdf_page)))"""

_TIERS = _LINES + f"""
, ts as (select book_id, tier, count(*) as lines, quantile_cont(font_size::double, 0.5) as median_size, sum(length(regexp_replace(text, '{_B}', '', 'g')))::bigint as text_length from t group by all),
cov as (select *, sum(text_length) over (partition by book_id) as whole, coalesce(sum(text_length) over (partition by book_id order by text_length desc, lines desc, tier rows between unbounded preceding and 1 preceding), 0) as before from ts),
bod as (select book_id, tier, before::double / whole < 0.95 as body from cov)
"""
ORACLE["tier_summary"] = _TIERS + "select * from ts"
ORACLE["tier_coverage"] = _TIERS + "select * from bod"
ORACLE["font_profile"] = _TIERS + """
, sets as (select book_id, list_sort(list(tier) filter (body)) as body_tiers, coalesce(list_sort(list(tier) filter (not body)), []) as candidate_tiers from bod group by all),
sz as (select t.book_id, quantile_cont(font_size::double, 0.5) as body_size from t join bod on t.book_id = bod.book_id and t.tier = bod.tier and bod.body group by all)
select * from sets join sz using (book_id)"""
_GAPS = """
, b as (select t.* from t join bod on t.book_id = bod.book_id and t.tier = bod.tier and bod.body),
g as (select *, lag(y0) over w as py0, lag(x0) over w as px0, lag(x1) over w as px1 from b window w as (partition by book_id, pdf_page order by y0, x0, line_id)),
gv as (select book_id, round(y0 - py0, 2)::double as v from g where y0 > py0 and greatest(x0, px0) < least(x1, px1)),
gq as (select book_id, quantile_cont(v, 0.5) as mid, quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) as fence from gv group by all),
core as (select book_id, v from gv join gq using (book_id) where v <= fence)
"""
ORACLE["body_gaps"] = _TIERS + _GAPS + "select book_id, count(*) as gaps, quantile_cont(v, 0.5) as median_gap from gv group by all"
_SPACING = _GAPS + ", " + _valleys("sv", "core", 1024, 0) + """,
sp as (select gq.book_id, mid as body_spacing, coalesce((select min(cut) from sv where sv.book_id = gq.book_id and cut >= mid), (select max(v) from core where core.book_id = gq.book_id)) as continuation_upper from gq)
"""
ORACLE["font_tier_cuts"] = _LINES + "select book_id, (row_number() over (partition by book_id order by cut) - 1)::int as n, round(cut, 6) as cut from fv"
ORACLE["font_tier_sets"] = _LINES + """
, n as (select b.book_id, count(fv.cut) as k from (select distinct book_id from l where font_size is not null) b left join fv using (book_id) group by all), c as (select book_id, unnest(range(1, k + 2))::int as tier from n),
r as (select book_id, cut, row_number() over (partition by book_id order by cut desc) as i from fv), h as (select book_id, tier, count(*) as n, quantile_cont(font_size::double, 0.5) as m from t where font_size > 0 group by all)
select c.book_id, c.tier, round(lo.cut, 6) as lower_bound, round(up.cut, 6) as upper_bound, round(coalesce(m, lo.cut, up.cut, 0.0), 4) as peak, coalesce(h.n, 0) as count
from c left join r lo on lo.book_id = c.book_id and lo.i = c.tier left join r up on up.book_id = c.book_id and up.i = c.tier - 1 left join h on h.book_id = c.book_id and h.tier = c.tier"""
ORACLE["body_spacing"] = _TIERS + _SPACING + "select book_id, round(body_spacing, 6) as body_spacing, round(continuation_upper, 6) as continuation_upper from sp"

_BPE = _LINES + """
, mode as (select book_id, arg_max(tier, n * 1000 + tier) as body_tier from (select book_id, tier, count(*) as n from t group by all) group by all),
bl as (select t.*, y0 - lag(y0) over w as dy, greatest(height, lag(height) over w, 1e-6) as hh from t join mode using (book_id) where tier >= body_tier window w as (partition by book_id, pdf_page order by y0, x0, line_id)),
rs as (select book_id, pdf_page, dy / hh as gap from bl where dy > 0)
"""
ORACLE["bpe_body"] = _BPE + "select mode.book_id, body_tier, coalesce((select quantile_cont(gap, 0.5) from rs where rs.book_id = mode.book_id), 1.0) as book_spacing from mode"
ORACLE["bpe_page_spacing"] = _BPE + "select book_id, pdf_page, quantile_cont(gap, 0.5) as page_spacing from rs group by all"
_CHUNKS = _TIERS + _SPACING + """
, c0 as (select l.*, case when y0 - lag(y0) over w <= coalesce(continuation_upper, 1.0) then 0 else 1 end as new, row_number() over w as n from l left join sp using (book_id) window w as (partition by book_id, pdf_page order by y0, x0, line_id)),
c1 as (select *, sum(new) over (partition by book_id, pdf_page order by n) as part from c0),
c2 as (select book_id, pdf_page, part, arg_min(x0, n) as x0, min(y0) as y0, count(*)::int as line_count, quantile_cont(font_size::double, 0.5) as font_size, string_agg(text, ' ' order by n) as text from c1 group by all),
c3 as (select *, row_number() over (partition by book_id order by pdf_page, part) as chunk_id from c2)
"""
ORACLE["line_chunks"] = _CHUNKS + "select book_id, chunk_id, pdf_page, x0, y0, line_count, font_size from c3"
ORACLE["anchor_patterns"] = _CHUNKS + """
, nx as (select *, lead(x0) over w as nx, lead(y0) over w as ny from c3 window w as (partition by book_id, pdf_page order by y0, x0, chunk_id))
select book_id, chunk_id, round(x0 / st, 6) as v0, round(y0 / st, 6) as v1, round(nx / st, 6) as v2, round(ny / st, 6) as v3 from (select nx.*, coalesce(body_spacing, 1.0) as st from nx left join sp using (book_id)) where nx is not null"""

_EVIDENCE = _LINES + rf"""
, rp as (select book_id, text from t where yr < 0.08 or yr > 0.92 group by all having count(*) >= 3),
kp as (select t.* from t left join rp using (book_id, text) where not (rp.text is not null and (yr < 0.10 or yr > 0.90))),
ev as (select *, tier <= 3 as a, depth is not null as b, yr < 0.28 as c, coalesce(is_bold, false) as d from (select *, {_depth('text')} as depth from kp where length(text) <= 160 and regexp_matches(text, '[A-Za-z가-힣]') and {_words('text')} <= 20)),
sc as (select *, round(least(1.0, 0.25 + (case when a then 0.25 else 0 end) + (case when b then 0.18 else 0 end) + (case when c then 0.07 else 0 end) + (case when d then 0.05 else 0 end))::double, 4) as confidence,
  concat_ws('|', case when a then 'large_font_tier' end, case when b then 'numbering' end, case when c then 'top_of_page' end, case when d then 'bold' end) as evidence from ev),
ca as (select * from (select *, row_number() over (partition by book_id, pdf_page, lower(text) order by confidence desc, y0, x0, line_id) as r from sc where a and confidence >= 0.45) where r = 1)
"""
ORACLE["heading_evidence"] = _EVIDENCE + "select book_id, line_id, confidence, evidence from ca"
ORACLE["strongest_candidates"] = _EVIDENCE + "select book_id, pdf_page, line_id from (select *, row_number() over (partition by book_id, pdf_page order by confidence desc, tier, coalesce(depth, 99), y0, length(text), line_id) as q from ca) where q = 1"
# candidate blocks: a class that is no body class, larger than the body, of few words; sr is the class's place among those of its book
_CANDIDATES = _CHUNKS + f"""
, bs as (select t.book_id, quantile_cont(font_size::double, 0.5) as body_size from t join bod on t.book_id = bod.book_id and t.tier = bod.tier and bod.body group by all),
kt as (select book_id, tier, row_number() over (partition by book_id order by tier) as sr from bod where not body),
cc as (select c3.*, 1 + (select count(*) from fv where fv.book_id = c3.book_id and fv.cut > c3.font_size)::int as tier from c3),
cd as (select cc.*, sr from cc join kt using (book_id, tier) join bs using (book_id) where cc.font_size > body_size and {_words('text')} <= 20)
"""
ORACLE["page_cap_filter"] = _CANDIDATES + "select book_id, chunk_id, tier from (select *, count(*) over (partition by book_id, pdf_page) as n from cd) where n <= 2"

ORACLE["plan_parents"] = _PLAN + "select a.book_id, a.ord, (select max(b.ord) from p b where b.book_id = a.book_id and b.ord < a.ord and b.level < a.level) as parent_ord from p a"
_RANGES = """
, rg as (select a.*, tot.total_pages, (select min(b.ord) from p b where b.book_id = a.book_id and b.ord > a.ord and b.level <= a.level) as n from p a join tot using (book_id)),
rr as (select a.*, a.pdf_page as start_page, greatest(a.pdf_page, coalesce(b.pdf_page - 1, a.total_pages))::int as end_page from rg a left join p b on a.book_id = b.book_id and a.n = b.ord)
"""
ORACLE["plan_ranges"] = _PLAN + _RANGES + "select book_id, ord, start_page, end_page from rr"
ORACLE["plan_levels"] = _PLAN + f"""
, o as (select * exclude (ord), row_number() over (partition by book_id order by ord) as ord from (select *, row_number() over (partition by book_id, pdf_page, lower(title) order by ord) as r from p where pdf_page >= 1 and {_norm('title')} <> '') where r = 1),
d as (select a.book_id, a.ord, count(b.ord) as above from o a left join o b on a.book_id = b.book_id and b.ord < a.ord and greatest(1, b.level) <
  (select min(greatest(1, c.level)) from o c where c.book_id = a.book_id and c.ord > b.ord and c.ord <= a.ord) group by all)
select o.book_id, o.ord::int as ord, title, (1 + above)::int as level, pdf_page from o join d using (book_id, ord)"""
_WARN = f"""
, lg as (select p.*, total_pages, lag(level) over w as pl, lag(pdf_page) over w as pp from p join tot using (book_id) window w as (partition by book_id order by ord)),
wn as (select book_id, ord, unnest(list_filter([case when {_norm('title')} = '' then 'blank_title' end, case when level < 1 then 'level_below_one' end, case when level > pl + 1 then 'level_jump' end,
  case when pdf_page < 1 or pdf_page > total_pages then 'page_out_of_range' end, case when pdf_page < pp then 'page_goes_back' end], lambda x: x is not null)) as warning from lg)
"""
ORACLE["plan_validation"] = _PLAN + _WARN + "select * from wn"
ORACLE["deepest_parents"] = _PLAN + _RANGES + f"""
, pg as (select distinct arm, book_id, pdf_page from {_FOUND}),
b as (select arm, pg.book_id, pg.pdf_page, level, ord, row_number() over (partition by arm, pg.book_id, pg.pdf_page order by level desc, start_page desc, ord desc) as r from pg left join rr on pg.book_id = rr.book_id and pg.pdf_page between start_page and end_page)
select arm, book_id, pdf_page, level as parent_level, ord as parent_ord from b where r = 1"""
_QUALITY = f"""
, q as (select book_id, count(*) as items, list_sort(list({{'o': ord, 't': trim(title)}}) filter (regexp_full_match(trim(title), '\\p{{Nd}}+')))[:5] as nums, max(total_pages) as total_pages from p join tot using (book_id) group by all),
qq as (select book_id, items, concat_ws('|', case when items < 4 then 'too_few_items' end, case when total_pages > 0 and items >= total_pages * 0.2 then 'near_one_bookmark_per_page' end, case when len(nums) > 0 then 'numeric_only_title' end) as reasons,
  concat_ws('|', case when items < 4 then 'item_count=' || items || ' < min_item_count=4' end, case when total_pages > 0 and items >= total_pages * 0.2 then 'item_count=' || items || ' >= total_pages(' || total_pages || ') * max_item_to_page_ratio(0.2)' end,
    case when len(nums) > 0 then 'numeric_only_titles=[''' || array_to_string(list_transform(nums, lambda x: x.t), ''', ''') || ''']' end) as evidence from q)
"""
ORACLE["outline_quality"] = _PLAN + _QUALITY + "select book_id, items, reasons <> '' as low_quality, reasons, evidence from qq"
ORACLE["clean_outlines"] = _PLAN + r"""
, x as (select *, lag(pdf_page ignore nulls) over (partition by book_id order by ord) as pp from p)
select book_id, count(distinct level) >= 2 as meaningful,
  count(*) >= 10 and count(*) filter (trim(title) = '') = 0 and count(pdf_page) >= 0.8 * count(*) and count(*) filter (pdf_page >= pp) >= 0.75 * count(pp) and count(distinct level) >= 2
    and bool_or(regexp_matches(lower(title), '(^|[^\p{L}\p{N}\p{M}_])(chapter|section|appendix|part)($|[^\p{L}\p{N}\p{M}_])') or regexp_matches(title, '\d+\.\d+')) as clean,
  bool_or(regexp_matches(title, '\p{L}')) as has_letter from x group by all"""
ORACLE["outline_reuse"] = _PLAN + _WARN + _QUALITY + """
select book_id, r is null as reuse, r as reason from (select qq.book_id, case when qq.book_id in (select book_id from wn) then 'invalid_structure' when reasons <> '' then 'low_quality_replace' end as r from qq)"""

_NODES = _PLAN + _RANGES + """
, par as (select a.book_id, a.ord, (select max(b.ord) from p b where b.book_id = a.book_id and b.ord < a.ord and b.level < a.level) as po from p a),
nd as (select rr.book_id, rr.ord, printf('n%04d', rr.ord) as node_id, title, level, start_page, end_page, total_pages, pdf_page,
  lead(pdf_page) over w as np, case when po is not null then printf('n%04d', po) end as parent_id, case when lag(rr.ord) over w is not null then printf('n%04d', lag(rr.ord) over w) end as previous_id,
  case when lead(rr.ord) over w is not null then printf('n%04d', lead(rr.ord) over w) end as next_id from rr join par on rr.book_id = par.book_id and rr.ord = par.ord window w as (partition by rr.book_id order by rr.ord)),
nn as (select *, (case when np is null then greatest(pdf_page, total_pages) when np > pdf_page then np - 1 end)::int as ce from nd),
ow as (select book_id, unnest(range(pdf_page, ce + 1))::int as pdf_page, node_id from nn where ce >= pdf_page)
"""
ORACLE["graph_nodes"] = _NODES + "select book_id, node_id, level, start_page, end_page, case when ce is not null then pdf_page end as content_start_page, ce as content_end_page, parent_id, previous_id, next_id from nn"
ORACLE["page_ownership"] = _NODES + "select book_id, pdf_page, node_id from ow"
_PW = f", pw as (select book_id, pdf_page, coalesce(sum({_words(_norm('text'))}), 0) as words from (select distinct stat_id, book_id, pdf_page, text from ocr_line_stats) group by all)"
ORACLE["coverage_report"] = _NODES + _PW + """
, iw as (select 'inclusive' as mode, book_id, unnest(range(start_page, end_page + 1))::int as pdf_page from nn union all select 'direct', book_id, pdf_page from ow), oc as (select mode, book_id, pdf_page, count(*) as n from iw group by all),
md as (select unnest(['inclusive', 'direct']) as mode),
pg as (select book_id, unnest(range(1, total_pages + 1))::int as pdf_page from tot)
select pg.book_id, md.mode, case when md.mode = 'direct' then (select count(*) from nn where nn.book_id = pg.book_id and ce is null) else 0 end as navigation_only_node_count, count(oc.n) as assigned_page_count, count(*) - count(oc.n) as unassigned_page_count, count(*) filter (oc.n > 1) as duplicated_page_count, count(*) filter (coalesce(pw.words, 0) = 0) as empty_text_page_count
from pg cross join md left join oc on oc.book_id = pg.book_id and oc.pdf_page = pg.pdf_page and oc.mode = md.mode left join pw on pw.book_id = pg.book_id and pw.pdf_page = pg.pdf_page group by pg.book_id, md.mode"""
_TITLE = f"(repeat('#', least(greatest(level, 1), 6)::int) || ' ' || {_norm('title')})"
# the chain of items each one level further up, walked row by row
_CHAIN = """
, up as (select a.book_id, a.ord, a.level, (select max(b.ord) from p b where b.book_id = a.book_id and b.ord < a.ord and b.level = a.level - 1) as above from p a),
ch as (select book_id, ord, above from up where above is not null union all select ch.book_id, ch.ord, up.above from ch join up on up.book_id = ch.book_id and up.ord = ch.above where up.above is not null)
"""
_SPLIT = _PLAN.replace("with p", "with recursive p") + _PW + _CHAIN + f"""
, lv as (select p.*, unnest(range(1, deep + 1))::int as split_level from p join (select book_id, max(level) as deep from p group by all) using (book_id)),
sg as (select *, sum(case when level <= split_level then 1 else 0 end) over (partition by book_id, split_level order by ord) as segment from lv),
s1 as (select book_id, split_level, segment, min(ord) as start_ord, arg_min(pdf_page, ord) as start_page, count(*) as items, sum({_words(_TITLE)}) as tw from sg where segment > 0 group by all),
s2 as (select s1.*, coalesce(lead(start_page) over (partition by book_id, split_level order by segment), total_pages + 1) as np from s1 join tot using (book_id)),
s3 as (select s2.*, case when np > start_page then start_page end as a, case when np > start_page then np - 1 end as b from s2),
s4 as (select book_id, split_level, segment::bigint as segment, start_page, a as content_start_page, b::int as content_end_page, items,
  (tw + coalesce((select sum(words) from pw where pw.book_id = s3.book_id and pw.pdf_page between a and b), 0) + coalesce((select sum({_words(_TITLE)}) from ch join p on p.book_id = ch.book_id and p.ord = ch.above where ch.book_id = s3.book_id and ch.ord = s3.start_ord), 0))::bigint as words from s3)
"""
ORACLE["split_segments"] = _SPLIT + "select * from s4"
ORACLE["split_statistics"] = _SPLIT + """
select book_id, split_level, count(*) as segments, sum(words)::bigint as words, min(words) as min_words, trunc(quantile_cont(words::double, 0.5))::int as p50, trunc(quantile_cont(words::double, 0.9))::int as p90,
  trunc(quantile_cont(words::double, 0.95))::int as p95, max(words) as max_words, round(avg(words), 1) as mean_words, round(avg((words <= 300)::int), 4) as coverage, count(*) filter (words > 300) as overflow from s4 group by book_id, split_level"""
ORACLE["split_levels"] = _SPLIT + """
, c as (select book_id, split_level, avg((words <= 300)::int) as c from s4 group by all)
select book_id, coalesce(min(split_level) filter (c >= 0.95), max(split_level)) as chosen_level, min(split_level) filter (c >= 0.95) is null as fallback from c group by all"""
ORACLE["ancestor_titles"] = _PLAN.replace("with p", "with recursive p") + """
, par as (select a.book_id, a.ord, a.title, (select max(b.ord) from p b where b.book_id = a.book_id and b.ord < a.ord and b.level < a.level) as po from p a),
w as (select book_id, ord, title, '' as ancestors from par where po is null union all
  select c.book_id, c.ord, c.title, case when w.ancestors = '' then w.title else w.ancestors || ' > ' || w.title end from par c join w on c.book_id = w.book_id and c.po = w.ord)
select book_id, ord, ancestors from w"""
ORACLE["graph_validation"] = _PARENTS + """
, s as (select distinct run_id, lower(trim(node_id)) v, lower(trim(parent_id)) pa, lower(trim(previous_id)) pr, lower(trim(next_id)) nx from segments),
ids as (select distinct run_id, v from s),
child as (select distinct run_id, lower(trim(node_id)) v, lower(trim(c)) c from (select run_id, node_id, unnest(children_ids) c from segments)),
named as (select distinct run_id, pa v, v c from s where pa is not null), nxt as (select distinct run_id, v, nx c from s where nx is not null), prv as (select distinct run_id, pr v, v c from s where pr is not null),
asym as (select * from ((select * from child except select * from named) union all (select * from named except select * from child))),
asyn as (select * from ((select * from nxt except select * from prv) union all (select * from prv except select * from nxt)))
select i.run_id, count(*) as nodes, 0::bigint as duplicate_ids,
  (select count(*) from named n where n.run_id = i.run_id and (n.run_id, n.v) not in (select run_id, v from ids)) as dangling_parents,
  (select count(*) from child n where n.run_id = i.run_id and (n.run_id, n.c) not in (select run_id, v from ids)) as dangling_children,
  (select count(*) from asym n where n.run_id = i.run_id) as asymmetric_children, (select count(*) from asyn n where n.run_id = i.run_id) as asymmetric_next,
  (select count(*) from link n where n.run_id = i.run_id and (n.run_id, n.v) not in (select run_id, v from walk)) as unreachable
from ids i group by i.run_id"""
ORACLE["title_band_join"] = _PLAN + f"""
, a as (select book_id, ord as a_ord, pdf_page, list_distinct(string_split({_key('title')}, ' ')) as ka from p), b as (select arm, book_id, ord as b_ord, pdf_page, list_distinct(string_split({_key('title')}, ' ')) as kb from {_FOUND}),
j as (select arm, a.book_id, a_ord, b_ord, case when ka = [''] or kb = [''] then 0.0 else round(2.0::double * len(list_intersect(ka, kb)) / (len(ka) + len(kb)), 6) end as dice from a join b on a.book_id = b.book_id and abs(a.pdf_page - b.pdf_page) <= 1)
select * from j where dice > 0.5"""
ORACLE["node_set_differences"] = f"""
with a as (select distinct book_id, level, pdf_page, lower({_norm('title')}) as k from {_found('vision_pass')}), b as (select distinct book_id, level, pdf_page, lower({_norm('title')}) as k from {_found('stack_refine')}),
f as (select coalesce(a.book_id, b.book_id) as book_id, a.k as l, b.k as r from a full join b on a.book_id = b.book_id and a.level = b.level and a.pdf_page = b.pdf_page and a.k = b.k)
select book_id, count(*) filter (l is null) as added, count(*) filter (r is null) as removed, count(*) filter (l is not null and r is not null) as common from f group by all"""
_SIGNALS = _PLAN + f"""
, pl as (select book_id, pdf_page, count(*) as lines from (select distinct stat_id, book_id, pdf_page from ocr_line_stats) group by all),
hc as (select book_id, pdf_page, lower({_norm('title')}) as k, count(*) as hits from {_FOUND} group by all),
w1 as (select p.*, {_norm('title')} as nt, count(*) over (partition by book_id, lower({_norm('title')})) as st, count(*) over (partition by book_id, pdf_page) as sp, lag(pdf_page) over (partition by book_id order by ord) as pp from p),
w2 as (select w1.*, coalesce(pl.lines, 0) as nl, coalesce(hc.hits, 0) as nh from w1 left join pl using (book_id, pdf_page) left join hc on hc.book_id = w1.book_id and hc.pdf_page = w1.pdf_page and hc.k = lower(w1.nt)),
sg as (select book_id, ord, level, source, list_filter([case when regexp_full_match(nt, '[^\\p{{L}}]+') then 'numeric_only_title' end, case when st > 1 then 'repeated_title' end, case when length(nt) > 100 then 'long_title' end,
  case when sp > 1 then 'same_page_bookmarks' end, case when nl = 0 then 'no_typography_text_on_page' end, case when nl > 0 and nl <= 2 then 'low_typography_line_count' end,
  case when nh = 0 then 'candidate_match_missing' end, case when nh > 1 then 'duplicate_candidates_collapsed' end, case when pdf_page - pp > 20 then 'long_page_gap_from_previous' end], lambda x: x is not null) as s from w2)
"""
ORACLE["attention_signals"] = _SIGNALS + "select book_id, ord, array_to_string(s, '|') as signals from sg"
ORACLE["review_priority"] = _SIGNALS + "select book_id, rank::int as rank, ord from (select *, row_number() over (partition by book_id order by len(s) desc, ord) as rank from sg where len(s) > 0) where rank <= 20"
ORACLE["review_summary"] = _SIGNALS + """
select sg.book_id, count(*) as items, count(*) filter (len(s) > 0) as attention_items, round(count(*) filter (len(s) > 0) / count(*), 6) as attention_ratio, round(count(*) / max(total_pages), 6) as items_per_page
from sg join tot using (book_id) group by sg.book_id"""
ORACLE["density_windows"] = _PLAN + """
, b as (select book_id, total_pages, unnest(range(0, (total_pages - 1) // 50 + 1))::int as w from tot), c as (select book_id, ((pdf_page - 1) // 50)::int as w, count(*) as items from p group by all)
select book_id, w * 50 + 1 as start_page, least((w + 1) * 50, total_pages) as end_page, coalesce(items, 0) as items from b left join c using (book_id, w)"""
_FRAG = r"""(case when trim({t}) = '' then ['empty'] else list_filter([case when len(regexp_extract_all({t}, '[A-Za-z가-힣]+')) = 0 then 'no_word' end, case when len(regexp_extract_all({t}, '[A-Za-z가-힣]+')) = 1 then 'single_token' end,
  case when len({t}) - len(replace({t}, '|', '')) >= 2 then 'table_like' end, case when contains({t}, '![image](') then 'image_placeholder' end], lambda x: x is not null) end)"""
ORACLE["title_fragments"] = _PLAN + "select * from (select book_id, ord, array_to_string(" + _FRAG.replace("{t}", "title") + ", '|') as reasons from p) where reasons <> ''"
_STATS = _PARENTS + """
, sg as (select distinct run_id, node_id, coalesce(title, '') as title, content_start_page a, content_end_page b, word_count from segments),
st as (select run_id, count(*) as nodes, round(avg(case when b >= a then b - a + 1 else 0 end), 4) as mean_pages, count(word_count) > 0 as has_words, quantile_cont(word_count::double, 0.5) as words_median, quantile_cont(word_count::double, 0.9) as words_p90,
  round(avg(case when len(""" + _FRAG.replace("{t}", "title") + """) > 0 then 1 else 0 end), 4) as fragment_ratio from sg group by all),
ow as (select run_id, unnest(range(a, b + 1)) as pg from sg where b >= a), oc as (select run_id, pg, count(*) as n from ow group by all),
op as (select run_id, max(pg) as pages, count(*) as assigned, count(*) filter (n > 1) as dup from oc group by all),
bad as (select distinct run_id from link where (run_id, v) not in (select run_id, v from walk)),
al as (select st.*, coalesce(pages, 0) as pages, coalesce(dup, 0) as dup, round(coalesce((pages - assigned) / pages, 0), 4) as un, st.run_id not in (select run_id from bad) as ok from st left join op using (run_id))
"""
ORACLE["node_statistics"] = _STATS + "select * from st"
ORACLE["graph_findings"] = _STATS + """
, th as (select *, (nodes <= 2 and pages >= 20) or mean_pages > 50 as thin from al),
fi as (select run_id, list_filter([case when not ok then 'invalid_graph' end, case when un >= 0.10 then 'uncovered' end, case when dup > 0 then 'duplicated' end, case when thin then 'thin' end,
  case when not thin and (mean_pages < 1 or (has_words and words_median < 50)) then 'over_split' end, case when fragment_ratio >= 0.30 then 'fragmented' end], lambda x: x is not null) as f from th)
select run_id, array_to_string(f, '|') as findings, coalesce(f[1], 'ok') as verdict from fi"""
_SWEEP = _CANDIDATES + f"""
, tp as (select book_id, max(pdf_page) as total_pages from l group by all),
gr as (select d, c, w from (select unnest([1, 2, 3]) as d), (select unnest([1, 2, 3, 5, 8, 999]) as c), (select unnest([1, 2]) as w)),
pg as (select book_id, pdf_page, d, w, count(*) as n, count(*) filter (len(regexp_extract_all(text, '[A-Za-z가-힣]+')) >= w) as kept from cd, (select distinct d, w from gr) where sr <= d group by all),
ct as (select book_id, gr.d, gr.c, gr.w, sum(kept) as k, count(*) as np from pg join gr on pg.d = gr.d and pg.w = gr.w and n <= gr.c where kept > 0 group by all),
sw as (select tp.book_id, gr.d as size_class_depth, gr.c as max_headings_per_page, gr.w as min_words, coalesce(k, 0)::bigint as candidate_count, coalesce(np, 0) as pages_with_candidate_count, case when k > 0 then round(total_pages / k, 2) end as pages_per_candidate
  from tp cross join gr left join ct on ct.book_id = tp.book_id and ct.d = gr.d and ct.c = gr.c and ct.w = gr.w)
"""
ORACLE["knob_sweep"] = _SWEEP + "select * from sw"
ORACLE["plausible_settings"] = _SWEEP + "select book_id, size_class_depth, max_headings_per_page, min_words, candidate_count from sw where pages_per_candidate between 5 and 40"
ORACLE["knob_directions"] = _SWEEP + """
, dl as (select book_id, 'size_class_depth' as knob, lead(candidate_count) over (partition by book_id, max_headings_per_page, min_words order by size_class_depth) - candidate_count as x from sw
  union all select book_id, 'min_words', lead(candidate_count) over (partition by book_id, max_headings_per_page, size_class_depth order by min_words) - candidate_count from sw
  union all select book_id, 'max_headings_per_page', lead(candidate_count) over (partition by book_id, min_words, size_class_depth order by max_headings_per_page) - candidate_count from sw),
n as (select book_id, knob, count(*) filter (x > 0) as u, count(*) filter (x < 0) as d, count(*) filter (x = 0) as f from dl group by all)
select book_id, knob, case when u + d + f = 0 then 'unknown' when u > 0 and d = 0 then (case when f = 0 then 'increases_candidates' else 'mostly_increases_candidates' end)
  when d > 0 and u = 0 then (case when f = 0 then 'decreases_candidates' else 'mostly_decreases_candidates' end) when u = 0 and d = 0 then 'no_effect' else 'mixed' end as direction from n"""
ORACLE["sampled_pages"] = _PLAN + "select distinct book_id, (case when total_pages <= 50 then i else i * total_pages // 50 end)::int as page_index from (select book_id, total_pages, unnest(range(0, least(total_pages, 50))) as i from tot)"
_OCR = "with o as (select distinct stat_id, book_id, pdf_page, element_id, category, text, x0_pt, y0_pt, x1_pt, y1_pt, height_pt, y_center_ratio from ocr_line_stats)"
ORACLE["ocr_page_statistics"] = """
with o as (select distinct stat_id, book_id, pdf_page, word_count, char_count, is_numeric_only, inserted_font_size_median_pt as sz, height_pt as h, y_center_ratio as y from ocr_line_stats),
q as (select *, quantile_cont(h, 0.9) over (partition by book_id, pdf_page) as cut from o)
select book_id, pdf_page, count(*) as line_count, coalesce(sum(word_count), 0)::bigint as word_count, coalesce(sum(char_count), 0)::bigint as char_count, min(h) as line_height_min_pt, quantile_cont(h, 0.25) as line_height_p25_pt, quantile_cont(h, 0.5) as line_height_median_pt,
  quantile_cont(h, 0.75) as line_height_p75_pt, quantile_cont(h, 0.9) as line_height_p90_pt, max(h) as line_height_max_pt, quantile_cont(sz, 0.5) as inserted_font_size_median_pt, max(sz) as inserted_font_size_max_pt,
  count(*) filter (h >= cut) as large_line_count, count(*) filter (h >= cut and y <= 0.33) as top_region_large_line_count, count(*) filter (is_numeric_only) as numeric_only_line_count from q group by all"""
ORACLE["ocr_element_statistics"] = _OCR + f"select book_id, pdf_page, element_id, count(*) as lines, sum({_words(_norm('text'))})::bigint as words, sum(coalesce(length(text), 0))::bigint as chars, min(x0_pt) as x0, min(y0_pt) as y0, max(x1_pt) as x1, max(y1_pt) as y1 from o group by all"
ORACLE["scan_verdicts"] = _OCR + """
, g as (select book_id, pdf_page, max(y_center_ratio * 100) / 100 as c, sum(case when regexp_full_match(text, '[\\d\\s.·\\-]+') then length(text) else 0 end) as v from o group by all)
select book_id, count(*) as pages, round(avg((c >= 0.85 and v < 10)::int), 6) as scan_fraction, sum(v)::bigint as visible_chars, avg((c >= 0.85 and v < 10)::int) >= 0.9 and sum(v) = 0 as is_scanned from g group by all"""
# row by row: each inferred page is what the next one builds on
ORACLE["inferred_pages"] = """
with recursive r as (select distinct sub_id, report_id, chapter, start_page lo, end_page hi, page, row_number() over (partition by report_id, chapter order by sub_id) as n from (select distinct sub_id, report_id, chapter, start_page, end_page, page from subsection_report)),
v as (select *, case when page > 0 and (lo is null or page >= lo) and (hi is null or page <= hi) then page end as ok from r),
f as (select *, first_value(ok ignore nulls) over (partition by report_id, chapter order by n rows between 1 following and unbounded following) as fo from v),
w as (
  select sub_id, report_id, chapter, n, coalesce(ok, case when fo is not null then greatest(lo, fo - 1) else lo end) as pg from f where n = 1
  union all select f.sub_id, f.report_id, f.chapter, f.n, coalesce(f.ok, case when f.fo is not null then (w.pg + f.fo + 1) // 2 else least(w.pg + 1, f.hi) end)
  from f join w on f.report_id is not distinct from w.report_id and f.chapter is not distinct from w.chapter and f.n = w.n + 1)
select sub_id, pg::int as inferred_page from w"""
ORACLE["chapter_owners"] = """
with r as (select distinct report_id, chapter, start_page, end_page from subsection_report where start_page is not null and end_page >= start_page), g as (select distinct report_id, page from subsection_report where page is not null),
b as (select g.report_id, g.page, chapter, row_number() over (partition by g.report_id, g.page order by start_page desc nulls last, chapter desc) as n from g left join r on g.report_id = r.report_id and g.page between start_page and end_page)
select report_id, page, chapter as owner_chapter from b where n = 1"""
ORACLE["character_classes"] = r"""
select doc_id, len(regexp_extract_all(coalesce(text, ''), '[가-힣]'))::int as hangul, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]'))::int as latin, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::int as digits,
  len(regexp_extract_all(coalesce(text, ''), '[^\s\p{L}\p{N}\p{P}]'))::int as odd from documents"""

# the documents of the level that 300 words ask for, over plans whose levels have no gaps; parts are put in order by page, kind and item
_RAW_PLAN, _TOTALS = _PLAN.split("tot as (")
_NORMAL = ORACLE["plan_levels"].split(_PLAN)[1].rsplit("select o.book_id", 1)[0].replace("from p where", "from p0 where").strip().lstrip(",")
_SPLIT_TAIL = _SPLIT[len(_PLAN.replace("with p", "with recursive p")) :]
_DOCUMENTS = (
    _RAW_PLAN.replace("with p as", "with recursive p0 as") + _NORMAL + ", p as (select o.book_id, o.ord::int as ord, title, (1 + above)::int as level, pdf_page from o join d using (book_id, ord)), tot as (" + _TOTALS + _SPLIT_TAIL
    + f"""
, cv as (select book_id, split_level, avg((words <= 300)::int) as c from s4 group by all),
lvl as (select book_id, coalesce(min(split_level) filter (c >= 0.95), max(split_level)) as split_level from cv group by all),
sx as (select s3.* from s3 join lvl using (book_id, split_level)),
it as (select sg.book_id, sg.segment, sg.ord, sg.pdf_page, sg.level, sg.title, sx.start_ord, sx.a, sx.b from sg join sx using (book_id, split_level, segment)),
pt as (select book_id, pdf_page, string_agg({_norm('text')}, chr(10) order by stat_id) as text from (select distinct stat_id, book_id, pdf_page, text from ocr_line_stats where text is not null) group by all),
parts as (
  select sx.book_id, segment, -2 as page, 0 as kind, p.ord, {_TITLE} as part, {_words(_TITLE)} as w from sx join ch on ch.book_id = sx.book_id and ch.ord = sx.start_ord join p on p.book_id = ch.book_id and p.ord = ch.above
  union all select book_id, segment, case when ord = start_ord then -1 when pdf_page between a and b then pdf_page else 1000000000 end, 0, ord, {_TITLE}, {_words(_TITLE)} from it
  union all select sx.book_id, segment, pt.pdf_page, 1, 0, '<!-- pdf_page ' || pt.pdf_page || ' -->' || chr(10) || chr(10) || text, {_words('text')} from sx join pt on pt.book_id = sx.book_id and pt.pdf_page between a and b where text <> ''),
md as (select book_id, segment, regexp_replace(string_agg(part, chr(10) || chr(10) order by page, kind, ord), '\\s+$', '') || chr(10) as md, sum(w)::bigint as word_count from parts group by all),
hd as (select sx.*, p.level, p.title from sx join p on p.book_id = sx.book_id and p.ord = sx.start_ord),
ct as (select book_id, segment, string_agg(printf('n%04d', ord), '|' order by ord) as contained_ids from it group by all)
"""
)
ORACLE["split_documents"] = _DOCUMENTS + """
select hd.book_id, printf('n%04d', start_ord) as node_id, row_number() over w as ord, level, a as content_start_page, b::int as content_end_page,
  (select printf('n%04d', max(x.start_ord)) from hd x where x.book_id = hd.book_id and x.start_ord < hd.start_ord and x.level < hd.level and not exists (select 1 from hd y where y.book_id = hd.book_id and y.start_ord > x.start_ord and y.start_ord < hd.start_ord and y.level <= x.level and false)) as parent_id,
  printf('n%04d', lag(start_ord) over w) as previous_id, printf('n%04d', lead(start_ord) over w) as next_id, contained_ids, word_count, md5(md) as content_md5, length(md)::int as content_length
from hd join md using (book_id, segment) join ct using (book_id, segment) window w as (partition by hd.book_id order by start_ord)"""
ORACLE["split_documents"] = ORACLE["split_documents"].replace(" and not exists (select 1 from hd y where y.book_id = hd.book_id and y.start_ord > x.start_ord and y.start_ord < hd.start_ord and y.level <= x.level and false)", "")
