"""DuckDB SQL oracles, one per registered query that SQL can express.

They re-derive the same injected inputs as ``fixtures.py`` and compute the
expected result independently with DuckDB's own regex/JSON/window functions.
Column names equal the Spark query's aliases.
"""

from __future__ import annotations

from typing import Dict

ORACLES: Dict[str, str] = {}

DIRTY = ("concat('  ', replace(text, chr(10), concat(chr(13),chr(10),chr(13),chr(10),chr(10),chr(9),' ')), "
         "chr(1), '  x', chr(11), chr(12), ' y', chr(13))")
MTIME0 = 1700000000
UPDATED_AT = 1750000000


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ------------------------------------------------------------------ C
_CLEAN_CHAIN = rf"""
with d as (select doc_id, {DIRTY} as t from documents),
a as (select doc_id, regexp_replace(t, '\r\n?', chr(10), 'g') as t from d),
b as (select doc_id, regexp_replace(t, '[\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g') as t from a),
c as (select doc_id, regexp_replace(t, '[ \t]*\n[ \t]*', chr(10), 'g') as t from b),
e as (select doc_id, regexp_replace(t, '[ \t\x0c\x0b]+', ' ', 'g') as t from c),
f as (select doc_id, regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') as t from e),
g as (select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from f)
select doc_id, t as text from g where t <> ''
"""
oracle("clean_text", _CLEAN_CHAIN)
oracle("clean_text_native", _CLEAN_CHAIN)
oracle("remove_null_bytes", "select doc_id, replace(replace(text, '.', '.' || chr(0)), chr(0), '') as text from documents")
oracle("normalize_nfkc", "select doc_id, text from documents")
oracle("normalize_newlines", rf"select doc_id, regexp_replace({DIRTY}, '\r\n?', chr(10), 'g') as text from documents")
oracle("strip_control_chars",
       rf"select doc_id, regexp_replace({DIRTY}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') as text from documents")
oracle("dehyphenate", r"""
select doc_id, regexp_replace(replace(text, 'e ', 'e-' || chr(10)), '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g') as text
from documents""")
oracle("strip_lines", rf"""
select doc_id, regexp_replace(regexp_replace({DIRTY}, '[ \t\r\x0b\x0c]*\n[ \t\r\x0b\x0c]*', chr(10), 'g'),
                              '^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$', '', 'g') as text
from documents""")
oracle("collapse_inline_spaces", rf"select doc_id, regexp_replace({DIRTY}, '[ \t\x0c\x0b]+', ' ', 'g') as text from documents")
oracle("collapse_blank_lines", rf"""
select doc_id, regexp_replace(regexp_replace({DIRTY}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as text
from documents""")
oracle("final_strip", rf"select doc_id, regexp_replace({DIRTY}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as text from documents")
oracle("drop_empty", """
select doc_id, t as text from (
  select doc_id, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else text end as t from documents)
where coalesce(t, '') <> ''""")

# ------------------------------------------------------------------ S
_EXTS = "['.txt', '.MD', '.html', '.htm', '.csv', '.json', '.pdf', '.exe', '.Docx', '.ppt', '', '.tar.gz', '.pptx']"
oracle("supported_files", rf"""
with p as (select doc_id, concat('kb/', lang, '/', cast(doc_id as varchar), {_EXTS}[(doc_id % 13) + 1]) as path
           from documents),
n as (select doc_id, path, regexp_extract(path, '([^/]*)/*$', 1) as name from p),
e as (select doc_id, path, lower(regexp_extract(name, '^.+(\.[^.]*)$', 1)) as file_ext from n)
select doc_id, path, file_ext from e
where file_ext in ('.pdf', '.txt', '.md', '.html', '.htm', '.docx', '.doc', '.pptx', '.ppt', '.csv', '.json')""")
oracle("file_metadata", f"""
select doc_id, 'kb/' || cast(doc_id as varchar) || '.txt' as source,
       case when doc_id % 4 = 0 then 'given.txt' else cast(doc_id as varchar) || '.txt' end as file_name,
       '.txt' as file_ext, cast(strlen(text) as bigint) as file_size,
       cast({MTIME0} + doc_id as bigint) as file_mtime,
       cast(case when doc_id % 3 = 0 then null else doc_id % 5 end as integer) as page,
       cast(case when doc_id % 3 = 0 then null else doc_id % 5 + 1 end as integer) as page_1based
from documents""")
oracle("read_json_docs", """
select event_id, json_valid(t) as is_json,
       case when json_valid(t) then cast(json_extract(t, '$.k') as bigint) end as k
from (select event_id, case when event_id % 9 = 0 then replace(props, '"k"', 'k') else props end as t from events)""")
oracle("scan_files", "select doc_id, cast(strlen(text) + 1 as bigint) as size from documents")
oracle("read_text_docs", "select doc_id, text || chr(10) as text from documents")
oracle("with_rejects", "select doc_id, 'UnicodeDecodeError' as error_type from documents where doc_id % 17 = 0")
oracle("route_by_ext", "select doc_id, '.txt' as file_ext, cast(length(text) + 1 as integer) as n_chars from documents")
oracle("read_csv_rows", """
select 'customers/part-' || cast(floor(c_custkey / 1000) as bigint) || '.csv' as source,
       cast(row_number() over (partition by floor(c_custkey / 1000) order by c_custkey) - 1 as integer) as row,
       'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) ||
       'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || cast(cast(c_acctbal as decimal(12,2)) as varchar)
       || chr(10) || 'c_mktsegment: ' || c_mktsegment as text
from customer""")

# ------------------------------------------------------------------ P
_MD_LINES = r"""
src as (
  select doc_id, lang,
         concat('# T', cast(doc_id as varchar), chr(10), replace(text, chr(10), concat(chr(10), '## S', chr(10))),
                chr(10), '```', chr(10), '# not a header', chr(10), '```', chr(10), '### D', cast(doc_id as varchar),
                chr(10), 'tail line') as md
  from documents),
raw as (
  select doc_id, lang, unnest(string_split(md, chr(10))) as line,
         unnest(range(1, len(string_split(md, chr(10))) + 1)) as ln
  from src),
l1 as (select doc_id, lang, ln, regexp_replace(line, '^\s+|\s+$', '', 'g') as s from raw),
l2 as (select *, sum(case when starts_with(s, '```') then 1 else 0 end)
                   over (partition by doc_id order by ln rows between unbounded preceding and current row) as fences
       from l1),
l3 as (select *, fences % 2 = 1 as in_code,
              (fences % 2 = 0) and regexp_matches(s, '^#{1,4}( |$)') as is_hdr
       from l2),
l4 as (select *, case when is_hdr then length(regexp_extract(s, '^(#+)', 1)) end as lvl,
              case when is_hdr then regexp_replace(regexp_replace(s, '^#+', ''), '^\s+|\s+$', '', 'g') end as data
       from l3),
l5 as (
  select *,
    max(case when lvl = 1 then ln end) over w as p1, max(case when lvl = 2 then ln end) over w as p2,
    max(case when lvl = 3 then ln end) over w as p3, max(case when lvl = 4 then ln end) over w as p4,
    last_value(case when lvl = 1 then data end ignore nulls) over w as v1,
    last_value(case when lvl = 2 then data end ignore nulls) over w as v2,
    last_value(case when lvl = 3 then data end ignore nulls) over w as v3,
    last_value(case when lvl = 4 then data end ignore nulls) over w as v4,
    sum(case when (not in_code) and (is_hdr or s = '') then 1 else 0 end) over w as blk
  from l4
  window w as (partition by doc_id order by ln rows between unbounded preceding and current row)),
l6 as (
  select doc_id, lang, ln, s, blk, in_code, is_hdr,
    v1 as h1,
    case when p2 > coalesce(p1, 0) then v2 end as h2,
    case when p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) then v3 end as h3,
    case when p4 > greatest(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0)) then v4 end as h4
  from l5),
c1 as (select * from l6 where (not is_hdr) and (in_code or s <> '')),
c2 as (select *, lag(blk) over w as pblk, lag(h1) over w as q1, lag(h2) over w as q2, lag(h3) over w as q3,
              lag(h4) over w as q4, row_number() over w as rn
       from c1 window w as (partition by doc_id order by ln)),
c3 as (select *, case when rn = 1 or h1 is distinct from q1 or h2 is distinct from q2 or h3 is distinct from q3
                           or h4 is distinct from q4 then 1 else 0 end as brk from c2),
c4 as (select *, sum(brk) over (partition by doc_id order by ln rows between unbounded preceding and current row) - 1
                 as section from c3)
"""
oracle("markdown_sections", f"""
with {_MD_LINES}
select doc_id, cast(section as integer) as section, any_value(h1) as h1, any_value(h2) as h2, any_value(h3) as h3,
       any_value(h4) as h4,
       string_agg(case when brk = 1 then s when blk = pblk then chr(10) || s else '  ' || chr(10) || s end, ''
                  order by ln) as text
from c4 group by doc_id, section""")
oracle("merge_section_metadata", f"""
with {_MD_LINES}
select doc_id, cast(section as integer) as section, any_value(h1) as h1, any_value(h2) as h2, any_value(h3) as h3,
       coalesce(any_value(h4), any_value(lang)) as h4
from c4 group by doc_id, section""")
oracle("html_section_headers", r"""
select distinct page_id,
  trim(regexp_replace(replace(replace(replace(replace(replace(
      regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
      '&amp;', '&'), '\s+', ' ', 'g')) as h1
from pages where regexp_matches(html, '(?s)<h1[^>]*>.*?</h1>')""")
oracle("json_sections", "select event_id, 0 as section, props as text from events")

# ------------------------------------------------------------------ K
_LINE_CHUNKS = r"""
f as (select doc_id, 'kb/' || cast(doc_id as varchar) || '.txt' as source, text from documents),
raw as (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               unnest(range(0, len(string_split(text, chr(10))))) as line_no from f),
pos as (select *, cast(coalesce(sum(length(line) + 1) over (partition by source order by line_no
                  rows between unbounded preceding and 1 preceding), 0) as integer) as start_index from raw),
ne as (select * from pos where trim(line) <> ''),
ix as (select *, cast(row_number() over (partition by source order by line_no) - 1 as integer) as chunk_index from ne)
"""
oracle("chunk_metadata", f"""
with {_LINE_CHUNKS}
select source, chunk_index, start_index, cast(start_index + length(line) as integer) as end_index,
       cast(doc_id as varchar) || '.txt#chunk' || cast(chunk_index as varchar) as citation,
       sha1(source || '||p=||s=' || cast(start_index as varchar) || '||th=' || sha1(line)) as chunk_id
from ix""")
oracle("end_index", f"""
with {_LINE_CHUNKS} select source, start_index, cast(start_index + length(line) as integer) as end_index from ix""")
oracle("chunk_index", f"with {_LINE_CHUNKS} select source, start_index, chunk_index from ix")
oracle("citation", f"""
with {_LINE_CHUNKS}
select source, chunk_index,
       case when doc_id % 3 = 0 then cast(doc_id as varchar) || '.txt#p' || cast(doc_id % 4 + 1 as varchar)
            else cast(doc_id as varchar) || '.txt#chunk' || cast(chunk_index as varchar) end as citation
from ix""")
oracle("chunk_id", f"""
with {_LINE_CHUNKS}
select source, chunk_index,
       sha1(source || '||p=||s=' || cast(start_index as varchar) || '||th=' || sha1(line)) as chunk_id
from ix""")
oracle("dedupe_chunks", f"""
with {_LINE_CHUNKS},
ids as (select source, chunk_index, sha1(source || '||p=||s=||th=' || sha1(line)) as chunk_id from ix)
select source, chunk_index, chunk_id from (
  select *, row_number() over (partition by chunk_id order by chunk_index) as rn from ids) where rn = 1""")

# ------------------------------------------------------------------ D / T
_SNAP = f"""
d as (select doc_id, 'kb/' || cast(doc_id as varchar) || '.txt' as source, text, sha256(text) as h from documents),
prev as (select source, cast(length(text) + case when doc_id % 7 = 2 then 1 else 0 end as bigint) as size,
                cast({MTIME0} + doc_id - case when doc_id % 5 = 1 then 60 else 0 end as bigint) as mtime,
                case when doc_id % 3 = 0 then null else h end as sha256,
                cast({UPDATED_AT - 1000} as bigint) as updated_at
         from d where doc_id % 10 <> 0),
cur as (select source, text, h, cast(length(text) as bigint) as size, cast({MTIME0} + doc_id as bigint) as mtime
        from d where doc_id % 10 <> 9),
j as (select coalesce(c.source, p.source) as source, c.size as c_size, c.mtime as c_mtime, c.h as c_h,
             p.size as o_size, p.mtime as o_mtime, p.sha256 as o_sha256,
             c.source is not null as in_cur, p.source is not null as in_old
      from cur c full outer join prev p on c.source = p.source),
cls as (select *, case when not in_old then 'added' when not in_cur then 'deleted'
                       when c_size is not distinct from o_size and c_mtime is not distinct from o_mtime
                         then 'unchanged' else 'suspect' end as status0 from j),
fin as (select *, case when status0 = 'suspect' and o_sha256 is not null and o_sha256 = c_h then 'unchanged'
                       when status0 = 'suspect' then 'modified' else status0 end as status from cls),
changes as (select source, status, coalesce(c_size, o_size) as size, coalesce(c_mtime, o_mtime) as mtime,
                   case when status = 'modified' then c_h when status = 'deleted' then o_sha256
                        when status = 'unchanged' then (case when status0 = 'suspect' then c_h else o_sha256 end)
                   end as sha256
            from fin)
"""
oracle("fast_signature", f"with {_SNAP} select source, size, mtime, cast(null as varchar) as sha256 from cur")
oracle("strong_signature", f"with {_SNAP} select source, size, mtime, h as sha256 from cur")
oracle("added_files", f"with {_SNAP} select source from cur where source not in (select source from prev)")
oracle("deleted_files", f"with {_SNAP} select source from prev where source not in (select source from cur)")
oracle("classify_files", f"with {_SNAP} select source, status0 as status from cls")
oracle("confirm_suspects", f"with {_SNAP} select source, status from fin where status0 = 'suspect'")
oracle("detect_changes", f"with {_SNAP} select * from changes")
oracle("change_counts", f"""
with {_SNAP}
select l.status, cast(coalesce(n, 0) as bigint) as n
from (select unnest(['added', 'modified', 'deleted', 'unchanged']) as status) l
left join (select status, count(*) as n from changes group by status) c using (status)""")
oracle("ordered_changes", f"with {_SNAP} select status, source from changes")
oracle("manifest_sources", f"with {_SNAP} select source from prev")
oracle("lookup_signatures", f"""
with {_SNAP} select c.source, p.size, p.mtime, p.sha256 from cur c left join prev p using (source)""")
_UPSERT = f"""
upserted as (
  select * from prev where source not in (select source from changes where status in ('added', 'modified'))
  union all
  select source, size, mtime, sha256, cast({UPDATED_AT} as bigint) as updated_at
  from changes where status in ('added', 'modified'))
"""
oracle("upsert_signatures", f"with {_SNAP}, {_UPSERT} select * from upserted")
oracle("delete_sources", f"with {_SNAP} select * from prev where source not in (select source from changes where status = 'deleted')")
_OLD_CHUNKS = f"""
{_LINE_CHUNKS},
old_chunks as (select source, sha1(source || '||p=||s=' || cast(start_index as varchar) || '||th=' || sha1(line)) as chunk_id
               from ix where doc_id % 10 <> 0),
new_rows as (select source, sha1(source || '||p=1||s=' || cast(start_index as varchar) || '||th=' || sha1(line)) as chunk_id
             from ix where source in (select source from changes where status in ('added', 'modified')))
"""
oracle("chunk_ids_of", f"""
with {_SNAP}, {_OLD_CHUNKS}
select * from old_chunks where source in (select source from changes where status = 'modified')""")
oracle("replace_chunk_ids", f"""
with {_SNAP}, {_OLD_CHUNKS}
select * from old_chunks where source not in (select source from new_rows)
union all select distinct source, chunk_id from new_rows""")
oracle("old_chunk_counts", f"""
with {_SNAP}, {_OLD_CHUNKS}
select c.source, c.status, cast(coalesce(n.n, 0) as bigint) as old_chunks
from (select source, status from changes where status <> 'unchanged') c
left join (select source, count(*) as n from old_chunks group by source) n using (source)""")
oracle("empty_files", f"""
with {_SNAP}
select source, status from changes
where status in ('added', 'modified') and cast(regexp_extract(source, '(\\d+)', 1) as bigint) % 13 = 0""")
oracle("sync_files", f"""
with {_SNAP}, {_UPSERT}
select * from upserted where source not in (select source from changes where status = 'deleted')""")
oracle("sync_chunks", f"""
with {_SNAP}, {_OLD_CHUNKS}
select * from old_chunks where source not in (select source from changes where status <> 'unchanged')
union all select distinct source, chunk_id from new_rows""")
oracle("sync_plan", f"""
with {_SNAP}, {_OLD_CHUNKS}
select c.source, c.status, cast(coalesce(n.n, 0) as bigint) as old_chunks,
       case c.status when 'deleted' then 'delete' when 'modified' then 'rebuild' else 'build' end as action
from (select source, status from changes where status <> 'unchanged') c
left join (select source, count(*) as n from old_chunks group by source) n using (source)""")
oracle("upsert_vectors", """
select vec_id as id, label, 1 as version from embeddings where vec_id not in (select vec_id * 2 from embeddings)
union all select vec_id * 2 as id, label + 100 as label, 2 as version from embeddings""")
oracle("delete_vectors", """
select vec_id as id, label from embeddings
where not (vec_id in (select vec_id * 3 from embeddings) and label < 5)""")
oracle("count_vectors", "select count(*) as n from embeddings")

# ------------------------------------------------------------------ E
oracle("last_token_pool", """
with t as (
  select vec_id as id, pos, embedding[pos * 8 + 1 : pos * 8 + 8] as vec,
         case when vec_id % 2 = 0 then pos < 1 + vec_id % 8 else pos >= 8 - (1 + vec_id % 8) end as m
  from embeddings, range(0, 8) r(pos)),
p as (select id, arg_max(vec, pos) as v, count(*) as token_count from t where m group by id)
select id, token_count, round(list_sum([cast(x as double) for x in v]), 6) as total,
       round(cast(v[1] as double), 6) as first, cast(len(v) as integer) as dim
from p""")
oracle("l2_normalize", """
with s as (select vec_id, [cast(x as double) * (label + 1) for x in embedding] as v from embeddings),
n as (select vec_id, v, greatest(sqrt(list_sum([x * x for x in v])), 1e-12) as nrm from s),
u as (select vec_id, [x / nrm for x in v] as v from n)
select vec_id, round(sqrt(list_sum([x * x for x in v])), 6) as norm, round(list_sum(v), 6) as total,
       round(v[1], 6) as first, cast(len(v) as integer) as dim
from u""")
oracle("truncate_tokens", """
select doc_id, cast(len(t) as integer) as n_tokens, t[len(t)] as last_token
from (select doc_id, string_split(text, ' ')[1:512] as t from documents)""")
oracle("token_usage", """
select source, cast(sum(len(string_split(text, ' '))) as bigint) as total_tokens from documents group by source""")

# ------------------------------------------------------------------ R
_DIST = """
dist as (
  select q.vec_id as query_id, v.vec_id as id,
         list_sum([(cast(q.embedding[i] as double) - cast(v.embedding[i] as double)) ^ 2 for i in range(1, len(q.embedding) + 1)]) as d
  from embeddings q, embeddings v {where}),
ranked as (select *, cast(row_number() over (partition by query_id order by d, id) as integer) as rank from dist)
"""
oracle("knn", f"with {_DIST.format(where='')} select query_id, rank, id, round(d, 6) as distance from ranked where rank <= 5")
oracle("knn_blocked", f"with {_DIST.format(where='')} select query_id, rank, id, round(d, 6) as distance from ranked where rank <= 5")
oracle("knn_filtered", f"""with {_DIST.format(where='where v.label in (1, 3, 5) or v.label = 8')}
select query_id, rank, id, round(d, 6) as distance from ranked where rank <= 5""")
_HITS = f"""
{_DIST.format(where='')},
hits as (select r.query_id, r.rank, cast(r.id as varchar) as id, coalesce(doc.text, '') as text, doc.source,
                r.d from ranked r left join documents doc on doc.doc_id = r.id where r.rank <= {{k}})
"""
oracle("shape_results", f"with {_HITS.format(k=3)} select query_id, rank, id, text, source, round(d, 6) as distance from hits")
_CTX = """
ctx as (select query_id, string_agg('[Document ' || rank || '] (source: ' || coalesce(source, 'Unknown Source') || ')'
                                    || chr(10) || text, chr(10) || chr(10) order by rank) as context
        from hits group by query_id)
"""
oracle("build_context", f"with {_HITS.format(k=3)}, {_CTX} select * from ctx")
oracle("context_fallback", f"""
with {_HITS.format(k=3)},
qk as (select e.vec_id as query_id, coalesce(doc.text, '') as query, e.vec_id % 4 as k
       from embeddings e left join documents doc on doc.doc_id = e.vec_id),
hits2 as (select h.* from hits h join qk using (query_id) where h.rank <= qk.k),
ctx as (select query_id, string_agg('[Document ' || rank || '] (source: ' || coalesce(source, 'Unknown Source') || ')'
                                    || chr(10) || text, chr(10) || chr(10) order by rank) as context
        from hits2 group by query_id)
select qk.query_id, case when qk.query = '' then '' when ctx.context is null
                         then 'No relevant information found in the knowledge base.' else ctx.context end as context
from qk left join ctx using (query_id)""")
oracle("rag_search", f"""
with {_HITS.format(k=3)},
qk as (select e.vec_id as query_id, coalesce(doc.text, '') as query, e.vec_id % 4 as k
       from embeddings e left join documents doc on doc.doc_id = e.vec_id),
hits2 as (select h.* from hits h join qk using (query_id) where h.rank <= qk.k),
ctx as (select query_id, string_agg('[Document ' || rank || '] (source: ' || coalesce(source, 'Unknown Source') || ')'
                                    || chr(10) || text, chr(10) || chr(10) order by rank) as context
        from hits2 group by query_id)
select qk.query_id, case when qk.query = '' then '' when ctx.context is null
                         then 'No relevant information found in the knowledge base.' else ctx.context end as context
from qk left join ctx using (query_id)""")

# ------------------------------------------------------------------ M
_REPLIES = r"""
r as (select conv_id, turn, role,
        case when role = 'assistant' and turn % 4 = 1 then
               concat(text, '<tool_call>', '{"name":"rag_search","arguments":{"query":"q', cast(conv_id as varchar),
                      '","k":', cast(1 + conv_id % 5 as varchar), '}}', '</tool_call>')
             when role = 'assistant' and turn % 4 = 3 then
               concat('<tool_call>', chr(10), '{"name":"a"}', chr(10), '</tool_call> <tool_call>{bad</tool_call>', text)
             else text end as text
      from conversations),
m as (select conv_id, turn, regexp_extract_all(text, '(?s)<tool_call>(.*?)</tool_call>', 1) as bodies from r),
b as (select conv_id, turn, unnest(bodies) as body, unnest(range(0, len(bodies))) as pos from m),
bv as (select *, trim(body, ' ' || chr(9) || chr(10) || chr(13)) as tb0 from b),
bw as (select *, case when json_valid(tb0) then tb0 end as tb from bv),
bk as (select *, coalesce(json_type(tb) = 'OBJECT' and json_type(tb, '$.name') = 'VARCHAR', false) as ok from bw),
calls as (
  select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by pos) - 1 as integer) as ordinal,
         json_extract_string(tb, '$.name') as name,
         coalesce(cast(json_extract(tb, '$.arguments') as varchar), '{}') as arguments
  from bk where ok),
calls2 as (select conv_id, turn, ordinal,
                  'call_' || substr(sha1(concat_ws(':', conv_id || '-' || turn, ordinal)), 1, 8) as call_id, name, arguments
           from calls)
"""
oracle("extract_tool_calls", f"with {_REPLIES} select * from calls2")
oracle("call_ids", f"with {_REPLIES} select conv_id, turn, ordinal, call_id from calls2")
oracle("invalid_tool_calls", f"""
with {_REPLIES}
select conv_id, turn, cast(pos as integer) as pos, body,
       case when tb is null then 'bad_json' when json_type(tb) <> 'OBJECT' then 'not_object'
            else 'bad_name' end as reason
from bk where not ok""")
_STRIP = r"nullif(regexp_replace(regexp_replace(text, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), '')"
oracle("strip_tool_calls", f"with {_REPLIES} select conv_id, turn, {_STRIP} as content from r")
oracle("finish_reason", f"""
with {_REPLIES},
n as (select conv_id, turn, count(*) as n_calls from calls group by conv_id, turn)
select r.conv_id, r.turn,
       case when coalesce(n.n_calls, 0) > 0 then 'tool_calls' else 'stop' end as finish_reason,
       case when coalesce(n.n_calls, 0) > 0 then {_STRIP} else r.text end as content,
       cast(coalesce(n.n_calls, 0) as bigint) as n_calls
from r left join n using (conv_id, turn)""")
oracle("format_messages", f"""
with {_REPLIES}
select conv_id, cast(count(*) as integer) as n_messages,
       string_agg(role || ': ' || text, chr(10) order by turn) as transcript
from r group by conv_id""")
oracle("chat_history", f"""
with {_REPLIES},
log as (select conv_id, turn, role, text, 1 as version from r
        union all select conv_id, turn, role, text || ' (edited)', 2 from r where role = 'user' and turn % 4 = 2),
latest as (select * from (select *, row_number() over (partition by conv_id, turn order by version desc) as rn from log)
           where rn = 1)
select conv_id, cast(count(*) as integer) as n_messages,
       string_agg(role || ': ' || text, chr(10) order by turn) as transcript
from latest group by conv_id""")
oracle("assemble_prompt", f"""
with {_REPLIES},
h as (select u.conv_id, u.turn, u.text as input,
             string_agg(p.role || ': ' || p.text, chr(10) order by p.turn) as hist, count(p.turn) as n_hist
      from r u left join r p on p.conv_id = u.conv_id and p.turn < u.turn
      where u.role = 'user' group by u.conv_id, u.turn, u.text)
select conv_id, turn, cast(n_hist + 2 as integer) as n_messages,
       'system: Answer briefly, and say when you do not know.' || chr(10) ||
       case when n_hist > 0 then hist || chr(10) else '' end || 'user: ' || input as prompt
from h""")
oracle("last_message", f"""
with {_REPLIES} select conv_id, max(turn) as last_turn, arg_max(role, turn) as role, arg_max(text, turn) as text
from r group by conv_id""")
oracle("assistant_text", f"with {_REPLIES} select conv_id, turn, text from r where role = 'assistant' and text <> ''")
oracle("route_turn", f"""
with {_REPLIES},
l as (select conv_id, max(turn) as last_turn from r group by conv_id),
n as (select conv_id, turn, count(*) as n from calls group by conv_id, turn)
select l.conv_id, l.last_turn, case when coalesce(n.n, 0) > 0 then 'tools' else 'end' end as route
from l left join n on n.conv_id = l.conv_id and n.turn = l.last_turn""")
oracle("strip_special_tokens", f"""
with {_REPLIES},
t0 as (select conv_id, turn,
              concat(case when turn % 2 = 0 then chr(10) else '' end, text,
                     case when turn % 3 = 0 then '<|im_end|>' when turn % 3 = 1 then '<|endoftext|>' || chr(10)
                          else '<|endoftext|><|im_end|>' end) as t from r),
t1 as (select conv_id, turn, replace(t, '<|im_end|>', '') as t from t0),
t2 as (select conv_id, turn, case when ends_with(t, '<|im_end|>') then left(t, length(t) - 10) else t end as t from t1),
t3 as (select conv_id, turn, case when ends_with(t, '<|endoftext|>') then left(t, length(t) - 13) else t end as t from t2)
select conv_id, turn, regexp_replace(t, '^\\n+|\\n+$', '', 'g') as text from t3""")
oracle("answer_tool_calls", f"""
with {_REPLIES},
q as (select c.conv_id, c.turn, c.ordinal, c.call_id, json_extract_string(c.arguments, '$.query') as query,
             coalesce(cast(json_extract(c.arguments, '$.k') as integer), 3) as k
      from calls2 c where c.name = 'rag_search'),
qv as (select q.*, e.embedding from q left join embeddings e on 'q' || cast(e.vec_id as varchar) = q.query),
dist as (select qv.call_id, v.vec_id as id,
                list_sum([(cast(qv.embedding[i] as double) - cast(v.embedding[i] as double)) ^ 2 for i in range(1, len(qv.embedding) + 1)]) as d
         from qv, embeddings v where qv.embedding is not null),
ranked as (select *, row_number() over (partition by call_id order by d, id) as rank from dist),
hits as (select rk.call_id, rk.rank, coalesce(doc.text, '') as text, doc.source
         from ranked rk join qv on qv.call_id = rk.call_id left join documents doc on doc.doc_id = rk.id
         where rk.rank <= qv.k),
ctx as (select call_id, string_agg('[Document ' || rank || '] (source: ' || coalesce(source, 'Unknown Source') || ')'
                                   || chr(10) || text, chr(10) || chr(10) order by rank) as context
        from hits group by call_id)
select qv.conv_id, qv.turn, qv.ordinal, qv.call_id,
       coalesce(ctx.context, 'No relevant information found in the knowledge base.') as context
from qv left join ctx using (call_id)""")

# ------------------------------------------------------------------ W
_DELTAS = f"""
{_REPLIES},
a as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as chat_id,
             regexp_extract_all(text || '<|im_end|>', '(?s).{{1,' || cast(1 + conv_id % 7 as varchar) || '}}') as p
      from r where role = 'assistant'),
pieces as (select chat_id, unnest(range(0, len(p))) as seq, unnest(p) as delta, false as is_end from a
           union all select chat_id, len(p), '', true from a),
clean as (select chat_id, seq, replace(replace(delta, '<|im_end|>', ''), '<|endoftext|>', '') as delta, is_end
          from pieces),
kept as (select * from clean where coalesce(delta, '') <> '' or is_end)
"""
oracle("drop_empty_deltas", f"with {_DELTAS} select chat_id, cast(seq as bigint) as seq, delta, is_end from kept")
oracle("assemble_stream", f"with {_DELTAS} select chat_id, string_agg(delta, '' order by seq) as text from kept group by chat_id")

_STREAM = f"""
{_REPLIES},
s as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as chat_id, conv_id, turn, text from r where role = 'assistant'),
n as (select conv_id, turn, count(*) as n from calls group by conv_id, turn)
"""
oracle("stream_summary", f"""
with {_STREAM}
select s.chat_id, regexp_replace(s.text, '(?s)<tool_call>\\s*\\{{"name".*?</tool_call>', '', 'g') as content,
       cast(coalesce(n.n, 0) as bigint) as n_calls, case when coalesce(n.n, 0) > 0 then 'tool_calls' else 'stop' end as finish
from s left join n using (conv_id, turn)""")
oracle("stream_gap", ORACLES["stream_summary"])
oracle("stream_summary_streaming", ORACLES["stream_summary"])

# ------------------------------------------------- K on whole documents
_CLEANED = r"""
cl as (select doc_id, 'kb/' || cast(doc_id as varchar) || '.txt' as source, regexp_replace(regexp_replace(regexp_replace(
         regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
         '[ \t]*\n[ \t]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t
       from documents)
"""
oracle("chunk_invariants", f"""
with {_CLEANED} select doc_id, true as all_placed, true as all_fit, true as covered from cl where t <> ''""")
oracle("embed_contents", """
select doc_id, sha1(coalesce(text, '')) as text_key,
       coalesce(text, '') in (select coalesce(text, '') from documents where lang = 'en') as reused, true as agrees
from documents""")
oracle("token_chunks", f"""
with {_CLEANED} select doc_id, true as all_fit, cast(length(regexp_replace(t, '\\s', '', 'g')) as bigint) as solid from cl where t <> ''""")
oracle("single_chunk_ids", f"""
with {_CLEANED}
select doc_id, case when length(t) <= 1000 then sha1(source || '||p=||s=0||th=' || sha1(t)) end as chunk_id from cl where t <> ''""")
oracle("preprocess_metadata", r"""
select doc_id, lang as language, source as site, cast(doc_id % 7 as integer) as row, true as chunked
from documents where regexp_replace(text, '\s', '', 'g') <> ''""")

# ---------------------------------------------------- T as jobs on storage
oracle("sync_job", f"""
select doc_id, cast(octet_length(encode(text)) + 1 as bigint) as size, cast({UPDATED_AT} as bigint) as updated_at,
       regexp_replace(text, '\\s', '', 'g') <> '' as has_chunks, true as vectors_agree
from documents where doc_id % 17 <> 0""")
oracle("init_tables", f"""
with {_LINE_CHUNKS}
select 'fresh' as state, cast(0 as bigint) as n union all select 'written', 0
union all select 'published', count(*) from ix where doc_id % 10 <> 0""")
oracle("assign_ids", """
select doc_id, case when doc_id % 3 <> 0 then 'd' || cast(doc_id as varchar) end as given,
       cast(case when doc_id % 3 <> 0 then length('d' || cast(doc_id as varchar)) else 36 end as integer) as id_chars
from documents""")

# ------------------------------------------------------------ R, hostile
_TIES = """
dist as (select q.vec_id as query_id, v.vec_id as id, case when q.label % 16 = v.label % 16 then 0.0 else 2.0 end as d
         from embeddings q, embeddings v),
ranked as (select *, cast(row_number() over (partition by query_id order by d, id) as integer) as rank from dist)
"""
oracle("knn_ties", f"with {_TIES} select query_id, rank, id, cast(d as double) as distance from ranked where rank <= 7")
oracle("knn_ties_blocked", ORACLES["knn_ties"])
oracle("knn_filtered_extra", f"""
with {_DIST.format(where="where v.label % 3 <> 0 or (v.label not in (3, 6) and v.label > 4)")}
select query_id, rank, id, round(d, 6) as distance from ranked where rank <= 5""")


oracle("knn_approx_recall", """
with n as (select count(*) as n from embeddings)
select k, is_exact, n * least(k, n) as n_hits, true as recall_ok from n, (values (5, false), (50, false), (5, true)) t(k, is_exact)""")
