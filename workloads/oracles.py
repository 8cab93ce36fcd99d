"""Reference SQL for the queries, in DuckDB's dialect."""

from __future__ import annotations

from workloads.frames import EPOCH_US, TEMPLATES, page_globs

TEMPLATE_COUNT = len(TEMPLATES)


def ext(path: str) -> str:
    return f"case when regexp_matches({path}, '[^/][.][^./]*$') then regexp_extract({path}, '[.][^./]*$', 0) else '' end"


def name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def stem(path: str) -> str:
    return f"left({name(path)}, length({name(path)}) - length({ext(path)}))"


def without_ext(path: str) -> str:
    return f"left({path}, length({path}) - length({ext(path)}))"


def dirs_of(relation: str, path: str) -> str:
    """Ancestor directories of all paths of a relation."""
    return f"""
    select distinct array_to_string(list_slice(parts, 1, n), '/') as path
    from (select string_split({path}, '/') as parts from {relation} where {path} like '%/%') p,
         lateral (select unnest(generate_series(1, len(parts) - 1)) as n) d"""


# --- documents ----------------------------------------------------------------------------------------

SOURCE = f"""
src as (
  select doc_id, text, n_chars as size, (doc_id % 512)::int as mode,
    {EPOCH_US} + doc_id * 1000000 + (doc_id % 1000) * 1000 as us,
    source || '/' || lang || '/' || doc_id || case doc_id % 6
      when 0 then '.flac' when 1 then '.FLAC' when 2 then '.png' when 3 then '.txt' when 4 then '.tar.gz' else '' end as rel_path
  from documents
)"""

WORK = f"""{SOURCE},
work as (
  select *, case lower_ext
      when '.flac' then {without_ext("rel_path")} || '.opus'
      when '.png' then {without_ext("rel_path")} || '.jpg'
      else rel_path end as target_path,
    case lower_ext when '.flac' then 'opus' when '.png' then 'jpg' when '.gz' then 'gz' end as converter
  from (select *, lower({ext("rel_path")}) as lower_ext from src)
)"""

TARGET = f"""{WORK},
tgt as (
  select target_path as path, size, mode, case
      when doc_id % 11 = 0 then us + 1400000
      when doc_id % 13 = 0 then us - 3600000000
      when doc_id % 5 = 0 then us // 1000000 * 1000000
      else us end as us
  from work where doc_id % 7 <> 0 and target_path not like 'src3/%'
  union all
  select 'orphans/' || doc_id % 4 || '/' || doc_id || case when doc_id % 2 = 0 then '.m3u' else '.opus' end, size, mode, us
  from src where doc_id % 17 = 0
)"""


def plan_rows(window: int) -> str:
    fresh = "t.us = w.us" if window < 0 else f"abs(t.us // 1000000 - w.us // 1000000) <= {window}"
    return f"""{TARGET},
plan as (
  select w.*, t.us as target_us, t.path is null as is_new,
    case when t.path is null then 'new' when {fresh} then 'fresh' else 'stale' end as reason
  from work w left join tgt t on t.path = w.target_path
),
acted as (
  select *, case when reason = 'fresh' then 'skip' when converter is not null then 'convert' else 'copy' end as action
  from plan
)"""


def plan_query(window: int) -> str:
    return f"""with {plan_rows(window)}
select rel_path, target_path, lower_ext as ext, converter, action, reason, us as mtime_us, target_us as target_mtime_us,
  abs(target_us // 1000000 - us // 1000000) as gap
from acted"""


# what the three text converters make of a document
TEXT_OUTPUT = """case when action = 'copy' then text
    when converter = 'opus' then replace(text, ' ', '_')
    when converter = 'jpg' then regexp_replace(text, '[0-9]', '#', 'g')
    else md5(text) end"""


def written(output: str) -> str:
    return f"""with {plan_rows(0)},
made as (select *, {output} as output from acted where action <> 'skip')
select target_path as rel_path, us as mtime_us, octet_length(encode(output))::bigint as size, mode, md5(output) as digest
from made"""


FAULTY = f"""{plan_rows(0)},
outcome as (
  select *, case
      when action = 'skip' then 'skipped'
      when doc_id % 19 = 0 then 'vanished'
      when action = 'copy' then 'ok'
      when converter = 'opus' and length(text) % 3 <> 0 then 'ok'
      else 'failed' end as status
  from acted
),
coded as (
  select *, case when status = 'failed' and converter = 'jpg' then 3 when status = 'failed' and converter = 'gz' then 1 end::int as exit_code
  from outcome
)"""

REMOVABLE = f"""{TARGET},
survivors as (select target_path as path from work union all select path from tgt where path like '%.m3u'),
target_dirs as ({dirs_of("tgt", "path")}),
known as ({dirs_of("src", "rel_path")}),
occupied as ({dirs_of("survivors", "path")}),
removable as (
  select path from target_dirs
  where path not in (select path from known) and path not in (select path from occupied)
)"""

# --- pages, events, lineitem --------------------------------------------------------------------------

PAGES = f"""
pg as (
  select page_id, html, {EPOCH_US} + page_id * 1000000 as us,
    rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') as rel_path
  from pages
)"""

LINES = """
lines as (
  select l_returnflag || '/' || l_linestatus || '/' || l_orderkey || '-' || l_linenumber as target_path,
    l_returnflag || '/' || l_linestatus || '/' || l_orderkey || '-' || l_linenumber || '/' || l_partkey || '-' || l_suppkey as rel_path,
    epoch_us(l_shipdate) as us, trunc(l_extendedprice)::bigint as size, l_orderkey
  from lineitem
),
winners as (
  select * from (
    select *, row_number() over (partition by target_path order by string_split(rel_path, '/')) as rn from lines
  ) where rn = 1
)"""

STATES = """
now_state as (
  select 'u' || user_id || '/' || event_type as path, max(epoch_us(ts)) as us from events group by all
),
old_state as (
  select 'u' || user_id || '/' || event_type as path, max(epoch_us(ts)) as us
  from events where ts < timestamp '2024-01-25' and user_id % 10 <> 3 group by all
)"""

# --- templates ----------------------------------------------------------------------------------------


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEMPLATE_LIST = "[" + ", ".join(literal(text) for text in TEMPLATES) + "]"
TOKENS = "'[{][{]|[}][}]|[{][^}]*[}]|[{]|[}]|[^{}]+'"
PLACEHOLDER = "length(t) > 1 and starts_with(t, '{') and t <> '{{'"

TEMPLATE_ERRORS = f"""with {SOURCE},
templates as (
  select rel_path as subject, {stem("rel_path")} || ':' || ({TEMPLATE_LIST})[doc_id % {TEMPLATE_COUNT} + 1] as template from src
  union all select 'event/' || event_id, props from events
  union all select 'page/' || page_id, html from pages
),
cut as (select subject, regexp_extract_all(template, {TOKENS}) as tokens from templates),
judged as (
  select subject, tokens, list_transform(tokens, lambda t: case
      when t = '{{' then 'unmatched_open'
      when t = '}}' then 'unmatched_close'
      when {PLACEHOLDER} and t not in ('{{input}}', '{{output}}', '{{stem}}', '{{ext}}') then 'unknown_variable'
      end) as codes
  from cut
),
located as (
  select subject, tokens, codes, list_position(list_transform(codes, lambda c: c is not null), true) as first_bad from judged
)
select subject, codes[first_bad] as code,
  coalesce(octet_length(encode(array_to_string(tokens[1:first_bad - 1], ''))), 0)::int as pos,
  case when codes[first_bad] = 'unknown_variable' then tokens[first_bad][2:-2] end as name
from located where first_bad > 0"""
# the f-string doubles braces; the regular expression and its literals need single ones
TEMPLATE_ERRORS = TEMPLATE_ERRORS.replace("t = '{{'", "t = '{'")

RENDERED = [
    # rendered text of each template, as SQL over the document's columns; NULL where it is malformed
    "'--from=' || rel_path",
    "ext || '-' || stem",
    "'{braced}'",
    "'<{{' || rel_path || '}}>'",
    "NULL",
    "NULL",
    "NULL",
    "'{' || ext || '}'",
    "NULL",
    "'ß' || ext || stem",
    "'q}z' || ext",
    "NULL",
    "NULL",
    "'--quiet'",
]
RENDER_CASES = " ".join(f"when {number} then {text}" for number, text in enumerate(RENDERED))

TEMPLATE_RENDER = f"""with {WORK},
parts as (select rel_path, target_path, doc_id, {stem("rel_path")} as stem, {ext("rel_path")} as ext from work)
select rel_path, 't' || doc_id % {TEMPLATE_COUNT} as converter,
  'tool ' || case doc_id % {TEMPLATE_COUNT} {RENDER_CASES} end || ' -o ' || target_path as command_line
from parts"""

# numbers of the templates that have an error
MALFORMED = ", ".join(str(number) for number, text in enumerate(RENDERED) if text == "NULL")

RULE_ERRORS = f"""with
conv as (
  select doc_id, case when doc_id % 23 = 0 then 'c_shared' else 'c' || doc_id end as name
  from documents where doc_id % 9 <> 0
),
maps as (
  select '.flac' || (doc_id - case when doc_id % 8 = 1 then 1 else 0 end) as ext,
    case when doc_id % 15 <> 0 then 'c' || doc_id end as converter
  from documents
)
select 'converter' as rule, name as subject, 'missing_command' as code from conv where doc_id % 10 = 0
union all select 'converter', name, 'empty_command' from conv where doc_id % 10 = 1
union all select distinct 'converter', name, 'invalid_template' from conv
  where doc_id % 10 > 1 and doc_id % {TEMPLATE_COUNT} in ({MALFORMED})
union all select 'converter', name, 'duplicate_converter' from conv group by name having count(*) > 1
union all select 'mapping', ext, 'missing_converter' from maps where converter is null
union all select 'mapping', ext, 'undefined_converter' from maps
  where converter is not null and converter not in (select name from conv)
union all select 'mapping', ext, 'duplicate_mapping' from maps group by ext having count(*) > 1"""

ORACLES: dict[str, str] = {
    "ext_histogram": f"with {WORK} select lower_ext as ext, count(*) as n from work group by all",
    "target_paths": f"with {WORK} select rel_path, lower_ext as ext, converter, target_path from work",
    "path_parts": f"""with {SOURCE}, {PAGES},
p as (select rel_path from src union all select rel_path from pg)
select '/data/source/' || rel_path as absolute, rel_path as relative, {ext("rel_path")} as raw_ext,
  lower({ext("rel_path")}) as ext, {stem("rel_path")} as stem,
  '.' || lower(ltrim(string_split(rel_path, '.')[-1], '.')) as normalized,
  {without_ext("rel_path")} || '.out' as replaced, {without_ext("rel_path")} as stripped
from p""",
    "source_excluded": f"with {SOURCE} select rel_path from src where rel_path not like '%.txt'",
    "source_excluded_globs": rf"""with {SOURCE} select rel_path from src where not (
  rel_path like 'src1/%.FLAC' or regexp_matches(rel_path, '^src[23]/[de]./') or rel_path like 'src4_/%' or rel_path like 'src5/%'
  or regexp_matches(rel_path, '(^|/)[^0-8].*[.]png$'))""",
    "dirs_excluded": f"""with {SOURCE}, dirs as ({dirs_of("src", "rel_path")})
select path from dirs where not (regexp_matches(path, '^src1.$') or path like '%/fr')""",
    "unmatched_dropped": f"with {WORK} select count(*) as scanned from work where converter is not null",
    "scanned_items": f"with {WORK} select count(*) as scanned from work where rel_path not like '%.txt' and rel_path not like 'src7/%'",
    "sync_plan_w0": plan_query(0),
    "sync_plan_w1": plan_query(1),
    "sync_plan_w2": plan_query(2),
    "sync_plan_w3600": plan_query(3600),
    "sync_plan_exact": plan_query(-1),
    "sync_plan_summary": f"""with {plan_rows(0)}
select action, reason, count(*) as items, sum(size)::bigint as bytes from acted group by all""",
    "event_state_sync": f"""with {STATES}
select n.path as target_path, n.us as mtime_us,
  case when o.path is null or n.us // 1000000 <> o.us // 1000000 then 'copy' else 'skip' end as action,
  case when o.path is null then 'new' when n.us // 1000000 <> o.us // 1000000 then 'stale' else 'fresh' end as reason
from now_state n left join old_state o using (path)""",
    "bulk_plan_summary": f"""with {LINES},
old as (
  select path, max(us) as us, max_by(size, us) as size from (
    select case when l_orderkey % 11 = 0 then 'gone/' || target_path else target_path end as path,
      case when l_orderkey % 7 = 0 then us - 86400000000 else us end as us, size
    from lines where l_orderkey % 5 <> 0
  ) group by path
),
both_sides as (
  select case
      when w.target_path is null then case when o.path like 'gone/A/%' then 'protected' else 'orphan' end
      when o.path is null then 'new' when o.us // 1000000 = w.us // 1000000 then 'fresh' else 'stale' end as reason,
    coalesce(w.size, o.size) as size
  from winners w full join old o on o.path = w.target_path
)
select case reason when 'protected' then 'keep' when 'orphan' then 'delete' when 'fresh' then 'skip' else 'copy' end as action,
  reason, count(*) as items, sum(size)::bigint as bytes
from both_sides group by all""",
    "orphans": f"""with {TARGET}
select path, us as mtime_us from tgt where path not like '%.m3u' and path not in (select target_path from work)""",
    "orphans_and_protected": f"""with {TARGET}
select path, case when path like '%.m3u' then 'keep' else 'delete' end as action,
  case when path like '%.m3u' then 'protected' else 'orphan' end as reason
from tgt where path not in (select target_path from work)""",
    "known_target_set": f"with {WORK} select distinct target_path from work",
    "dir_tree": f"""with {LINES}, dirs as ({dirs_of("lines", "rel_path")})
select len(string_split(path, '/'))::int as depth, count(*) as n from dirs group by all""",
    "ancestor_dirs": f"with {SOURCE} select * from ({dirs_of('src', 'rel_path')})",
    "missing_dirs": f"""with {TARGET}
select * from ({dirs_of("src", "rel_path")}) except select * from ({dirs_of("tgt", "path")})""",
    "orphan_dirs": f"""with {TARGET}
select * from ({dirs_of("tgt", "path")}) except select * from ({dirs_of("src", "rel_path")})""",
    "removable_dirs": f"with {REMOVABLE} select path from removable",
    "plan_deletes": f"""with {REMOVABLE}
select path, 'dir' as kind from removable
union all select path, 'file' from tgt where path not like '%.m3u' and path not in (select target_path from work)""",
    "target_conflicts": f"""with {LINES}
select target_path, count(*) as n_sources, min_by(rel_path, string_split(rel_path, '/')) as first_source,
  max_by(rel_path, string_split(rel_path, '/')) as last_source
from lines group by target_path having count(*) > 1""",
    "conflict_sources": f"""with {LINES},
claims as (select target_path, count(*) as n_sources, min_by(rel_path, string_split(rel_path, '/')) as winner
  from lines group by target_path having count(*) > 1)
select target_path, rel_path, winner, n_sources from lines join claims using (target_path)""",
    "conflict_outcome": """with claims as (
  select 'notes/' || doc_id // 3 as stem, case doc_id % 3 when 0 then '.htm' when 1 then '.md' else '.rst' end as ext
  from documents
),
ranked as (select *, first_value(stem || ext) over (partition by stem order by ext) as winner from claims)
select stem || ext as rel_path, stem || '.txt' as target_path,
  case when stem || ext = winner then 'ok' else 'conflict' end as status,
  case when stem || ext <> winner then 'target taken by ' || winner end as message
from ranked""",
    "content_matches_manifest": f"select rel_path, true as agrees from ({written(TEXT_OUTPUT)}) made",
    "conflict_winner": f"with {LINES} select target_path, rel_path, us as mtime_us, size from winners",
    "template_render": TEMPLATE_RENDER,
    "template_errors": TEMPLATE_ERRORS,
    "rule_errors": RULE_ERRORS,
    "payload_for_work": f"with {plan_rows(0)} select rel_path, action, md5(text) as digest from acted where action <> 'skip'",
    "indexed_payload": f"with {plan_rows(0)} select rel_path, action, md5(text) as digest from acted where action <> 'skip'",
    "tree_to_content": f"select rel_path, mtime_us, size, digest from ({written(TEXT_OUTPUT)})",
    "incremental_content": f"""with {SOURCE},
made as (select *, case when size > 1000 then 'second ' || text else text end as content from src)
select rel_path, us + case when size > 1000 then 3600000000 else 0 end as mtime_us,
  octet_length(encode(content)) as size, mode, md5(content) as digest from made""",
    "many_globs": f"""with {PAGES}
select rel_path, page_id from pg
where not exists (select 1 from (select unnest([{", ".join(f"'{glob}'" for glob in page_globs())}]) as pattern) where rel_path glob pattern)""",
    "digested_run": f"""with {SOURCE}
select rel_path, us + case when size > 1000 then 3600000000 else 0 end as mtime_us, octet_length(encode(text)) as size,
  case when size > 1000 then 2 else 1 end::bigint as data_version from src""",
    "compacted_manifest": f"""with {SOURCE}
select rel_path, us + 3600000000 as mtime_us, octet_length(encode(text)) as size, 2::bigint as data_version
from src where size <= 1000""",
    "convert_text": written(TEXT_OUTPUT),
    "convert_udf": written("""case when action = 'copy' then text when converter = 'opus' then sha256(text)
    when converter = 'jpg' then octet_length(encode(text))::varchar else md5(text) end"""),
    "convert_command": f"""with {plan_rows(0)}
select rel_path, target_path, action, converter,
  case when action = 'skip' then 'skipped' when converter = 'gz' then 'failed' else 'ok' end as status,
  case when action <> 'skip' and converter = 'jpg' then 0 when action <> 'skip' and converter = 'gz' then 3 end::int as exit_code,
  case when action <> 'skip' and converter = 'gz' then 'no ' || {stem("rel_path")} end as message
from acted""",
    "copied_items": f"with {plan_rows(0)} select target_path, us as mtime_us, md5(text) as digest from acted where action = 'copy'",
    "strip_html": f"""with {PAGES},
newest as (select * from pg where page_id in (select max(page_id) from pg group by rel_path)),
made as (
  select case when lower({ext("rel_path")}) = '.html' then {without_ext("rel_path")} || '.txt' else rel_path end as rel_path, us,
    case when lower({ext("rel_path")}) = '.html' then regexp_replace(html, '<[^>]*>', ' ', 'g') else html end as output
  from newest
)
select rel_path, us as mtime_us, octet_length(encode(output))::bigint as size, md5(output) as digest from made""",
    "post_sync_manifest": f"""with {plan_rows(0)}
select target_path as rel_path, case when action = 'skip' then target_us else us end as mtime_us, mode, action <> 'skip' as written from acted
union all select path, us, mode, false from tgt where path like '%.m3u'""",
    "post_sync_dirs": f"""with {REMOVABLE}
select path from (select path from target_dirs union select path from known union select path from occupied)
where path not in (select path from removable)""",
    "second_run": f"""with {plan_rows(0)}
select 'skip' as action, 'fresh' as reason, count(*) as items from acted
union all select 'keep', 'protected', count(*) from tgt where path like '%.m3u'""",
    "vanished": f"""with {plan_rows(0)}
select rel_path, target_path, 'vanished' as status from acted where action <> 'skip' and doc_id % 19 = 0""",
    "sync_outcome": f"""with {FAULTY}
select rel_path, target_path, action, converter, status, exit_code, us as mtime_us from coded""",
    "faulty_manifest": f"""with {FAULTY}
select target_path as rel_path, case when status = 'ok' then us else target_us end as mtime_us
from coded where status = 'ok' or target_us is not null
union all select path, us from tgt where path like '%.m3u'""",
    "failure_summary": f"""with {FAULTY}
select converter, exit_code, count(*) as failures from coded where status = 'failed' group by all""",
    "scan_manifest": """select 's=' || source || '/l=' || lang as dir, sum(octet_length(encode(text)) + 1)::bigint as bytes
from documents group by all""",
    "scan_tree": """select 's=' || source || '/l=' || lang as dir, sum(octet_length(encode(text)) + 1)::bigint as bytes
from documents group by all
union all select distinct 's=' || source, null::bigint from documents""",
    "snapshot_sink": f"with {SOURCE} select rel_path, us as mtime_us, size, mode from src",
    "incremental": f"""with {STATES} select path || '.opus' as rel_path, us as mtime_us from now_state""",
}
ORACLES["incremental_keyed"] = ORACLES["incremental"]
ORACLES["removable_dirs_deep"] = ORACLES["removable_dirs"]
