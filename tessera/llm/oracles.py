"""DuckDB SQL for the dealt operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), seen as (
  select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (
  select doc_id, place, line, coalesce(last <> doc_id, false) as gone from keyed left join seen using (k)
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP2 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 22 as chars from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""

OP3 = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents
), stats as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, source_size * 3.0::double as cap from stats
), stepped as (
  select *, row_number() over w as place,
    ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed window w as (order by cap / weight, source nulls last)
), found as (
  select arg_min(level, place) filter (level * weight <= cap) as level from stepped
), goals as (
  select s.source, s.source_size, least(s.cap, f.level * s.weight) as target from stepped s, found f
), placed as (
  select d.doc_id, d.size, g.source_size, g.target, floor(round(g.target, 6))::bigint as budget,
    sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as start
  from sized d join goals g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  (budget // greatest(source_size, 1) * size + greatest(0, least(size, budget - budget // greatest(source_size, 1) * source_size - start)))::bigint as taken
from placed
"""

OP4 = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as words from documents
), s as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from d where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)
), reach as (
  select doc_id, doc_id as other from d
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.component_id
from d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
"""

OP7 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), bn as (
  select item_id, words, least(len(words), 10) as n from b where len(words) > 0
), windows as (
  select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as gram from (select item_id, words, n, unnest(range(1, len(words) - n + 2)) as i from bn)
), sizes as (
  select distinct n from windows
), probes as (
  select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as gram
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, sizes where len(words) >= n)
), hits as (
  select doc_id, i, n, item_id from probes join windows using (n, gram)
), covered as (
  select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + n)) as w from hits) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hits) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

_RULED = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents
), w as (
  select doc_id, generate_subscripts(words, 1) as i, unnest(words) as word, len(words) as n from d
), grams as (
  select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 7 following) as gram, n from w
), marked as (
  select doc_id, i, n, i <= n - 7 and count(*) filter (i <= n - 7) over (partition by doc_id, gram) > 1 as twice from grams
), covered as (
  select doc_id, max(twice::int) over (partition by doc_id order by i rows between 7 preceding and current row) as hit from marked
), repeats as (
  select doc_id, sum(hit)::bigint as n_repeat_words from covered group by doc_id
), l as (
  select doc_id, unnest(string_split(text, chr(10))) as line from d
), lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '{_WORD}') group by doc_id
), m as (
  select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    length(regexp_replace(text, '[^!]', '', 'g')) as n_bangs, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from d left join repeats using (doc_id) left join lines using (doc_id)
)
"""

OP8 = _RULED + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 2 * n_symbols > n_words or 5 * n_bangs > n_words
    or (n_letters >= 100 and 2 * n_capitals > n_letters) or (n_lines >= 4 and 2 * n_dup_lines > n_lines)
    or word_chars > 25 * n_words or word_chars < 2 * n_words) as kept
from m
"""

RULES_ABLATION = _RULED + """
, bits as (
  select (n_words < 20)::int as few_words, (100 * n_repeat_words > 30 * n_words)::int as repeats, (2 * n_symbols > n_words)::int as symbols, (5 * n_bangs > n_words)::int as bangs,
    (n_letters >= 100 and 2 * n_capitals > n_letters)::int as capitals, (n_lines >= 4 and 2 * n_dup_lines > n_lines)::int as dup_lines,
    (word_chars > 25 * n_words or word_chars < 2 * n_words)::int as word_length
  from m
), each as (
  select few_words + repeats + symbols + bangs + capitals + dup_lines + word_length as n,
    unnest([{'rule': 'few_words', 'hit': few_words}, {'rule': 'repeats', 'hit': repeats}, {'rule': 'symbols', 'hit': symbols}, {'rule': 'bangs', 'hit': bangs},
      {'rule': 'capitals', 'hit': capitals}, {'rule': 'dup_lines', 'hit': dup_lines}, {'rule': 'word_length', 'hit': word_length}]) as r
  from bits
)
select r.rule as rule, sum(r.hit)::bigint as n_failed, sum((r.hit = 1 and n = 1)::int)::bigint as n_only from each group by r.rule
"""

ORACLES: dict[str, str] = {"quality_rules_ablation": RULES_ABLATION, "op1_line_dedup": OP1, "op2_chat_formatting": OP2, "op3_mixing": OP3, "op4_ngram_jaccard_join": OP4, "op7_benchmark_decontamination": OP7, "op8_quality_rules": OP8}
