"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from fieldcast.llm.line_dedup import MIN_WORDS
from fieldcast.llm.quality_rules import LEAST, RATES, REACH

_WS = r"[\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality_rules() -> str:
    floors = ", ".join(f"('{r}', {f})" for r, f in RATES.items())
    inside = " and ".join(f"f.{r} <= l.{r}_fence" for r in RATES)
    fences = ", ".join(f"max(fence) filter (rate = '{r}') as {r}_fence" for r in RATES)
    rates = ", ".join(f"f.{r}" for r in RATES)
    limits = ", ".join(f"l.{r}_fence" for r in RATES)
    quart = """
      select {k} rate, max(total) as n, min(top) filter (upto * 100 >= total * 25) as q25,
             min(top) filter (upto * 100 >= total * 75) as q75
      from (select *, sum(n) over (partition by {k} rate) as total,
                   sum(n) over (partition by {k} rate order by bucket) as upto
            from (select {k} rate, bucket, sum(n) as n, max(top) as top from sketch
                  group by {k} rate, bucket)) group by {k} rate"""
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: trim(x, {_TRIM}) <> '') as l from t),
grams as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g
          from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from w)),
twins as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from grams)
          where c > 1),
again as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n
          from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twins)
          group by doc_id),
c as (select w.doc_id, lang, source, len(w) as n_words,
        length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) as n_upper,
        len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
        coalesce(again.n, 0) as n_repeat_words
      from w left join again on again.doc_id = w.doc_id),
f as (select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol_rate,
        1000 * n_upper // greatest(word_chars, 1) as upper_rate,
        1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_rate,
        1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate from c),
long as (unpivot (select lang, source, {", ".join(RATES)} from f)
         on {", ".join(RATES)} into name rate value v),
sketch as (select lang, source, rate,
             case when v < 64 then v else 32 * (length(bin(v)) - 6)
               + (v >> (length(bin(v)) - 6)) end as bucket, count(*) as n, max(v) as top
           from long group by lang, source, rate, bucket),
own as ({quart.format(k="lang, source,")}),
of_lang as ({quart.format(k="lang,")}),
of_all as ({quart.format(k="")}),
floors as (select * from (values {floors}) x(rate, floor)),
chosen as (select own.lang, own.source, own.rate,
    case when own.n >= {LEAST} then own.q75 + {REACH} * greatest(own.q75 - own.q25, floor)
         when of_lang.n >= {LEAST} then of_lang.q75 + {REACH} * greatest(of_lang.q75 - of_lang.q25, floor)
         else of_all.q75 + {REACH} * greatest(of_all.q75 - of_all.q25, floor) end as fence
  from own join floors using (rate) join of_all using (rate)
  join of_lang on of_lang.rate = own.rate and of_lang.lang is not distinct from own.lang),
l as (select lang, source, {fences} from chosen group by lang, source)
select f.doc_id, f.lang, f.source, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines,
  cast(f.n_repeat_words as bigint) as n_repeat_words, {rates}, {limits},
  (f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words) as base_failed,
  not (f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words) and {inside} as kept
from f left join l on f.lang is not distinct from l.lang and f.source is not distinct from l.source
"""


def _line_dedup() -> str:
    return f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
nb as (select doc_id, lines, list_filter(lines, lambda x: trim(x, {_TRIM}) <> '') as l,
         list_filter(generate_series(1, len(lines)), lambda i: trim(lines[i], {_TRIM}) <> '') as pos from s),
lines as (select doc_id, unnest(l) as g, unnest(generate_series(1, len(l))) as i from nb),
met as (select a.doc_id, a.i, a.g, b.doc_id as other, a.i - b.i as shift
        from lines a join lines b on a.g = b.g and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.i < a.i))),
spans as (select doc_id, min(i) as i, count(*) as h, min(g) as g from (
            select *, i - row_number() over (partition by doc_id, other, shift order by i) as run from met)
          group by doc_id, other, shift, run),
later as (select * from spans where h > 1
          or len(list_filter(regexp_split_to_array(g, '{_WS}'), lambda x: x <> '')) >= {MIN_WORDS}),
gone as (select distinct doc_id, unnest(generate_series(i, i + h - 1)) as i from later),
runs as (select doc_id, count(*) as n from (
           select doc_id, i - row_number() over (partition by doc_id order by i) as run from gone)
         group by doc_id, run),
per as (select doc_id, sum(n) as n_removed, count(*) as n_runs, max(n) as longest_run
        from runs group by doc_id),
shared as (select doc_id, max(h) as h from later group by doc_id),
drops as (select doc_id, list(i) as g from gone group by doc_id)
select nb.doc_id, len(l) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  coalesce(n_runs, 0) as n_runs, coalesce(longest_run, 0) as longest_run,
  cast(coalesce(h, 0) as bigint) as shared_lines,
  md5(case when g is null then array_to_string(lines, chr(10)) else array_to_string(
    list_transform(list_filter(generate_series(1, len(lines)),
      lambda i: not list_contains(list_transform(g, lambda x: pos[x]), i)), lambda i: lines[i]), chr(10)) end)
    as kept_md5
from nb left join per on per.doc_id = nb.doc_id left join shared on shared.doc_id = nb.doc_id
left join drops on drops.doc_id = nb.doc_id
"""


def _chat_rotation() -> str:
    return f"""
with said as (select conv_id, turn, coalesce(role, 'unknown') as role,
    trim(coalesce(text, ''), {_TRIM}) as body from conversations),
people as (select distinct conv_id, role as speaker from said where role <> 'system'),
views as (select s.*, speaker, case when role = 'system' then '<|system|>' || chr(10)
      when role = speaker then '<|assistant|>' || chr(10)
      else '<|user name=' || role || '|>' || chr(10) end as head
  from said s join people p on p.conv_id is not distinct from s.conv_id),
r as (select *, head || body || '<|end|>' || chr(10) as rendered from views),
o as (select *, cast(sum(length(rendered)) over (partition by conv_id, speaker
        order by turn, role, body rows unbounded preceding) as bigint) as e from r)
select conv_id, speaker, turn, role,
  case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user' end
    as chat_role,
  case when role <> 'system' and role <> speaker then role end as name, rendered,
  e - length(rendered) as char_start, e as char_end,
  case when role = speaker then e - length(rendered) + length(head) end as train_start,
  case when role = speaker then e - 1 end as train_end
from o
"""


def statements() -> dict[str, str]:
    return {"op1_quality_rules": _quality_rules(), "op2_line_dedup": _line_dedup(),
            "op9_chat_rotation": _chat_rotation()}
