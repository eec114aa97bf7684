"""The queries of the thirteen operators, the pipeline's, and their SQL where it can express them."""

from __future__ import annotations

from barlake.llm import bestfit, bpe, edits, interactions, itq, lm, packing, pii, quality, repair, simhash, suffix, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_packing": packing.op3,
    "op4_pii": pii.op4,
    "op5_bpe": bpe.op5,
    "op6_embedding_near_dedup": itq.op6,
    "op7_lm_scoring": lm.op7,
    "op8_warc": warc.op8,
    "op9_suffix_dedup": suffix.op9,
    "op10_token_counts": edits.op10,
    "op11_filter_interactions": interactions.op11,
    "op12_best_two_fit": bestfit.op12,
    "op13_conversation_repair": repair.op13,
    "pipeline": pipeline,
}

#: Words of a text in DuckDB; its regular expressions take no \x0B in a class, so chr() gives it.
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

_OP1 = f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as words from documents),
w as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win
      from (select rid, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from w) where n > 1),
cov as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
li as (select rid, unnest(string_split(text, chr(10))) as line from d),
dup as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from li where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') group by rid),
f as (select d.rid, doc_id, lang, source, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines
      from d left join cov using (rid) left join dup using (rid)),
g as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, n_symbols * 1000 // greatest(word_chars, 1) as m1,
        n_dup_lines * 1000 // greatest(n_lines, 1) as m2, n_repeat_words * 1000 // greatest(n_words, 1) as m3, word_chars * 100 // greatest(n_words, 1) as m4 from f),
v as (select lang, source, unnest([1, 2, 3, 4]) as m, unnest([m1, m2, m3, m4]) as v from g where not base_failed),
b as (select lang, source, m, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) as v from v),
own as (select lang, source, m, count(*) as n, quantile_disc(v, 0.1) as q10, quantile_disc(v, 0.5) as q50, quantile_disc(v, 0.9) as q90 from b group by all),
lg as (select lang, m, count(*) as n, quantile_disc(v, 0.1) as q10, quantile_disc(v, 0.5) as q50, quantile_disc(v, 0.9) as q90 from b group by all),
ev as (select m, quantile_disc(v, 0.1) as q10, quantile_disc(v, 0.5) as q50, quantile_disc(v, 0.9) as q90 from b group by all),
pick as (select own.lang, own.source, own.m, case when own.n >= {quality.LEAST_GROUP} then {{'a': own.q10, 'b': own.q50, 'c': own.q90}} when lg.n >= {quality.LEAST_GROUP} then {{'a': lg.q10, 'b': lg.q50, 'c': lg.q90}}
           else {{'a': ev.q10, 'b': ev.q50, 'c': ev.q90}} end as q
         from own join lg on own.lang is not distinct from lg.lang and own.m = lg.m join ev on ev.m = own.m),
lim as (select lang, source, m, greatest(q.c + {quality.SPREAD} * (q.c - q.b), q.b + [{", ".join(str(x[1]) for x in quality.METRICS)}][m]) as high,
          case when m = 4 then least(q.a - {quality.SPREAD} * (q.b - q.a), q.b - {quality.METRICS[3][1]}) else -1 end as low from pick),
bad as (select distinct g.rid from g join lim on g.lang is not distinct from lim.lang and g.source is not distinct from lim.source
        where not base_failed and ([m1, m2, m3, m4][m] > high or [m1, m2, m3, m4][m] < low))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and bad.rid is null) as kept
from g left join bad using (rid)
"""

_OP11 = f"""
with lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
d as (select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {_WORDS} as words, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from documents d left join lab on lab.doc_id = d.doc_id),
low as (select text, min(doc_id) as least from d group by text),
f as (select part, good, toxic, len(words) < 200 as "A", 100 * len(list_distinct(words)) < 50 * len(words) as "B", 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as "C", regexp_matches(text, '[#$%&*|]') as "D", coalesce(doc_id > least, false) as "E" from d join low using (text)),
m as (select part, [a.v, b.v, c.v, e.v, g.v] as fails, n, good, toxic from (select part, "A", "B", "C", "D", "E", count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all) x, lateral (select x."A" as v) a, lateral (select x."B" as v) b, lateral (select x."C" as v) c, lateral (select x."D" as v) e, lateral (select x."E" as v) g),
l as (select unnest([1, 2, 3, 4, 5]) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as p from l a, l b, l c, l d, l e where a.i <> b.i and a.i <> c.i and a.i <> d.i and a.i <> e.i and b.i <> c.i and b.i <> d.i and b.i <> e.i and c.i <> d.i and c.i <> e.i and d.i <> e.i),
s as (select part, array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') as filter_order, step, p[step] as filter, fails[p[step]] as bad, len(list_filter(p[:step - 1], lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 as single, n, m.good, m.toxic from m, o, (select unnest([1, 2, 3, 4, 5]) as step)),
g as (select part, filter_order, step, filter, sum(case when not gone and not bad then n else 0 end) as kept, sum(case when not gone and bad then n else 0 end) as removed, sum(case when gone and bad then n else 0 end) as redundant, sum(case when bad and single then n else 0 end) as unique_fails,
  sum(case when not gone and bad then good else 0 end) as good_lost, sum(case when not gone and bad then toxic else 0 end) as toxic_lost from s group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from g
"""

_BLANKS = "[ \\t\\n\\x0B\\f\\r]"

#: A row's edits lead from place p of a legal conversation to place q (0 start, 1 after the system's row, 2 user's, 3 assistant's), insertions before it included; rows are taken one after the other.
_OP13 = f"""
with recursive tab as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end) as v from (select unnest(range(256))::bigint as i))),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
harm as (select raw.*, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::bigint) % 20 as h from raw, tab),
rows as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from harm where h > 0),
o as (select *, row_number() over w as i, role[1] as initial, lag(role[1]) over w as before, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, regexp_replace(text, '{_BLANKS}+', '', 'g') as solid from rows window w as (partition by conv_id order by turn nulls first, role, sha256(text), copy)),
f as (select *, case when solid = '' then 'blank' when again then 'duplicate' when solid[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from f group by conv_id),
ins as (select * from (values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) as v(p, q, a)),
moves as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) as v(p, x, q)),
kinds as (select distinct initial, fault from f),
edits as (select initial, fault, p, p as q, 3 as cost, 'D' as a from kinds, (values (0), (1), (2), (3)) as v(p)
  union all select initial, fault, p, q, case when fault = 'truncated' then 1 else 0 end + case when x = initial then 0 else 2 end, case when x = initial then 'K' else 'R' end from kinds, moves where fault not in ('blank', 'duplicate') and (x = initial or x <> 's')),
steps as (select e.initial, e.fault, i.p, e.q, 2 * length(i.a) + e.cost as cost, i.a || e.a as a from edits e join ins i on i.q = e.p),
dp as (select conv_id, 0::bigint as i, 0 as place, 0::bigint as cost, '' as audit from counts
  union all select conv_id, i, place, cost, audit from (select dp.conv_id, f.i, s.q as place, dp.cost + s.cost as cost, dp.audit || s.a as audit from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join steps s on s.initial = f.initial and s.fault = f.fault and s.p = dp.place) qualify row_number() over (partition by conv_id, place order by cost, audit) = 1),
done as (select dp.conv_id, dp.cost + 2 * length(ins.a) as cost, dp.audit || ins.a as audit from dp join counts c on c.conv_id is not distinct from dp.conv_id and c.n = dp.i join ins on ins.p = dp.place where ins.q in (0, 3) qualify row_number() over (partition by dp.conv_id order by dp.cost + 2 * length(ins.a), dp.audit || ins.a) = 1),
marks as (select conv_id, j, audit[j] as e, length(replace(audit[:j], 'I', '')) as i, length(replace(audit[:j], 'D', '')) as out from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as j from done)),
lines as (select m.conv_id, j, e, out, role, text, max(case when out = 1 and e = 'K' and initial = 's' then 1 else 0 end) over (partition by m.conv_id) as sys from marks m left join f on e <> 'I' and f.conv_id is not distinct from m.conv_id and f.i = m.i where e <> 'D'),
texts as (select conv_id, string_agg(case when e = 'K' then role when (out - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by j) as repaired from lines group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts n on n.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id left join texts t on t.conv_id is not distinct from c.conv_id
"""

ORACLE_SQL = {"op1_quality_rules": _OP1, "op11_filter_interactions": _OP11, "op13_conversation_repair": _OP13}
