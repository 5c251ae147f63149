"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, i, substr(x, 2 * i::int + 1, 100) as s from h, unnest(generate_series(0, length(x) // 2 - 50)) u(i) where length(x) >= 100),
f as (select s, min(doc_id) as first from w group by 1),
r as (select doc_id, i as lo, i + 50 as hi from w join f using (s) where first < doc_id),
g as (select *, max(hi) over (partition by doc_id order by lo rows between unbounded preceding and 1 preceding) as reach from r),
k as (select *, sum((reach is null or lo > reach)::int) over (partition by doc_id order by lo) as span from g),
spans as (select doc_id, span, min(lo) as lo, max(hi) as hi from k group by 1, 2),
cuts as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as prev from spans),
pieces as (select c.doc_id, string_agg(substr(x, (2 * prev + 1)::int, (2 * (lo - prev))::int), '' order by lo) as kept, max(hi) as last, sum(hi - lo) as removed, count(*) as n from cuts c join h using (doc_id) group by 1)
select h.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept || substr(x, (2 * last + 1)::int), x))) as kept_sha256 from h left join pieces using (doc_id)
"""

OP3 = rf"""
with d as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text from documents),
l as (select doc_id, host, text, line, {_WORDS.format('line')} as ws from (select *, unnest(string_split(text, chr(10))) as line from d)),
n as (select doc_id, host, text, line, len(ws) as k, regexp_replace({_LOW.format("array_to_string(ws, ' ')")}, '[0-9]+', '0', 'g') as norm from l where len(ws) > 0),
signs as (select doc_id, md5(text) as sign from d),
hosts as (select host, count(distinct sign) as docs from n join signs using (doc_id) group by 1),
often as (select n.host, norm from n join signs using (doc_id) join hosts using (host) group by 1, 2 having count(distinct sign) > 10 and count(distinct sign) > 0.1 * any_value(docs)),
left_ as (select doc_id, sum(k)::bigint as n_words_left from n where not exists (select 1 from often o where o.host = n.host and o.norm = n.norm) group by 1),
dup as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from n group by 1),
t as (select doc_id, text, {_WORDS.format('text')} as ws from d),
win as (select doc_id, i, ws[i::int] || ' ' || ws[i::int + 1] || ' ' || ws[i::int + 2] as g from t, unnest(generate_series(1, len(ws) - 2)) u(i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + o)::bigint as n_repeat_words from rep, (values (0), (1), (2)) v(o) group by 1),
b as (select t.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_words_left, 0) as n_words_left from t left join dup using (doc_id) left join cov using (doc_id) left join left_ using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words_left >= 0.3 * n_words as kept, n_words_left from b
"""

OP5 = rf"""
with recursive w as (select doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} as w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as g from w, unnest(generate_series(1, greatest(len(w) - 4, 1))) u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
r(doc_id, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join links l on l.a = r.doc_id)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(c) as component_id from r left join n using (doc_id) group by 1
"""

ORACLES = {"op1_suffix_dedup": OP1, "op3_quality_rules": OP3, "op5_jaccard_join": OP5}
