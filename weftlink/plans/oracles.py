"""DuckDB SQL that gives the linkage queries' results on the same tables."""

from __future__ import annotations

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+"
NULLS = "('null','none','nan','n/a','na','nil','<null>','missing')"


def lowered(x: str) -> str:
    return rf"lower(regexp_replace({x}, '{CONTROL}', ' ', 'g'))"


def ws(x: str) -> str:
    return rf"trim(regexp_replace({lowered(x)}, '\s+', ' ', 'g'))"


def punct(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({ws(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def missing(x: str) -> str:
    return rf"(trim(regexp_replace(regexp_replace({x}, '{CONTROL}', ' ', 'g'), '\s+', ' ', 'g')) = '')"


def null_like(x: str) -> str:
    return f"(not {missing(x)} and {ws(x)} in {NULLS})"


def uni(x: str) -> str:
    return f"case when {missing(x)} or {null_like(x)} then '' else {punct(x)} end"


def fold(x: str) -> str:
    return f"case when {missing(x)} or {null_like(x)} then '' else strip_accents({punct(x)}) end"


E = r"""e as (
  select 'S' || (doc_id % 3 + 1) || '-' || doc_id as entity_id, 'S' || (doc_id % 3 + 1) as source, substr(split_part(text, chr(10), 1), 1, 60) as business_name,
    case when split_part(text, chr(10), 2) = '' then '' else n_chars || ' ' || substr(split_part(text, chr(10), 2), 1, 80) end as business_address, lang as country, md5(text) as content
  from documents)"""
EDGES = """edges as (select a.entity_id as s1_id, b.entity_id as target_id, b.source as target_source from e a join e b on a.content = b.content where a.source = 'S1' and b.source <> 'S1')"""
LISTS = """lists as (select s.entity_id as s1_id, coalesce(list_sort(list(t.target_id) filter (t.target_id is not null)), []) as targets from (select entity_id from e where source = 'S1') s left join edges t on t.s1_id = s.entity_id group by 1)"""
V = f"""v as (select *, {uni('business_name')} as n_uni, {fold('business_name')} as n_fold, {uni('business_address')} as a_uni, {fold('business_address')} as a_fold,
  sha256(concat_ws(chr(31), business_name, business_address, country)) as tie from e)"""
KEYS = """keys as (
  select entity_id, source, country, tie, 'name' as field, 'unicode_preserving' as view, n_uni as key from v where n_uni <> '' union all select entity_id, source, country, tie, 'name', 'accent_folded', n_fold from v where n_fold <> ''
  union all select entity_id, source, country, tie, 'address', 'unicode_preserving', a_uni from v where a_uni <> '' union all select entity_id, source, country, tie, 'address', 'accent_folded', a_fold from v where a_fold <> '')"""
EXACT = """exact as (
  select q.entity_id as s1_id, t.entity_id as target_id, t.source as target_source, 'exact_' || q.field || '_' || q.view as channel, q.field, 1.0::double as retrieval_score, 1 as channel_rank, true as exact_match, t.tie
  from keys q join keys t on q.field = t.field and q.view = t.view and q.key = t.key and q.country = t.country where q.source = 'S1' and t.source <> 'S1')"""


def grams(name: str, text: str, table: str = "v") -> str:
    """Character 3- to 5-grams inside padded words."""
    return f"""{name}_w as (select entity_id, source, country, tie, ' ' || w || ' ' as p from (select entity_id, source, country, tie, unnest(string_split({text}, ' ')) as w from {table}) where w <> ''),
{name}_g as (select entity_id, source, country, tie, g as gram, count(*) as tf from (select entity_id, source, country, tie, substr(p, i::int, n) as g from {name}_w, (values (3), (4), (5)) s(n), unnest(generate_series(1, length(p) - n + 1)) u(i)) group by all)"""


def vocab(name: str, features: int = 50_000) -> str:
    return f"""{name}_n as (select source, count(distinct entity_id) as n from {name}_g where source <> 'S1' group by 1),
{name}_d as (select source, gram, df, row_number() over (partition by source order by total desc, gram) as r from (select source, gram, count(*) as df, sum(tf) as total from {name}_g where source <> 'S1' group by 1, 2) where df >= 2),
{name}_v as (select d.source, gram, ln((1 + n) / (1 + df)::double) + 1 as idf from {name}_d d join {name}_n n on d.source = n.source where r <= {features})"""


def topn(name: str, channel: str, k: int = 10, threshold: str = "> 0.2", country: bool = True, target: str = "true", query: str = "true") -> str:
    on = " and q.country = t.country" if country else ""
    return f"""{name}_raw as (select g.*, v.source as target_source, (1 + ln(tf)) * idf as w0 from {name}_g g join {name}_v v on g.gram = v.gram),
{name}_x as (select *, w0 / sqrt(sum(w0 * w0) over (partition by entity_id, target_source)) as w from {name}_raw),
{name}_s as (select q.entity_id as s1_id, t.entity_id as target_id, q.target_source, t.tie, round(sum(q.w * t.w), 6) as retrieval_score from {name}_x q join {name}_x t on q.gram = t.gram and q.target_source = t.target_source{on}
  where q.source = 'S1' and t.source = t.target_source and ({target}) and ({query}) group by all having round(sum(q.w * t.w), 6) {threshold}),
{name}_t as (select * from (select *, row_number() over (partition by s1_id, target_source order by retrieval_score desc, tie, target_id) as channel_rank from {name}_s) where channel_rank <= {k})"""


NAME = ",\n".join([grams("nm", "n_uni"), vocab("nm"), topn("nm", "name_char_tfidf")])
ADDRESS = ",\n".join([grams("ad", "a_uni"), vocab("ad"), topn("ad", "address_char_tfidf")])
EV = """ev as (select s1_id, target_id, target_source, channel, retrieval_score, channel_rank, exact_match, tie from exact
  union all select s1_id, target_id, target_source, 'name_char_tfidf', retrieval_score, channel_rank, false, tie from nm_t union all select s1_id, target_id, target_source, 'address_char_tfidf', retrieval_score, channel_rank, false, tie from ad_t)"""
ALL = ",\n".join([E, EDGES, V, KEYS, EXACT, NAME, ADDRESS, EV])
OBS = """obs as (
  select s1_id, target_id, target_source, sum(1.0::double / (60 + channel_rank) order by channel) as fusion_score, count(*) as n_channels, bool_or(exact_match) as exact_match, min(tie) as tie,
    arg_min(channel, (not exact_match, channel_rank, channel)) as channel, arg_min(channel_rank, (not exact_match, channel_rank, channel)) as channel_rank, max(retrieval_score) as best_score
  from ev group by 1, 2, 3)"""
S1 = "s1 as (select entity_id as s1_id, country from e where source = 'S1')"
F = "case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred::double) * (tp / n_true::double) / (0.25 * (tp / n_pred::double) + tp / n_true::double) end"


def q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


ORACLES: dict[str, str] = {}
O = ORACLES
O["source_validation"] = q(E, select="select source, count(*) as n_rows, count(distinct entity_id) as n_ids, sum((trim(entity_id) = '')::int)::bigint as n_empty, sum((not starts_with(entity_id, source || '-'))::int)::bigint as n_bad_prefix from e group by 1")
_tok = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
O["norm_views"] = q(E, f"p as (select entity_id, {lowered('business_name')} as unicode_lower, {ws('business_name')} as whitespace_normalized, {punct('business_name')} as punctuation_normalized from e)", select=rf"""
select *, strip_accents(punctuation_normalized) as accent_folded, regexp_replace(strip_accents(punctuation_normalized), '[^\p{{L}}\p{{N}}_]', '', 'g') as alphanumeric_compact,
  array_to_string({_tok.format('strip_accents(punctuation_normalized)')}, '|') as word_tokens, array_to_string(list_sort({_tok.format('strip_accents(punctuation_normalized)')}), '|') as sorted_tokens from p""")
O["digit_tokens"] = q(E, select=rf"select entity_id, array_to_string(regexp_extract_all({lowered('business_address')}, '\d+'), ',') as digits from e")
_suffix = r"(?i)(?:\s|,)+(?:inc(?:orporated)?|corp(?:oration)?|co(?:mpany)?|llc|ltd|limited|llp|plc|pvt(?:\s+ltd)?|private\s+limited)\.?$"
O["legal_suffix"] = q("""n as (select c_name as name, c_custkey as k from customer union all select s_name, s_suppkey from supplier union all select p_name, p_partkey from part)""", """f as (select name || [' Inc.', ', LLC', ' Private Limited', ' Company', ' plc', '', ' Ltd. ', ' Corp', ' pvt ltd', ' Co-op'][k % 10 + 1] as full_name from n)""", select=rf"select full_name, regexp_replace(regexp_replace({punct('full_name')}, '{_suffix}', ''), '^[ ,.]+|[ ,.]+$', '', 'g') as bare_name from f")
O["terminal_postal"] = q(E, "a as (select entity_id, business_address || [' 12345', ' 12345-6789', '9 123456', ' 90210 ', '', ' 1234'][('0x' || substr(content, 1, 4))::int % 6 + 1] as address from e)", r"x as (select *, regexp_extract(address, '(^|[^\d])(\d{5}(?:[- ]?\d{4})?)\s*$', 2) as code from a)", select=r"select entity_id, address, case when code <> '' and regexp_matches(regexp_replace(address, '\d{5}(?:[- ]?\d{4})?\s*$', ''), '\p{L}') then code else '' end as postal from x")
O["null_like_flags"] = q(E, "a as (select entity_id, case when ('0x' || substr(content, 1, 4))::int % 16 < 8 then ['NULL', ' n/a ', 'nan', '--', '', '  ', 'None', 'nonesuch'][('0x' || substr(content, 1, 4))::int % 16 + 1] else business_address end as value from e)", select=f"select entity_id, value, {missing('value')} as missing, {null_like('value')} as null_like, {uni('value')} as unicode_view from a")
O["content_tie_key"] = q(E, select="select entity_id, sha256(concat_ws(chr(31), business_name, business_address, country)) as tie from e")
O["truth_edges"] = q(E, EDGES, select="select s1_id, target_id from edges")
O["truth_lists"] = q(E, EDGES, LISTS, select="select s1_id, array_to_string(targets, ',') as targets from lists")
O["exact_block_top_k"] = q(E, V, KEYS, EXACT, select="select s1_id, target_id, target_source, channel, r::int as channel_rank from (select *, row_number() over (partition by s1_id, target_source, channel order by tie, target_id) as r from exact) where r <= 5")
O["exact_block_all"] = q(E, V, KEYS, EXACT, select="select s1_id, target_id, target_source, string_agg(channel, '|' order by channel) as channels, round(count(*) / 61.0::double, 9) as fusion_score from exact group by 1, 2, 3")
O["digit_overlap_block"] = q(E, rf"d as (select entity_id, source, unnest(list_distinct(regexp_extract_all({lowered('business_address')}, '\d+'))) as g from e)", select="select distinct a.entity_id as s1_id, b.entity_id as target_id, b.source as target_source from d a join d b on a.g = b.g where a.source = 'S1' and b.source <> 'S1'")
O["tfidf_idf"] = q(E, V, grams("nm", "n_uni"), vocab("nm"), select="select source, gram, round(idf, 6) as idf from nm_v")
O["tfidf_topn_join"] = q(E, V, NAME, select="select s1_id, target_id, target_source, retrieval_score, channel_rank::int as channel_rank from nm_t")
_words = """wd_t0 as (select entity_id, source, country, tie, string_split(n_fold, ' ') as t from v where n_fold <> ''),
wd_g as (select entity_id, source, country, tie, gram, count(*) as tf from (select entity_id, source, country, tie, unnest(t) as gram from wd_t0 union all select entity_id, source, country, tie, t[i] || ' ' || t[i + 1] from wd_t0, unnest(generate_series(1, len(t) - 1)) u(i)) group by all)"""
O["word_tfidf_topn"] = q(E, V, _words, vocab("wd", 40_000), topn("wd", "", 20, ">= 0.35", False), select="select s1_id, target_id, target_source, retrieval_score, channel_rank::int as channel_rank from wd_t")
QUALITY = """mg as (select s1_id, target_source, channel, retrieval_score, row_number() over w as r, lead(retrieval_score) over w as nx from ev where not exact_match window w as (partition by s1_id, target_source, channel order by channel_rank, retrieval_score desc, tie)),
fz as (select s1_id, min(coalesce(retrieval_score - nx, 1.0)) as margin, count(distinct channel) as views from mg where r = 1 group by 1),
pr as (select s1_id, max(n) as agreement, bool_or(e) as has_exact from (select s1_id, target_id, count(*) as n, bool_or(exact_match) as e from ev group by 1, 2) group by 1),
qq as (select v.entity_id as s1_id, n_uni = '' as missing_name, a_uni = '' as missing_address, length(n_uni) < 5 as short_name, length(a_uni) < 8 as short_address, coalesce(has_exact, false) as has_exact, coalesce(margin, 0.0) as min_margin, coalesce(agreement, 0) as max_agreement, coalesce(views, 0) as fuzzy_views
  from v left join fz on fz.s1_id = v.entity_id left join pr on pr.s1_id = v.entity_id where v.source = 'S1'),
ql as (select *, missing_name or missing_address or short_name or short_address or not has_exact or min_margin < 0.05 or max_agreement < 2 or fuzzy_views < 2 as weak from qq)"""
O["query_quality"] = q(ALL, QUALITY, select="select * replace (round(min_margin, 6) as min_margin) from ql")
O["rescue_missing_address"] = q(ALL, QUALITY, "rs_g as (select g.* from nm_g g)", vocab("rs"), topn("rs", "", 20, target="t.entity_id in (select entity_id from v where a_uni = '')", query="q.entity_id in (select s1_id from ql where weak and not missing_name)"), select="select s1_id, target_id, target_source, 'missing_address_name_char' as channel, retrieval_score, channel_rank::int as channel_rank from rs_t")
O["semi_anti_membership"] = q(E, EDGES, V, KEYS, EXACT, select="select s1_id, target_id, case when exists (select 1 from exact x where x.s1_id = edges.s1_id and x.target_id = edges.target_id) then 'recovered' else 'missed' end as kind from edges")
O["union_topk"] = q(ALL, select="select distinct s1_id, target_id, target_source from ev where channel in ('name_char_tfidf', 'address_char_tfidf') and channel_rank <= 3")
_ch = "max(case when channel = '{0}' then {1} end)"
O["provenance"] = q(ALL, select=f"""select s1_id, target_id, target_source, bool_or(channel like 'exact_name%') as exact_name, bool_or(channel like 'exact_address%') as exact_address, string_agg(channel, '|' order by channel) as channels,
  {_ch.format('name_char_tfidf', 'retrieval_score')} as score_name_char_tfidf, coalesce({_ch.format('name_char_tfidf', 'channel_rank::int')}, 0) as rank_name_char_tfidf, {_ch.format('address_char_tfidf', 'retrieval_score')} as score_address_char_tfidf,
  coalesce({_ch.format('address_char_tfidf', 'channel_rank::int')}, 0) as rank_address_char_tfidf, bool_or(channel = 'exact_name_accent_folded') as has_exact_name_accent_folded from ev group by 1, 2, 3""")
_rrf = "round(coalesce(sum(case when {0} then 1.0::double / (60 + channel_rank) end), 0.0), 9) as {1}"
O["rrf_pivot"] = q(ALL, select=f"""select s1_id, target_id, target_source, {_rrf.format("channel like '%name%'", 'rrf_name')}, {_rrf.format("channel like '%address%'", 'rrf_address')}, {_rrf.format("channel like 'exact_name%'", 'rrf_exact_name')}, {_rrf.format("channel like 'exact_address%'", 'rrf_exact_address')},
  {_rrf.format('true', 'rrf_total')}, round(coalesce(max(case when channel = 'name_char_tfidf' then 1 - (channel_rank - 1) / 9.0::double end), 0.0), 9) as normalized_rank_name_char_tfidf, count(*) as supporting_channels from ev group by 1, 2, 3""")
_take = """rk as (select *, row_number() over (partition by s1_id, x order by {score} desc, {n} desc, tie, {last}) as r, sum(x::int) over (partition by s1_id) as ne from {t}),
ed as (select *, max(case when r = greatest({b} - ne, 0) then {score} end) over (partition by s1_id, x) as e1, max(case when r = greatest({b} - ne, 0) then {n} end) over (partition by s1_id, x) as e2, max(case when r = greatest({b} - ne, 0) then tie end) over (partition by s1_id, x) as e3 from rk),
ch as (select * from ed where x or r <= greatest({b} - ne, 0) or coalesce({score} = e1 and {n} = e2 and tie = e3, false))"""
O["select_budget_ties"] = q(ALL, "pq as (select s1_id, target_id, target_source, round(sum(1.0::double / (60 + channel_rank)), 9) as score, count(*) as n, bool_or(exact_match) as x, min(tie) as tie from ev group by 1, 2, 3)", _take.format(score="score", n="n", t="pq", b=3, last="target_id"), select="select s1_id, target_id, target_source from ch")
O["fuse_no_quota"] = q(ALL, OBS, "pq as (select *, exact_match as x from obs)", _take.format(score="fusion_score", n="n_channels", t="pq", b=4, last="target_source, target_id"), select="select s1_id, target_id, target_source, channel, channel_rank::int as channel_rank, exact_match, round(fusion_score, 9) as fusion_score, n_channels from ch")
O["country_rollup"] = q(E, EDGES, select="select x.target_source, count(*) as edges, sum((a.country = b.country)::int)::bigint as agreeing, avg((a.country = b.country)::int) as rate from edges x join e a on a.entity_id = x.s1_id join e b on b.entity_id = x.target_id group by rollup (x.target_source)")
PER = """pred as (select distinct s1_id, target_id from {0}),
ps as (select s1.s1_id, s1.country, (select count(distinct target_id) from edges t where t.s1_id = s1.s1_id) as n_true, (select count(*) from pred p where p.s1_id = s1.s1_id) as n_pred, (select count(*) from pred p join (select distinct s1_id, target_id from edges) t using (s1_id, target_id) where p.s1_id = s1.s1_id) as tp from s1)"""
_oracle = F.replace("n_pred", "tp")
O["candidate_metrics"] = q(ALL, S1, PER.format("ev"), f"pf as (select *, {_oracle} as f from ps)", select="""select case when grouping(country) = 1 then 'all' else 'country' end as grouping, case when grouping(country) = 1 then 'all' else country end as value, count(*) as entities, sum(n_true)::bigint as truth_edges, sum(tp)::bigint as recalled,
  round(sum(tp) / greatest(sum(n_true), 1)::double, 9) as recall, round(avg((tp = n_true)::int), 9) as all_truth_rate, round(avg(n_pred), 9) as mean, round(quantile_cont(n_pred, 0.5), 9) as median, round(quantile_cont(n_pred, 0.9), 9) as p90, round(quantile_cont(n_pred, 0.95), 9) as p95, round(quantile_cont(n_pred, 0.99), 9) as p99,
  round(avg((n_pred = 0)::int), 9) as zero_rate, round(avg(f), 9) as oracle_f, max(n_pred) as max from pf group by grouping sets ((), (country))""")
O["volume_stats"] = q(ALL, "c as (select s1_id, count(*) as k from (select distinct s1_id, target_id from ev) group by 1)", select="select count(*) as count, round(avg(k), 9) as mean, quantile_cont(k, 0.5)::double as median, round(quantile_cont(k, 0.95), 9)::double as p95, max(k)::double as max from c")
_dup = "select '{0}' as key, count(*) as n_unique, sum(c - 1)::bigint as excess, sum((c > 1)::int)::bigint as n_groups, sum(case when c > 1 then c else 0 end)::bigint as rows_in_groups from (select count(*) as c from e group by {1})"
O["duplicate_metrics"] = q(E, select=" union all ".join(_dup.format(a, b) for a, b in (("name", "business_name"), ("address", "business_address"), ("name_address", "business_name, business_address"), ("all", "business_name, business_address, country"), ("content", "content"))))


def _rates(column: str, p: str) -> str:
    r = lambda c, n: f"round(avg(({c})::int), 9) as {p}_{n}"
    return ", ".join([r(f"{column} = ''", "empty"), r(f"{column} <> '' and {missing(column)}", "blank"), r(null_like(column), "null_like"), r(rf"regexp_matches({column}, '[^\x00-\x7f]')", "non_ascii"), r(rf"regexp_matches({column}, '\d')", "has_digit"), r(f"contains({column}, chr(65533))", "replacement"), r(rf"regexp_matches({column}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')", "control"), f"round(avg(length({column})), 9) as {p}_mean_length"])


O["profile_rates"] = q(E, select=f"select source, country, count(*) as n_rows, round(avg(({missing('business_name')} and {missing('business_address')})::int), 9) as both_missing, {_rates('business_name', 'name')}, {_rates('business_address', 'address')} from e group by 1, 2")
O["truth_structure"] = q(E, EDGES, LISTS, "c as (select s1_id, len(targets) as n, len(list_filter(targets, lambda x: starts_with(x, 'S2-'))) as n2, len(list_filter(targets, lambda x: starts_with(x, 'S3-'))) as n3 from lists)", select="""select count(*) as n_s1, sum((n = 0)::int)::bigint as n_0, sum((n = 1)::int)::bigint as n_1, sum((n = 2)::int)::bigint as n_2, sum((n = 3)::int)::bigint as n_3, sum((n >= 4)::int)::bigint as n_4_or_more, sum(n2)::bigint as edges_s2, sum(n3)::bigint as edges_s3,
  sum((n2 > 0 and n3 > 0)::int)::bigint as n_both_sources, (select coalesce(sum((o > 1)::int), 0)::bigint from (select count(distinct s1_id) as o from edges group by target_id)) as n_shared_targets, 0::bigint as n_unknown_targets from c""")
O["edges_by_country"] = q(E, EDGES, select="select country, business_address = '' as missing_address, count(*) as edges, count(distinct s1_id) as n_s1, count(distinct target_id) as n_targets from edges join e on e.entity_id = s1_id group by 1, 2")
O["oov_shift"] = q(E, rf"t as (select source, token, count(*) as n from (select source, unnest(regexp_extract_all({punct('business_name')}, '[\p{{L}}\p{{N}}_]+')) as token from e) group by 1, 2)", select="""select round((select coalesce(sum(n), 0) from t where source = 'S3' and token not in (select token from t where source = 'S2')) / greatest((select sum(n) from t where source = 'S3'), 1)::double, 9) as oov_rate, (select sum(n)::bigint from t where source = 'S3') as total,
  (select count(*) from (select token from t where source = 'S2' order by n desc, token limit 100) join (select token from t where source = 'S3' order by n desc, token limit 100) using (token)) as common_top""")
O["pareto_frontier"] = q(ALL, S1, """ks as (select unnest([1, 2, 3, 5, 10])::int as k)""", "pk as (select distinct k, s1_id, target_id from ev join ks on channel_rank <= k)", "te as (select distinct s1_id, target_id from edges)", """pp as (select k, p.s1_id, count(*) as n_pred, count(t.s1_id) as tp from pk p left join te t on t.s1_id = p.s1_id and t.target_id = p.target_id group by 1, 2)""", "nt as (select s1_id, count(*) as n_true from te group by 1)", f"rw as (select k, s1_id, n_true, n_pred, tp, {_oracle} as f from (select ks.k, s1.s1_id, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from s1 cross join ks left join nt on nt.s1_id = s1.s1_id left join pp on pp.k = ks.k and pp.s1_id = s1.s1_id))", "cf as (select k, round(sum(tp) / greatest(sum(n_true), 1)::double, 9) as recall, round(avg(f), 9) as oracle_f, round(avg(n_pred), 9) as mean, round(quantile_cont(n_pred, 0.95), 9)::double as p95 from rw group by 1)", select="""select * from cf a where not exists (select 1 from cf b where b.recall >= a.recall and b.oracle_f >= a.oracle_f and b.mean <= a.mean and b.p95 <= a.p95 and (b.recall > a.recall or b.oracle_f > a.oracle_f or b.mean < a.mean or b.p95 < a.p95))""")
STRATA = """cc as (select l.s1_id, country, sha256(concat_ws(chr(31), business_name, business_address, country)) as tie, len(targets) as n, len(list_filter(targets, lambda x: starts_with(x, 'S2-'))) as n2, len(list_filter(targets, lambda x: starts_with(x, 'S3-'))) as n3 from lists l join e on e.entity_id = l.s1_id),
st as (select s1_id, country, tie, case when n >= 4 then '4+' else n::varchar end as cardinality, case when n2 > 0 and n3 > 0 then 'both_sources' when n2 > 0 then 'S2_only' when n3 > 0 then 'S3_only' else 'no_match' end as composition,
  case when n2 > 0 and n3 > 0 then 'both' when n2 > 0 then 's2_only' when n3 > 0 then 's3_only' else 'no_match' end as fold_composition from cc)"""
O["stratified_round_robin"] = q(E, EDGES, LISTS, STRATA, select="select s1_id, country, cardinality, composition from (select *, row_number() over (partition by country, cardinality, composition order by tie, s1_id) as turn from st) order by turn, concat_ws(chr(31), country, cardinality, composition) limit 40")
O["uniform_hash_sample"] = q(E, EDGES, LISTS, STRATA, select="select tie, s1_id from st where s1_id not in (select s1_id from edges) and tie in (select distinct tie from st where s1_id not in (select s1_id from edges) order by tie limit 25)")
O["folds"] = q(E, EDGES, LISTS, STRATA, "sz as (select s1_id, concat_ws('_', country, cardinality, fold_composition) as stratum, count(*) over (partition by concat_ws('_', country, cardinality, fold_composition)) as c from st)", select="select s1_id, stratum, ((row_number() over (partition by case when c >= 5 then stratum else '' end order by sha256('13:' || s1_id), s1_id) - 1) % 5)::int as fold from sz")
O["hard_negatives"] = q(ALL, OBS, "lb as (select s1_id, target_id, target_source, exact_match::int as x, round(fusion_score, 9) as ev, (exists (select 1 from edges t where t.s1_id = obs.s1_id and t.target_id = obs.target_id))::int as label, sha256(concat_ws('|', '7', s1_id, target_id)) as h from obs)", "ps as (select s1_id, count(*) as p from lb where label = 1 group by 1)", "o1 as (select *, row_number() over (partition by s1_id, target_source order by x desc, ev desc, h) as own from lb where label = 0)", "o2 as (select *, row_number() over (partition by s1_id order by (own <> 1)::int, x desc, ev desc, h) as r from o1 where own <= 4)", select="select s1_id, target_id, target_source, label from lb where label = 1 union all select o2.s1_id, target_id, target_source, label from o2 left join ps on ps.s1_id = o2.s1_id where r <= least(4, greatest(2, floor(2.0 * coalesce(p, 0))))")
SCORED = "sc as (select s1_id, target_id, target_source, round(0.7 * greatest(best_score, 0.0) + 0.3 * n_channels / 6, 6) as score from obs)"
_decode = """d1 as (select * from sc where score >= case when target_source = 'S3' then 0.55 else 0.5 end),
d2 as (select * from (select *, row_number() over (partition by s1_id, target_source order by score desc, s1_id, target_id) as k from d1) where k <= 2),
d3 as (select *, row_number() over (partition by target_id order by score desc, s1_id) as o, lead(score) over (partition by target_id order by score desc, s1_id) as nx from d2),
d4 as (select * from d3 where o = 1 and (nx is null or score - nx >= 0.01 or abs(score - nx - 0.01) <= 1e-12 + 1e-14))"""
O["decode_matches"] = q(ALL, OBS, S1, SCORED, _decode, select="select s1.s1_id, coalesce(string_agg(target_id, ',' order by target_id), '') as targets from s1 left join d4 on d4.s1_id = s1.s1_id group by 1")
O["threshold_search"] = q(ALL, OBS, S1, SCORED, "gr as (select t.t as threshold, k.k from (values (0.4::double), (0.6::double), (0.8::double)) t(t), (values (1), (3)) k(k))", """g1 as (select threshold, gr.k, sc.*, row_number() over (partition by threshold, gr.k, s1_id, target_source order by score desc, s1_id, target_id) as r from sc join gr on score >= threshold)""", "g2 as (select *, row_number() over (partition by threshold, k, target_id order by score desc, s1_id) as o from g1 where r <= k)", "te as (select distinct s1_id, target_id from edges)", "hp as (select threshold, k, g.s1_id, count(*) as n_pred, count(t.s1_id) as tp from g2 g left join te t on t.s1_id = g.s1_id and t.target_id = g.target_id where o = 1 group by 1, 2, 3)", "nt as (select s1_id, count(*) as n_true from te group by 1)", select=f"select threshold, k::int as k, round(avg({F}), 8) as macro_f from (select gr.threshold, gr.k, s1.s1_id, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from s1 cross join gr left join nt on nt.s1_id = s1.s1_id left join hp on hp.threshold = gr.threshold and hp.k = gr.k and hp.s1_id = s1.s1_id) group by 1, 2")
FALLBACK = """fb as (select s1_id, target_id from exact group by 1, 2 having bool_or(field = 'name') and bool_or(field = 'address')),
ow as (select * from (select *, row_number() over (partition by target_id order by s1_id) as o, count(*) over (partition by target_id) as c from fb) where o = 1 and c = 1)"""
O["macro_f05"] = q(E, EDGES, V, KEYS, EXACT, S1, FALLBACK, PER.format("ow"), f"pf as (select *, {F} as f from ps)", select="""select count(*) as n_s1, round(avg(f), 9) as macro_f, sum(tp)::bigint as tp, sum(n_pred - tp)::bigint as fp, sum(n_true - tp)::bigint as fn, sum((n_true = 0)::int)::bigint as n_no_match, sum((n_true = 0 and n_pred = 0)::int)::bigint as n_no_match_right,
  sum((f < 0.2)::int)::bigint as bin_0, sum((f >= 0.2 and f < 0.4)::int)::bigint as bin_1, sum((f >= 0.4 and f < 0.6)::int)::bigint as bin_2, sum((f >= 0.6 and f < 0.8)::int)::bigint as bin_3, sum((f >= 0.8)::int)::bigint as bin_4 from pf""")
O["ranker_diagnostics"] = q(E, EDGES, V, KEYS, EXACT, S1, select="select *, case when truth > 0 then round(retrieved / truth::double, 9) end as recall from (select (select count(*) from edges) as truth, (select count(*) from edges t where exists (select 1 from exact x where x.s1_id = t.s1_id and x.target_id = t.target_id)) as retrieved, (select count(*) from s1 where s1_id not in (select s1_id from exact)) as candidate_free, (select count(*) from s1 where s1_id not in (select s1_id from edges)) as no_match)")
O["submission_lists"] = q(E, V, KEYS, EXACT, S1, FALLBACK, select="select s1.s1_id, coalesce((select string_agg(target_id, ',' order by target_id) from ow where ow.s1_id = s1.s1_id), '') as matches, coalesce((select string_agg(distinct target_id, ',' order by target_id) from exact x where x.s1_id = s1.s1_id), '') as candidates from s1")
_sup = """select s1_id, target_id, target_source, round(sum(1.0::double / (60 + channel_rank) order by channel), 9) as fusion_score, round(1.0::double / arg_min(channel_rank, (not exact_match, channel_rank, channel)), 9) as reciprocal_rank, count(*)::int as channel_support_count, sum(exact_match::int)::int as exact_support_count,
  round(max(retrieval_score), 9) as support_best_score, round(avg(retrieval_score), 9) as support_mean_score, round(min(retrieval_score), 9) as support_min_score, round(max(retrieval_score), 9) as support_max_score, min(channel_rank)::double as support_min_rank, round(avg(channel_rank), 9) as support_mean_rank,
  sum((channel like '%exact%')::int)::int as exact_support_family_count, sum((channel not like '%exact%')::int)::int as fuzzy_support_count, bool_or(exact_match)::int as has_exact_support, bool_or(channel not like '%exact%')::int as has_fuzzy_support, arg_min(channel, (not exact_match, -retrieval_score, channel_rank, channel)) as strongest_channel,
  (bool_or(channel like '%name%') and bool_or(channel like '%address%'))::int as independent_channel_agreement, 0::int as source_support_count, 0::int as has_source_support, sum((channel like '%name%')::int)::int as name_support_count, bool_or(channel like '%name%')::int as has_name_support,
  sum((channel like '%address%')::int)::int as address_support_count, bool_or(channel like '%address%')::int as has_address_support, case when target_source = 'S2' then count(*) else 0 end::int as s2_support_count, (target_source = 'S2')::int as has_s2_support,
  case when target_source = 'S3' then count(*) else 0 end::int as s3_support_count, (target_source = 'S3')::int as has_s3_support from ev group by 1, 2, 3"""
O["support_features"] = q(ALL, select=_sup)
_bare = rf"regexp_replace(regexp_replace({{0}}, '{_suffix}', ''), '^[ ,.]+|[ ,.]+$', '', 'g')"
_words = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
#: What the audit compares of each record.
CONTENTS = f"""ct as (select *, {punct('business_name')} as p, strip_accents({punct('business_name')}) as sf, {_bare.format(punct('business_name'))} as bare,
  list_sort({_words.format(f"strip_accents({punct('business_name')})")}) as sorted, {_words.format('n_fold')} as toks, regexp_replace(n_fold, '[^\\p{{L}}\\p{{N}}_]', '', 'g') as compact,
  {missing('business_name')} as n_m, {missing('business_address')} as a_m, case when a_uni = '' then [] else regexp_extract_all({lowered('business_address')}, '\\d+') end as digits, count(*) over (partition by source, country, n_uni, a_uni) as fr from v)"""
AUDIT = [
    "sel as (select distinct s1_id, target_id from exact where field = 'address')",
    "te as (select distinct s1_id, target_id, target_source from edges)",
    "fd as (select t.s1_id, count(*) as n_found from te t join sel using (s1_id, target_id) group by 1)",
    "mt as (select s1_id, count(*) as n_true from te group by 1)",
    "sn as (select s1_id, target_id, bool_or(channel like '%name%') as by_name, bool_or(channel like '%address%') as by_address from ev group by 1, 2)",
    CONTENTS,
    """fl as (select t.s1_id, t.target_id, t.target_source, a.country, b.a_m as target_address_missing, a.n_m or b.n_m or not coalesce(by_name, false) as weak_or_missing_name_evidence,
  coalesce(by_name, false) as name_retrieved_below_selected_budget, coalesce(by_address, false) as address_retrieved_below_selected_budget, by_name is null as absent_from_every_existing_top80_channel,
  b.fr > 1 as duplicate_common_normalized_signature, a.p <> '' and a.p <> b.p and a.sf = b.sf as accent_unicode_normalization_issue,
  a.p <> '' and a.p <> b.p and (a.bare = b.bare or a.sorted = b.sorted) as legal_suffix_or_token_order_variation, a.country = 'en' as india_specific_concentration, t.target_source = 'S3' as s3_specific_concentration,
  n_true > 1 and coalesce(n_found, 0) > 0 as multi_match_truncation, substr(sha256(concat_ws(chr(31), a.business_name, a.business_address, b.business_name, b.business_address)), 1, 16) as redacted_content_key
  from te t left join sn using (s1_id, target_id) left join fd on fd.s1_id = t.s1_id join mt on mt.s1_id = t.s1_id join ct a on a.entity_id = t.s1_id join ct b on b.entity_id = t.target_id
  where not exists (select 1 from sel where sel.s1_id = t.s1_id and sel.target_id = t.target_id))""",
    """audit as (select *, case when absent_from_every_existing_top80_channel then case when target_address_missing then 'absent_top80_target_address_missing' when weak_or_missing_name_evidence then 'absent_top80_weak_name'
  when accent_unicode_normalization_issue then 'absent_top80_accent_unicode' when legal_suffix_or_token_order_variation then 'absent_top80_name_variation' when duplicate_common_normalized_signature then 'absent_top80_common_signature' else 'absent_top80_other' end
  when multi_match_truncation then 'multi_match_truncation' when name_retrieved_below_selected_budget then 'name_evidence_fusion_truncation' when address_retrieved_below_selected_budget then 'address_evidence_fusion_truncation' else 'other_fusion_truncation' end as primary_category from fl)""",
]
_FLAGS = (
    "target_address_missing", "weak_or_missing_name_evidence", "name_retrieved_below_selected_budget", "address_retrieved_below_selected_budget", "absent_from_every_existing_top80_channel",
    "duplicate_common_normalized_signature", "accent_unicode_normalization_issue", "legal_suffix_or_token_order_variation", "india_specific_concentration", "s3_specific_concentration", "multi_match_truncation",
)
_LONG = "lg as (" + " union all ".join(f"select s1_id, target_id, '{x}' as flag from audit where {x}" for x in _FLAGS) + ")"
O["miss_audit"] = q(ALL, *AUDIT, select="select * from audit")
O["miss_flag_table"] = q(ALL, *AUDIT, _LONG, "rk as (select *, row_number() over (partition by flag order by s1_id, target_id) as r from lg)", select="""
select flag, count(*) as n_rows, count(*) / (select count(*) from audit)::double as share, string_agg(s1_id || '>' || target_id, ';' order by s1_id || '>' || target_id) filter (r <= 3) as examples from rk group by 1""")
O["miss_categories"] = q(ALL, *AUDIT, select="select primary_category, count(*) as n_rows, min(redacted_content_key) as example from audit group by 1")
O["miss_overlaps"] = q(ALL, *AUDIT, _LONG, select="select a.flag as flag_a, b.flag as flag_b, count(*) as n_rows from lg a join lg b on a.s1_id = b.s1_id and a.target_id = b.target_id and a.flag < b.flag group by 1, 2")
_short = "(len({0}.toks) > 1 and list_reduce(list_concat([''], list_transform({0}.toks, lambda w: w[1])), lambda x, y: x || y) = {1}.compact)"
_differ = "(a.n_uni <> '' and b.n_uni <> '' and a.n_uni <> b.n_uni)"
O["taxonomy_pairs"] = q(ALL, CONTENTS, "pr as (select s1_id, target_id, exists (select 1 from exact x where x.field = 'address' and x.s1_id = nm_t.s1_id and x.target_id = nm_t.target_id) as present from nm_t where channel_rank = 1)", select=f"""
select pr.s1_id, pr.target_id, a.n_uni = '' or b.n_uni = '' as missing_or_null_name, a.a_uni = '' or b.a_uni = '' as missing_address,
  (length(a.n_uni) < 3 and length(a.a_uni) < 5) or (length(b.n_uni) < 3 and length(b.a_uni) < 5) as both_fields_sparse, {_differ} and a.n_fold = b.n_fold as accent_unicode, {_differ} and a.bare <> '' and a.bare = b.bare as legal_suffix,
  {_differ} and list_sort(a.toks) = list_sort(b.toks) as token_reorder, {_differ} and a.compact = b.compact as token_segmentation, {_differ} and ({_short.format('a', 'b')} or {_short.format('b', 'a')}) as abbreviation_initials,
  len(a.digits) > 0 and len(b.digits) > 0 and a.digits <> b.digits as digit_address_conflict, present as fusion_truncation, not present as absent_every_channel
from pr join ct a on a.entity_id = pr.s1_id join ct b on b.entity_id = pr.target_id""")
O["truth_summary"] = q(E, EDGES, LISTS, select="select count(*) as n_rows, sum(len(targets))::bigint as positive_edges from lists")
O["truth_onto_s2"] = q(E, EDGES, LISTS, select="select s1_id, array_to_string(list_filter(targets, lambda t: starts_with(t, 'S2-')), ',') as targets from lists")
O["fetched_targets"] = q(E, EDGES, select="select entity_id, business_name, country from e where entity_id in (select target_id from edges)")
_SAMPLE = "sm as (select entity_id as s1_id, tie, row_number() over (order by tie, entity_id) as place from v where source = 'S1' and tie in (select distinct tie from v where source = 'S1' order by tie limit 30))"
O["sampled_queries"] = q(E, V, _SAMPLE, select="select entity_id, business_name, place::int as place from sm join e on e.entity_id = sm.s1_id")
O["sampled_truth"] = q(E, EDGES, LISTS, V, _SAMPLE, select="select sm.s1_id, array_to_string(targets, ',') as targets from sm join lists on lists.s1_id = sm.s1_id")
O["hash_prefilter"] = q(E, V, select="select entity_id, ('0x' || substr(tie, 1, 8))::bigint % 100 as bucket from v where ('0x' || substr(tie, 1, 8))::bigint % 100 < 3")
O["seeded_order"] = q(E, EDGES, select="""select s1_id, target_id, sha256('[13, "' || s1_id || '", "' || target_id || '"]') as order_key from edges""")
O["redacted_keys"] = q(E, select="select entity_id, substr(sha256(concat_ws(chr(31), business_name, business_address)), 1, 16) as redacted from e")
_runs = rf"regexp_extract_all({lowered('business_address')}, '\d+')"
O["digit_agreement"] = q(E, V, KEYS, EXACT, f"dg as (select entity_id, {_runs} as d from e)", select="select x.s1_id, x.target_id, len(list_intersect(a.d, b.d)) > 0 as digit_overlap, len(a.d) > 0 and a.d = b.d as digits_equal from (select distinct s1_id, target_id from exact) x join dg a on a.entity_id = x.s1_id join dg b on b.entity_id = x.target_id")
O["fold_counts"] = f"select stratum, {', '.join(f'sum((fold = {i})::int)::bigint as fold_{i}' for i in range(5))} from ({O['folds']}) group by 1"
O["token_overlap_neutral"] = q(E, EDGES, V, f"tk as (select entity_id, n_uni, {_words.format('n_fold')} as w from v)", select="""
select t.s1_id, t.target_id, round(case when len(a.w) = 0 and len(b.w) = 0 then 1.0 else len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(list_concat(a.w, b.w)))::double end, 9) as jaccard,
  round(case when a.n_uni = '' and b.n_uni = '' then 1.0 else least(length(a.n_uni), length(b.n_uni)) / greatest(length(a.n_uni), length(b.n_uni))::double end, 9) as lengths from edges t join tk a on a.entity_id = t.s1_id join tk b on b.entity_id = t.target_id""")
O["per_s1_scores"] = q(E, EDGES, V, KEYS, EXACT, S1, FALLBACK, PER.format("ow"), select=f"select s1_id, n_true, n_pred, tp, round({F}, 9) as f from ps")
O["source_specific_scores"] = q(ALL, """ws as (select s1_id, target_id, target_source, channel, 1.0::double / (60 + channel_rank) * case when channel like 'exact%' then case when target_source = 'S2' then 2.0 else 1.5 end
  when channel like '%name%' then case when target_source = 'S2' then 1.0 else 0.7 end else case when target_source = 'S2' then 0.5 else 1.0 end end as w from ev)""", select="select s1_id, target_id, target_source, round(sum(w), 9) as fusion_score from ws group by 1, 2, 3")
O["norm_views_strict_ascii"] = f"select * from ({O['norm_views']}) where entity_id in (with {E} select entity_id from e where not regexp_matches(business_name, '[^\\x00-\\x7F]'))"
_BLOCKS = r"""bk as (
  select entity_id, source, country, tie, 'name_prefix' as sample_type, substr(c, 1, 6) as block from cp where length(c) >= 6 union all select entity_id, source, country, tie, 'address_prefix', substr(ac, 1, 8) from cp where length(ac) >= 8
  union all select entity_id, source, country, tie, 'exact_name', n_fold from cp where n_fold <> ''),
fw as (select * from (select *, row_number() over (partition by sample_type, country, block, source = 'S1' order by tie, entity_id) as r from bk) where r <= 8),
nx as (select a.entity_id as s1_id, b.entity_id as target_id, b.source as target_source, a.sample_type, row_number() over (partition by a.sample_type order by sha256(a.entity_id || '|' || b.entity_id), a.entity_id, b.entity_id) as r
  from fw a join fw b on a.sample_type = b.sample_type and a.country = b.country and a.block = b.block where a.source = 'S1' and b.source <> 'S1' and not exists (select 1 from edges t where t.s1_id = a.entity_id and t.target_id = b.entity_id))"""
_compact = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}_]', '', 'g')"
O["prefix_block_negatives"] = q(E, EDGES, V, f"cp as (select *, {_compact.format('n_fold')} as c, {_compact.format('a_fold')} as ac from v)", _BLOCKS, select="select s1_id, target_id, target_source, sample_type from nx where r <= 500")


def _sides(f: str, u: str, d: str, raw: str) -> str:
    """SQL of the features that name and address have in common."""
    ok = f"(not (q.{f}_m or q.{f}_l or t.{f}_m or t.{f}_l))"
    jac = "case when len(list_distinct(list_concat({0}, {1}))) = 0 then 0.0 else len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct(list_concat({0}, {1})))::double end"
    con = "case when len({0}) = 0 then 0.0 else len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct({0}))::double end"
    rat = "case when greatest({0}, {1}) = 0 then 0.0 else least({0}, {1}) / greatest({0}, {1})::double end"
    q_, t_ = f"q.{f}_t", f"t.{f}_t"
    cols = {
        "s1_missing": f"q.{f}_m::int", "target_missing": f"t.{f}_m::int", "s1_null_like": f"q.{f}_l::int", "target_null_like": f"t.{f}_l::int", "raw_exact": f"({ok} and q.{raw} = t.{raw})::int", "normalized_exact": f"({ok} and q.{u} = t.{u})::int", "accent_exact": f"({ok} and q.{d} = t.{d})::int",
        "token_jaccard": f"round({jac.format(q_, t_)}, 9)", "token_containment_s1": f"round({con.format(q_, t_)}, 9)", "token_containment_target": f"round({con.format(t_, q_)}, 9)", "token_count_diff": f"least(abs(len({q_}) - len({t_})), 32767)::int", "token_count_ratio": f"round({rat.format(f'len({q_})', f'len({t_})')}, 9)",
        "char_length_diff": f"least(abs(length(q.{raw}) - length(t.{raw})), 32767)::int", "char_length_ratio": f"round({rat.format(f'length(q.{raw})', f'length(t.{raw})')}, 9)",
    }
    name = "name" if f == "n" else "address"
    return ", ".join(f"{v} as {name}_{k}" for k, v in cols.items())


_ok = {f: f"(not (q.{f}_m or q.{f}_l or t.{f}_m or t.{f}_l))" for f in "na"}
_jac = "round(case when len(list_distinct(list_concat({0}, {1}))) = 0 then 0.0 else len(list_intersect(list_distinct({0}), list_distinct({1}))) / len(list_distinct(list_concat({0}, {1})))::double end, 9)"
O["token_features"] = q(E, V, KEYS, EXACT, rf"""w as (select *, {missing('business_name')} as n_m, {null_like('business_name')} as n_l, {missing('business_address')} as a_m, {null_like('business_address')} as a_l,
  regexp_extract_all(n_fold, '[\p{{L}}\p{{N}}_]+') as n_t, regexp_extract_all(a_fold, '[\p{{L}}\p{{N}}_]+') as a_t, {lowered('business_name')} as n_low, {punct('business_name')} as n_p, regexp_replace(n_fold, '[^\p{{L}}\p{{N}}_]', '', 'g') as n_c,
  case when {missing('business_name')} or {null_like('business_name')} then [] else regexp_extract_all({lowered('business_name')}, '\d+') end as n_d, case when {missing('business_address')} or {null_like('business_address')} then [] else regexp_extract_all({lowered('business_address')}, '\d+') end as a_d from v)""", rf"""x as (select *,
  regexp_replace(regexp_replace(n_p, '{_suffix}', ''), '^[ ,.]+|[ ,.]+$', '', 'g') as n_b, array_to_string(list_transform(n_t, lambda z: z[1]), '') as n_i, case when length(n_fold) < 3 then [] else list_transform(generate_series(1, length(n_fold) - 2), lambda i: substr(n_fold, i::int, 3)) end as n_g,
  case when regexp_matches(regexp_replace(business_address, '\d{{5}}(?:[- ]?\d{{4}})?\s*$', ''), '\p{{L}}') then regexp_extract(business_address, '(^|[^\d])(\d{{5}}(?:[- ]?\d{{4}})?)\s*$', 2) else '' end as a_z from w)""", "pr as (select distinct s1_id, target_id, target_source from exact)", select=f"""
select s1_id, target_id, target_source, {_sides('n', 'n_uni', 'n_fold', 'business_name')}, {_sides('a', 'a_uni', 'a_fold', 'business_address')}, ({_ok['n']} and q.n_low = t.n_low)::int as name_casefold_exact, ({_ok['n']} and q.n_p = t.n_p)::int as name_punctuation_agreement, ({_ok['n']} and q.n_b <> '' and q.n_b = t.n_b)::int as name_legal_suffix_agreement,
  ({_ok['n']} and q.n_i <> '' and q.n_i = t.n_i)::int as name_initials_agreement, ({_ok['n']} and q.n_i <> '' and (q.n_i = t.n_c or t.n_i = q.n_c))::int as name_acronym_agreement, ({_ok['n']} and len(q.n_d) > 0 and q.n_d = t.n_d)::int as name_digit_agreement, {_jac.format('q.n_g', 't.n_g')} as name_char_3gram_jaccard,
  ({_ok['a']} and len(q.a_d) > 0 and q.a_d = t.a_d)::int as address_number_exact, {_jac.format('q.a_d', 't.a_d')} as address_number_overlap, coalesce({_ok['a']} and q.a_d[1] = t.a_d[1], false)::int as address_house_number_agreement, ({_ok['a']} and q.a_z <> '' and q.a_z = t.a_z)::int as address_postal_agreement
  from pr join x q on q.entity_id = s1_id join x t on t.entity_id = target_id""")
