"""Query op3: quality rules with host verdicts over all documents."""

from questline.llm import quality_rules as rules
from questline.llm.common import read


def op3_host_rules(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    return rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


QUERIES = {"op3_host_rules": op3_host_rules}
ORACLE = {"op3_host_rules": r"""
with words as (
  select doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), spots as (
  select doc_id, unnest(generate_series(1, len(w) - 2)) as i, w from words where len(w) >= 3
), windows as (
  select doc_id, i, row(w[i], w[i + 1], w[i + 2]) as g from spots
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows) where n > 1
), covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id
), lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line from words
), line_counts as (
  select doc_id, sum(n) as n_lines, sum(n - 1) as n_dup_lines from (
    select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line
  ) group by doc_id
), counted as (
  select doc_id, coalesce(source, '') as host, cast(len(w) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines
  from words left join covered using (doc_id) left join line_counts using (doc_id)
), tested as (
  select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
         n_words < 50 or n_repeat_words * 100 > n_words * 50 or n_symbols > n_words * 0.5
         or n_dup_lines > n_lines * 0.5 or word_chars > n_words * 25.0 as failed
  from counted
), hosts as (
  select host, count(*) as n, count(*) filter (failed) as f from tested group by host
), moments as (
  select sum(n) as all_n, count(*) as hosts, avg(1.0 / n) as inverse, sum(f) / sum(n) as mean,
         coalesce(var_samp(f / n), 0.0) as v from hosts
), verdicts as (
  select host, (f + strength * mean) / (n + strength) > 0.5 as host_failed from (
    select host, n, f, mean, case when v - mean * (1 - mean) * inverse > 0
           then greatest(mean * (1 - mean) / (v - mean * (1 - mean) * inverse) - 1, 1.0) else all_n / hosts end as strength
    from hosts cross join moments)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not failed and not host_failed as kept
from tested join verdicts using (host)
"""}
