"""Query op10: benchmark windows in all documents."""

from pyspark.sql import functions as F

from questline.llm.common import read
from questline.llm.decontaminate import contamination


def op10_wu_manber(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op10_wu_manber": op10_wu_manber}
ORACLE = {"op10_wu_manber": r"""
with folded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), patterns as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as p
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from patterns where len(w) > 0)
), lengths as (select distinct n from windows
), spots as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as p
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from folded, lengths where len(w) >= n)
), hits as (
  select doc_id, i, spots.n, item_id from spots join windows on spots.n = windows.n and spots.p = windows.p
), per_doc as (
  select doc_id, count(distinct item_id) as n_items,
         array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as names
  from hits group by doc_id
), hit_words as (
  select doc_id, count(distinct k) as n_hit
  from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as k from hits) group by doc_id
)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from folded left join per_doc using (doc_id) left join hit_words using (doc_id)
"""}
