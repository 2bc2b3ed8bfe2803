"""Query op13: near-duplicate vectors of all embeddings."""

from questline.llm.common import read
from questline.llm.product_quantiser import near_vectors


def op13_product_quantiser(spark, d):
    return near_vectors(read(spark, d, "embeddings"))


QUERIES = {"op13_product_quantiser": op13_product_quantiser}
ORACLE = {"op13_product_quantiser": r"""
with recursive able as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.r as a, b.r as b from able a join able b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reached as (
  select r as a, r as b from able
  union select reached.a, links.b from reached join links on reached.b = links.a
), placed as (
  select r.a, min(able.vec_id) as component_id from reached r join able on r.b = able.r group by r.a
), counted as (select a, count(*) as n from links group by a)
select able.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, able.vec_id is not distinct from component_id as kept
from able join placed on able.r = placed.a left join counted on able.r = counted.a
union all
select vec_id, 0, vec_id, true from embeddings
where label is null or embedding is null or len(embedding) = 0
   or len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 or len(list_filter(embedding, lambda x: x <> 0)) = 0
"""}
