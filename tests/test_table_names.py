"""Table names in statements: expectations written by hand, and the registered query's SQL."""

import time

import pytest
from pyspark.sql import functions as F

from questline.functions.table_names import extract_tables

CASES = [
    ("select * from a join b", ["a", "b"]),
    ("select * from a x left outer join b y on x.i=y.i, c", ["a", "b", "c"]),
    ("select * from `my cat`.`s`.t join \"Q\".u", ["my cat.s.t", "q.u"]),
    ("select * from my-project.ds.tbl-1 t", ["my-project.ds.tbl-1"]),
    ("select trim(both 'x' from y), extract(year from d), substring(s from 2) from t", ["t"]),
    ("select * from t where a is distinct from b", ["t"]),
    ("with t as (select * from t) select * from t", ["t"]),
    ("with recursive r as (select 1 from base union all select * from r) select * from r", ["base"]),
    ("with r as (select * from t), s (i) as (select 1 from r) select * from r join s", ["t"]),
    ("select * from (with x as (select * from y) select * from x) q join x", ["x", "y"]),
    ("select * from (a join b on a.i=b.i) cross join c", ["a", "b", "c"]),
    ("select * from a where i in (select i from b where exists (select 1 from c)) order by x, y", ["a", "b", "c"]),
    ("select * from range(10), unnest(z) u, d", ["d"]),
    ("select 'from x' from y -- from z\n/* join w */ join v", ["v", "y"]),
    ("select * from a union all (select * from b) union select * from c", ["a", "b", "c"]),
    ("select * from t lateral view explode(m) e as k, v join u", ["t", "u"]),
    ("select * from a, lateral (select * from b where b.i = a.i) l", ["a", "b"]),
    ("select * from c..t", ["c..t"]),
    ("select * from a . b . c", ["a.b.c"]),
    ("insert into z select * from a group by x, y having count(*) > 1", ["a"]),
    ("select a, b from t; select c from u", ["t", "u"]),
    ("select case when x in (1, 2) then y else z end from t where k between 1 and 2", ["t"]),
    ("select cast(x as timestamp with time zone) from t", ["t"]),
    ("SELECT O FROM MAIN.ORDERS", ["main.orders"]),("", []),("select 1", []),
    ("from t select a", ["t"]),("select * from a natural join b using (x, y), c", ["a", "b", "c"]),
    ("select * from a tablesample (10 percent) join b", ["a", "b"]),
    ("select * from t pivot (sum(x) for y in ('a', 'b')), u", ["t", "u"]),
    ("select sum(x) over (partition by a order by b) from t window w as (partition by c)", ["t"]),
    ("with a as (select 1), b as (select * from a) insert into x select * from b join c", ["c"]),
    ("select ')' || x from t where y = '(' and z in (select w from v)", ["t", "v"]),
    ("x from "+"(select * from "*300+"deep"+")"*300,["deep"]),
    ("select * from `a`.`b`, `c d` x where x.i = \"from y\"", ["a.b", "c d"]),
    ("select 1 from a /* from b", ["a", "b"]),
    ("delete from t where i in (select i from u)", ["t", "u"]),
    ("select it''s, 'it''s from x' from t", ["t"]),
    ("select 1 fromage from t", ["t"]),
    (None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    return {r["i"]: r["t"] for r in frame.select("i", extract_tables(F.col("s")).alias("t")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found[i] == CASES[i][1], CASES[i][0]


def test_very_long_statements_end(spark):
    numbers = ", ".join(map(str, range(50_000)))
    rows = [(f"select a from t where x in ({numbers})",), ("a." * 50_000,), ("`" * 9_999,), ("/*" + "x*" * 100_000 + "*/ from t",),
            ("from " + "a-" * 50_000,), ("(" * 5_000 + " from t",), ("from t where a = '" + "x" * 1_000_000,)]
    start = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(extract_tables(F.col("s"))).collect()]
    assert got[0] == got[3] == got[6] == ["t"] and got[1] == got[2] == got[5] == [] and time.time() - start < 120
