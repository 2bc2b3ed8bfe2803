"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import functools
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_oracle import compare, connect
from questline.llm import (
    chat, components, decontaminate, lm_scoring, mixing, pseudonyms, quality_classifier, quality_rules, sharding, simhash,
    toxicity,
)
from questline.llm.common import held_out
from questline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, sf, key):
    assert compare(spark, connect(sf), QUERIES[key], ORACLE[key], sf) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


# --- 1 ---------------------------------------------------------------------------------------

LAYOUTS = {
    '{"role": "user", "text": "a"}': [("user", "a")],
    '{"role": "gpt", "text": "a"}': [("gpt", "a")],
    '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}': [("user", "a"), ("assistant", "")],
    '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 3}': [("user", "a"), ("assistant", "b")],
    '{"prompt": "a", "response": "b"}': [("user", "a"), ("assistant", "b")],
    '{"system": "s", "prompt": "a", "completion": "b"}': [("system", "s"), ("user", "a"), ("assistant", "b")],
    '{"instruction": "a", "input": "c", "output": "b"}': [("user", "a\n\nc"), ("assistant", "b")],
    '{"instruction": "a", "input": "", "output": "b"}': [("user", "a"), ("assistant", "b")],
}


def test_layouts_become_turns(spark):
    records = list(LAYOUTS) + ["not json", None, '{"other": 1}', '{"messages": []}', "[1]"]
    rows = spark.createDataFrame(list(enumerate(records)), "n long, record string")
    turns = chat.canonical_turns(rows, "record", ["n"]).orderBy("n", "position").collect()
    got = {n: [(t.role, t.text) for t in group] for n, group in itertools.groupby(turns, lambda t: t.n)}
    assert [got[i] for i in range(len(LAYOUTS))] == list(LAYOUTS.values())
    assert all(got[i] == [(None, None)] for i in range(len(LAYOUTS), len(records)))


def test_formatting_can_be_undone(spark):
    parts = [*chat.CONTROLS, "\\", "<", "[", "\n", "a", "\U0001f600", "|>", ""]
    pick = random.Random(3)
    texts = ["".join(pick.choices(parts, k=12)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t[::-1], t) for i, t in enumerate(texts)], "n long, role string, text string")
    for r in chat.formatted_turns(rows).collect():
        assert chat.read_back(r.piece) == [(r.role, r.text)]
        inside = r.piece[len(chat.OPEN):-len(chat.CLOSE)].split(chat.MIDDLE)
        assert len(inside) == 2 and not any(c in part for c in chat.CONTROLS for part in inside)


def test_chat_digests_with_nulls(spark):
    rows = [(None, 0, "user", "x"), (5, 1, "assistant", None), (5, None, None, "first"), (5, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted_turns(turns), "conv_id", ["turn"]).collect()}
    assert set(got) == {None, 5} and got[5].n_turns == 3 and got[5].loss_chars == 0
    assert got[5].turns_sha256 == hashlib.sha256(b"\nfirst\nassistant\n\nassistant\n\n").hexdigest()
    assert chat.digests(chat.formatted_turns(turns.limit(0)), "conv_id", ["turn"]).count() == 0


# --- 2 ---------------------------------------------------------------------------------------

def test_poisson_inversion(spark):
    means, us = [1e-6, 0.3, 1.0, 7.5, 60.0, 900.0, 4e5], [1e-15, 0.003, 0.2, 0.5, 0.77, 0.999, 1 - 1e-12, 1 - 2.0 ** -53]
    pairs = spark.createDataFrame([(m, u) for m in means for u in us], "m double, u double")
    rows = pairs.select("m", "u", mixing.poisson_table(F.col("m")).alias("t")).select(
        "m", "u", "t", mixing.poisson_inverse(F.col("t"), F.col("m"), F.col("u")).alias("k")).collect()

    def upto(m, k):
        low = max(0, int(m - 40 * math.sqrt(m)))
        return math.fsum(math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(low, k + 1))

    for r in rows:
        assert abs(r.t.upto[-1] - 1) < 1e-9 and len(r.t.upto) == r.t.stride
        for i in (0, len(r.t.upto) // 2):
            assert abs(r.t.upto[i] - upto(r.m, r.t.first + (i + 1) * r.t.stride - 1)) < 1e-9
        assert upto(r.m, r.k) > r.u - 1e-9 and (r.k == 0 or upto(r.m, r.k - 1) < r.u + 1e-9)


def test_huge_means_end_soon(spark):
    t = spark.range(1).select(mixing.poisson_table(F.lit(1e9) + F.col("id")).alias("t")).first().t
    assert len(t.upto) < 2000 and abs(t.upto[-1] - 1) < 1e-6


def test_many_copies_are_made_in_chunks(spark):
    docs = spark.createDataFrame([(1, "0123456789", "rare"), (2, "9876543210", "rare"), *[(i, "0123456789", "x") for i in range(3, 400)]],
                                 "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"rare": 0.5}, total=40_000.0)
    got = mixed.filter("source = 'rare'").groupBy("doc_id", "copies").agg(
        F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.min("copy_no").alias("a"), F.max("copy_no").alias("b")).collect()
    assert len(got) == 2
    assert all(abs(r.copies - 909) < 200 and r.n == r.d == r.b == r.copies and r.a == 1 for r in got)
    more = mixing.mix(docs, {"rare": 0.5}, total=400_000.0).filter("source = 'rare'").groupBy("doc_id", "copies").agg(
        F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("b")).collect()
    assert len(more) == 2 and all(abs(r.copies - 9091) < 600 and r.n == r.d == r.b == r.copies for r in more)


def test_mix_meets_weights(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(docs, {"hot": 0.1, "s1": 0.4}).groupBy("source").count().collect()}
    total = sum(got.values())
    assert abs(total / 40_000 - 1) < 0.03 and abs(got["hot"] / total - 0.1) < 0.01 and abs(got["s1"] / total - 0.4) < 0.02


@pytest.mark.parametrize("names", [("other", "more"), ("src0", "src1"), ("src0", "other")])
def test_mix_keeps_the_size_where_sources_are_missing(spark, names):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 4 == 0, names[0]).otherwise(names[1]).alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    shares = [mixing.WEIGHTS.get(n, 0.0) for n in names]
    left = 1 - sum(mixing.WEIGHTS.values())
    rest = [size if n not in mixing.WEIGHTS else 0 for n, size in zip(names, (1, 3), strict=True)]
    shares = [w + left * r / (sum(rest) or 1) for w, r in zip(shares, rest, strict=True)]
    assert abs(sum(got.values()) / 20_000 - 1) < 0.03
    assert all(abs(got[n] / 20_000 - x / sum(shares)) < 0.03 for n, x in zip(names, shares, strict=True))


def test_rows_without_id_are_drawn_each_for_itself(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    kept = mixing.mix(docs, {}).select("text").distinct().count()
    assert abs(kept / 3000 - (1 - math.exp(-1))) < 0.05


def test_mix_odd_input(spark, odd, nothing):
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mix(odd, {"a": 0.5}, total=1e7)
    assert {r.doc_id for r in mixed.select("doc_id").distinct().collect()} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert mixed.select("copies").dtypes == [("copies", "int")]


# --- 3 ---------------------------------------------------------------------------------------

def test_shrinking_needs_evidence(spark):
    rows = [("good", i % 20 == 0) for i in range(400)] + [("bad", i % 10 != 0) for i in range(400)] + [("tiny", True)]
    rows += [(f"h{i}", i % 9 == j % 9) for i in range(30) for j in range(30)]
    verdict = {r.host: r for r in quality_rules.host_verdicts(
        spark.createDataFrame(rows, "host string, f boolean"), "host", {"any": "f"}).collect()}
    assert verdict["bad"].host_failed and not verdict["good"].host_failed
    assert verdict["tiny"].rate_any < verdict["bad"].rate_any < 0.9


def test_rules_odd_input(odd, nothing):
    assert quality_rules.judge(nothing).count() == 0
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == 10 and all(r.base_failed == (r.doc_id != 4) for r in rows)


# --- 4 and 7 ---------------------------------------------------------------------------------

def test_segments_are_maximal():
    pick = np.random.default_rng(5)
    for _ in range(200):
        s = pick.normal(-0.3, 1, pick.integers(1, 30))
        found = toxicity.segments(s)
        best = max([0.0] + [s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert abs(max((x[2] for x in found), default=0.0) - best) < 1e-9
        covered = sorted(i for a, b, _ in found for i in range(a, b))
        assert len(covered) == len(set(covered)) and set(np.flatnonzero(s > 0)) <= set(covered)


def _held_out(spark, sf, key, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return QUERIES[key](spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", label).collect()


def test_quality_on_held_out(spark):
    rows = _held_out(spark, "/root/testdata/sf0.01", "op7_nbsvm_quality", "quality")
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_toxicity_on_held_out(spark):
    rows = _held_out(spark, "/root/testdata/sf0.01", "op4_toxic_segments", "toxic")
    bad, good = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert sum(a > b for a in bad for b in good) / (len(bad) * len(good)) > 0.8
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 2


def test_repeated_passages_are_all_found(spark):
    """A toxic passage that comes again in a text is reported at each of its places."""
    pick = random.Random(4)
    calm, bad = [f"calm{i}" for i in range(400)], [f"vile{i}" for i in range(12)]
    rows = []
    for i in range(300):
        words = [pick.choice(calm) for _ in range(80)]
        if i % 3 == 0:
            words[20:20] = pick.sample(bad, 9)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    taught = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(taught.drop("toxic"), taught.drop("text"))
    clean = [pick.sample(calm, 150) for _ in range(20)]
    texts = [(i, " ".join([*w[:50], *bad[:9], *w[50:100], *bad[:9], *w[100:]])) for i, w in enumerate(clean)]
    found = toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert all([(p.start, p.end) for p in r.passages] == [(50, 59), (109, 118)] for r in found)


def test_models_odd_input(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for docs, taught in ((odd, labels), (nothing, labels), (odd, labels.limit(0))):
        for scored in (quality_classifier.score(docs, quality_classifier.train(docs, taught)),
                       toxicity.score(docs, toxicity.train(docs, taught))):
            rows = scored.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_fold(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


# --- 5 ---------------------------------------------------------------------------------------

def _linked(fps, distance):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("swept", [2, 24])
def test_classes_of_dense_groups(spark, monkeypatch, swept):
    monkeypatch.setattr(simhash, "SWEPT", swept)
    pick = random.Random(swept)
    fps = {pick.getrandbits(64) for _ in range(200)}
    for centre in list(fps)[:3]:
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, 6))))
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp long").repartition(7)
    got = {r.node: r.component for r in simhash.classes(nodes, 4).collect()}
    want = _linked(fps, 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_fingerprint_components_odd_input(odd, nothing):
    assert simhash.fingerprint_components(nothing).count() == 0
    rows = simhash.fingerprint_components(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fp == 0} == {2} and {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}


def _plain_fingerprint(text):
    """Bit by bit, from the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def _near_texts():
    pick = random.Random(1)
    words = [f"W{i}" for i in range(3000)] + ["Ünï", "\u00a0x", "a\u3000b"]
    rows = []
    for i in range(30):
        text = [pick.choice(words) for _ in range(pick.choice([0, 1, 3, 4, 5, 40, 300, 1500]))]
        for c in range(5):
            copy = list(text)
            for at in pick.sample(range(len(text)), min(len(text) // 100, c)):
                copy[at] = pick.choice(words)
            rows.append((i * 5 + c, pick.choice([" ", "\t", "\n"]).join(copy)))
    return [*rows, (1000, None), (1001, "\x0b \x0c")]


def test_fingerprints_and_groups_from_texts(spark):
    """Fingerprints, classes and the kept documents against brute force over the texts."""
    rows = _near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fps = {i: _plain_fingerprint(t) for i, t in rows}
    root = _linked(set(fps.values()), 4)
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.fingerprint_components(docs).collect()}
    assert got == {i: (f, least[root[f]]) for i, f in fps.items()}
    assert sorted(r.doc_id for r in simhash.one_per_group(docs).collect()) == sorted(least.values())
    assert len(least) < len({t for _, t in rows})


def test_one_per_group_odd_input(spark, odd, nothing):
    assert simhash.one_per_group(nothing).count() == 0
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7]
    same_id = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (None, "p q r s"), (None, None)], "doc_id long, text string")
    assert simhash.one_per_group(same_id).count() == 4


@pytest.mark.parametrize("hot_rows", [components.HOT_ROWS, 100])
def test_components(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    pick = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 400)]
    edges = chain + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (pick.randint(2000, 2005), 2006)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 401)) and all(got[i] == 1000 for i in range(1000, 1300)) and 7 not in got


# --- 6 ---------------------------------------------------------------------------------------

def test_pseudonyms_keep_format_and_turn_back(spark):
    text = ("4041894974608795, 4041-8949-7460-8795 on 2024-02-29, 29.02.2023 31.12.1999 12/31/2001 +1 (988) 555-2485 "
            "10.0.0.256 10.1.2.3 a.b9@x.org 123-45-6789")
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "call 10.1.2.3.")], "doc_id long, text string")
    found = pseudonyms.with_pseudonyms(rows).withColumn("back", pseudonyms.pseudonymise(F.col("text"), undo=True))
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].back == text and got[2].text is None and got[3].text == "" and got[1].n_values == 11
    new = got[1].text
    assert re.sub(r"[0-9]", "9", new).replace(new.split("@")[0].split(" ")[-1], "L")[:17] == "9999999999999999,"
    card, dashed = new.split(" ")[0][:-1], new.split(" ")[1]
    assert card == dashed.replace("-", "") and card != "4041894974608795"
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(card))))
    assert total % 10 == 0 and "29.02.2023" in new and "10.0.0.256" in new
    assert got[4].text[5:-1] in new and "10.1.2.3" not in new.replace("10.0.0.256", "")


def test_pseudonyms_end_on_hard_texts(spark):
    """Long tokens, domains of many labels and many numbers: no stack overflow and no quadratic search."""
    texts = ["a1@x" + ".a" * 20_000, "a" * 1_000_000 + " 1", "a.b+c-" * 100_000 + "1", "1" * 500_000, "1." * 200_000,
             "x" * 80 + "@long.org", " ".join(f"10.{i % 256}.3.4" for i in range(10_000)), "a@b" * 50_000, "12-" * 100_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts))
    start = time.time()
    got = {r.doc_id: r for r in pseudonyms.with_pseudonyms(rows).collect()}
    assert time.time() - start < 240
    assert got[0].n_values >= 1 and got[0].text != texts[0] and len(got[0].text) == len(texts[0])
    assert got[1].text == texts[1] and got[5].n_values == 1 and got[5].text.endswith("@long.org") and got[6].n_values == 10_000


def test_only_validated_numbers_change(spark):
    text = "order 4041894974608796 isbn 9783161484100 card 4041894974608795"
    new = spark.createDataFrame([(text,)], "text string").select(pseudonyms.pseudonymise(F.col("text"))).first()[0]
    assert new.startswith("order 4041894974608796 isbn 9783161484100 card ") and new != text


def test_feistel_is_a_permutation(spark):
    rows = spark.range(189 * 7).select(F.array((F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int")).alias("s"))
    new = rows.select(pseudonyms.feistel(F.col("s"), F.array(F.lit(189), F.lit(7)), F.lit("t"), "k").alias("n")).distinct()
    assert new.count() == 189 * 7


def test_pseudonyms_odd_input(odd, nothing):
    assert pseudonyms.with_pseudonyms(nothing).count() == 0 and pseudonyms.with_pseudonyms(odd).count() == 10


# --- 8 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("dims", [2, 3])
def test_curve_visits_neighbours(dims):
    cells = np.array(list(itertools.product(range(8), repeat=dims)))
    order = np.argsort(sharding.hilbert_index(cells, 3))
    assert sorted(sharding.hilbert_index(cells, 3)) == list(range(8 ** dims))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_shards_are_even_runs(spark, odd, nothing):
    assert sharding.shard(nothing).count() == 0
    for docs, shards in ((odd, 8), (odd, 3), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 8)):
        rows = sharding.shard(docs, shards).collect()
        sizes = Counter(r.shard for r in rows)
        counts = [sizes.get(i, 0) for i in range(shards)]
        assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        ends = sorted((r.shard, r.hilbert) for r in rows)
        assert all(a[1] <= b[1] for a, b in itertools.pairwise(ends))


def test_contents_name_the_shards_to_read(spark, odd, nothing):
    """Filters open just the shards that hold such rows, fewer than the ranges of names let pass."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).select("shard", "source", "lang", F.octet_length("text").alias("bytes")).toPandas()
    sharded = spark.createDataFrame(rows, "shard int, source string, lang string, bytes int")
    held = sharding.contents(sharded, size=F.col("bytes")).cache()
    ranges = rows.groupby("shard").agg(least=("source", "min"), most=("source", "max"))
    opened, passed = 0, 0
    for name in sorted(set(rows.source.dropna())):
        got = {r.shard for r in sharding.shards_for(held, F.col("source") == name).collect()}
        assert got == set(rows.shard[rows.source == name])
        opened += len(got)
        passed += ((ranges.least <= name) & (name <= ranges.most)).sum()
    assert opened < passed
    large = {r.shard for r in sharding.shards_for(held, (F.col("lang") == "de") & (F.col("max_bytes") >= 20_000)).collect()}
    assert large == set(rows.shard[(rows.lang == "de") & (rows.bytes >= 20_000)])
    assert held.agg(F.sum("n_rows")).first()[0] == len(rows)
    assert sharding.contents(sharding.shard(nothing)).count() == 0
    some = sharding.contents(sharding.shard(odd, 2)).collect()
    assert sum(r.n_rows for r in some) == 10 and any(r.source is None and r.min_bytes is None for r in some)


# --- 9 ---------------------------------------------------------------------------------------

def test_lm_odd_input(odd, nothing):
    for docs in (odd, nothing):
        marked = docs.withColumn("is_target", F.lit(True))
        got = lm_scoring.score(marked).collect()
        assert len(got) == docs.count()
        assert all((r.n_words == 0) == (r.difference is None) for r in got)


def test_nothing_is_known_without_target(spark):
    rows = spark.createDataFrame([("a b a", None), ("b a", False)], "text string, is_target boolean")
    assert [r.difference for r in lm_scoring.score(rows).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("hot_bits, vocabulary_bits", [(0, 20), (3, 20), (18, 20), (3, 4)])
def test_losses_leave_each_text_out(spark, monkeypatch, hot_bits, vocabulary_bits):
    """Losses against exact counts of all other texts: one-word texts, copies, hot and rare bigrams, unknown words."""
    monkeypatch.setattr(lm_scoring, "HOT_BITS", hot_bits)
    monkeypatch.setattr(lm_scoring, "VOCABULARY_BITS", vocabulary_bits)
    pick = random.Random(9)
    docs = [(" ".join(f"w{int(pick.paretovariate(0.7))}" for _ in range(pick.randint(1, 60))), i % 3 == 0) for i in range(150)]
    docs += [("only", False), ("Only", True), docs[0], (docs[0][0], False)] + [docs[1]] * 20
    rows = spark.createDataFrame(docs, "text string, is_target boolean").repartition(3)
    got = lm_scoring.score(rows).collect()
    often = Counter(w for text, _ in docs for w in text.lower().split())
    step = {w: math.floor(math.log2(n) * 16) for w, n in often.items()}
    least = min(s for s in step.values() if sum(t >= s for t in step.values()) <= 1 << vocabulary_bits)
    known = {w for w, s in step.items() if s >= least}

    def numbered(text):
        return ["^", *(w if w in known else "?" for w in text.lower().split())]

    @functools.cache
    def want(text):
        w = numbered(text)
        counts = []
        for marked in (True, False):
            own, before, pairs = Counter(), Counter(), Counter()
            for other, target in docs:
                if other != text and (target or not marked):
                    o = numbered(other)
                    own.update(o[1:])
                    before.update(o[:-1])
                    pairs.update(itertools.pairwise(o))
            counts.append((own, before, pairs))
        words = sum(counts[0][0].values())
        out = []
        for own, before, pairs in counts:
            scale = words / sum(own.values())
            chance = {b: (own[b] * scale + lm_scoring.UNIGRAM) / (words + lm_scoring.UNIGRAM * (len(known) + 1)) for b in w}
            out.append(sum(-math.log2((pairs[a, b] * scale + lm_scoring.BACKOFF * chance[b]) / (before[a] * scale + lm_scoring.BACKOFF))
                           for a, b in itertools.pairwise(w)) / (len(w) - 1))
        return out

    assert len(got) == len(docs) and (len(known) == len(often)) == (vocabulary_bits == 20)
    for r in got:
        assert r.n_words == len(r.text.split())
        assert abs(r.target_loss - want(r.text)[0]) < 1e-5 and abs(r.background_loss - want(r.text)[1]) < 1e-5


def test_bigrams_are_sent_packed_by_chunks(spark, monkeypatch):
    """Many chunks and parts score like one chunk, targets named by a table like a column, and no bigram is a row of its own."""
    pick = random.Random(5)
    docs = [(i, " ".join(f"w{int(pick.paretovariate(0.7))}" for _ in range(pick.randint(0, 60))), i % 3 == 0) for i in range(120)]
    docs += [(120, docs[0][1], False), (None, docs[1][1], False), (121, "", True), (122, None, True)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, is_target boolean").repartition(3)
    names = ["text", "n_words", "target_loss", "background_loss", "difference"]
    want = sorted(map(str, lm_scoring.score(rows).select(*names).collect()))
    monkeypatch.setattr(lm_scoring, "HELD", 100)
    monkeypatch.setattr(lm_scoring, "HOT_BITS", 6)
    named = spark.createDataFrame([(r[0],) for r in docs if r[2]] * 2 + [(None,), (999,)], "doc_id long")
    assert sorted(map(str, lm_scoring.score(rows.drop("is_target"), targets=named).select(*names).collect())) == want
    parts = lm_scoring.chunks(lm_scoring.text_classes(rows))
    words = lm_scoring.vocabulary(lm_scoring.count_words(parts).localCheckpoint())
    sent = lm_scoring.counts_elsewhere(parts, words).select("chunk", "part", "n").collect()
    n_chunks, n_parts = parts.count(), len({r.part for r in sent})
    assert n_chunks > 10 and n_parts > 2 and len(sent) <= n_chunks * n_parts < sum(r.n for r in sent)


def test_scores_do_not_tell_who_was_labelled(spark):
    """Good texts score alike whether or not the target has them, and good ones below bad ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic = 0").select("doc_id", "quality").distinct()
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    rows = docs.join(labels, "doc_id", "left").withColumn("is_target", F.coalesce((F.col("quality") == 1) & kept, F.lit(False)))
    got = lm_scoring.score(rows).filter("difference is not null and quality is not null").select(
        "difference", "quality", "is_target").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0].difference.to_numpy()
    seen, unseen = (good[good.is_target == mark].difference.to_numpy() for mark in (True, False))
    noise = math.sqrt(seen.var() / len(seen) + unseen.var() / len(unseen))
    assert abs(seen.mean() - unseen.mean()) < 4 * noise, (seen.mean(), unseen.mean(), noise)
    auc = (unseen[:, None] < bad[None, :]).mean()
    print("seen", seen.mean(), "unseen", unseen.mean(), "bad", bad.mean(), "noise", noise, "auc", auc)
    assert auc > 0.5


# --- 10 --------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_items", [decontaminate.BLOCK_ITEMS, 4, 1])
def test_search_equals_direct_comparison(spark, monkeypatch, block_items):
    pick = random.Random(4)
    words = ["a", "b", "c1", "É"]
    items = [" ".join(pick.choices(words, k=pick.choice([1, 2, 3, 9, 10, 12]))) for _ in range(8)] + [None, "", "a b c1 a b", "a b c1 a b"]
    docs = [" ".join(pick.choices(words, k=pick.randint(0, 80))).upper() for _ in range(60)] + [None, "", None, "A b C1 a b"] * 2
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block_items)
    rows = decontaminate.contamination(
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    for r in rows:
        w = decontaminate.item_words(r.text)
        hit, got = set(), set()
        for i, t in enumerate(items):
            p = decontaminate.item_words(t)
            n = min(len(p), decontaminate.WINDOW)
            for s in range(len(p) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == p[s:s + n]:
                        hit |= set(range(at, at + n))
                        got.add(str(i))
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(got))


@pytest.mark.parametrize("block_items", [decontaminate.BLOCK_ITEMS, 1])
def test_contamination_odd_input(spark, odd, nothing, monkeypatch, block_items):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block_items)
    items = spark.createDataFrame([(1, "four five SIX"), (1, "four five SIX"), (None, None), (2, "")], "item_id long, text string")
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontaminate.drop_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == 7


# --- pipeline --------------------------------------------------------------------------------

def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline
    from questline.session import cut_lineage

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in pipeline.STAGES:
        seen[name] = docs = cut_lineage(stage(spark, docs, sf))
        if name != "shard":
            assert docs.columns == seen["documents"].columns
    got = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    texts = {r.doc_id: r.text for r in seen["documents"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(i, 1) == 0 for i in got["quality"]) <= 2
    assert sum(i in got["quality"] for i, q in labels.items() if q == 1) / sum(labels.values()) > 0.97
    fps = {i: _plain_fingerprint(texts[i]) for i in got["quality"]}
    root, least = _linked(set(fps.values()), 4), {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert sorted(got["near_dedup"]) == sorted(least.values())
    items = [decontaminate.item_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)}

    def leaks(text):
        w = decontaminate.item_words(text)
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))

    assert sorted(got["decontaminate"]) == sorted(i for i in got["near_dedup"] if not leaks(texts[i]))
    assert set(got["mix"]) <= set(got["decontaminate"]) and sorted(got["shard"]) == sorted(got["mix"])
    assert pipeline.run(spark, sf).count() == len(got["shard"])


def test_pipeline_on_empty_table(spark, nothing, sf):
    import corpus_pipeline as pipeline

    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
    assert json.dumps([n for n, _ in pipeline.STAGES]) == '["quality", "near_dedup", "decontaminate", "mix", "shard"]'


def test_toxicity_reads_texts_for_segments_once(spark, monkeypatch):
    """Calibration and scores come from one written table of segments, and equal those of training and scoring apart."""
    docs = spark.createDataFrame([(i, "clean words of text " * (1 + i % 4) + ("vile !! " * 5 if i % 3 == 0 else "")) for i in range(60)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    apart = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "n_words", "score", "passages").orderBy("doc_id").collect()
    calls, find = [], toxicity.best_segments
    monkeypatch.setattr(toxicity, "best_segments", lambda *args: calls.append(1) or find(*args))
    whole = toxicity.train_and_score(docs, labels)
    got = whole.select("doc_id", "n_words", "score", "passages").orderBy("doc_id").collect()
    assert len(calls) == 1 and "text" not in whole.columns
    assert [(r[0], r[1], len(r[3])) for r in got] == [(r[0], r[1], len(r[3])) for r in apart]
    assert all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(got, apart, strict=True))
