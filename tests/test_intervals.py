"""Sweeps, position buckets and cut rewriting against plain Python, on pages of many spans."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import intervals
from veilspan.operators import detect, propagate, spans, tagging
from veilspan.sources.tables import tokens

SPAN = "doc_id bigint, page_index int, ord bigint, label string, text string, norm_text string, confidence double, source string, char_start int, char_end int"


def random_spans(rng, n, width, longest):
    out = []
    for k in range(n):
        a = rng.randrange(width)
        out.append((k % 3, 0, k, rng.choice("AB"), "t", "t", rng.choice([0.5, 0.7, 0.7, 0.95]), rng.choice(["ner", "regex", "user"]), a, a + rng.choice([0, 1, 2, 5, longest])))
    return out


def plain_resolve(rows):
    """The greedy rule as it is worded: every candidate against every kept span."""
    score = lambda s: s[6] * 100 + {"ner": 10.0, "user": 1000.0}.get(s[7], 0.0) + (s[9] - s[8]) * 0.1
    kept = []
    for x in sorted(rows, key=lambda s: (s[8], -score(s), s[2])):
        def hits(y, x=x):
            common = max(0, min(x[9], y[9]) - max(x[8], y[8]))
            return y[9] > x[8] and y[8] < x[9] and common / max(1, min(x[9] - x[8], y[9] - y[8])) > 0.5

        if not any(hits(y) and score(y) >= score(x) for y in kept):
            kept = [y for y in kept if not hits(y)] + [x]
    return kept


@pytest.mark.parametrize(("n", "width", "longest"), [(0, 1, 1), (2, 3, 2), (300, 40, 30), (900, 3000, 700), (2000, 9000, 12)])
def test_resolution_equals_the_plain_rule(spark, n, width, longest):
    rows = random_spans(random.Random(n), n, width, longest)
    found = sorted(map(tuple, spans.resolve(spark.createDataFrame(rows, SPAN)).collect()))
    assert found == sorted(s for d in range(3) for s in plain_resolve([r for r in rows if r[0] == d]))


def test_resolution_of_a_long_chain(spark):
    """Every span overlaps the next one by less than half: all stay, and none waits for those far behind."""
    n = 30_000
    chain = spark.range(n).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").alias("ord"), F.lit("A").alias("label"), F.lit("t").alias("text"), F.lit("t").alias("norm_text"), F.lit(0.5).cast("double").alias("confidence"), F.lit("ner").alias("source"), (F.col("id") * 10).cast("int").alias("char_start"), (F.col("id") * 10 + 14).cast("int").alias("char_end"))
    assert spans.resolve(chain).count() == n


@pytest.mark.parametrize("width", [600, 20_000])
def test_interval_joins_equal_nested_loops(spark, width):
    rng = random.Random(width)
    left, right = random_spans(rng, 250, width, 1500), random_spans(rng, 250, width, 40)
    a, b = spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN)
    meets = lambda x, y: x[0] == y[0] and y[9] > x[8] and y[8] < x[9]
    pairs = sorted((x[2], y[2]) for x in left for y in right if meets(x, y))
    met = spans.tokens_in_spans(a, b.withColumnRenamed("ord", "token_idx"))
    assert sorted((r[0], r[1]) for r in met.select("s.ord", "t.token_idx").collect()) == pairs
    probes = b.select("doc_id", "page_index", F.col("ord").alias("probe_id"), "char_start", "char_end")
    assert sorted((r.span_ord, r.probe_id) for r in spans.overlapping(probes, a).collect()) == pairs
    # positions that repeat are kept as often
    twice = b.select("doc_id", "page_index", "char_start", "char_end").unionAll(b.select("doc_id", "page_index", "char_start", "char_end"))
    hit = [any(meets(x, y) for x in left) for y in right]
    for how, wanted in (("left_semi", True), ("left_anti", False)):
        expected = sorted(2 * [(y[0], 0, y[8], y[9]) for y, h in zip(right, hit, strict=True) if h is wanted])
        assert sorted(map(tuple, spans.covered(twice, a, how).collect())) == expected
    offsets = b.select("doc_id", "page_index", F.col("char_start").alias("offset")).distinct()
    holders = {(y[0], y[8]): min((x[2] for x in left if x[0] == y[0] and x[8] <= y[8] < x[9]), default=None) for y in right}
    assert {(r.doc_id, r.offset): r.ord for r in spans.at_offsets(offsets, a).collect()} == {k: v for k, v in holders.items() if v is not None}
    bounds = a.where("ord % 5 = 0").select("doc_id", "page_index", F.col("ord").alias("owner"), (F.col("char_start") - 40).alias("lo"), F.col("char_end").alias("hi"))
    inside = lambda y: any(x[2] % 5 == 0 and x[0] == y[0] and x[2] != y[2] and y[8] >= x[8] - 40 and y[9] <= x[9] for x in left)
    assert sorted(r.ord for r in spans.absorb_contained(bounds, b).collect()) == sorted(y[2] for y in right if not inside(y))
    tagged = a.withColumn("tag", F.concat(F.lit("T"), F.col("ord").cast("string")))
    first = {y[2]: min((x[2] for x in left if x[0] == y[0] and y[8] >= x[8] and y[9] <= x[9]), default=None) for y in right}
    found = {r.token_idx: r.anonymized_text for r in tagging.annotate_tokens(b.withColumnRenamed("ord", "token_idx"), tagged).collect()}
    assert found == {k: "t" if v is None else f"T{v}" for k, v in first.items()}


def test_a_long_page_is_spread_over_buckets(spark):
    """A page of 200,000 tokens and 20,000 spans: what a join key holds is bounded by the bucket, not by the page."""
    page = spark.range(1).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(0).alias("page_index"), F.repeat(F.lit("abcd "), 200_000).alias("text"))
    t = tokens(page).select("doc_id", "page_index", "token_idx", "char_start", "char_end")
    s = spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").alias("ord"), (F.col("id") * 50).cast("int").alias("char_start"), (F.col("id") * 50 + 12).cast("int").alias("char_end"))
    assert spans.tokens_in_spans(s, t).count() == 3 * 20_000
    most = intervals.in_buckets(t).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most <= intervals.BUCKET // 5 + 2


def test_runs_are_apart_and_whole(spark):
    rng = random.Random(5)
    rows = [[(a := rng.randrange(60), a + rng.randint(1, 9)) for _ in range(n)] for n in (1, 2, 5, 12, 12, 30)]
    df = spark.createDataFrame([(sorted(r),) for r in rows], "items array<struct<a:int,b:int>>")
    for r in df.select("items", intervals.runs(F.col("items"), lambda x: x["a"], lambda x: x["b"]).alias("runs")).collect():
        assert [x for run in r.runs for x in run] == r["items"]
        ends = 0
        for run in r.runs:
            assert run[0].a >= ends
            for x, y in zip(run, run[1:], strict=False):
                ends = max(ends, x.b)
                assert y.a < ends
            ends = max(ends, run[-1].b)


def test_uncovered_places_equal_the_plain_rule(spark):
    rng = random.Random(17)
    taken = [(d, 0, a := rng.randrange(400), a + rng.randint(1, 9)) for d in range(4) for _ in range(20)]
    places = sorted({(d, 0, c := rng.randrange(9), rng.randrange(3), a := rng.randrange(400), a + 3 + c) for d in range(5) for _ in range(90)})
    expected = []
    for d in range(5):
        kept, seen = [], set()
        for p in sorted((p for p in places if p[0] == d), key=lambda p: p[2:]):
            if (p[2], p[4], p[5]) in seen:
                continue
            seen.add((p[2], p[4], p[5]))
            if not any(t[0] == d and t[2] < p[5] and t[3] > p[4] for t in taken) and not any(k[4] < p[5] and k[5] > p[4] for k in kept):
                kept.append(p)
        expected += [(d, 0, p[2], p[4], p[5]) for p in kept]
    found = propagate._uncovered(spark.createDataFrame(places, "doc_id bigint, page_index int, cluster int, variant_no int, char_start int, char_end int"), spark.createDataFrame(taken, "doc_id bigint, page_index int, char_start int, char_end int"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_hits_of_one_place_or_inside_a_longer_one(spark):
    rng = random.Random(23)
    groups = [[]] + [sorted({(rng.randrange(6), k, a := rng.randrange(30), a + rng.randint(1, 12)) for k in range(n)}) for n in (1, 2, 3, 10, 40, 120) for _ in range(4)]
    df = spark.createDataFrame([(g,) for g in groups], "hits array<struct<d:int,i:int,start:int,stop:int>>")
    for r in df.select("hits", detect._kept(F.col("hits"), [3, 5]).alias("kept")).collect():
        same = lambda o, m: (o.start, o.stop) == (m.start, m.stop)
        around = lambda o, m: o.start <= m.start and o.stop >= m.stop and o.stop - o.start > m.stop - m.start
        dropped = [m for m in r.hits if any(o.d < m.d and (same(o, m) or (m.d in (3, 5) and around(o, m))) for o in r.hits) or any(o.d == m.d and o.i < m.i and same(o, m) for o in r.hits)]
        assert r.kept == [m for m in r.hits if m not in dropped]


def test_rewriting_equals_replacing_from_the_end(spark):
    rng = random.Random(4)
    rows = []
    for apart in (True, False):
        for n in (0, 1, 2, 7, 40):
            text = "".join(rng.choice("abc déf") for _ in range(400))
            at, items = 0, []
            for k in range(n):
                a = at + rng.randrange(9) if apart else rng.randrange(390)
                at = a + rng.randrange(1, 4)
                items.append((a, at, f"[T_{k}]"))
            rows.append((text, items))
    df = spark.createDataFrame(rows, "text string, items array<struct<char_start:int,char_end:int,tag:string>>")
    for r in df.select("text", "items", tagging.rewrite(F.col("text"), F.col("items")).alias("out")).collect():
        text = r.text
        for a, b, tag in sorted(map(tuple, r["items"]), reverse=True):
            text = text[:a] + tag + text[b:]
        assert r.out == text
