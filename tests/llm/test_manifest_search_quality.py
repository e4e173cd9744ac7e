"""Operators 11 to 13 against brute force and held-out accuracy, with the awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import compression, lexical, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "Same line\nother\n", "en", "a", 1), (1, "Same line\nother\n", "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no\nid here", "fr", "b", 5), (None, "no\nid here", "fr", "b", 5),
    (4, " \n\t\n ", "fr", "", 3), (5, "word\n" * 30_000, "en", "a", 9), (6, "x" * 60_000, "de", "é", 9), (7, "Ünïcode ÀÉ 日本語 😀", "de", "Z", 1), (8, "same LINE\nunique tail", "en", "b", 1), (-9, "K İ ſ k", None, "b", None),
]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with the names that the operators use inside."""
    names = ["tree", "pos", "range", "digest", "tie", "block", "bucket", "n", "terms", "counts", "item", "rank", "score", "predicted", "held_out", "doc", "label"]
    return spark.createDataFrame(AWKWARD, DOCS).withColumns({n: F.lit(n) for n in names})


# --- 11 manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels_of(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def brothers(levels, at):
    """(left, right) of the node's siblings on every level."""
    out = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for k, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = brothers(trees[s], k) + brothers(top, place)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf(r[0], text, *r[2:])
            for lft, rgt in path:
                node = sha(lft, node, rgt)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(*[p for pair in path for p in pair]), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_plain_trees(spark, levels):
    rng = random.Random(levels)
    rows = [*AWKWARD]
    for k in range(400):
        rows.append((rng.randrange(300), rng.choice(["a\nb", "x", "", None, "lines\n\n"]), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", *[f"s{j}" for j in range(12)], None]), k % 3))
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), levels=levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == plain_manifest(rows)
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_one_none_and_many_sources(spark, empty, clashing):
    assert merkle.manifest(empty).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(5, "alone", "en", "a", 5)], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha() and one.verified
    assert sorted(map(tuple, merkle.manifest(clashing).collect()), key=repr) == plain_manifest(AWKWARD)
    rows = [(k, "t\n", None, f"host{k % 97}", k) for k in range(300)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS), levels=1).collect()), key=repr) == plain_manifest(rows)


# --- 12 ranked search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, top=20):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is not None, doc or 0))
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_search_equals_plain_ranking(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "ſ", "K"]
    text = lambda n: "".join(rng.choice([w, w.upper()]) + rng.choice([" ", ", ", "\x00", "_", "-"]) for w in rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(rng.randrange(400) or None, text(rng.choice([0, 1, 5, 40, 300]))) for _ in range(500)] + [(900 + k, "w3 w4 copy") for k in range(60)] + [(r[0], r[1]) for r in AWKWARD] + [(1, None)]
    items = [(k // 2, text(rng.choice([0, 1, 3, 30]))) for k in range(30)] + [(None, "w1 w1 copy"), (77, None), (78, "nowhere"), (79, "w3 w4 copy")]
    held = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    expected = plain_search(docs, items)
    assert sorted(map(tuple, lexical.search(held, asked).collect()), key=repr) == expected
    monkeypatch.setattr(lexical, "CHUNK_IMPACTS", 50)
    assert sorted(map(tuple, lexical.search(held, asked, block_items=4, block_bytes=200).collect()), key=repr) == expected
    assert sorted(map(tuple, lexical.search(held, asked, top=3).collect()), key=repr) == plain_search(docs, items, 3)


def test_search_without_rows(spark, empty, clashing):
    items = spark.createDataFrame([(1, "same line")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(clashing, items.where("false")).count() == 0
    assert sorted(map(tuple, lexical.search(clashing, items.withColumns({c: F.lit(1) for c in ("item", "doc_id", "n", "score")})).collect()), key=repr) == plain_search([r[:2] for r in AWKWARD], [(1, "same line")])


def test_pieces_and_radix_order():
    text = "".join(f"T{k}{'.' * (k % 4)} " for k in range(3000)) + "é" * 500
    for piece in (1, 7, 100, 1 << 20):
        assert [t.decode() for part in lexical.term_lists(text, piece) for t in part] == terms(text)
    rng = np.random.default_rng(1)
    for keys in (rng.integers(0, 1 << 32, 5000), rng.integers(0, 9, 300), np.empty(0), np.array([5])):
        keys = keys.astype(np.uint32)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()


# --- 13 quality by compression


def area(score, label):
    """The share of (good, bad) pairs that the scores order rightly."""
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad[None, :]).sum() + 0.5 * (good[:, None] == bad[None, :]).sum()) / (len(good) * len(bad))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = compression.classify_quality(some.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    print("area", area(score, label), "accuracy", ((score >= 0.5) == label).mean())
    assert len(rows) > 1000 and area(score, label) > 0.98
    assert (score[label == 1] >= 0.5).mean() > 0.97 and (score[label == 0] < 0.5).mean() > 0.9


def test_quality_of_awkward_rows(spark, empty, clashing):
    good = "The committee will meet again in the spring to discuss what was found. "
    bad = "$$$ BUY!!! NOW!!! | click | here | %%% ### "
    learned = [(1000 + k, (good if k % 2 else bad) * 8 + str(k)) for k in range(300)]
    docs = clashing.select("doc_id", "text").union(spark.createDataFrame(learned, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(t.startswith("The")), 0) for i, t in learned] + [(None, 1, 0), (1001, None, 0), (1002, 7, 0), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    model = compression.learn(docs, labels)
    scores = {r.doc_id: r.score for r in compression.score_texts(docs, model).collect()}
    assert all((scores[i] >= 0.5) == t.startswith("The") for i, t in learned)
    base = 1 / (1 + math.exp(-model.prior))
    assert scores[2] == scores[3] == pytest.approx(base)
    found = compression.classify_quality(clashing, labels)
    assert set(found.columns) == set(clashing.columns) and found.count() == len(AWKWARD)
    # only one label, or none: the base rate
    alone = compression.classify_quality(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(alone) == 1 and alone[0].score > 0.5
    assert compression.classify_quality(docs, labels.where("false")).select("score").distinct().collect() == [(0.5,)]
    assert compression.classify_quality(empty, labels).count() == 0


def test_every_window_counts():
    raw = bytes(range(256)) * 5 + b"tail"
    assert b"".join(compression.windows_of(raw)) == raw and compression.windows_of(b"") == []
    texts = [(k % 2, (f"{'plain words here and there' if k % 2 else '%% || ## &&'} {k} " * 20).encode()) for k in range(80)]
    model = compression.train(texts, (40, 40))
    compressors = model.compressors()
    start, end = compression.difference(b"plain words here " * 200 + b"%% || ## " * 20, compressors), compression.difference(b"plain words here " * 200 + b"%% || ## " * 2000, compressors)
    assert start > 0 > end
