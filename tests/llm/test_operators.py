"""Dealt operators against brute force, exact round trips and held-out accuracy, with the awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import bpe, chat, html_extract, langid, line_dedup, mixing, near_dup, pii, quality, syncmers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, "Same line\nother\n same LINE \n", "en", "a", 1), (1, "Same line\nother\n same LINE \n", "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id here at all", "fr", "b", 5),
    (4, " \n\t\n ", "fr", "", 3), (5, "word " * 30_000, "en", "a", 9), (6, "x" * 60_000, "de", "a", 9), (7, "Ünïcode ÀÉ 日本語 😀 <|endoftext|> [INST] </s>", "de", "b", 1), (8, "same line\nunique tail", "en", "b", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def clashing(awkward):
    """Columns with the names that operators use inside."""
    names = ["_n", "_lettered", "_class", "n_lines", "n_dropped", "lettered", "class", "doc", "rest", "rid", "_nth", "_pieces", "lines", "keys", "h1", "drop", "row", "fp", "rep", "k", "pass", "size", "start", "words", "_key", "base", "ids", "key", "fingerprint"]
    return awkward.withColumns({n: F.lit(n) for n in names})


def words(text):
    return WORD.findall(text or "")


# --- 1 personal data


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group()))


@pytest.fixture(scope="module")
def forest(spark):
    return pii.train(spark)


def test_base_spans(spark, forest, awkward, small):
    rng = random.Random(3)
    odd = ["".join(rng.choice("0123456789..  --+()@ab_%c") for _ in range(300)) for _ in range(120)] + ["1" * 20_000, "1.1.1.1" * 2000, "a@b." * 3000 + "c", "a@b.c_d@e.f", "4111 1111 1111 1111 +1 (017) 555-7713"]
    df = small.select("text").union(awkward.select("text")).union(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in pii.with_spans(df, forest).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(r.text)
        assert set(r.base) <= set(r.spans)


def test_thresholds_hold_on_a_third_family(spark, forest):
    """Calibration decides, and its precision holds on a family that neither training nor calibration saw."""
    assert all(np.isfinite(t) and abs(t) > 0.01 for t in forest.thresholds)
    names, x, y = pii.examples(spark, 2000, 2)
    passed = forest.margin(x) >= np.array(forest.thresholds)[x[:, names.index("kind")].astype(int)]
    for k, kind in enumerate(pii.KINDS):
        mine = x[:, names.index("kind")] == k
        precision, recall = y[mine & passed].mean(), passed[mine & (y > 0)].mean()
        print(kind, "precision", round(precision, 3), "recall", round(recall, 3), "threshold", round(forest.thresholds[k], 2))
        assert precision >= 0.95 and recall >= 0.8


def test_added_spans_find_the_worded_ones(spark, forest):
    unseen = spark.createDataFrame(pii.worded_examples(600, 2, seed=99), "text string, truth int, begin int, stop int")
    hits, wrong, positive = 0, 0, 0
    for r in pii.with_spans(unseen, forest).collect():
        added = [s for s in r.spans if s not in r.base]
        positive += r.truth >= 0
        hits += any(s.kind == r.truth and s.start < r.stop and s.end > r.begin for s in r.spans)
        wrong += r.truth < 0 and bool(added)
    assert hits >= 0.85 * positive and wrong <= 0.05 * (600 - positive)


def test_choice_is_greedy_without_chain_loss(spark):
    rng = random.Random(8)
    groups = [[(0, 0, 10, 3.0), (5, 1, 15, 2.0), (12, 2, 20, 1.0)]]
    for _ in range(300):
        groups.append([(a := rng.randrange(60), rng.randrange(4), a + rng.randint(1, 12), float(rng.randrange(5))) for _ in range(rng.randrange(12))])
    base = [sorted((a := rng.randrange(60), k, a + rng.randint(1, 9)) for k in range(rng.randrange(4))) for _ in groups]
    df = spark.createDataFrame(list(zip(groups, base, strict=True)), "c array<struct<start:int,kind:int,end:int,score:double>>, base array<struct<start:int,kind:int,end:int>>")
    for r in df.select("c", "base", pii._chosen(F.col("c")).alias("chosen"), pii._apart(F.col("c"), F.col("base")).alias("apart")).collect():
        kept = []
        for c in sorted(r.c, key=lambda c: (-c.score, c.start, c.kind, c.end)):
            if not any(o.start < c.end and c.start < o.end for o in kept):
                kept.append(c)
        assert sorted((k.start, k.end, k.score) for k in kept) == sorted((k.start, k.end, k.score) for k in r.chosen)
        assert r.apart == [c for c in r.c if not any(o.start < c.end and c.start < o.end for o in r.base)]


def test_many_matches_take_little_time(spark, forest):
    """Four times the matches take about four times as long: no step looks at all matches for each."""
    import time

    text = lambda n: " ".join(f"a{k}@b.example or call 0{k % 9 + 1} 12 34 56 78," for k in range(n))

    def run(n):
        df = spark.createDataFrame([("short",)], "text string").unionByName(spark.createDataFrame([(text(n),)], "text string"))
        began = time.perf_counter()
        rows = pii.with_spans(df, forest).select("base", "spans").collect()
        took = time.perf_counter() - began
        assert max(len(r.base) for r in rows) == n and max(len(r.spans) for r in rows) == 2 * n
        return took

    run(5_000)  # starts the code paths
    few, many = min(run(5_000) for _ in range(2)), run(20_000)
    assert many < 8 * few, (few, many)


def test_spans_keep_all_columns(clashing, forest, empty):
    got = pii.with_spans(clashing.withColumn("_found", F.lit("f")).withColumn("passed", F.lit("p")), forest)
    assert all(r._found == "f" and r.passed == "p" and r.k == "k" and isinstance(r.base, list) for r in got.collect())
    assert pii.with_spans(empty, forest).count() == 0


def test_plain_prose_gets_no_spans(forest, small):
    got = pii.with_spans(small.where(~F.col("text").rlike("[0-9]")), forest)
    assert got.where(F.size("spans") > 0).count() == 0


def test_redaction(spark, forest):
    df = spark.createDataFrame([(1, "mail a@b.com or 10.0.0.1!"), (2, None), (3, "none"), (4, "x +1 415 555 013 10.0.0.1 y")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df, forest).collect()} == {1: "mail [EMAIL] or [IP]!", 2: None, 3: "none", 4: "x [PHONE] y"}


# --- 2 language


def test_held_out_accuracy(spark):
    rows = langid.op2_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_of_awkward_texts(awkward, empty, clashing):
    got = langid.identify(clashing).collect()
    assert len(got) == len(AWKWARD) and all(r.lang_pred == "und" and r.score == 0 for r in got if not re.search(r"[^\W\d_]", r.text or ""))
    assert langid.identify(empty).count() == 0


def test_tables_equal_a_plain_convolution(small):
    """Pooled responses through byte-pair tables against the convolution written out."""
    rows = [r for r in small.where("text is not null and lang is not null").limit(30).collect()]
    net = langid.train([r.text[:400] for r in rows], [r.lang for r in rows])
    windows = np.concatenate([langid.windows_of(r.text[:600]) for r in rows[:6]])
    x = net.embedding[windows]
    plain = []
    places = langid.WINDOW - max(langid.WIDTHS) + 1
    for w in net.filters:
        responses = np.stack([np.einsum("nwe,wef->nf", x[:, at : at + len(w)], w) for at in range(places)], axis=1)
        plain.append(responses.max(axis=1))
    assert np.allclose(np.maximum(np.concatenate(plain, axis=1) + net.bias, 0), net.pooled(windows, net.tables()), atol=1e-3)


def test_every_labelled_language_is_learned(spark):
    """Hundreds of labels: none is left out of the sample."""
    df = spark.createDataFrame([(k, f"text of language number {k % 700}", f"l{k % 700}") for k in range(2800)], "doc_id long, text string, lang string")
    texts, labels = langid.training_sample(df)
    learnable = {r.lang for r in df.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(labels) == learnable and len(texts) <= langid.SAMPLE_TOTAL


def test_prediction_reads_only_the_text(small):
    other = small.withColumn("doc_id", F.col("doc_id") + 0).withColumn("source", F.lit("z"))
    net = langid.train(["the cat and the dog " * 20] * 20 + ["der hund und die katze " * 20] * 20, ["en"] * 20 + ["de"] * 20)
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(df, net).collect())
    assert key(small) == key(other.withColumn("lang", F.lit("xx")))


# --- 3 lines


def drop_lines(texts, min_docs, min_chars):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    return ["\n".join(x for x in lines if n[key(x)] < min_docs) for lines in split]


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
@pytest.mark.parametrize("shard_keys", [1_000_000, 3])
def test_line_dedup(small, awkward, broadcast, shard_keys):
    for df, min_docs, min_chars in ((small, 4, 1), (awkward, 2, 3)):
        rows = df.collect()
        got = line_dedup.drop_shared_lines(df, min_docs, min_chars, broadcast_bytes=broadcast, shard_keys=shard_keys).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(zip([r.doc_id for r in rows], drop_lines([r.text for r in rows], min_docs, min_chars), strict=True))


def test_large_index_moves_only_texts_with_hits(spark):
    """The dealt way on copies, ties and a hot line: the same rows as the broadcast way, and no text is stored or moved without a hit."""
    rng = random.Random(2)
    shared = ["".join(rng.choices("abcdefgh ", k=rng.randint(5, 30))) for _ in range(300)]
    rows = [(k, "\n".join(rng.choice(shared) if rng.random() < 0.7 else f"own {k} {j}" for j in range(rng.randint(1, 12)))) for k in range(600)]
    rows += [(1000 + k, "hot line\nrest of a copy") for k in range(400)] + [(2000 + k, f"alone {k}") for k in range(200)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"content": F.lit("c"), "hits": F.lit("h"), "m": F.lit(1), "_a": F.lit(2)})
    one = line_dedup.drop_shared_lines(df, 10)
    other = line_dedup.drop_shared_lines(df, 10, shard_keys=40, broadcast_bytes=0)
    assert one.columns == other.columns and Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))
    assert sum(r.n_dropped for r in one.collect()) > 800


def test_line_dedup_keeps_columns(clashing, empty):
    assert line_dedup.drop_shared_lines(clashing.drop("lines")).columns == [*[c for c in clashing.columns if c not in ("text", "lines")], "text", "n_lines", "n_dropped"]
    assert line_dedup.drop_shared_lines(clashing).where("lines = 'lines' and h1 = 'h1'").count() == len(AWKWARD)
    assert line_dedup.drop_shared_lines(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(-(1 << 62), 1 << 62, n)
    displacement, slot = line_dedup.build_perfect_hash(h1, h2)
    assert sorted(slot.tolist()) == list(range(n))
    shard = {"displacement": displacement, "fingerprint": np.empty(n, np.int64), "doc_count": np.empty(n, np.int64)}
    shard["fingerprint"][slot], shard["doc_count"][slot] = h2, np.arange(n) + 1
    assert (line_dedup.probe_perfect_hash(h1, h2, shard) == np.arange(n) + 1).all()
    assert (line_dedup.probe_perfect_hash(rng.integers(0, 1 << 62, 500), rng.integers(0, 1 << 62, 500), shard) == 0).all()


# --- 4 pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><main><article><h1>A &amp; B</h1><p>One  <b>two</b>
three<p>Four<script>var x = "</p>";</script></article><section class="comments"><p>Nice!</p></section></main>
<aside>Related</aside><form><p>Subscribe</p></form><footer>&copy; Site</footer></body></html>"""


def test_page_blocks():
    assert [b.text for b in html_extract.blocks_of(PAGE) if b.prior >= 0] == ["A & B", "One two three", "Four"]
    assert [b.text for b in html_extract.blocks_of("a < b & c<br>d<!-- x")] == ["a < b & c d"]
    assert html_extract.blocks_of("") == [] and html_extract.blocks_of("<script>x") == []


def test_entropy_removes_repeated_branches(spark):
    """No element says what it is: the tree alone tells the banner from the text."""
    page = "<body><div><p>Welcome to our wonderful site</p></div><div><p>Story number {0} with its own words {0}</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(12)] + [(90, None, None), (91, "http://h.example/0", ""), (92, "x", "<p>Only page</p>")]
    rows.append(rows[0])
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(texts[k] == f"Story number {k} with its own words {k}" for k in range(12))
    assert texts[90] == "" and texts[91] == "" and texts[92] == "Only page" and all(r.n_chars == len(r.text) for r in got)


def article_of(html):
    import html as entities

    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    blocks = re.sub("<[^>]*>", " ", re.sub("</?(?:p|h1)>", "\n", inner)).split("\n")
    return "\n".join(t for t in (" ".join(entities.unescape(b).split()) for b in blocks) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_articles_of_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html")
    assert all(r.text == article_of(r.html) for r in html_extract.op4_html(spark, f"/root/testdata/{sf}").join(pages, "page_id").collect())


def keyed_pages(pages):
    html, host = F.coalesce("html", F.lit("")), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.xxhash64(host, html).alias("key"), host.alias("host"), html.alias("html"))


def test_importance_decides_without_names(spark):
    """On tables of some size the tree alone, without what elements are called, parts articles from the rest."""
    tree = html_extract.parsed(keyed_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    nodes, _ = html_extract.importances(tree, names=False)
    rows = html_extract.block_rows(tree).join(nodes, "node").select("prior", "importance").collect()
    assert np.mean([(r.importance >= html_extract.KEEP) == (r.prior == 1) for r in rows]) > 0.98


def nonsense_site(rng, host, n):
    """Pages whose classes say nothing: menu, notice inside the article, changing advert, sign-off; and what should stay."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    name = {k: word() for k in "menu body ad end note".split()}
    sentence = lambda k: " ".join(word() for _ in range(k))
    menu, note, end, adverts = [word() for _ in range(6)], sentence(9), sentence(12), [sentence(7) for _ in range(2)]
    for k in range(n):
        own = [sentence(rng.randint(5, 60)) for _ in range(rng.randint(2, 6))]
        html = f"<body><div class='{name['menu']}'>" + "".join(f"<div><a href='/{m}'>{m}</a></div>" for m in menu) + f"</div><div class='{name['ad']}'>{adverts[k % 2]}</div><div class='{name['body']}'>"
        html += f"<p>{own[0]}</p><p>{note}</p>" + "".join(f"<p>{t}</p>" for t in own[1:]) + f"</div><div class='{name['end']}'>{end}</div></body>"
        yield f"https://{host}/{k}", html, "\n".join(own)


@pytest.mark.parametrize("small_tree", [0, 1 << 20])
def test_nonsense_classes(spark, small_tree):
    rng = random.Random(3)
    rows = [r for h, n in (("a.example", 5), ("b.example", 8), ("c.example", 20), ("d.example", 40)) for r in nonsense_site(rng, h, n)]
    pages = spark.createDataFrame([(k, url, html, "x") for k, (url, html, _) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = html_extract.extract_main_text(pages, small_tree=small_tree).collect()
    assert all(r.text == rows[r.page_id][2] and r.n_chars == len(r.text) and r.html == rows[r.page_id][1] and r.host == "x" for r in got) and len(got) == len(rows)


def brute_importances(pages):
    """A plain version of the tree: {(host, path): importance} of (host, html)."""
    import math

    seen, shown, styles, priors, key_of = set(), defaultdict(set), defaultdict(Counter), defaultdict(list), {}
    for k, (host, page) in enumerate(pages):
        blocks, branches = html_extract.parse(page, host)
        if (host, tuple(b.text for b in blocks)) in seen:
            continue
        seen.add((host, tuple(b.text for b in blocks)))
        for b in blocks:
            for own, up in (((host, b.path), (host, b.up_path)), ((b.path,), (b.up_path,)), ((b.tags, "t"), (b.up_tags, "t"))):
                shown[own, b.content].add(k)
                shown[own, None].add(k)
            key_of[host, b.path] = b
            priors[b.path].append(b.prior)
        for path, tags, style in branches:
            for own in ((host, path), (path,), (tags, "t")):
                styles[own][style] += 1

    def raw(own, up):
        pages_of = len(shown[own, None])
        logs = [math.log(len(v)) for (o, c), v in shown.items() if o == own and c is not None]
        content = max(0, 1 - np.mean(logs) / math.log(pages_of)) if pages_of > 1 else 1
        k = list(styles[up].values())
        t = sum(k)
        branch = 1 - sum(x * math.log(x) for x in k) / (t * math.log(t)) if t > 1 else 0
        return pages_of, html_extract.CONTENT_SHARE * content + (1 - html_extract.CONTENT_SHARE) * branch

    out = {}
    for (host, path), b in key_of.items():
        own = priors[path]
        named = np.mean(np.abs(own)) * html_extract.NAMED_PAGES
        told = (np.mean(own) / np.mean(np.abs(own)) + 1) / 2 if named else 0
        m3, r3 = raw((b.tags, "t"), (b.up_tags, "t"))
        m2, r2 = raw((path,), (b.up_path,))
        m1, r1 = raw((host, path), (host, b.up_path))
        bare = (m3 * r3 + html_extract.UNSEEN_PAGES * html_extract.UNSEEN_IMPORTANCE) / (m3 + html_extract.UNSEEN_PAGES)
        wide = (m2 * r2 + html_extract.PATH_PAGES * bare + named * told) / (m2 + html_extract.PATH_PAGES + named)
        out[host, path] = (m1 * r1 + html_extract.HOST_PAGES * wide) / (m1 + html_extract.HOST_PAGES)
    return out


def test_importances_equal_a_plain_tree(spark):
    pages = keyed_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    want = brute_importances([(r.host, r.html) for r in pages.collect()])
    got = {r.node: r.importance for r in html_extract.importances(html_extract.parsed(pages))[0].collect()}
    assert len(got) == len(want) and all(got[html_extract._node(h, p)] == pytest.approx(v) for (h, p), v in want.items())


def test_hosts_of_copies_keep_their_text(spark):
    """Equal pages count once; a host of near copies falls back to the elements that are not low."""
    text = "<body><article><p>The same story on each page of it</p><p>told in two paragraphs</p></article></body>"
    rows = [(k, "http://copies.example/", text) for k in range(30)] + [(100 + k, "http://near.example/", text.replace("</body>", f"<footer>{k}</footer></body>")) for k in range(30)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 60 and {r.text for r in got} == {"The same story on each page of it\ntold in two paragraphs"}


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "x<hr>" * 50_000, "<a href='" * 50_000 + ">", "<p>word " * 100_000, "<!-- " * 100_000])
def test_parsing_is_linear(page):
    import time

    began = time.perf_counter()
    html_extract.blocks_of(page)
    assert time.perf_counter() - began < 8


# --- 5 near duplicates


def simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(small, awkward):
    for df in (small, awkward.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(df.collect(), key=lambda r: r.doc_id)
        prints = [simhash(r.text) for r in rows]
        roots = components(prints, 2)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dup.near_duplicates(df).collect()}
        assert got == {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, roots, strict=True)}


@pytest.mark.parametrize("tile_rows", [1 << 17, 20])
def test_tiles_lose_no_link(spark, tile_rows):
    """Chains and clumps of fingerprints, in whole and in split tiles."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(120)}
    for v in list(values)[:60]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    classes = spark.createDataFrame([(near_dup._signed(v), k) for k, v in enumerate(values)], "fp long, rep long")
    found = {r.node: r.component for r in near_dup.connected_components(near_dup.tile_links(classes, 2, tile_rows)).collect()}
    assert [found.get(k, k) for k in range(len(values))] == components(values, 2)


def test_a_text_without_an_id_still_links(spark):
    """A-N and N-B lie within the radius and A-B doesn't; N's only row has no id."""
    rng = random.Random(77)
    base = [f"w{rng.randrange(5000)}" for _ in range(800)]
    texts = {}
    for _ in range(150):
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(800)] = f"n{rng.randrange(99)}"
        texts.setdefault(near_dup.simhash(" ".join(edited)), " ".join(edited))
    near = lambda x, y: x != y and (x ^ y).bit_count() <= 2
    n, a, b = next((n, a, b) for n in texts for a in texts for b in texts if near(a, n) and near(n, b) and a != b and not near(a, b))
    for middle in (2, None):
        rows = [(1, texts[a]), (middle, texts[n]), (3, texts[b])]
        found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r.component_id for r in found] == [1, 1, 1]
    alone = near_dup.near_duplicates(spark.createDataFrame([(None, "only here"), (None, "only here")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_a_hub_and_a_large_bucket(spark, monkeypatch):
    """A node with most edges, and a pivot that most pairs need, are dealt to several tasks with the same result."""
    from veilspan.llm import common

    star = spark.createDataFrame([(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(50)], "a long, b long")
    whole = sorted(map(tuple, near_dup.connected_components(star).collect()))
    assert whole == sorted([(k, 0) for k in range(400)] + [(1000 + k, 1000) for k in range(51)])
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([rng.choice("xyz") if rng.random() < 0.002 * (k % 5) else w for w in base])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = sorted(r.doc_id for r in near_dup.keep_representatives(docs).collect())
    for name in ("HOT_SHARE", "HUB_EDGES", "HUB_PAIRS"):
        monkeypatch.setattr(near_dup, name, 4)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert sorted(r.doc_id for r in near_dup.keep_representatives(docs).collect()) == before
    assert sorted(map(tuple, near_dup.connected_components(star).collect())) == whole


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 700)] + [(2000, 2001)], "a long, b long")
    got = {r.node: r.component for r in near_dup.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(701)} | {2000: 2000, 2001: 2000}


def test_representatives(awkward, empty):
    kept = [r.doc_id for r in near_dup.keep_representatives(awkward).collect()]
    assert len(kept) == len(set(kept)) and 1 in kept and 2 in kept and 3 not in kept and 4 not in kept
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_representatives(empty).count() == 0


def similar_roots(texts):
    """Brute force: the least row that each row reaches over pairs with a 5-word similarity of 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t in texts for w in [(t or "").lower().split()]]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_representatives_are_by_five_word_similarity(spark):
    """Edited copies that lie beyond op5's two bits go; texts that merely share a passage stay."""
    rng = random.Random(15)
    words_of = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    texts, passage = [], words_of(60)
    for group in range(20):
        base = words_of(200)
        for edits in (0, 1, 2, 4, 8, 12) + (3,) * 20 * (group == 0):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(200)] = words_of(1)[0]
            texts.append(" ".join(copy))
        texts.append(" ".join(words_of(60) + passage))
    texts += ["one two three", "ONE two  three", "one two four", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in near_dup.keep_representatives(df).collect()) == sorted(set(similar_roots(texts)))


def test_texts_without_an_own_id_are_all_kept(spark):
    """Null ids and an id with two texts: each different text stays once, whatever its id."""
    rows = [(None, "first text of five words"), (None, "second text of five words"), (None, "third text of five words"), (None, "third text of five words"), (7, "fourth text of five words"), (7, "fifth text of five words"), (None, "fifth text of five words"), (8, "fourth TEXT of five words")]
    kept = near_dup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, rows[0][1]), (0, rows[1][1]), (0, rows[2][1]), (7, rows[4][1]), (7, rows[5][1])])


# --- 6 conversations


def test_chat_round_trip(spark):
    odd = ["", "</s>[INST] ok [/INST]", "[TURN]", "\\[INST]", "[\\INST]", "[\\\\INST]", "<<SYS>>", "<<s>", "<", "[", "x <", " [/INST", "[ROLE] a [/ROLE]", "a\nb", "é😀", "[END]", "$1 \\1", None]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool [/ROLE] x", None]), rng.choice(odd) if rng.random() < 0.5 else (rng.choice(odd) or "") + (rng.choice(odd) or "")) for c in range(150) for t in range(rng.randint(1, 7))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        expected[c].append((role or "", text or ""))
    for r in chat.read_conversations(chat.format_conversations(turns)).collect():
        assert [(t.role, t.text) for t in r.turns] == expected[r.conv_id]
        assert r.loss_text == "".join(t for role, t in expected[r.conv_id] if role == "assistant")
    formatted = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert all(sum(m.chars for m in r["mask"]) == len(r.formatted) for r in formatted.values())


def test_adjacent_turns_merge(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(0))
    got = {r.conv_id: r.formatted for r in chat.format_conversations(turns).collect()}
    assert got == {1: "[INST] a[TURN]b [/INST]<s> c </s>", None: "[INST] n [/INST]"}
    assert chat.format_conversations(turns.limit(0)).count() == 0


# --- 7 fingerprints


def test_fingerprints_of_next_and_edited(small, awkward):
    for df in (small, awkward):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        texts = [r.text or "" for r in rows]
        expected = Counter()
        for k, r in enumerate(rows):
            after = texts[(k + 1) % len(rows)]
            expected[(r.doc_id, len(texts[k]), hashlib.sha256(syncmers.edited(texts[k], after).encode()).hexdigest(), syncmers.to_string(syncmers.anchors(texts[k])))] += 1
        got = syncmers.compare_with_next(df, range_rows=7).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got) == expected
        assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
        long = [r for r in got if r.n_chars > 400 and r.doc_id not in (5, 6)]
        assert not long or np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def plain_syncmers(text):
    """Closed syncmers by their definition, one k-mer at a time: {hash: first place}."""
    mask = (1 << 64) - 1

    def inner(codes):
        h = 0
        for c in codes:
            h = ((h ^ c) * 0x9FB21C651E98DF25) & mask
            h ^= h >> 29
        h = (h * 0xD6E8FEB86659FD93) & mask
        return h ^ (h >> 32)

    codes, out = [ord(c) for c in text], {}
    if len(codes) < syncmers.K:
        return {inner(codes) >> 32: 0} if codes else {}
    for i in range(len(codes) - syncmers.K + 1):
        hashes = [inner(codes[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            h = 0
            for k in range(0, syncmers.K - syncmers.S + 1, syncmers.S // 2):
                h = ((h ^ hashes[k]) * 0xA24BAED4963EE407) & mask
                h ^= h >> 31
            h = ((h ^ hashes[-1]) * 0x9FB21C651E98DF25) & mask
            out.setdefault(h >> 32, i)
    return out


def test_anchors_equal_plain_syncmers(small):
    rng = random.Random(4)
    texts = [r.text or "" for r in small.limit(25).collect()] + ["", "a", "short text", "x" * 40, "é😀" * 30, "".join(rng.choice("ab ") for _ in range(500))]
    for text in texts:
        plain = plain_syncmers(text[:6000])
        hashes, places = syncmers.syncmers(text[:6000])
        assert dict(zip(hashes.tolist(), places.tolist(), strict=True)) == plain
        f = syncmers.anchors(text[:6000])
        again = syncmers.from_string(syncmers.to_string(f))
        assert set(f.hashes.tolist()) == set(plain) and dict(zip(again.hashes.tolist(), again.places.tolist(), strict=True)) == plain


def plain_likeness(a, b):
    """Shared anchors on diagonals that hold several (or the best one), of all anchors of both, by definition."""
    a, b = plain_syncmers(a), plain_syncmers(b)
    shifts, diagonals = sorted(a[h] - b[h] for h in a.keys() & b.keys()), []
    for x in shifts:
        if diagonals and x - diagonals[-1][-1] <= syncmers.DRIFT:
            diagonals[-1].append(x)
        else:
            diagonals.append([x])
    sizes = [len(d) for d in diagonals]
    return max(sum(n for n in sizes if n > 1), max(sizes, default=0)) / len(a.keys() | b.keys()) if a and b else float(len(a) == len(b))


def test_likeness_equals_the_definition(spark):
    """Over edits of all sizes, insertions included; and text that is added never takes an anchor away."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    for n in (5, 100, 1000):
        base = [word() for _ in range(n)]
        for share in (0.0, 0.02, 0.3, 1.0):
            other = [word() if rng.random() < share else w for w in base]
            other[n // 2 : n // 2] = [word() for _ in range(n // 10)]
            a, b = " ".join(base), " ".join(other)
            assert syncmers.likeness(syncmers.anchors(a), syncmers.anchors(b)) == plain_likeness(a, b)
        longer = syncmers.anchors(" ".join([word() for _ in range(n)] + base + [word() for _ in range(3 * n)]))
        assert set(syncmers.anchors(" ".join(base)).hashes.tolist()) <= set(longer.hashes.tolist())
    texts = [(1, "x " * 900), (2, "y z" * 900), (3, None), (4, "a" * 700 + "".join(chr(97 + k % 23) for k in range(600)))]
    for r in syncmers.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert set(syncmers.from_string(r.fingerprint).hashes.tolist()) == set(plain_syncmers(r.text or ""))


def test_local_edits_of_long_texts_show():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(120_000))
    passage = text[50_000:56_000]
    other = "".join(rng.choice("abcdefghij ") for _ in range(120_000))
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(other[:60_000] + passage + other[60_000:])) > 0.01
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(text[:50_000] + text[56_000:])) < 0.99
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(other)) < 0.001


def test_syncmers_do_not_depend_on_context():
    rng = random.Random(7)
    body = "".join(rng.choice("abcdefgh ") for _ in range(400))
    a, b = syncmers.anchors(body), syncmers.anchors("zz" * 20 + body)
    assert set(a.hashes.tolist()) <= set(b.hashes.tolist())
    assert syncmers.likeness(syncmers.anchors(body), syncmers.anchors(body)) == 1.0
    assert syncmers.likeness(syncmers.anchors(""), syncmers.anchors("")) == 1.0 and syncmers.likeness(syncmers.anchors(""), syncmers.anchors(body)) == 0.0


def test_one_and_no_document(spark, empty):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert syncmers.compare_with_next(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert syncmers.compare_with_next(empty).count() == 0


# --- 8 mixing


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 3 * sizes[s]]
        for s in over or free:
            out[s] = 3.0 * sizes[s] if over else left * w[s] / total
        if not over:
            break
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("shard_slots", [4096, 7])
def test_mixture(small, shard_slots):
    rows = small.collect()
    placed, targets_df, mixture = mixing.mix(small, shard_slots=shard_slots, block_words=16)
    size = {r.doc_id: len(words(r.text)) for r in rows}
    per = Counter()
    for r in rows:
        per[r.source] += size[r.doc_id]
    goal = targets(per)
    assert {r.source: (r.source_size, round(r.target, 6)) for r in targets_df.collect()} == {s: (per[s], round(goal[s], 6)) for s in per}
    taken, by_source = Counter(), Counter()
    source = {r.doc_id: r.source for r in rows}
    for r in mixture.collect():
        taken[r.row.doc_id] += r.words
        by_source[source[r.row.doc_id]] += r.words
    assert all(taken[d] <= 3 * size[d] for d in size)
    # quotas are whole blocks, and a source's last block may be short
    assert all(abs(by_source[s] - goal[s]) <= 16 * 2 for s in per)
    starts = defaultdict(list)
    for r in placed.collect():
        starts[r.source].append((r.start, r["size"]))
    for spans in starts.values():  # end to end, without gaps
        spans = sorted(s for s in spans if s[1])
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_shards_draw_multinomial_counts(spark):
    """Mean and covariance of a shard's counts are those of numpy's multinomial, given the same shares."""
    targets = spark.createDataFrame([("a", 64_000, 50.0 * 64 * 200), ("b", 64_000, 30.0 * 64 * 200), ("c", 64_000, 15.0 * 64 * 200), (None, 64_000, 5.0 * 64 * 200)], "source string, source_size long, target double")
    quotas = mixing.source_quotas(targets)
    assert quotas.first().quota == [10_000, 6_000, 3_000, 1_000] and quotas.first().name == ["a", "b", "c", None]
    shard, n = 50, 20_000
    counts = np.zeros((n // shard, 4))
    for r in mixing.draw_counts(quotas, n, 4, shard, 3).collect():
        counts[r.shard, r.k] = r.slots
    p = np.array([0.5, 0.3, 0.15, 0.05])
    drawn = np.random.default_rng(0).multinomial(shard, p, n // shard)
    assert (counts.sum(axis=1) == shard).all()
    assert np.allclose(counts.mean(axis=0), shard * p, atol=4 * np.sqrt(shard * p * (1 - p) / (n // shard)))
    theory = shard * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(counts.T) - theory).max() <= 2 * max(1.0, np.abs(np.cov(drawn.T) - theory).max())
    # what is over quota goes to the sources that fell short: quotas are met exactly, each number once
    slots = mixing.draw_slots(targets, 64, shard, 3).collect()
    seen = defaultdict(list)
    for r in slots:
        seen[r.source].append(r.t)
    assert {s: sorted(t) for s, t in seen.items()} == {s: list(range(q)) for s, q in zip(["a", "b", "c", None], [10_000, 6_000, 3_000, 1_000], strict=True)}
    assert all(v == shard for v in Counter(r.shard for r in slots).values())


def test_mixed_documents(awkward, empty, clashing):
    got = mixing.mixed_documents(clashing, block_words=4, shard_slots=8).collect()
    assert got and all(r["pass"] == "pass" and r.k == "k" and r.size == "size" for r in got)
    known = defaultdict(list)
    for r in AWKWARD:
        known[r[0]].append(words(r[1]))
    assert all(set(words(r.text)) <= {w for ws in known[r.doc_id] for w in ws} for r in got)
    assert mixing.mixed_documents(empty).count() == 0


def test_reruns_agree(small):
    key = lambda: sorted((r.shard, r["pass"], r.row.doc_id, r.piece_from, r.words) for r in mixing.mix(small)[2].collect())
    assert key() == key()


# --- 9 byte pairs


def test_bpe_equals_the_library(small, awkward, empty):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for df in (small, awkward):
        for r in bpe.encode_decode(df.withColumn("ids", F.lit("x")), path, keep_text=True).collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t, v, rng = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read()), random.Random(9)
    texts = ["".join(rng.choice("abcdeéß😀 \n\t'sTHE0123-_!") for _ in range(200)) for _ in range(150)]
    for text, (n, ids, decoded) in zip(texts, v.encode_batch(texts), strict=True):
        expected = t.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, expected)) and n == len(expected) and decoded.decode() == text


# --- 10 quality


def base_counts(text):
    w = words(text)
    shingles = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(shingles)
    covered = {i + k for i, s in enumerate(shingles) if n[s] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, small, awkward, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 0, 1)], labels.schema))
    for df in (small, awkward):
        texts = defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(base_counts(r.text))
        for r in quality.quality_rules(df, noisy).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got in texts[r.doc_id]
            assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(awkward, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_ratios_equal_counts(spark, small):
    """The log ratios against plain counting, with Spark's own hash of each n-gram."""
    trusted = small.where("doc_id % 2 = 0").select("doc_id")
    got = {r.bucket: r.ratio for r in quality.log_ratios(small, trusted, 64).collect()}
    grams = [(r.doc_id, w, i) for r in small.collect() for ws in [words(r.text)] for i, w in enumerate([*ws, *zip(ws, ws[1:], strict=False)])]
    df = spark.createDataFrame([(d, *(w if isinstance(w, tuple) else (w, None))) for d, w, _ in grams], "d long, a string, b string")
    bucket = F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(64))
    raw, target = Counter(), Counter()
    for r in df.groupBy(bucket.alias("k"), (F.col("d") % 2 == 0).alias("good")).count().collect():
        raw[r.k] += r["count"]
        target[r.k] += r["count"] * r.good
    for k in range(64):
        ratio = np.log(((target[k] + 1) / (sum(target.values()) + 64)) / ((raw[k] + 1) / (sum(raw.values()) + 64)))
        assert abs(ratio - got[k]) < 1e-9


def test_kept_equals_a_plain_verdict(spark, small):
    """The whole verdict, ratios and threshold written out; the quantiles are exact on tables of this size."""
    import math

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows, buckets = small.select("doc_id", "text").collect(), 1 << 10
    hashed = {}
    grams = lambda w: [(x,) for x in w] + list(zip(w, w[1:], strict=False))
    every = sorted({g for r in rows for g in grams(words(r.text))})
    frame = spark.createDataFrame([(list(g),) for g in every], "g array<string>")
    for r in frame.select("g", F.when(F.size("g") == 1, F.pmod(F.xxhash64(F.get("g", 0)), F.lit(buckets))).otherwise(F.pmod(F.xxhash64(F.get("g", 0), F.get("g", 1)), F.lit(buckets))).alias("b")).collect():
        hashed[tuple(r.g)] = r.b
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    apart = {r.doc_id for r in labels.where(F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(quality.FOLDS)) == 0).collect()}
    raw, good = Counter(), Counter()
    for r in rows:
        for g in grams(words(r.text)):
            raw[hashed[g]] += 1
            good[hashed[g]] += r.doc_id in trusted - apart
    share = lambda c, b: (c[b] + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * buckets)
    ratio = {b: math.log(share(good, b) / share(raw, b)) for b in range(buckets)}
    llr = [np.mean([ratio[hashed[g]] for g in grams(words(r.text))]) if words(r.text) else None for r in rows]
    held = sorted(v for r, v in zip(rows, llr, strict=True) if r.doc_id in trusted & apart and len(words(r.text)) >= quality.MIN_WORDS)
    quantile = lambda q: held[max(0, math.ceil(q * len(held)) - 1)]
    threshold = quantile(quality.TRUSTED_LOSS) - quality.SLACK * (quantile(0.75) - quantile(0.25))
    want = Counter((r.doc_id, round(v, 6) if v is not None else None, v is not None and v >= threshold) for r, v in zip(rows, llr, strict=True))
    got = quality.quality_rules(small, labels, buckets=buckets).collect()
    assert Counter((r.doc_id, round(r.llr, 6) if r.llr is not None else None, r.kept or (r.base_failed and r.llr is not None and r.llr >= r.threshold)) for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)


def test_threshold_covers_all_trusted_documents(spark):
    """With a fit sample of 20 the threshold is that of every trusted document outside the sample."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_rules(docs, labels, trusted_docs=20).cache()
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(quality.FOLDS)) == 0
    sample = [r.doc_id for r in trusted.where(~apart).orderBy(F.xxhash64(F.lit("trusted"), "doc_id")).limit(20).collect()]
    ids = {r.doc_id for r in trusted.collect()} - set(sample)
    scores = sorted(r.llr for r in rows.collect() if r.doc_id in ids and r.n_words >= quality.MIN_WORDS)
    at = lambda q: scores[max(0, int(np.ceil(q * len(scores))) - 1)]
    assert len(scores) > 100 and abs(rows.first().threshold - (at(quality.TRUSTED_LOSS) - quality.SLACK * (at(0.75) - at(0.25)))) < 1e-9


def test_quality_tells_junk_from_prose(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.2


# --- all of them


def test_inputs_may_have_any_other_columns(spark, clashing, forest):
    """Columns with the operators' own names change no result, and stay where an operator keeps its input's columns."""
    few = clashing.drop(*[c for c in clashing.columns if c not in DOCS.split()[::2] and c != "doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    plain = lambda df: sorted(map(repr, df.collect()))
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("n", "bucket", "m")})
    for run in (
        lambda df: near_dup.near_duplicates(df), lambda df: syncmers.compare_with_next(df), lambda df: quality.quality_rules(df, labels).select("doc_id", "n_words", "kept"),
        lambda df: bpe.encode_decode(df, bpe.default_tokenizer()).select("doc_id", "n_tokens"), lambda df: line_dedup.drop_shared_lines(df, 2).select("doc_id", "text", "n_lines", "n_dropped"),
        lambda df: langid.identify(df).select("doc_id", "lang_pred"), lambda df: pii.with_spans(df, forest).select("doc_id", "base"), lambda df: syncmers.fingerprint_documents(df).select("doc_id", "fingerprint"),
    ):
        assert plain(run(clashing)) == plain(run(few))
    for df in (line_dedup.drop_shared_lines(clashing), langid.identify(clashing)):
        assert len(set(df.columns)) == len(df.columns) and set(clashing.columns) <= set(df.columns)
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    odd = turns.withColumns({c: F.lit(1) for c in ("n", "m", "turns", "places", "mask", "formatted", "at", "key")})
    assert chat.format_conversations(odd).collect() == chat.format_conversations(turns).collect()
    pages = spark.createDataFrame([(1, "http://a.example/x", "<article><p>Some text</p></article>")], "page_id long, url string, html string")
    odd = pages.withColumns({c: F.lit(1) for c in ("key", "host", "node", "path", "place", "_row", "m", "text")})
    assert [r.text for r in html_extract.extract_main_text(odd).collect()] == [r.text for r in html_extract.extract_main_text(pages).collect()] == ["Some text"]


def test_exact_quantiles(spark):
    rng = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [rng.random() for _ in range(1000)], [1.0] * 500 + [2.0] * 3):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
        ordered = sorted(values)
        wanted = [ordered[max(1, -int(-share * len(values) // 1)) - 1] if values else None for share in (0.005, 0.25, 0.75, 1.0)]
        assert quality.exact_quantiles(df, [0.005, 0.25, 0.75, 1.0]) == wanted


def test_formulas_stay_in_their_sentence():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be and <svg viewBox='0 0 1 1'><path d='M0'/><text>y</text></svg> too</p><p>next</p></article>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["Let x=2 be and y too", "next"]
