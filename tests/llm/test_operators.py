"""The corpus operators against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

from rulegrain.llm import chat, decontam, html_text, knn, linededup, minhash, mixing, quality, sharding, toxicity
from rulegrain.llm.queries import ORACLE_SQL, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"


@pytest.fixture(scope="module")
def fixture(spark):
    """Copies, near copies, shared passages, blanks, nulls, ties, a very long text and clashing columns."""
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd éf gh ij kl mn op qr st".split()) + rng.choice("uvwxyz")
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(80), prose(60)
    texts = [base] * 5 + [base.replace(" ", "  ")] + [None, "", "  \n", "one", "One", "two words", prose(20000)]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [f"{prose(12)}\n{passage}\n{prose(10)}" for _ in range(12)]
    texts += [f"{prose(12)}\n{passage[:200]}\nx\n{passage}\n\n{prose(55)}" for _ in range(4)]
    rows = [(i, t, "en", (None, "a", "b", "ü")[i % 4], 0, "k", 1) for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_sharding(spark, fixture):
    d = sharding.shard(fixture).toPandas()
    n = d.groupby("shard").size().reindex(range(24), fill_value=0)
    assert len(d) == fixture.count() and n.max() - n.min() <= 1 and set(d.law) == {"rows"} and d.grown_shard.isna().all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in d.groupby("shard"))
    texts = {r["doc_id"]: r["text"] for r in fixture.collect()}
    for r in d.itertuples():
        t = texts[r.doc_id]
        assert r.size == 8 + len((t or "").encode()) and (t is None or r.text_crc32 == zlib.crc32(t.encode()))
    assert sharding.shard(fixture.limit(0)).count() == 0


def test_ring_moves_only_overflow():
    counts = {c: random.Random(c).randrange(9) for c in range(sharding.CELLS)}
    plan = sharding.quotas(counts)
    order = sharding.ring()
    assert sum(hi - lo for _, lo, hi, _, _ in plan) == sum(counts.values())
    assert sum(hi - lo for c, lo, hi, s, _ in plan if order[c][0] == s) > 0.8 * sum(counts.values())


def test_one_more_shard_moves_little():
    n = 100_000
    counts = defaultdict(int)
    for i in range(n):
        counts[zlib.crc32(str(i).encode()) % sharding.CELLS] += 1
    where = []
    for shards in (24, 25):
        at = {}
        for cell, lo, hi, shard, _ in sharding.quotas(dict(counts), shards, sharding.ring(shards)):
            at |= dict.fromkeys(((cell, k) for k in range(lo, hi)), shard)
        where.append(at)
    moved = [(where[0][k], where[1][k]) for k in where[0] if where[0][k] != where[1][k]]
    assert len(where[0]) == len(where[1]) == n and 0.04 * n <= len(moved) < 0.09 * n
    assert sum(b != 24 for _, b in moved) < 0.04 * n


def test_targets_against_water_filling(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 40):
        z = [rng.choice([0, 1, 10, 100, 3000]) * rng.randrange(1, 9) for _ in range(n)]
        rows = spark.createDataFrame([(int(i == n - 1), f"s{i:03}", x) for i, x in enumerate(z)], "none int, src string, z long")
        weight, free, want, left = [(3, 1, 2)[i % 3] for i in range(n)], set(range(n)), {}, 1.5 * sum(z)
        while free:
            level = left / sum(weight[i] for i in free)
            full = {i for i in free if 2 * z[i] <= level * weight[i]}
            want |= {i: 2 * z[i] for i in full} if full else {i: level * weight[i] for i in free}
            left -= sum(2 * z[i] for i in full)
            free = free - full if full else set()
        got = {r["ord"] - 1: (r["weight"], r["target"]) for r in mixing.targets(rows.repartition(3)).collect()}
        assert {i: w for i, (w, _) in got.items()} == dict(enumerate(weight)) and got.keys() == want.keys()
        assert all(got[i][1] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_quotas_of_shards(spark):
    """Block by block: every shard has its integer quota by highest quotients, and the choice adds up."""
    for nb, q in ((1, 0), (1, 1), (7, 3), (16, 16), (37, 20), (100, 99), (333, 100)):
        rows = spark.range(nb + 1).selectExpr("id AS b", f"CAST({nb} AS BIGINT) AS nb", f"CAST({q} AS BIGINT) AS q", "CAST(5 AS BIGINT) AS seat")
        upto = [r[0] for r in rows.orderBy("b").select(F.expr(mixing._before("b"))).collect()]
        chosen = np.diff(upto)
        assert upto[0] == 0 and upto[-1] == q and set(chosen.tolist()) <= {0, 1}
        edges = [h * nb // mixing.PARTS for h in range(mixing.PARTS + 1)]
        sizes, got = np.diff(edges), np.diff([upto[e] for e in edges])
        want = [0] * mixing.PARTS
        for _ in range(q):
            want[max(range(mixing.PARTS), key=lambda h: (sizes[h] / (2 * want[h] + 1), -h))] += 1
        assert got.tolist() == want


def test_mixing(spark, fixture):
    d = mixing.mix(fixture).toPandas()
    texts = {r["doc_id"]: r["text"] for r in fixture.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in d.itertuples())
    assert ((d.taken >= 0) & (d.taken <= 2 * d["size"])).all()
    by = d.groupby("source", dropna=False).agg(z=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by.z == by.said).all() and (by.target <= 2 * by.z + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by.z.sum()) < 1e-6 and ((by.taken - by.target).abs() <= 40).all()
    again = mixing.mix(fixture.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert d[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(fixture.where("text is null")).toPandas().taken.tolist() == [0]
    assert mixing.mix(fixture.limit(0)).count() == 0


def test_mixed_documents_meet_the_targets(spark):
    rng = random.Random(8)
    rows = [(None if i % 50 == 0 else i, " ".join(f"w{i}" for _ in range(rng.randrange(400))), "en", (None, "a", "b", "ü", "b")[i % 5], 0, "k", i) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    aims = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = [tuple(r) for r in mixing.mixed(docs).select(*docs.columns).collect()]
    got, copies = defaultdict(int), defaultdict(int)
    for r in out:
        got[r[3]] += len(r[1].split())
        copies[r[6]] += 1
    assert all(abs(got[s] - aims[s]) <= 500 for s in aims) and set(out) <= set(rows)
    assert max(copies.values()) == 2 and len(copies) < len(rows) and any(r[0] is None for r in out)
    again = mixing.mixed(docs.repartition(7)).select(*docs.columns).collect()
    assert sorted(r[6] for r in out) == sorted(r["h"] for r in again)
    assert mixing.mixed(docs.where("text = ''")).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_apportionment_against_highest_quotients(spark):
    rng = random.Random(1)
    for seats, aims in [(k, [(i, rng.random() * 100) for i in range(9)]) for k in (1, 7, 100)] + [(k, [(i, float(5 * (i % 3))) for i in range(9)]) for k in (1, 2, 10, 35)]:
        want = [0] * 9
        for _ in range(seats):
            want[max(range(9), key=lambda i: (aims[i][1] / (2 * want[i] + 1), -i))] += 1
        got = mixing.apportion(spark.createDataFrame(aims, "ord int, target double"), seats)
        assert [r["seats"] for r in got.orderBy("ord").collect()] == want


def test_decontamination(spark, fixture):
    text = {r["doc_id"]: r["text"] for r in fixture.collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    long = words(next(t for t in text.values() if t and "\n" in t and len(t) > 300))
    items = {1: " ".join(long[5:40]), 2: " ".join(long[20:33]), 3: "One", 4: "", 5: None, 6: "two, WORDS!", 7: " ".join(long[30:41]), 8: " ".join(long[50:64]), 10: "zz"}
    found = {}
    for i, t in text.items():
        w, hit, of = words(t), set(), set()
        for k, x in items.items():
            g = words(x)
            n = min(13, len(g))
            windows = {tuple(g[a : a + n]) for a in range(len(g) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    of.add(str(k))
        found[i] = (len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontam.BLOCK_WORDS, 40):
        got = decontam.verdict(decontam.contamination(fixture, bench, block)).collect()
        assert len(got) == fixture.count()
        assert all((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == found[r["row"]["doc_id"]] for r in got)
    left = decontam.clean(fixture, bench)
    assert left.columns == fixture.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in fixture.collect() if not found[r["doc_id"]][4])
    assert decontam.contamination(fixture.limit(0), bench).count() == 0
    assert decontam.verdict(decontam.contamination(fixture, bench.limit(0))).where("n_hit > 0").isEmpty()


def test_items_without_an_id_are_hit(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {passage} y", "en", "a", 0, "k", 1)], SCHEMA)
    items = spark.createDataFrame([(None, passage)], "item_id long, text string")
    got = decontam.verdict(decontam.contamination(docs, items)).first()
    assert (got["n_hit"], got["n_items"], got["contaminated"]) == (20, 0, True)


def test_windows_against_brute_force():
    """Few words, so that texts repeat themselves and the items; all-equal words; items longer than a block; in time linear in the words."""
    rng = random.Random(6)
    for round in range(40):
        kinds = 1 + round % 3
        texts = [[rng.randrange(1, kinds + 1) for _ in range(rng.randrange(0, 60))] for _ in range(6)]
        items = [[rng.randrange(1, kinds + 1) for _ in range(rng.randrange(0, 30))] for _ in range(4)]
        flat = lambda rows: (np.array([w * 977 for r in rows for w in r], np.uint64), np.cumsum([0, *map(len, rows)]))
        got = decontam.Index(list("abcd"), *flat(items)).matches(*flat(texts))
        for w, ((lo, hi), of) in zip(texts, got, strict=True):
            hit, found = set(), set()
            for k, g in enumerate(items):
                n = min(13, len(g))
                windows = {tuple(g[a : a + n]) for a in range(len(g) - n + 1)} if n else set()
                for a in range(len(w) - n + 1) if n else ():
                    if tuple(w[a : a + n]) in windows:
                        hit |= set(range(a, a + n))
                        found.add(k)
            assert {x for a, b in zip(lo, hi, strict=True) for x in range(a, b)} == hit and set(of.tolist()) == found
    spam = np.full(300_000, 5, np.uint64)
    ((lo, hi), _), = decontam.Index(["a"], spam[:5000], np.array([0, 5000])).matches(spam, np.array([0, 300_000]))
    assert (lo.tolist(), hi.tolist()) == ([0], [300_000])


def test_long_items_are_cut(spark):
    ws = [f"w{i}" for i in range(500)]
    items = spark.createDataFrame([(1, " ".join(ws)), (1, " ".join(ws)), (2, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(a, " ".join(ws[a : a + 13]), "en", "a", 0, "k", 1) for a in range(0, 488)], SCHEMA)
    most, decontam.PIECE_WORDS = decontam.PIECE_WORDS, 40
    try:
        got = decontam.verdict(decontam.contamination(docs, items, 100)).collect()
    finally:
        decontam.PIECE_WORDS = most
    assert len(got) == 488 and all((r["n_words"], r["n_hit"], r["n_items"]) == (13, 13, 1) for r in got)


def test_near_duplicates(spark, fixture):
    sets = {}
    for r in fixture.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if j < i and n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    tile, minhash.TILE = minhash.TILE, 4
    try:
        got = minhash.components(fixture).collect()
    finally:
        minhash.TILE = tile
    assert len(got) == fixture.count()
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]) for r in got)
    assert minhash.components(fixture.limit(0)).count() == 0
    kept = minhash.keep_one(fixture)
    assert kept.columns == fixture.columns or set(kept.columns) == set(fixture.columns)


def test_pairs_lost_at_the_threshold():
    """Of pairs at a similarity of exactly 0.75, those without a common band, or with an estimate below the bound."""
    rng = np.random.default_rng(1)
    lost = total = 0
    for _ in range(20):
        same = rng.random((10_000, minhash.K)) < 0.75
        band = same.reshape(len(same), minhash.BANDS, minhash.ROWS).all(axis=2).any(axis=1)
        chance = rng.random(same.shape) < 2.0**-minhash.PLANES
        close = minhash.estimated((~(same | chance)).sum(axis=1)) >= minhash.ESTIMATE
        lost, total = lost + int((~(band & close)).sum()), total + len(same)
    assert lost < 0.0005 * total


def test_rows_that_share_an_id(spark):
    """One document with two texts has the links of both, however the table is dealt."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " z"), (8, b + " z"), (9, c), (9, c), (None, a), (10, None), (11, c + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9), (10, 10), (11, 9)])
    for n in (1, 3):
        got = minhash.components(docs.repartition(n)).where("doc_id is not null").collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["comp"] for r in minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_line_runs(spark, fixture):
    rows = sorted({(r["doc_id"], r["text"]) for r in fixture.collect() if r["text"] is not None})
    lines = {i: [(k, x.strip(" \t\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")] for i, t in rows}
    first, gone = {}, defaultdict(set)
    runs = [(i, a, b) for i, ls in lines.items() for a in range(len(ls)) for b in range(a, len(ls)) if sum(len(x.split()) for _, x in ls[a : b + 1]) >= 50]
    for i, a, b in sorted(runs):
        key = tuple(x for _, x in lines[i][a : b + 1])
        if first.setdefault(key, (i, a)) < (i, a):
            gone[i] |= set(range(lines[i][a][0], lines[i][b][0] + 1))
    blank = lambda i, t: {k for k, x in enumerate(t.split("\n")) if not x.strip(" \t\r")}
    for r in linededup.dedup_lines(fixture).collect():
        if r["text"] is None:
            continue
        text = dict(rows)[r["doc_id"]]
        got = {k for s in r["deleted"] for k in range(s["lo"], s["hi"])}
        assert got - blank(r["doc_id"], text) == gone[r["doc_id"]] - blank(r["doc_id"], text)
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in got)


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).astype(np.float64)
    v[50:150] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [float("nan")] * 8), (402, [1.0]), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    size, knn.SHARD_VALUES = knn.SHARD_VALUES, 500
    try:
        got = defaultdict(list)
        for r in knn.topk(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
    finally:
        knn.SHARD_VALUES = size
    x = np.floor(v * 256).astype(np.int64)
    for q in range(0, 400, 50):
        s = x @ x[q]
        assert got[q] == [(int(j), int(s[j])) for j in np.lexsort((np.arange(400), -s)) if j != q][:5]
    one = "id long, v array<double>"
    big = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (9, [1e300, 1.0]), (8, [2e300, 0.0])], one)
    assert [(r["vec_id"], r["score"]) for r in knn.topk(big, F.col("id") == 0).orderBy("rank").collect()][:4] == [(8, 2**63 - 1), (9, 2**63 - 1), (1, 256**2 * (10**12 + 3)), (2, 256**2 * (10**12 + 2))]
    same = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [2.0]), (7, [1.0]), (3, []), (50, [])], one)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.topk(same, F.col("id") % 50 == 0).collect())
    n = 256**2
    assert got == sorted([(0, 1, 0, 2 * n), (0, 2, 0, n), (0, 3, 7, n)] * 2 + [(0, 1, 0, 2 * n), (0, 2, 0, 2 * n), (0, 3, 7, 2 * n), (50, 1, 3, 0)])
    assert knn.topk(df.limit(0), F.col("id") == 0).count() == 0


def test_html(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy this</div><article><h1>A &amp; B</h1><p>First\n  long paragraph with many words in it.<p><b>Second &eacute; paragraph<br>goes on</b></p><div id="cookie-notice">We use cookies</div><script>var t="</p>"</script><form>Search <input></form></article><section class="comments"><p>Nice post, I liked it a lot indeed.</p></section><footer>&copy; x</footer></body></html>'
    want = "A & B First long paragraph with many words in it. Second é paragraph goes on"
    assert html_text.main_text(page) == want
    assert html_text.main_text("<div><p>Only a paragraph of text here, without an article.</p></div><p class='x") == "Only a paragraph of text here, without an article."
    assert html_text.main_text("<nav>only menu</nav>") == html_text.main_text("") == html_text.main_text(None) == ""
    got = html_text.extract(spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [(want, len(want)), ("", 0)]


def _article(page):
    """The article of a page of the test tables, by cutting the text up: no parser, no ratios."""
    import html

    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.DOTALL).group(1)
    if "<footer>" not in page and "</article>" not in page:
        body = body[: body.rfind("<")] if body.rfind("<") > body.rfind(">") else body
    blocks = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_html_against_cutting(spark, sf, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    assert [html_text.main_text(p) for p in pages] == [_article(p) for p in pages]
    # the content lines come from the smoothed ratios alone: without them there is no region
    monkeypatch.setattr(html_text, "smooth", lambda ratios: np.zeros(len(ratios)))
    assert all(html_text.main_text(p) == "" for p in pages)


def test_ratios_choose_the_region_and_judge_hints():
    menu = "".join(f"<a href=/{i}>Section number {i}</a> " for i in range(9))
    plain = f"<body><div>{menu}</div><div><h1>Head</h1><div>A first paragraph with a good many words to be read, and no links in it at all.</div><div>Short.</div><div>A last one that is long enough as well to stand out from what surrounds it here.</div></div><div>{menu}</div></body>"
    assert html_text.main_text(plain).startswith("Head A first") and html_text.main_text(plain).endswith("it here.") and "Section" not in html_text.main_text(plain)
    hinted = '<article><p class="related-work">Related work fills a long paragraph of its own, which says a lot about what was done before.</p><div class="comment-on-law"><p>A comment on the law is no comment of a reader, and it is a long one too.</p></div><div class="post-header"><h1>Lead</h1><p>Some words that lead into the article, as long as any other paragraph of it.</p></div><div class="article-share"><a href=a>Share</a> <a href=b>it</a></div><div class="reader-comments"><p>I have read all of this article with a great deal of interest, thank you so much.</p></div><div class="more-related-things"><a href=c>Some other text</a></div></article>'
    text = html_text.main_text(hinted)
    assert all(x in text for x in ("Related work", "comment on the law", "Lead Some words")) and not any(x in text for x in ("Share", "thank you", "other text"))


def test_smoothing_and_threshold_against_plain_sums():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        x = rng.integers(0, 300, n).astype(float)
        weights = {d: np.exp(-d * d / (2 * html_text.SIGMA**2)) for d in range(-html_text.REACH, html_text.REACH + 1)}
        want = [sum(w * x[min(max(i + d, 0), n - 1)] for d, w in weights.items()) / sum(weights.values()) for i in range(n)]
        assert np.allclose(html_text.smooth(x), want)
        cut = html_text.threshold(x)
        low, high = x[x < cut], x[x >= cut]
        if len(low) and len(high):
            assert cut == pytest.approx((low.mean() + high.mean()) / 2)


def test_deep_and_long_pages():
    import time

    took = []
    for n in (4000, 16000):
        began = time.time()
        assert html_text.main_text("<div>" * n + "some text of a page " * 5 + "<b>" * n + "<p>x" * n).startswith("some text")
        took.append(time.time() - began)
    assert took[1] < 16 * max(took[0], 0.05)
    assert len(html_text.main_text("<p>" + "word " * 600_000)) == 5 * 600_000 - 1
    assert html_text.main_text("<div hidden>a long text that nobody sees, whatever it may say</div>") == ""


def test_chat(spark):
    turns = [(1, 0, "system", "S"), (1, 2, "bob", "hi <|im_end|>"), (1, 1, "ann", "yo"), (1, None, None, None), (2, 0, "system", "x"), (None, 0, "ann", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["perspective"]: r for r in chat.dialogues(df).collect()}
    assert set(got) == {"ann", "bob", "unknown"}
    text = got["bob"]["text"]
    assert text.startswith("<|im_start|>user name=unknown\n<|im_end|>\n<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nyo")
    assert [chat.unescape(text[s["lo"] : s["hi"]]) for s in got["bob"]["spans"]] == ["hi <|im_end|>" + "<|im_end|>"]
    odd = spark.createDataFrame([(1, 0, "a\nb", "x"), (1, 1, "c", "y " * 50_000), (1, 1, "c", "y " * 50_000), (1, 1, "c", None)], "conv_id long, turn long, role string, text string")
    said = {r["perspective"]: r["text"] for r in chat.dialogues(odd).collect()}
    assert said["c"].startswith("<|im_start|>user name=a b\nx<|im_end|>\n") and said["c"].count("<|im_start|>assistant") == 3 and len(said["a\nb"]) > 200_000
    assert chat.segments(odd.limit(0)).count() == 0 and chat.dialogues(odd.limit(0)).count() == 0


def test_quality_learns_and_holds_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    d = quality.score(docs, quality.learn(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = d[d.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() >= 0.9 and d.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "", "", 0, "", 0), (None, "", "", "", 0, "", 0), (2, "wörd " * 100_000, "", "", 0, "", 0), (2, "wörd " * 100_000, "", "", 0, "", 0)], SCHEMA)
    assert quality.score(odd, quality.Model()).count() == 4 and quality.score(odd.limit(0), quality.Model()).count() == 0
    model = quality.learn(docs, labels)
    got = quality.score(odd, model).collect()
    assert all(r["score"] == pytest.approx(_additive(model, quality.features(t["text"]))) for r, t in zip(got, odd.collect(), strict=True))


def _additive(model, x):
    """The score of one text: the base and one table entry for each feature and pair, looked up one by one."""
    bin_of = lambda edges, v: sum(v >= e for e in edges)
    total = model.base + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
    total += sum(t[bin_of(model.coarse[i], x[i]), bin_of(model.coarse[j], x[j])] for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-total))


def test_toxicity_gradients_against_differences():
    rng = np.random.default_rng(0)
    letters = rng.integers(97, 123, 60).astype(np.uint8)
    places = np.arange(0, 61, 6)
    net = toxicity.Network(0.3, np.arange(5, dtype=np.uint64), np.linspace(-1, 1, 5), np.zeros(toxicity.PIECES, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["wa"] = rng.normal(size=net.p["wa"].shape)
    ids, grams = np.arange(10) % 6, toxicity.trigrams(letters, places)
    fixed = net.fixed(ids, toxicity.sixes(letters, places), toxicity.begins(letters, places), places)
    at, length, y = rng.integers(0, 10, (4, toxicity.SPAN)), np.array([48, 3, 20, 1]), np.array([1.0, 0, 1, 0])

    def loss():
        p = toxicity._sigmoid(net.run(net.inputs(ids, grams, places, fixed), at, length))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(ids, grams, places, fixed, at, length, y)
    for k in ("wa", "wo", "bo", "Wf", "Ub", "bb", "own"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape) if k != "own" else (1, 2)
        step, keep = 1e-3, net.p[k][i]
        net.p[k][i] = keep + step
        up = loss()
        net.p[k][i] = keep - step
        down = loss()
        net.p[k][i] = keep
        assert grads[k][i] == pytest.approx((up - down) / (2 * step), abs=2e-4), k


def test_toxicity_learns(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randrange(5, 150))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty"]) + rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(w), "", "", 0, "", 0))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    net = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    d = toxicity.score(docs, net).toPandas()
    held = d[d.held_out]
    assert (held.predicted == (held.doc_id % 5 == 0)).mean() >= 0.9
    odd = spark.createDataFrame([(1, None, "", "", 0, "", 0), (2, "?!", "", "", 0, "", 0), (2, "?!", "", "", 0, "", 0), (None, "", "", "", 0, "", 0)], SCHEMA)
    out = toxicity.score(odd, net).collect()
    assert len(out) == 4 and all(r["score"] == net.rate for r in out)
    assert toxicity.score(odd.limit(0), net).count() == 0
    nothing = toxicity.learn(odd, spark.createDataFrame([(1, 1, None), (9, 0, 1)], "doc_id long, quality int, toxic int"))
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in toxicity.score(odd, nothing).collect())


@pytest.mark.parametrize("size, least, flagged", [("0.01", 0.6, 0.02), ("0.1", 0.9, 0.02)])
def test_toxicity_found_in_held_out_texts(spark, sf, size, least, flagged):
    """Of 6 and 97 toxic texts; at 0.01 there are 45 to learn from, and 15 of them in languages other than English."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', size)}/{t}.parquet") for t in ("documents", "labels"))
    d = toxicity.score(docs, toxicity.learn(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = d[d.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held[held.toxic == 1].predicted == 1).mean() >= least and (held[held.toxic == 0].predicted == 1).mean() <= flagged


def test_fitting_samples_are_bounded(spark):
    """A labelled doc_id that many rows share counts for each of them, and the limits hold all the same."""
    docs = spark.createDataFrame([(i % 3, "x" * (10 if i % 2 else 90), "", "", 0, "", 0) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1), (2, None, None), (None, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fitting_sample(docs, labels, "toxic", (5, 9), 25, 1000).count() == 25 and quality.labelled(docs, labels, "toxic", (5, 9)).count() == 60
    small = quality.fitting_sample(docs, labels, "toxic", (5, 9), 500, 50).collect()
    assert len(small) == 30 and {len(r["text"]) for r in small} == {10}
    assert quality.fitting_sample(docs, labels.limit(0), "toxic", (5, 9), 5, 99).count() == 0 and quality.labelled(docs.limit(0), labels, "toxic", (5, 9)).count() == 0


def test_numbers_of_a_fold_come_from_the_others():
    """A word that stands in one toxic text alone tells nothing about that text."""
    rng = np.random.default_rng(2)
    y = (np.arange(60) % 3 == 0).astype(float)
    fold = toxicity._dealt(y, rng)
    assert all(abs(int((fold[y == v] == k).sum()) - (y == v).sum() / toxicity.FOLDS) < 1 for v in (0, 1) for k in range(toxicity.FOLDS))
    code = np.arange(60) * 4 + (np.arange(60) % 3 == 0)
    counts = toxicity._counts(code, fold, y, 4)
    assert counts[1].sum() == 60 and counts[0, :, 1].sum() == y.sum() and counts[0, :, 0].sum() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    assert difference(spark, name, queries()[name], ORACLE_SQL[name], sf) is None


def test_pipeline(spark, sf):
    """Every stage against a plain reckoning on what its predecessor kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    model = quality.learn(docs, spark.createDataFrame(labels))
    good = stages["quality"](spark, docs, sf).collect()
    want = [r for r in docs.collect() if model.scores(quality._rows_of([r["text"]]))[0] >= quality.CUT]
    assert sorted(map(tuple, good)) == sorted(map(tuple, want))

    kept = stages["near_dedup"](spark, spark.createDataFrame(good, docs.schema), sf).collect()
    sets = {}
    for r in good:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    first, ids = {i: i for i in sets}, sorted(sets)
    changed = True
    links = [(i, j) for i in ids for j in ids if i < j and sets[i] and 100 * (n := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    while changed:
        changed = False
        for i, j in links:
            low = min(first[i], first[j])
            changed |= (first[i], first[j]) != (low, low)
            first[i] = first[j] = low
    assert sorted(r["doc_id"] for r in kept) == [i for i in ids if first[i] == i]

    clean = stages["decontamination"](spark, spark.createDataFrame(kept, docs.schema), sf).collect()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {tuple(g[a : a + min(13, len(g))]) for t in items.text for g in [words(t)] if g for a in range(len(g) - min(13, len(g)) + 1)}
    left = []
    for r in kept:
        w = words(r["text"])
        hit = {a + k for n in range(1, 14) for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            left.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in clean) == sorted(left) and len(left) < len(kept)

    mix = stages["mixing"](spark, spark.createDataFrame(clean, docs.schema), sf).collect()
    size, got, most = defaultdict(int), defaultdict(int), 0
    for r in clean:
        size[r["source"]] += len(r["text"].split())
        most = max(most, len(r["text"].split()))
    for r in mix:
        got[r["source"]] += len(r["text"].split())
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight, left, free, aim = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] <= level * weight[s]} or free
        aim |= {s: min(2 * size[s], level * weight[s]) for s in full}
        left -= sum(aim[s] for s in full)
        free = free - full
    assert all(abs(got[s] - aim[s]) <= most for s in order) and {r["doc_id"] for r in mix} <= {r["doc_id"] for r in clean}

    out = corpus_pipeline.run(spark, sf).toPandas()
    n = out.groupby("shard").size().reindex(range(24), fill_value=0)
    assert sorted(out.doc_id) == sorted(r["doc_id"] for r in mix) and n.max() - n.min() <= 1


def test_stages_with_odd_tables(spark, fixture, sf):
    """Null ids, nulls, repeated rows, an empty table, columns with names that the operators use."""
    import corpus_pipeline

    odd = fixture.withColumns({c: F.lit("x") for c in ("row", "size", "spans", "h1", "salt", "keys", "n_words")}).withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_id")))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, table, sf)
            assert name == "sharding" or sorted(out.columns) == sorted(odd.columns)
            n, rows = table.count(), out.count()
            assert rows <= 2 * n and (name not in ("sharding",) or rows == n)


def test_line_dedup_keeps_columns(spark, fixture):
    odd = fixture.withColumns({c: F.lit("x") for c in ("d", "t", "gone", "row", "n_lines", "lo")})
    out = linededup.dedup_lines(odd)
    assert set(out.columns) == set(odd.columns) | {"n_deleted", "deleted"} and out.schema["n_lines"].dataType.simpleString() == "int"
    assert out.count() == odd.count() and linededup.dedup_lines(odd.limit(0)).count() == 0
