"""Link suggestion, keyword links, sitemaps and throttling on the known small cases."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.functions.html_links import insert_links, strip_links
from linkspark.operators import blocks as B
from linkspark.operators import keywords as K
from linkspark.operators import relevance as R
from linkspark.operators.corpus import PAGE
from linkspark.operators.links import append_generation, generation_totals, history, import_links, search_links, slug_map, upsert_links
from linkspark.operators.selection import enforce_roles, greedy_links
from linkspark.plans.config import overlay, settings
from linkspark.operators.blocks import best_pairs
from linkspark.plans.suggest import batch, dry_run, ready, ready_field, suggest_links
from linkspark.sources.databases import jdbc_options
from linkspark.sources.pages import read_pages, suggestion_tsv
from linkspark.sources.sitemaps import decoded, fetch_sitemaps, parse_sitemaps, read_uploads, sitemap_source
from linkspark.streaming.throttle import admit, admitted, admitted_stream, client_ip, stretches

HOME = "https://example.com"


def page(path, title, text, **more):
    meta = {f.name: None for f in PAGE["metadata"].dataType.fields} | more.pop("meta", {})
    row = {"url": HOME + path, "title": title, "html": text, "text": text, "lang": "en", "tags": [], "type": "blog", "published_at": "2024-01-01T00:00:00+00:00", "canonical": HOME + path, "noindex": False, "nofollow": False}
    return row | more | {"metadata": meta}


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGE).withColumn("page_id", F.monotonically_increasing_id())


def test_anchor_choice(spark):
    text = "We compare the Norvik Alpine Tent with others: the Norvik Alpine Tent Buying Guide by Norvik tells more. A Norvik Alpine Tent lasts."
    source = frame(spark, [page("/notes/tents", "Sleeping outside in winter", text)])
    corpus = frame(spark, [page("/guides/alpine-tent", "Norvik Alpine Tent Buying Guide", "All about tents of Norvik, with sizes and weights.", meta={"head_terms": ["Alpine Tent"], "brand": "Norvik"})])
    _, evaluated, _, _ = batch(source, corpus, settings(max_anchors_per_target=5, score_floor=0.0))
    got = {(a["text"], text[a["start"] : a["end"]], a["variant"]) for a in evaluated.first()["anchors"]}
    assert got == {(x, x, v) for x, v in [("Norvik Alpine Tent Buying", "partial"), ("Norvik Alpine Tent Buying Guide", "exact"), ("Alpine Tent", "partial"), ("Tent Buying Guide", "partial"), ("Norvik", "brand")]}


def test_guardrails_and_budget(spark):
    text = "Our list of Olmo Bread Ovens shows which of the Olmo Bread Ovens bakes best at home."
    source = frame(spark, [page("/notes/bread", "Olmo Bread Ovens", text, tags=["oven"])])
    target = lambda path, **more: page(path, "Olmo Bread Ovens", "A test of Olmo Bread Ovens at home.", tags=["oven"], type="review", **more)
    rows = [target("/tests/ovens", meta={"is_pillar": True, "authority_score": 0.9}), target("/tests/hidden", noindex=True), target("/tests/moved", meta={"is_redirect": True, "status_code": 301}), target("/it/forni", lang="it", canonical=HOME + "/tests/ovens")]
    got = suggest_links(source, frame(spark, rows), settings(score_floor=0.3)).collect()
    assert [(r["target_url"], r["rel"], r["placement_hint"]) for r in got] == [(HOME + "/tests/ovens", "follow", "intro")]
    assert suggest_links(source, frame(spark, rows), settings(score_floor=0.3, max_links_per_page=0)).count() == 0
    assert suggest_links(source.limit(0), frame(spark, rows)).count() == suggest_links(source, frame(spark, rows).limit(0)).count() == 0


def test_pages_of_two_tables_are_told_apart_by_url(spark):
    """Both tables number their rows from 0; a page of the same url is the same page wherever it is."""
    one = [page("/a", "Garden pumps", "Quiet Garden pumps for ponds.", tags=["pump"])]
    two = [page("/b", "Garden pumps", "Garden pumps compared.", tags=["pump"]), page("/a", "Garden pumps", "Quiet Garden pumps for ponds.", tags=["pump"])]
    got = suggest_links(frame(spark, one), frame(spark, two), settings(score_floor=0.1)).collect()
    assert [r["target_url"] for r in got] == [HOME + "/b"]


def test_shared_language_or_tag_opens_a_target(spark):
    text = "Wool Scarves from the hills: Wool Scarves keep warm."
    source = frame(spark, [page("/s", "Wool Scarves", text, tags=["wool"])])
    rows = [page("/de", "Wool Scarves", "Wool Scarves aus den Bergen", lang="de", tags=["berg"]), page("/nl", "Wool Scarves", "Wool Scarves uit de heuvels", lang="nl", tags=["wool"]), page("/none", "Wool Scarves", "Wool Scarves", lang=None)]
    urls = lambda **c: {r["target_url"][len(HOME) :] for r in batch(source, frame(spark, rows), settings(score_floor=0.0, **c))[1].select("t.url").withColumnRenamed("url", "target_url").collect()}
    assert urls() == {"/nl", "/none"}


def test_guides_rank_before_products_for_reviews(spark):
    source = frame(spark, [page("/r", "Kettle Trio", "The Kettle Trio boils fast, and Kettle Trio owners agree.", type="review", tags=["kettle"])])
    same = dict(tags=["kettle"])
    rows = [page("/plain", "Kettle Trio", "Kettle Trio", **same), page("/shop", "Kettle Trio", "Kettle Trio", type="product", **same), page("/guide", "Best Kettle Trio", "Kettle Trio", type="category", **same)]
    best = batch(source, frame(spark, rows), settings(score_floor=0.0))[1].select("t.url", "recall").collect()
    order = [r["url"][len(HOME) :] for r in sorted(best, key=lambda r: -r["recall"])]
    assert order.index("/shop") < order.index("/plain") and "/guide" in order


def test_blocks_of_any_size_give_the_same_pairs(spark):
    rng = random.Random(11)
    words = "oak elm ash fir yew bay fig nut pea rye the of and".split()
    rows = [page(f"/p{k}", " ".join(rng.choice(words) for _ in range(4)), " ".join(rng.choice(words) for _ in range(40)), tags=rng.sample(words, 2), lang=rng.choice(["en", "de", None])) for k in range(90)]
    p = ready(frame(spark, rows))
    want = None
    for sizes in ((4096, 16384), (20, 25), (7, 1000)):
        got = sorted((r["src"], r["tgt"], r["rank"], round(r["recall"], 9)) for r in best_pairs(p, p, 12, source_block=sizes[0], target_block=sizes[1]).collect())
        assert want is None or got == want
        want = got
    assert len(want) == 90 * 12


def test_blocks_copy_no_target_and_need_a_task_a_block(spark):
    p = ready(frame(spark, [page(f"/p{k}", f"oak elm {k % 7}", "oak elm ash " * (k % 5 + 1), lang=["en", "de", None][k % 3]) for k in range(90)]))
    made = best_pairs(p, p, 5, source_block=7, target_block=10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan and made.rdd.getNumPartitions() == 13


def test_bounds_pass_over_no_target(spark):
    """Against all pairs (``k`` beyond the corpus), by each score and with and without gates."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    word = lambda: words[min(int(rng.expovariate(0.15)), 59)]
    rows = [page(f"/p{k}", " ".join(word() for _ in range(3)), " ".join(word() for _ in range(rng.randrange(0, 60))), tags=rng.sample(words, 2), lang=rng.choice(["en", "en", "de", None]), type=rng.choice(["review", "product", "category"]), noindex=k % 9 == 0) for k in range(120)]
    p = ready(frame(spark, rows))
    for by, floor, digits in (("recall", 0.05, 9), ("title_bm25", 0.0, 6), ("body_bm25", 0.0, 6)):
        for gated in (True, False):
            read = lambda k, **sizes: sorted((r["src"], r["rank"], r["tgt"], round(r["recall"], 9), r["first_pos"]) for r in best_pairs(p, p, k, by, floor, digits, gated, **sizes).collect() if r["rank"] <= 4)  # noqa: B023, E731
            assert read(4, target_block=30) == read(200), (by, gated)


def test_phrases_are_found_where_pairs_are_scored(spark):
    text = "Öl und Wool Scarves: the Hill Mill made wool scarves."
    rows = [page("/s", "Start", text, meta={"entities": [{"name": "Hill Mill", "type": "generic"}]}), page("/t", "Wool Scarves", "Wool Scarves of the Hill Mill", meta={"entities": [{"name": "hill mill", "type": "generic"}]}), page("/none", "Iron Pans", "made of iron")]
    p = ready(frame(spark, rows))
    ids = {r["url"][len(HOME) :]: r["page_id"] for r in p.select("url", "page_id").collect()}
    got = best_pairs(p, p, 9, spans=True, target_block=2).where(F.col("src") == ids["/s"]).collect()
    assert [r["tgt"] for r in got] == [ids["/t"]] and got[0]["length"] == len(text)
    hits = {(h["text"], h["start"], h["end"], h["variant"]) for h in got[0]["hits"]}
    assert hits == {("Wool Scarves", 7, 19, "exact"), ("Wool Scarves", 7, 19, "partial"), ("Hill Mill", 25, 34, "generic")}


def test_dry_run_row(spark):
    rows = [page("/x/one", "Bike Lamp hints", "A Bike Lamp is what riders of dark roads want; the Bike Lamp needs care.", tags=["lamp"]),
            page("/x/two", "Bike Lamp", "Test of the Bike Lamp.", tags=["lamp"], type="review", meta={"is_pillar": True, "authority_score": 0.7})]
    row = dry_run(frame(spark, rows), settings(score_floor=0.3)).first().asDict()
    assert len(row) == 9 and row["coverage"] > 0 and row["dup_target_rate"] == 0 and 0 <= row["orphan_rate"] < 1
    assert dry_run(frame(spark, rows).limit(0)).first()["coverage"] == 0


def with_roles(items, chosen, budget, role):
    """What :func:`enforce_roles` does with one source, item by item."""
    if budget <= 0 or any(x["role"] == role for x in chosen):
        return chosen
    texts = {a for c in chosen for a in c["anchors"]}
    for x in sorted((x for x in items if x["role"] == role), key=lambda x: -x["score"]):
        if x["url"] in {c["url"] for c in chosen} or texts & set(x["anchors"]):
            continue
        weakest = min(range(len(chosen)), key=lambda k: chosen[k]["score"], default=None)
        if len(chosen) < budget:
            return [*chosen, x]
        return [x if k == weakest else c for k, c in enumerate(chosen)] if chosen[weakest]["score"] < x["score"] else chosen
    return chosen


def test_roles(spark):
    rng = random.Random(1)
    rows, chosen, want, greedy = [], [], set(), set()
    budget = 3  # pages without words
    for src in range(120):
        items = [{"tgt": k, "url": f"u{rng.randrange(6)}", "role": rng.choice(["parent", "sibling", "other", "other"]), "score": rng.random(), "anchors": rng.sample("abcdefgh", rng.randrange(1, 3))} for k in range(8)]
        rows += [(src, x["tgt"], n, x["score"], (x["url"],), (0,), "", [(a.upper(), 0, 1, "exact") for a in x["anchors"]], "body", [], x["role"]) for n, x in enumerate(items, 1)]
        mine = rng.sample(items, rng.randrange(0, 4))
        chosen += [(src, x["tgt"], n) for n, x in enumerate(mine, 1)]
        for role in ("parent", "sibling"):
            mine = with_roles(items, mine, budget, role)
        want |= {(src, n, x["tgt"]) for n, x in enumerate(mine, 1)}
        best = []
        for x in sorted(items, key=lambda x: -x["score"]):
            if len(best) < budget and x["url"] not in {c["url"] for c in best} and not set(x["anchors"]) & {a for c in best for a in c["anchors"]}:
                best.append(x)
        greedy |= {(src, n, x["tgt"]) for n, x in enumerate(best, 1)}
    pairs = spark.createDataFrame(rows, "src long, tgt long, rank int, score double, t struct<url:string>, s struct<n_words:int>, reason string, anchors array<struct<text:string,start:int,end:int,variant:string>>, placement string, risk_flags array<string>, role string")
    flat = lambda df: {(r["src"], r["place"], r["tgt"]) for r in df.collect()}
    assert flat(enforce_roles(pairs, spark.createDataFrame(chosen, "src long, tgt long, place int"), settings())) == want
    links = greedy_links(pairs, settings())
    assert flat(links) == greedy and flat(enforce_roles(pairs, links, settings())) == greedy


def test_history_of_a_user(spark, tmp_path):
    kind = "id long, user_id long, domain_id long, source_excerpt string, inserted_records array<struct<term:string,url:string,priority:boolean,context:string>>, created_at timestamp"
    rows = [(1, 7, 1, "x" * 3000, [("a", "/a", True, "c"), ("b", "/b", False, "c")], datetime(2024, 5, 1, 8)), (2, 8, None, "short", None, datetime(2024, 5, 2, 9)), (3, 7, 9, None, [], datetime(2024, 5, 3, 10))]
    path = str(tmp_path / "generations")
    for row in rows:
        append_generation(spark.createDataFrame([row], kind), path)
    domains = spark.createDataFrame([(1, "https://e.com")], "id long, base_url string")
    kept = spark.read.parquet(path)
    got = [(r["id"], r["base_url"], len(r["shown"] or ""), r["made"]) for r in history(kept, domains, 7).collect()]
    assert got == [(3, None, 0, "May 3, 2024 10:00"), (1, "https://e.com", 240, "May 1, 2024 08:00")] and history(kept, domains).count() == 3
    cut = kept.where("id = 1").first()["source_excerpt"]
    assert len(cut) == 1001 and cut.endswith("…")
    totals = kept.select("id", *generation_totals(F.col("inserted_records"))).orderBy("id").collect()
    assert [tuple(r) for r in totals] == [(1, 2, 1, 1), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_uploaded_sitemaps(spark, tmp_path):
    import gzip

    body = "<urlset><url><loc>https://e.com/é</loc></url></urlset>"
    (tmp_path / "a.xml").write_bytes(body.encode())
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "c.xml").write_bytes(body.encode("latin-1"))
    (tmp_path / "d.xml.gz").write_bytes(b"no gzip")
    files = read_uploads(spark, str(tmp_path))
    got = sorted((r["id"].rsplit("/", 1)[1], r["url"]) for r in parse_sitemaps(files, "path", "xml").collect())
    assert got == [(x, "https://e.com/é") for x in ("a.xml", "b.xml.gz", "c.xml")]


def test_settings(tmp_path):
    assert overlay({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert settings(max_links_per_page=2)["max_links_per_page"] == 2


def test_read_pages(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"url": "https://e.com/a", "title": "A", "tags": ["x"]}')
    (tmp_path / "many.json").write_text('[{"url": "https://e.com/b", "html": "b"}, {"url": "https://e.com/c", "metadata": {"status_code": 302}}]')
    assert sorted(r["url"] for r in read_pages(spark, str(tmp_path)).collect()) == ["https://e.com/a", "https://e.com/b", "https://e.com/c"]


def test_priority_pairs(spark):
    text = "Alpha -> https://a.com/1\nbeta | https://a.com/2\n\ngamma, https://a.com/3\ndelta\thttps://a.com/4\nALPHA -> https://a.com/5\nMissing separator line\na, b -> x.com\n -> y.com\nq -> not a url"
    rows = K.parse_pairs(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("line_no").collect()
    good = [(r["term"], r["url"]) for r in rows if r["error"] is None]
    assert good == [("Alpha", "https://a.com/1"), ("beta", "https://a.com/2"), ("gamma", "https://a.com/3"), ("delta", "https://a.com/4"), ("a, b", "http://x.com")]
    assert [r["line_no"] for r in rows if r["error"]] == [7, 9, 10] and "Priority line 7" in rows[4]["error"]


def test_html_links():
    terms = [{"key": "olive press", "term": "Olive press", "url": "/own", "priority": True}, {"key": "stone mill", "term": "stone mill", "url": "/mill", "priority": False}]
    html = "<p>An olive PRESS stands here.</p><p>Behind it, one stone mill turns.</p>"
    out, made = insert_links(html, terms, 5)
    assert [(m["term"], m["priority"], m["context"]) for m in made] == [("Olive press", True, "An olive PRESS stands here."), ("stone mill", False, "Behind it, one stone mill turns.")]
    assert '<a href="/own" class="interlinked-anchor" data-source="priority">olive PRESS</a> stands' in out and strip_links(out) == html
    many = [{"key": x, "term": x, "url": x, "priority": x == "d"} for x in "abcd"]
    assert [m["term"] for m in insert_links("<p>a <b>b</b> <i>c</i> <u>a d</u></p><p>c</p>", many, 9, 2)[1]] == ["a", "b", "d", "c"]
    assert [m["term"] for m in insert_links("<blockquote>a b <p>c a</p></blockquote>", many, 9)[1]] == ["a", "c"] and len(insert_links("<p>a</p><p>b</p>", many, 1)[1]) == 1
    for skipped in ("<h1>stone mill</h1>", "<p><a href='x'>stone mill</a></p>", "<pre>stone mill</pre>", "<p>stone mills</p>", "<p><!-- stone mill --></p>"):
        assert insert_links(skipped, terms)[1] == []
    assert insert_links("", terms) == ("", []) and insert_links("<ul><li>a &amp; <br>b</ul>", terms)[0] == "<ul><li>a &amp; <br/>b</li></ul>"


def test_plain_links_match_html_links(spark):
    rng, words = random.Random(3), "red plate blue lamp old map new bag".split()
    docs = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(6)) for _ in range(5))) for k in range(20)] + [(99, None), (98, "")]
    terms = [(k, r, t, t, f"/{t.replace(' ', '-')}", p) for k, _ in docs for r, (t, p) in enumerate([("red plate", True), ("old map", False), ("lamp", False), ("new", False)], 1)]
    got = {r["id"]: r for r in K.link_paragraphs(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(terms, "id int, rank int, key string, term string, url string, priority boolean"), 3).collect()}
    for k, text in docs:
        html = "".join(f"<p>{x.strip()}</p>" for x in (text or "").split("\n") if x.strip())
        want = insert_links(html, [{"key": t[2], "term": t[3], "url": t[4], "priority": t[5]} for t in terms if t[0] == k], 3) if html else ("", [])
        assert got[k]["html"] == want[0] and [x["context"] for x in got[k]["inserted"]] == [x["context"] for x in want[1]]


def test_dictionary_prefers_pairs(spark):
    pairs = spark.createDataFrame([(1, 0, "Olive  Press", "/custom")], "id int, pos int, term string, url string")
    slugs = spark.createDataFrame([(1, "olive press", "/slug"), (1, "lamp", "/l"), (1, "long lamp", "/ll"), (1, " ", "/e")], "id int, slug string, url string")
    got = [(r["key"], r["url"], r["priority"]) for r in K.term_dictionary(pairs, slugs).orderBy("rank").collect()]
    assert got == [("olive press", "/custom", True), ("long lamp", "/ll", False), ("lamp", "/l", False)]


def test_matching_slugs_in_any_script(spark):
    import re

    texts = [
        (1, 1, "我们使用Spark处理数据，北京烤鸭很好吃。東京タワーへ行く"), (2, 1, "Éspark and naïve café-lamp; реклама ламп, C++ → #1!"), (3, 1, "sparks spark_x xlamp"), (4, 2, "北京 spark"), (5, 1, None), (6, 1, ""),
        (7, 1, "กรุงเทพมหานครspark ΟΔΟΣ Straße STRASSE kap\u0131 \u212ailo \U0001f600spark\U0001f600 de  luxe"), (8, None, "spark 北京"),
    ]
    slugs = ["spark", "北京", "北京烤鸭", "東京タワー", "京", "лам", "лампа", "реклама", "lamp", "cafe", "caf", "café", "c++", "→", "#1", "ve", "กรุงเทพ", "οδος", "οδοσ", "straße", "é", "Éspark", "kap", "kilo", "\U0001f600", "  ", "", "de  luxe", "，北京"]
    docs = spark.createDataFrame(texts, "id int, scope int, text string")
    got = {(r["id"], r["slug"]) for r in K.matching_slugs(docs, spark.createDataFrame([(1, x, "/" + x) for x in slugs] + [(2, "spark", "/"), (3, "北京", "/")], "scope int, slug string, url string")).collect()}
    want = set()
    for k, scope, text in texts:
        for x in slugs if scope == 1 else ["spark"] if scope == 2 else []:
            term = " ".join(x.split())
            if term and text and term.lower() in text.lower() and re.search(rf"(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])", text, re.I):
                want.add((k, x))
    assert got == want and {(1, "spark"), (1, "北京"), (1, "京"), (2, "→"), (2, "ve"), (7, "กรุงเทพ"), (7, "kilo")} <= got


def test_evaluated_pairs_keep_what_choice_reads(spark):
    corpus = frame(spark, [page(f"/p{k}", "Alpine Tent Guide", "An alpine tent guide of tents") for k in range(3)])
    _, evaluated, _, _ = batch(corpus, None, settings(score_floor=0.0))
    kept = {f.name: f.dataType.names if f.name in "st" else None for f in evaluated.schema}
    assert kept["s"] == ["n_words"] and kept["t"] == ["url"] and not {"f_semantic", "first_entity"} & set(kept)


def test_titles_alone(spark):
    names = ["the red lamp", "the lamp", "red red lamp of the north", "a lamp", "the", "", "north star", "the red lamp", "blue star of the north", "lamp lamp the"]
    rows = [page(f"/{n}", names[n * 7 % len(names)] + (f" x{n % 13}" if n % 3 else ""), f"text the {n}", noindex=n % 9 == 0) for n in range(90)]
    p = ready(frame(spark, rows))
    for gated in (False, True):
        read = lambda **more: sorted((r["src"], r["rank"], r["tgt"], round(r["title_bm25"], 6)) for r in best_pairs(p, p, 4, "title_bm25", 0.0, 6, gated, **more).collect())  # noqa: B023, E731
        want = read()
        assert len(want) > 200 and read(alone=True) == want == read(alone=True, source_block=17, target_block=11)
    with pytest.raises(ValueError):
        best_pairs(p, p, 4, alone=True)


def _mixed(n):
    """Pages of several languages, types, tags and entities (stated, repeated, none), of which some are alike."""
    rng, words = random.Random(11), "lamp stone north river mill tent guide best plate old red map".split()
    for k in range(n):
        named = [{"name": rng.choice(["Olm", "olm", "Brenn", "Kar Del"]), "type": rng.choice(["brand", "product", None])} for _ in range(rng.choice([0, 2, 3]))]
        yield page(
            f"/{k}", " ".join(rng.choices(words, k=rng.choice([0, 2, 4]))), " ".join(rng.choices(words + ["Olm", "Brenn", "the", "of"], k=rng.choice([0, 5, 30]))), lang=rng.choice(["en", "en", "de", "it", None]),
            tags=rng.sample(["a", "B", "b", "c", "d"], rng.choice([0, 1, 3])), type=rng.choice(["blog", "review", "product", "category"]), noindex=k % 11 == 0,
            meta={"entities": named or None, "taxonomy": rng.choice([[], ["r"], ["r", "s"]]), "outbound_links": [HOME + f"/{k + 1}"], "inlinks": float(k)})


def test_attributes_come_with_pairs_without_a_join(spark):
    p = ready(frame(spark, list(_mixed(70))))
    got = R.candidates(p, p, settings(max_candidates=9))
    want = R.with_pages(best_pairs(p, p, 9), p, p)
    rows = lambda df: sorted(map(str, df.select("src", "rank", "tgt", "recall", "s", "t", "first_entity").collect()))
    assert rows(got) == rows(want) and 300 < len(rows(got)) and any("first_entity=Row" in x for x in rows(got))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    some = R.candidates(p, p, settings(max_candidates=9), True, ["url"], ["taxonomy"], False)
    assert some.schema["s"].dataType.names == ["url"] and some.schema["t"].dataType.names == ["taxonomy"] and "first_entity" not in some.columns


def test_lists_that_cannot_reach_are_passed_over(spark):
    p = ready(frame(spark, list(_mixed(260))))
    for gated in (False, True):
        every = best_pairs(p, p, 400, gated=gated).select("src", "tgt", F.round("recall", 9).alias("recall")).collect()
        of = {}
        for r in every:
            of.setdefault(r["src"], []).append((-r["recall"], r["tgt"]))
        want = sorted((k, n, t) for k, x in of.items() for n, (_, t) in enumerate(sorted(x)[:3], 1))
        for size in (300, 90, 40):
            got = best_pairs(p, p, 3, gated=gated, source_block=100, target_block=size)
            assert sorted((r["src"], r["rank"], r["tgt"]) for r in got.collect()) == want
    assert len(want) > 500


def test_texts_alone(spark):
    p = ready(frame(spark, list(_mixed(120))))
    read = lambda **more: sorted((r["src"], r["rank"], r["tgt"], round(r["body_bm25"], 6)) for r in best_pairs(p, p, 4, "body_bm25", 0.0, 6, False, **more).collect())
    want = read()
    assert len(want) > 200 and read(alone=True) == want == read(alone=True, source_block=17, target_block=11)
    assert all(r["title_codes"] == [] and r["body_codes"] for r in ready_field(frame(spark, [page("/x", "Lamp", "a lamp")]), "body").collect())


def test_chunks_of_texts_that_cannot_reach_are_passed_over(monkeypatch):
    rng, n = np.random.default_rng(5), 1200
    body = [rng.integers(60 * (k % 6), 60 * (k % 6) + 60, 40) * (k % 50 > 0) + (k % 50 == 0) * rng.integers(0, 500, 40) for k in range(n)]  # six topics, some texts of all
    none, zero = [[]] * n, np.zeros(n, np.int64)
    rows = pa.table({
        "page_id": np.arange(n), "title_codes": pa.array(none, pa.list_(pa.int64())), "body_codes": pa.array(body, pa.list_(pa.int64())), **{f"{f}_codes": pa.array(none, pa.list_(pa.int64())) for f in ("tag", "entity")},
        "entity_weights": pa.array(none, pa.list_(pa.float64())), **{c: zero for c in ("lang_code", "canonical_code", "url_code")}, **{c: zero == 1 for c in ("is_guide", "is_product", "is_review")}, "open": zero == 0})
    code, df = np.unique(np.concatenate([np.unique(x) for x in body]), return_counts=True)
    facts = {"n": n, "title": 1.0, "body": 40.0, "by": "body_bm25", "floor": 0.0, "digits": 6, "gated": False, "same": True, "k": 5, "alone": True}
    multiplied, fill = [], B._Block._fill
    monkeypatch.setattr(B, "CHUNK", 16)
    monkeypatch.setattr(B._Block, "_fill", lambda self, out, asked, wanted: (multiplied.append(sum(wanted[:, c].sum() * (x[1] - x[0]) for c, x in enumerate(self.chunks))), fill(self, out, asked, wanted)))
    sources = B._Sources(rows, facts)
    for part in (rows.slice(0, 900), rows.slice(900)):
        sources.meet(B._index(part, pa.table({"code": code, "df": df}), facts))
    got = {}
    for r in sources.table().to_pylist():
        got.setdefault(r["src"], []).append(r["tgt"])
    assert sum(multiplied) < 0.6 * n * n
    idf, tf = np.log(1 + (n - df + 0.5) / (df + 0.5)), np.stack([(np.asarray(x)[:, None] == code).sum(0) for x in body])
    all_scores = np.round(tf @ (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * np.array([len(x) for x in body]) / 40.0)[:, None])).T, 6)
    np.fill_diagonal(all_scores, 0.0)
    assert got == {k: [int(t) for t in np.lexsort((np.arange(n), -x))[:5] if x[t] > 0] for k, x in enumerate(all_scores)}


def test_blocks_scored_together_give_the_same_pairs(spark):
    p = ready(frame(spark, list(_mixed(240))))
    words = p.select(F.explode(F.array_union("title_codes", "body_codes")).alias("code")).groupBy("code").agg(F.count("*").alias("df")).toArrow()
    rows = p.select(*B.FACTS, "is_review", "is_guide", "is_product", "open").toArrow()
    facts = {"n": 240, "title": 2.0, "body": 12.0, "by": "recall", "floor": 0.05, "digits": 9, "gated": True, "same": True, "k": 6, "alone": False}
    parts = [B._index(rows.filter(pa.array(np.arange(240) % 5 == k)), words, facts) for k in range(5)]
    found = []
    for together in (1, 2, 3, 5):
        sources = B._Sources(rows, facts)
        for k in range(0, 5, together):
            sources.meet(B._joined(parts[k : k + together]))
        table = sources.table()
        found.append([table.select(["src", "tgt", "rank", "first_pos"]).to_pylist(), np.stack([table.column(c).to_numpy() for c in ("title_bm25", "body_bm25", "cosine", "entity", "tag", "recall")])])
    assert len(found[0][0]) > 1000 and all(x[0] == found[0][0] and np.allclose(x[1], found[0][1], rtol=0, atol=1e-12) for x in found)


def test_terms_meet_texts_by_their_rarest_word(spark):
    slugs = spark.createDataFrame([(1, f"The lamp of  row{n}", "/") for n in range(50)] + [(1, "the lamp", "/"), (2, "the", "/"), (1, "灯 the x", "/"), (1, "灯台", "/")], "scope int, slug string, url string")
    named, other = K.term_heads(slugs)
    got = {(r["scope"], r["slug"]): r["head"] for r in named.collect()}
    assert all(got[1, f"The lamp of  row{n}"] == f"ROW{n}" for n in range(50)) and (got[1, "the lamp"], got[2, "the"], got[1, "灯 the x"]) == ("LAMP", "THE", "X")
    assert [(r["slug"], r["head"]) for r in other.collect()] == [("灯台", "灯台")]
    docs = spark.createDataFrame([(1, 1, "see the lamp OF row7, the 灯 the x"), (2, 1, "row7 of the lamp")], "id int, scope int, text string")
    assert {(r["id"], r["slug"]) for r in K.matching_slugs(docs, slugs).collect()} == {(1, "the lamp"), (1, "The lamp of  row7"), (1, "灯 the x"), (2, "the lamp")}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [("a", f"<urlset {ns}><url><loc> https://e.com/one </loc></url><url><loc>https://e.com/two</loc></url></urlset>"), ("i", f"<sitemapindex {ns}><sitemap><loc>https://e.com/child.xml</loc></sitemap></sitemapindex>"), ("bad", "<urlset><loc>"), ("null", None), ("empty", "")]
    df = spark.createDataFrame(docs, "id string, xml string")
    seen = fetch_sitemaps(spark.createDataFrame([("https://e.com/child.xml",), (None,), ("https://e.com/none",)], "u string"), "u", lambda u, t: (b"<urlset><url><loc>/child</loc></url></urlset>", "text/xml", None) if "child" in u else None)
    got = sorted((r["id"], r["url"]) for r in parse_sitemaps(df, "id", "xml", seen).collect())
    assert got == [("a", "https://e.com/one"), ("a", "https://e.com/two"), ("i", "/child")]
    import gzip

    assert decoded(gzip.compress(b"x"), "s.xml.gz") == "x" and decoded(b"\xe9", "s.xml") == "é" and decoded(b"x", "s.gz") == "x"
    r = spark.range(1).select(sitemap_source(F.lit(None), F.lit(""), F.lit("https://e.com/")).alias("s")).first()["s"]
    assert r == "https://e.com/sitemap.xml"


def test_link_table(spark):
    urls = spark.createDataFrame([(0, "https://E.com/a/First-Slug/"), (1, "/rel/second_slug"), (2, "https://other.com/x"), (3, "https://e.com/")], "pos int, url string")
    got = [(r["base_url"], r["raw_slug"], r["slug"]) for r in import_links(urls, None).orderBy("raw_slug").collect()]
    assert got == [("https://E.com", "", ""), ("https://E.com", "First-Slug", "first slug"), ("https://E.com", "second_slug", "second slug")]
    with pytest.raises(ValueError):
        import_links(urls.where("pos = 1"), None)
    old = spark.createDataFrame([(1, "u", "s", 10, 0)], "d int, url string, slug string, made int, n int")
    new = spark.createDataFrame([(1, "u", "t", 20, 1), (1, "u", "v", 30, 2), (1, "w", "x", 40, 3)], "d int, url string, slug string, made int, n int")
    assert sorted(map(tuple, upsert_links(old, new, ["d", "url"], ["slug"], ["made"], "n").collect())) == [(1, "u", "v", 10), (1, "w", "x", 40)]
    links = spark.createDataFrame([(1, 1, "a", "Foo bar", None, "T"), (2, 2, "b", "x", "FOO", None), (3, 1, "c", None, None, None)], "id int, domain_id int, url string, slug string, raw_slug string, title string")
    assert [r["id"] for r in search_links(links, "foo").collect()] == [1, 2] and search_links(links, "foo", "1").count() == 1 and search_links(links, "foo", "zz").count() == 2
    assert slug_map(links).count() == 2


def test_database_urls():
    o = jdbc_options("postgres://me:p%40s@db:5432/app?x=1", require_ssl=True)
    assert o == {"url": "jdbc:postgresql://db:5432/app", "driver": "org.postgresql.Driver", "user": "me", "password": "p@s", "sslmode": "require", "x": "1"}
    with pytest.raises(ValueError):
        jdbc_options("oracle://x/y")


def test_throttle(spark, tmp_path):
    assert admit([1, 2, 3], [], 2, 60)[0] == [True, True, False]
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.choice(["x", None]), rng.randrange(400)) for k in range(500)] + [(500, "a", "x", None)]
    df = spark.createDataFrame(rows, "hit int, route string, ip string, us long")
    got = {r["hit"]: r["admitted"] for r in admitted(df, ["route", "ip"], ["us", "hit"], 3, 50).collect()}
    for key in {(r[1], r[2]) for r in rows}:
        mine = sorted((r[3], r[0]) for r in rows if (r[1], r[2]) == key and r[3] is not None)
        live = []
        for t, hit in mine:
            live = [x for x in live if x > t - 50]
            assert got[hit] == (len(live) < 3)
            if got[hit]:
                live.append(t)
    # a hot key with bursts and quiet times is cut into several stretches with the same decisions
    times = sorted(rng.randrange(0, 4000) for _ in range(900)) + [10_000 + k // 3 for k in range(200)]
    hot = spark.createDataFrame([(k, "a", None, t) for k, t in enumerate(times)], "hit int, route string, ip string, us long")
    for limit, window in ((14, 50), (12, 50), (30, 100), (1, 7), (0, 50)):
        want = admit(times, [], limit, window)[0]
        rows = admitted(hot, ["route", "ip"], ["us", "hit"], limit, window).collect()
        assert [r["admitted"] for r in sorted(rows, key=lambda r: r["hit"])] == want and len(rows) == len(times)
    assert 3 < stretches(hot, ["route", "ip"], "us", 30, 100).select("__stretch").distinct().count()
    assert got[500] is False and admitted(df.limit(0), ["route", "ip"], ["us", "hit"], 3, 50).count() == 0
    assert spark.range(1).select(client_ip(F.lit("1.2.3.4, 5"), F.lit("9")).alias("a"), client_ip(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("b")).first() == ("1.2.3.4", "0.0.0.0")


def test_throttle_stream(spark, tmp_path):
    """Times of two files, read a file a batch: state outlives the pause between batches and leaves by event time."""
    at = lambda k: f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"
    rows = [[("r", "i", at(k)) for k in (0, 1, 2, 3)] + [("r", "j", at(0))], [("r", "i", at(k)) for k in (30, 61, 62, 63)], [("r", "j", at(300)), ("r", "i", at(301))]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "route string, ip string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = "route string, ip string, ts timestamp"
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        q = admitted_stream(stream, 2, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["ip"], r["ts"].minute * 60 + r["ts"].second, r["admitted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("i", 0, True), ("i", 1, True), ("i", 2, False), ("i", 3, False), ("i", 30, False), ("i", 61, True), ("i", 62, True), ("i", 63, False), ("i", 301, True), ("j", 0, True), ("j", 300, True)]
