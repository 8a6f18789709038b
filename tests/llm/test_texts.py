"""Languages, main content, mixtures and sentences on held-out rows, fixtures and edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm.languages import fit_model, line_languages, page_languages, segments, stated_language
from linkspark.llm.main_content import blocks, common_words, evidence, line_key, line_roles, main_texts, matched, render
from linkspark.llm import mixture
from linkspark.llm.mixture import Marginals, mix_sources, rake, rake_table, token_counts
from linkspark.llm.sentences import sentence_units

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def units(spark, rows, **bounds):
    df = spark.createDataFrame(rows, "at long, t string")
    got = {}
    for r in sentence_units(df, "at", "t").collect():
        got.setdefault(r["id"], []).append((r["start_off"], r["end_off"]))
    return {k: [t[a:b] for a, b in sorted(got.get(k, []))] for k, t in rows if t is not None}


def test_sentences(spark):
    first = "Subject. Still one! unit\n\n"
    cases = {
        1: (first + "Dr. A. B. Smith paid 3.5 vs. 4. Then e.g. this, etc. in all.\nNext line goes on. See https://a.example/x.y?z=1. were it so.", ["Dr. A. B. Smith paid 3.5 vs. 4.", "Then e.g. this, etc. in all.", "Next line goes on.", "See https://a.example/x.y?z=1. were it so."]),
        2: (first + 'She asked "Does it? I doubt it." in May. (It is. Really.) Why?! No...\n\n* one. two.\n* three\n1. four', ['She asked "Does it? I doubt it." in May.', "(It is. Really.)", "Why?!", "No...", "one. two.", "three", "four"]),
        3: (first + "Am 3. Mai z. B. kam er (vgl. Abb. 3). „Ja. Nein.“ sagte er. Ende", ["Am 3. Mai z. B. kam er (vgl. Abb. 3).", "„Ja. Nein.“ sagte er.", "Ende"]),
        4: (first + "バージョン2.8.2では、測りました！「はい。いいえ。」と言いました。次です", ["バージョン2.8.2では、測りました！", "「はい。いいえ。」と言いました。", "次です"]),
        5: (first + "他问：“这样吗？”我们走。好", ["他问：“这样吗？”", "我们走。", "好"]),
        6: (first + "ทีมงานของ Lumor ทำความ ในรุ่น 7.1 คณะ\nกรรม", ["ทีมงานของ Lumor ทำความ", "ในรุ่น 7.1 คณะ\nกรรม"]),
        7: (first + "डॉ. राम आए। वे गए। क्या?", ["डॉ. राम आए।", "वे गए।", "क्या?"]),
        8: (first + "lower case. the next one. pause... then on. at 5 p.m. and later.", ["lower case.", "the next one.", "pause... then on.", "at 5 p.m. and later."]),
        10: (first + "One\ue001two\ue000. Three four.\ue001 Five.", ["One\ue001two\ue000.", "Three four.\ue001 Five."]),
        11: (first + "See https://a.example/" + "x.y" * 400 + ". It ends. At http://b.example/" + "p.q" * 400 + ". and on. Das z." + " " * 40 + "B. hier, d.h. dort. Ecco ad   es. Roma, poi. Fine", ["See https://a.example/" + "x.y" * 400 + ".", "It ends.", "At http://b.example/" + "p.q" * 400 + ". and on.", "Das z." + " " * 40 + "B. hier, d.h. dort.", "Ecco ad   es. Roma, poi.", "Fine"]),
        9: (first + "🎉 Emoji first. Second 🎉 one.", ["🎉 Emoji first.", "Second 🎉 one."]),
    }
    got = units(spark, [(k, t) for k, (t, _) in cases.items()] + [(20, None), (21, ""), (22, " \n\t\n "), (23, "only")])
    for k, (_, want) in cases.items():
        assert got[k] == ["Subject. Still one! unit", *want], k
    assert got[21] == got[22] == [] and got[23] == ["only"]


def test_sentence_bounds_and_long_texts(spark):
    long = "Head\n" + "It goes on and on. " * 3000
    df = spark.createDataFrame([(1, "xx Head. a\n\nOne. Two. yy", 3, 20), (2, long, None, None), (3, "abc", -5, 99), (4, "abc", 3, 1)], "kind long, t string, a int, b int")
    rows = sentence_units(df, "kind", "t", "a", "b").collect()
    one = sorted((r["start_off"], r["end_off"]) for r in rows if r["id"] == 1)
    assert one == [(3, 10), (12, 16), (17, 20)]
    assert sum(r["id"] == 2 for r in rows) == 3001 and [(r["start_off"], r["end_off"]) for r in rows if r["id"] == 3] == [(0, 3)] and not [r for r in rows if r["id"] == 4]
    assert sentence_units(df.limit(0), "kind", "t").count() == 0


def test_stated_language(spark):
    cases = {"en": "en", " EN-us ": "en", "de_AT": "de", "ger": "de", "deu": "de", "French": "fr", "zh-Hans": "zh", "und": None, "mul": None, "??": None, "": None, None: None, "xx": None, "english ": "en"}
    df = spark.createDataFrame([(k,) for k in cases], "lang string").select("lang", stated_language(F.col("lang")).alias("c"))
    assert {r["lang"]: r["c"] for r in df.collect()} == cases


@needs_data
def test_language_model_on_held_out_samples(spark):
    rows = spark.read.parquet(f"{SF}/lang_sample.parquet")
    held = F.col("sample_id") % 4 == 0
    model = fit_model(rows.where(~held))
    test = rows.where(held).select(F.col("sample_id").alias("page_id"), "lang", "text")
    main = page_languages(line_languages(test, "page_id", "text", model))
    right = main.join(test.withColumnRenamed("page_id", "id"), "id").where("lang = lang_code").count()
    assert right >= 0.99 * test.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... \n !!"), (None, "text"), (4, "Unser Test des Filters erklärt den Stadtplan in der Altstadt. Le petit atelier compare la lourde bague en laiton malgré la pluie.")], "page_id long, text string").withColumn("lang_code", F.lit("x"))
    got = {(r["id"], r["lang_code"]) for r in line_languages(odd, "page_id", "text", model).where("counts").collect()}
    assert got == {(4, "de"), (4, "fr")}
    assert line_languages(odd.limit(0), "page_id", "text", model).count() == 0


def test_segments_of_short_lines():
    assert segments("これは短い文です the quick brown fox jumps") == ["これは短い文です", "the quick brown fox jumps"]
    assert segments("") == [""]


HTML = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a href=1>Home</a><a href=2>About</a></nav>
<div class="x"><h1>Head</h1><p>First <b>bold</b> text.<p>Second.<div class=ad>Buy now</div><ul><li>one<li>two</ul><blockquote>Said.</blockquote>
<p style="display: none">hidden</p><table><tr><td>a<td>bbb<tr><td>cccc</td><td>d</td></tr></table></div><aside>Aside</aside><h3>More</h3><li><a href=#>Teaser</a></li><footer>Foot</footer></body></html>"""


def test_rendering():
    texts = [b.text for b in blocks(HTML)]
    assert texts == ["Home About", "Head", "First bold text.", "Second.", "Buy now", "one", "two", "Said.", "a", "bbb", "cccc", "d", "Aside", "More", "Teaser", "Foot"]
    shown = render(HTML)
    assert "- one\n- two" in shown and "a     bbb\ncccc  d" in shown and "First bold text.\n\nSecond." in shown
    text = "Home · About\nHead\nFirst bold text.\nSecond.\nBuy now\none\ntwo\nSaid.\nAside\nMore\nTeaser\nFoot\nunknown"
    against = evidence(blocks(HTML))
    # nothing but its class speaks against the notice amid the text, which repetition alone can tell
    assert [None if k is None else against[k] < 2 for _, _, k in matched(blocks(HTML), text)] == [False, True, True, True, True, True, True, True, False, False, False, False, None]
    for broken in ("", "<", "<p", "</p></div>", "<b><i>x</b></i>", "<td>x", "<!-- x", "<script>x", "&amp;&bogus;", "<li>" * 500 + "x"):
        evidence(blocks(broken)), render(broken)
    assert line_key("A b-C. 1") == "abc1"


def test_line_roles_edges(spark):
    rows = [(1, "Head", HTML, "Home · About\nHead\n\nSecond.\nFoot"), (2, None, None, "Foot\nSome text that no page has"), (3, "x", "", ""), (4, "x", HTML, None), (None, "x", HTML, "Head"), (5, "Head", "<p", "Head")]
    df = spark.createDataFrame(rows, "page_id long, title string, html string, text string").withColumn("main", F.lit("clash")).withColumn("key", F.lit(1))
    got = {(r["id"], r["line_no"]): r["main"] for r in line_roles(df).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): False, (1, 2): True, (1, 4): True, (1, 5): False} and got[(5, 1)] is True
    assert {k[0] for k in got} == {1, 2, 5} and line_roles(df.limit(0)).count() == 0


def test_main_texts(spark):
    page = "<body><nav>Home</nav><h1>Head</h1><p>One.</p><ol><li>a<li>b</ol><table><tr><td>x<td>yy<tr><td>zzz<td>w</table><aside>Ad</aside></body>"
    rows = [(1, "Head", page, "Home\nHead\nOne.\nAd"), (2, "Own", None, "Menu\nOwn\nWords of it.\nAd"), (3, "Head", page, None), (4, "x", None, None), (5, "Own", "<p", "Own"), (None, "x", page, "Head")]
    got = {r["id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, title string, html string, text string")).collect()}
    body = "Head\n\nOne.\n\n1. a\n2. b\n\nx    yy\nzzz  w"
    assert got == {1: body, 2: "Own\n\nWords of it.", 3: body, 4: "", 5: "Own"}


def test_headings_and_common_words_of_all_pages(spark):
    page = "<body><h1>{0}</h1><p>Some words of {0} and Zanzibar.</p><aside><h3>Read {1} too</h3><a href=x>{0} again</a></aside></body>"
    head = lambda k: "Head" + "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(k, head(k), page.format(head(k), f"n{k % 20}"), f"{head(k)}\nSome words of {head(k)} and Zanzibar.\nRead n{k % 20} too") for k in range(200)]
    hidden = [(1000 + k, "Own", None, f"Own\nSome words of Own.\nRead n{k} too\nSome words of Own here.") for k in range(20)]
    got = line_roles(spark.createDataFrame(rows + hidden, "page_id long, title string, html string, text string"), fit_pages=4).where("id >= 1000 and not main").collect()
    assert sorted((r["id"], r["line_no"]) for r in got) == [(1000 + k, n) for k in range(20) for n in (3, 4)]
    lines = spark.createDataFrame([(["Zanzibar", f"Rare{k}"],) for k in range(500)] + [(None,)], "words array<string>")
    assert common_words(lines, 500) == {"Zanzibar"}


REAL = """<html><body><header class="site"><a href="/">Shop</a></header><nav id="m"><a href="/a">A</a><a href="/b">B</a></nav><article class="post" role="main"><header class="top"><h1 class="title">{0}</h1>
<span class="meta">By Ann, 3 min of reading</span></header><div class="content"><p class="lead">Lead of {0} in {1}, which runs on for a while.</p><h3 id="s1" class="sub">Part of {0}</h3><p id="p3">Third text of {0} with a <a href="x">link</a> in it.</p>
<div class="box">Free delivery this week only.</div><blockquote class="q">Quoted words of {0}.</blockquote><ul class="specs"><li class="i">Weight {1} kg</li><li>Height of {0}</li></ul><h4>Last part of {0}</h4><p>{0} ends here.</p></div></article>
<h3>More stories</h3><div class="t"><a href="y">Other story {1}</a></div><footer>Imprint</footer></body></html>"""


def test_main_content_of_pages_with_classes(spark):
    """A class, id or role is no reason by itself; subheads of any level stay; repeated notices go."""
    names = [f"Tale{x}" for x in "abcdefghijkl"]
    lines = "Shop\n{0}\nBy Ann, 3 min of reading\nLead of {0} in {1}, which runs on for a while.\nPart of {0}\nThird text of {0} with a link in it.\nFree delivery this week only.\nQuoted words of {0}.\nWeight {1} kg\nHeight of {0}\nLast part of {0}\n{0} ends here.\nMore stories\nOther story {1}\nImprint"
    rows = [(k, 1, x, REAL.format(x, k), lines.format(x, k)) for k, x in enumerate(names)]
    df = spark.createDataFrame(rows, "page_id long, domain_id long, title string, html string, text string")
    got = {}
    for r in line_roles(df).collect():
        got.setdefault(r["id"], []).append((r["line_no"], r["main"]))
    outside = {1, 3, 7, 13, 14, 15}
    assert all({n for n, main in v if not main} == outside and len(v) == 15 for v in got.values()) and len(got) == 12
    body = {r["id"]: r["text"] for r in main_texts(df).collect()}[3]
    assert body == "Taled\n\nLead of Taled in 3, which runs on for a while.\n\nPart of Taled\n\nThird text of Taled with a link in it.\n\nQuoted words of Taled.\n\n- Weight 3 kg\n- Height of Taled\n\nLast part of Taled\n\nTaled ends here."


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_rake():
    langs, topics = ["de", "en"], ["x", "y"]
    tokens = np.array([[0, 500, 1000, 0], [50, 0, 0, 100], [0, 0, 0, 0.0]])
    share = lambda k: tokens.reshape(3, 2, 2).sum(axis=(0, k)) / tokens.sum()
    use, _, _ = rake(tokens, np.array([1.0, 2, 3]), np.array([400.0, 400, 80]), Marginals(langs, topics, share(2), share(1)))
    assert abs(use[0].sum() - 400) < 1e-6 and use[1].sum() == 300 and use[2].sum() == 0 and (use <= tokens * [[1], [2], [3]]).all()


def test_rake_meets_marginals_in_both_ways(spark):
    rng = np.random.default_rng(3)
    tokens = np.round(rng.gamma(0.5, 400, (40, 6)))
    repeats, goal = rng.integers(1, 6, 40).astype(float), tokens.sum(axis=1) * rng.uniform(0.2, 1.5, 40)
    make = lambda: Marginals(["a", "b", "c"], ["x", "y"], np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]))
    use, _, done = rake(tokens, repeats, goal, make())
    assert done and np.allclose(use.sum(axis=1), np.minimum(goal, (tokens * repeats[:, None]).sum(axis=1)))
    cube = use.reshape(-1, 3, 2).sum(axis=0) / use.sum()
    assert np.allclose(cube.sum(axis=1), [0.5, 0.3, 0.2], atol=1e-5) and np.allclose(cube.sum(axis=0), [0.6, 0.4], atol=1e-5)
    rows = spark.createDataFrame([(f"s{k:02d}", [float(x) for x in tokens[k]], float(repeats[k]), float(goal[k])) for k in range(40)], "source string, tokens array<double>, repeats double, goal double")
    for limit in (100, 5):
        table, _, done = rake_table(rows, make(), precision=1e-3, local_rows=limit)
        got = {r["source"]: r["use"] for r in table.collect()}
        assert done and np.allclose([got[f"s{k:02d}"] for k in range(40)], use, rtol=0.05, atol=2)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_mixture(spark, monkeypatch):
    rows = [(k, "word " * (k % 7 + 1), s, "en") for k, s in enumerate([" Big", "big", "BIG ", "small", None, "other"] * 60)] + [(9999, None, "big", None), (9998, "", "small", "und"), (None, "x", "big", "xx")]
    docs = spark.createDataFrame(rows, "tokens long, copies string, weight string, topic string")
    counts = token_counts(docs, "tokens", "copies", "weight", "topic", VOCABULARY).cache()
    goal = spark.createDataFrame([("big", 0.3, 1), ("Small ", 0.7, 2), ("none", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(counts, goal)
    r = {x["source"]: x for x in mix.report.collect()}
    total = counts.agg(F.sum("tokens")).first()[0]
    assert set(r) == {"big", "small", "none"} and r["small"]["short"] and r["none"]["short"] and not r["big"]["short"] and mix.converged
    assert r["small"]["mix_tokens"] == 2 * r["small"]["tokens"] and abs(r["big"]["mix_tokens"] - 0.15 * total) < 0.1 * total and abs(sum(x["mix_share"] for x in r.values()) - 1) < 1e-9
    assert mix.sample.where("copies > 2 or (source = 'big' and copies > 1)").count() == 0
    assert {(s["kind"], s["name"]) for s in mix.shares.collect()} >= {("language", "en"), ("topic", "none")}
    empty = mix_sources(counts.limit(0), goal)
    assert empty.report.agg(F.sum("mix_tokens")).first()[0] == 0 and empty.sample.count() == 0
    many = spark.createDataFrame([(f"s{k}", 0.0001, 1) for k in range(3000)] + [("big", 0.3, 1)], "source string, target_share double, max_repeats int")
    assert mix_sources(counts, many).report.where("not short").select("source").collect()[0][0] == "big"
    with pytest.raises(FileNotFoundError):
        token_counts(docs, "tokens", "copies", "weight", "topic", "/no/such/file")
    # what is short comes from the fitted uses
    monkeypatch.setattr(mixture, "rake", lambda t, *_: (t * 0, 1, True))
    assert mix_sources(counts, goal).report.where("short").count() == 3


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_mixture_to_language_shares(spark):
    rows = [(k, f"word {k}", "a" if k % 3 else "b", "en" if k % 5 else "de") for k in range(600)]
    counts = token_counts(spark.createDataFrame(rows, "id long, t string, s string, l string"), "id", "t", "s", "l", VOCABULARY)
    goal = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    mix = mix_sources(counts, goal, languages=spark.createDataFrame([("DE ", 0.5), ("en", 0.5), ("fr", 0.3)], "l string, s double"))
    got = {r["name"]: (r["wanted"], r["fitted"]) for r in mix.shares.where("kind = 'language'").collect()}
    assert mix.converged and set(got) == {"de", "en"} and all(abs(w - 0.5) < 1e-9 and abs(f - 0.5) < 1e-4 for w, f in got.values())
