import html
import re

import corpus_pipeline
from loomset.llm import decontamination, htmltext, langid, minhash

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body><header class="site-header">Site</header><div class=menu><a href=x>Home</a> | <a href=y>About</a></div>
<main><header><h1>Title &amp; more</h1></header><p>Hello <b>bo</b>ld&nbsp;text. <p>Sh is.<script>var t="</p>";</script><div class="comments"><p>what a reader says about the article is here</div>
<ul class="related"><li><a href=1>x</a></ul><aside>side</aside><p>Last <a href="/a>b">one</a><br>line</main><div id="cookie-notice">we use the cookies of the site</div><form>in <input> the</form>&am"""
PLAIN = """<body><div id="sidebar">the of and to in is it was he for on are as with his they at be this from</div><div><p>Short one.</p>
<p>the of and to in is it was he for on are as with his they at be this from have or by one had not but what all</p><p>Tiny end.</p></div>
<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>After it</p><div class="footer">copyright</div>"""


def test_blocks_and_labels():
    assert htmltext.main_text(PAGE) == "Title & more Hello bold text. Sh is. Last one line"
    text = htmltext.main_text(PLAIN)
    assert text.startswith("Short one. the of") and text.endswith("Tiny end.")
    assert [htmltext.main_text(x) for x in (None, "", "<", "<p", "plain", "<script>x", "<!-- a")] == ["", "", "<", "", "plain", "", ""]
    assert htmltext.main_text("<article>" + "<p>a b " * 3000) == " ".join(["a b"] * 3000)
    assert htmltext.main_text('<article class="post-header"><p>kept</p><p class="entry-header">also</p></article>') == "kept also"


def test_what_stands_in_an_article_and_is_not_of_it():
    """Comments, adverts and the like go under whatever name; the article's own class, its title and its links in sentences stay."""
    keep = "<p>one two</p>"
    for name in ("post-comments", "post__comments", "article-sidebar", "story-ad", "story-share", "entry-related", "commentlist", "pageFooter", "socialBar", "entry-footer", "comment-thread open", "sponsored", "widgets"):
        assert htmltext.main_text(f'<article class="post">{keep}<div class="{name}"><p>the of and to in is it</p></div>{keep}</article>') == "one two one two", name
    for inside in ('<div id="content-footer">x</div>', '<b class="ad">x <b>y</b> z</b>', "<div hidden>x</div>", '<div style="display: none">x</div>', '<p aria-hidden="true">x</p>', '<script src="a.js>var x=1;</script>', "<style media='x>p{}</style >", "<ul><li><a href=1>Next</a></ul>", "<p><a href=2>Read more</a></p>", '<span class="share-links"><i>x</i></span>', '<p role="navigation">x'):
        assert htmltext.main_text(f"<article>{keep}{inside}</article>") == "one two", inside
    assert htmltext.main_text(f'<main class="content has-sidebar">{keep}<div class="no-comments"><p>a</div></main>') == "one two a"
    assert htmltext.main_text('<article class="story ad-free"><div class="post-header"><h1><a href=1>T</a></h1></div><p>a <a href=x>b</a><span class="ad">no</span>c</article>') == "T a bc"
    assert htmltext.main_text('<body style="visibility:hidden"><p hidden="">x<article><p>shown') == "shown"


def test_pages_in_languages_without_stop_words():
    words = " ".join(["слово", "речь", "мир", "дом"] * 10)
    assert htmltext.main_text(f'<div class="menu">нет</div><div><p>{words}</p><p>кратко</p></div><div><a href=1>{words}</a></div>') == words + " кратко"


def test_empty_pages_and_other_columns(spark):
    rows = [(1, "u", "<p>a &lt; b</p>", 7, "t"), (1, "u", "<p>a &lt; b</p>", 7, "t"), (None, None, "<p>" + "long " * 1_000_000, 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    found = htmltext.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and htmltext.extract(pages.limit(0)).count() == 0
    assert sorted((r["n_chars"], r["text"][:5]) for r in found.collect()) == [(5, "a < b"), (5, "a < b"), (4_999_999, "long ")]


def test_second_pass_takes_the_nearest_decided_label():
    block = lambda n: htmltext.Block(" ".join(["w"] * n), 0, htmltext.FREE, False, False)
    found = [block(20), block(3), block(2), block(20)]
    assert htmltext.second_pass(found, [1, -1, -1, 0]) == [1, 1, 0, 0]
    assert htmltext.second_pass(found[:2], [-1, -1]) == [1, 1] and htmltext.second_pass(found, [0, -1, -1, 0]) == [0, 0, 0, 0]


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", "&#xD800;<p>x"), (-2, "u", "&#xD800;<p>x")], "page_id long, url string, html string")
    found = htmltext.extract(pages.select("page_id", "url", "html").union(odd)).collect()
    by = {r["page_id"]: r for r in found}
    assert len(found) == pages.count() + 3 and (by[-1]["text"], by[-1]["n_chars"]) == ("", 0)
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1]
        expected = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert (by[page["page_id"]]["text"], by[page["page_id"]]["n_chars"]) == (expected, len(expected))


def test_pipeline_equals_its_stages_by_hand(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    now, held = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), now.schema)
        held.append({r["doc_id"]: r for r in now.collect()})
    start = {r["doc_id"]: r for r in docs.collect()}
    language, near, clean, private = held
    assert set(language) == {i for i, r in start.items() if any(c.isalpha() for c in r["text"] or "")}
    groups = {}
    for r in minhash.near_duplicates(docs.filter(docs.doc_id.isin(list(language)))).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert set(near) == {min(g) for g in groups.values()}
    leaks = {r["doc_id"] for r in decontamination.held_items(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert leaks and set(clean) == set(near) - leaks and set(private) == set(clean)
    changed = [i for i in private if private[i]["text"] != clean[i]["text"]]
    assert changed and not any(re.search(r"[\w.]+@mail\d\.example\.com|token = \"" + re.escape(x), private[i]["text"]) for i in changed for x in re.findall(r'token = "(\w+)', clean[i]["text"]) or ["-"])
    assert all(private[i]["n_chars"] == len(private[i]["text"]) for i in private)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, data).collect()
    assert {r["doc_id"] for r in packed} == set(private)
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_stages_with_null_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep string"
    words = "ka lo mi ta ru ne " * 5
    rows = [(1, words + "alpha", "xx", None, None, None), (1, words + "alpha", "xx", "s", 1, "r"), (2, None, None, "s", 1, "r"), (None, words, None, "s", 1, "r"), (3, "", "xx", None, 0, None), (4, "12", None, None, 2, None)]
    docs = spark.createDataFrame(rows, schema)
    first = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in first.collect()) == ["1", "1", "None"] and {r["lang"] for r in first.collect()} == {"xx"}
    second = corpus_pipeline.drop_near_duplicates(spark, first, "")
    assert sorted(str(r["doc_id"]) for r in second.collect()) == ["1", "None"] and second.columns == docs.columns
    benchmark = spark.createDataFrame([(1, "never seen words in any of these texts"), (2, None)], "item_id long, text string")
    third = decontamination.clean(second, benchmark)
    assert third.count() == 2 and corpus_pipeline.replace_personal_data(spark, third, "").count() == 2
    assert langid.UNKNOWN == "und" and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_repeated_ids_and_own_columns(spark):
    """Rows that repeat an id with other texts all stay; columns that look like a stage's own pass unchanged."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(5, text(1), "xx", 0.5, "own", 1), (5, text(2), "xx", 0.5, "own", 2), (6, text(3), "xx", 0.5, "own", 3), (7, text(3), "xx", 0.5, "own", 4), (None, text(4), "xx", 0.5, "own", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _id int")
    kept = [corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), "").collect() for n in (1, 3)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and kept[0][0].asDict().keys() == set(docs.columns)
    assert sorted(str(r["doc_id"]) for r in kept[0]) == ["5", "5", "6", "None"]
    spoken = corpus_pipeline.identify_language(spark, docs, "")
    assert spoken.columns == docs.columns and {(r["score"], r["lang_pred"]) for r in spoken.collect()} == {(0.5, "own")} and spoken.count() == 5


def test_no_text_without_a_copy_is_lost(spark):
    """Texts under one id are judged each for itself; of rows that repeat id and text one stays."""
    text = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "ABCDQ"}
    near = text["D"] + " more"
    rows = [(3, text["A"]), (5, text["A"]), (5, text["Q"]), (9, text["C"]), (9, text["D"]), (9, text["C"]), (11, near), (12, ""), (12, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = [corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), "").collect() for n in (1, 4)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept[0]) == [(3, text["A"]), (5, text["Q"]), (9, text["C"]), (9, text["D"]), (12, ""), (12, "")]
