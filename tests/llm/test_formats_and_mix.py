"""Chat templates, page texts, source mixing and the pipeline."""

import random
import time

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from roadweave.llm import chat, html_text, language_id, mixing
from roadweave.llm.chat_template import Const, Output, Template, TemplateError, Text, fold, parse
from roadweave.llm.common import corpus_session


def shown(source, **values):
    return Template(source).render(**values)[0]


def test_template_language():
    assert shown("{{ a.b[1] }}|{{ a['c'] }}|{{ missing.x }}|", a={"b": [1, 2]}) == "2|||"
    assert shown("{% if x > 1 and not y %}A{% elif x == 1 %}B{% else %}C{% endif %}", x=1) == "B"
    assert shown("{% for i in l -%} {{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", l=["a", "b"]) == "1a,2b"
    assert shown("{% set z = 'q' ~ 2 %}{{ z|upper }}{# no #}{{ ' x '|trim }}{{ l|length }}", l=[1]) == "Q2x1"
    assert shown("{{ 'in' if 'a' in l else 'out' }} {{ 3 - 1 + 2 }}", l=["a"]) == "in 4"
    assert Template("a{% generation %}bc{% endgeneration %}d{% generation %}{% endgeneration %}").render()[1] == [(1, 3), (4, 4)]


def test_template_sandbox_and_errors():
    assert shown("{{ x.__class__ }}{{ x.upper }}{{ x['__len__'] }}", x="abc") == ""
    for bad in ("{{ x( }}", "{{ x() }}", "{% if x %}", "{% endfor %}", "{{ x | eval }}", "{% for in x %}{% endfor %}", "{{ 'a' + 1 }}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ (1 + 1) }}{% if 2 < 1 %}x{% else %}c{% endif %}{{ 'D'|lower }}")) == (Text("ab2cd"),)
    assert fold(Output(Const(None))) == Text("")


TEXTS = st.text(st.sampled_from(list("a#\\</turn>\n :é\U0001f600")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), TEXTS), TEXTS), max_size=5))
def test_turns_come_back_from_the_text(turns):
    text, spans = Template(chat.TURNS).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert chat.trained_text(text, [{"start": a, "end": b} for a, b in spans]) == "".join(t for r, t in turns if r == "assistant")
    assert text.count("</turn>") == len(turns) and text.count("###") == len(turns)


def test_conversations_of_odd_rows(spark):
    turns = corpus_session(spark).createDataFrame(
        [(1, 1, "assistant", "b" * 100000, 0), (1, 0, "user", None, 0), (2, None, None, "x", 0), (2, 0, "assistant", "y", 0), (None, 0, "user", "z", 0),
         (3, 0, "user", "r", 0), (3, 0, "user", "r", 0)], "conv_id long, turn long, role string, text string, n_turns int")
    rows = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    read = {k: chat.read_turns(r["text"]) for k, r in rows.items()}
    assert read == {1: [("user", ""), ("assistant", "b" * 100000)], 2: [("", "x"), ("assistant", "y")], None: [("user", "z")], 3: [("user", "r")] * 2}
    assert rows[2]["n_turns"] == 2 and chat.trained_text(rows[2]["text"], rows[2]["spans"]) == "y"
    assert chat.format_conversations(turns.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>My Site</h1><p>A tagline, here.</p></header><nav><ul><li><a href="/a>b">Home</a><li>Other</ul></nav><div id="cookie-notice">We use cookies. Accept them, please.</div>
<div class="wrap"><div class="sidebar"><p>Latest: this, that and more. A long teaser text, that goes on and on for a while.</p></div>
{open}<h1>Title &amp; more</h1><p>First <a href="x">para&shy;graph</a>,<br>with   words.<ul><li>one<li>two</ul><blockquote><p>A quote.</p></blockquote>
<div class="advert">Buy now!</div><!-- <p>hidden</p> --><p>Last &lt;one&gt; 1 < 2.</p>{close}
<form><label>Name</label><textarea>x</textarea></form><section id="comments"><p>I think, that this is a very long comment. It goes on, and on. Really!</p>
<p>I think, that this is another very long comment. It goes on, and on. Really, it does!</p></section></div><footer>&copy; 2020</footer></body></html>"""
WANTED = "Title & more\nFirst para­graph, with words.\none\ntwo\nA quote.\nLast <one> 1 < 2."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
                                  ('<div id="post-body">', "</div>"), ("<div>", "</div>")])
def test_page_texts(tags):
    assert html_text.main_text(PAGE.replace("{open}", tags[0]).replace("{close}", tags[1])) == WANTED


def test_page_texts_of_odd_rows(spark):
    rows = [(1, None, ""), (2, "", ""), (3, "just text &amp; x < 3", "just text & x < 3"), (4, "<p>a<!-- x", "a"), (5, "<script>x", ""), (6, "<p>a<p>a", "a\na"),
            (7, "<div><a href='", ""), (8, "<p>" + "word, " * 50000, ("word, " * 50000).strip()), (None, "<p>a<p>a", "a\na")]
    pages = corpus_session(spark).createDataFrame([(i, h, "old") for i, h, _ in rows], "page_id long, html string, text string")
    found = html_text.extract(pages).collect()
    assert [r["text"] for r in found] == [w for *_, w in rows] and [r["n_chars"] for r in found] == [len(w) for *_, w in rows]
    assert html_text.extract(pages.limit(0)).count() == 0


MIXES = [
    mixing.Settings(budget_percent=60, epochs=3, seed=1, weights={"a": 3, "b": 1, "*/en": 5, "a/fr": 2, "*/*/s1": 4}),
    mixing.Settings(budget_percent=250, epochs=3, seed=2, weights={"a": 1, "b": 50, "*/fr": 0}),
    mixing.Settings(budget_percent=900, epochs=2, seed=3),
    mixing.Settings(budget_percent=0, epochs=2, seed=4),
]
DOMAIN = "CASE WHEN source IN ('s1', 's2') THEN 'a' WHEN source = 's3' THEN 'b' END"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ("en", "fr", None)[i % 3], ("s1", "s2", "s3", None)[i * i % 4 if i % 5 else 3]) for i in range(160)]
    rows += [(500, None, "en", "s1"), (None, "x y z", "en", "s1"), (None, "x", "en", "s1"), (3, rows[3][1], rows[3][2], rows[3][3]), (501, "", "xx", "s3"),
             (502, "t " * 5000, "en", "s3")]
    return corpus_session(spark).createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, epoch string")


@pytest.mark.parametrize("setting", MIXES)
def test_mix_equals_sql(mixed, tmp_path, setting):
    mixed.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select doc_id, text, lang, source from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.execute(f"select doc_id, domain, tokens, epoch from ({mixing.mix_sql(f'coalesce({DOMAIN}, {chr(39)}(none){chr(39)})', setting)})").fetchall()
    found = mixing.mix(mixed, F.expr(DOMAIN), setting)
    assert found.columns == ["doc_id", "text", "lang", "source", "domain", "tokens", "epoch"]
    key = lambda rows: sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in rows)
    assert key(tuple(r) for r in found.select("doc_id", "domain", "tokens", "epoch").collect()) == key(wanted)
    total = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert sum(r[2] for r in wanted) <= total * setting.budget_percent // 100



def test_sections_of_an_unnamed_container_stay_whole():
    sentence = "The river rose over the old bridge, and the town waited; nobody slept that night. "
    sizes = [[4] * 12, [40, 40, 1, 40, 2, 40]]
    for own in sizes:
        parts = [f"Part {i}. " + sentence * n for i, n in enumerate(own)]
        sections = "".join(f"<section id=s{i}><p>{p}</p></section>" for i, p in enumerate(parts))
        links = "<div class=more>" + "".join(f"<p>Page {i}</p>" for i in range(20)) + "</div>"
        found = html_text.main_text(f"<html><body><div class=wrap>{sections}{links}</div></body></html>")
        assert found.split("\n") == [p.strip() for p in parts]
    table = "<table><tr><th>Year</th><th>Level</th></tr><tr><td>1990</td><td>12</td></tr></table>"
    paragraphs = "".join(f"<p>{sentence * 5}</p>" for _ in range(6))
    assert "Level\n1990\n12" in html_text.main_text(f"<body><div class=wrap>{paragraphs}{table}<div class=box><p>{sentence}</p></div></div></body>")
    assert html_text.main_text(f"<body><div class=wrap>{paragraphs}<div class=box><p>{sentence}</p></div></div></body>").count("river") == 31


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)]
    rows = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("total", F.lit(2010).cast("long"))
    found = mixing.budgets(rows, mixing.Settings(budget_percent=20, epochs=1))
    # 402: 201 for each domain; s1 can use 10 of its 100, the other 191 stay in the domain
    assert {r["source"]: r["budget"] for r in found.collect()} == {"s1": 10, "s2": 191, "s3": 201}


def test_mix_of_an_empty_table(mixed):
    assert mixing.mix(mixed.limit(0), F.expr(DOMAIN)).count() == 0


def test_pipeline_stages(spark):
    path, columns = "/root/testdata/sf0.001", corpus_pipeline.COLUMNS
    docs = corpus_session(spark).read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !", "en", "src0", 7)], docs.schema)
    docs = docs.unionByName(odd).withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "mixing"]
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, path).cache()
        now = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert now <= ids and kept.columns[:5] == columns and (name == "mixing" or len(kept.columns) == 5)
        assert name == "mixing" or kept.count() == len(now)
        if name == "language_id":
            assert ids - now == {10**6, 10**6 + 1}
        docs, ids = kept, now
    assert docs.count() > 0


def test_the_language_stage_drops_what_has_no_language():
    assert language_id.UNKNOWN == "und" and corpus_pipeline.LEAST_LANGUAGE_SCORE < 1


TEASERS = "<ul class=teasers>" + "".join(f"<li><a href=x>Teaser number {i} of today</a></li>" for i in range(8)) + "</ul>"
BODY = "<p>The first paragraph tells, at some length, what this is about.</p><p>The second one goes on, and ends here.</p>"
PLAIN = "The first paragraph tells, at some length, what this is about.\nThe second one goes on, and ends here."


@pytest.mark.parametrize("page,wanted", [
    (f'<body>{TEASERS}<div class="content with-sidebar">{BODY}</div></body>', PLAIN),
    (f'<body><nav>{TEASERS}</nav><div id=page class="no-banner has-comments"><article>{BODY}</article></div></body>', PLAIN),
    (f'<body><nav>{TEASERS}</nav><div class="post comments-open">{BODY}</div></body>', PLAIN),
    (f'<article>{BODY}<section id="related-work"><p>Others did it before.</p></section></article>', PLAIN + "\nOthers did it before."),
    (f'<main>{BODY}<section id="promotion-and-relegation"><p>Two go up.</p></section></main>', PLAIN + "\nTwo go up."),
    (f'<article>{BODY}<p class="recommended-dose">One a day.</p></article>', PLAIN + "\nOne a day."),
    (f'<article><div class="entry-header"><h1>Title</h1><span>by me</span></div>{BODY}</article>', "Title\n" + PLAIN),
    (f'<article>{BODY}<div class="related-posts"><p>Read this too.</p></div><div class="related"><p>And this.</p></div><div class="wp-social-share"><p>Tell others.</p></div></article>', PLAIN),
    (f'<article>{BODY}</article><div class=comments>' + "<p>I do not agree with any of this, at all, and never did.</p>" * 200 + "</div>", PLAIN),
    (f'<article><button>Buy{BODY}<math><mi>x</mi></math></article>', "Buy\n" + PLAIN + "\nx"),
])
def test_main_text_of_named_elements(page, wanted):
    assert html_text.main_text(page) == wanted


SENTENCE = "The river rose over the old bridge, and the town waited; nobody slept that night. "
LONG = [f"Part {i}. " + SENTENCE * (2 + i % 4) for i in range(10)]


def paragraphs(first, last):
    return "".join(f"<p>{p}</p>" for p in LONG[first:last])


@pytest.mark.parametrize("page,first", [
    (f"<div><div class=one>{paragraphs(0, 2)}</div><div class=two>{paragraphs(2, 10)}</div></div>", ""),
    (f"<div><h1>Title</h1><p>{LONG[0]}</p><div class=chapter>{paragraphs(1, 10)}</div></div>", "Title"),
    (f"<div><h1>Title</h1><div class=body-of-it>{paragraphs(0, 10)}</div></div>", "Title"),
    (f"<div><div class=top><div><h1>Title</h1></div></div><div class=below>{paragraphs(0, 10)}</div></div>", "Title"),
    (f"<div>{LONG[0]}<div>{LONG[1]}<div>{paragraphs(2, 10)}</div></div></div>", ""),
])
def test_no_part_of_an_unnamed_article_is_passed_by(page, first):
    wanted = [first] * bool(first) + [p.strip() for p in LONG]
    assert html_text.main_text(f"<body>{TEASERS}<div class=wrap>{page}</div></body>").split("\n")[-len(wanted):] == wanted
    assert html_text.main_text(f"<body><nav>{TEASERS}</nav>{page}<footer>Imprint</footer></body>").split("\n") == wanted


@pytest.mark.parametrize("seed", range(40))
def test_generated_nestings_keep_all_running_text_and_nothing_else(seed):
    """Paragraphs in random nestings of unnamed or oddly named containers, with menus, notices and teasers around them."""
    r = random.Random(seed)
    noise = [TEASERS, "<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<div class=sidebar><p>Latest, and more. Really!</p></div>",
             "<div id=cookie-notice>We use cookies. Accept them, please.</div>", "<div class='ad-box'><p>Buy now, save.</p></div>"]

    def nested(parts):
        if len(parts) == 1 or r.random() < 0.3:
            inner = "".join(f"<p>{p}</p>" for p in parts)
        else:
            at = r.randrange(1, len(parts))
            inner = nested(parts[:at]) + nested(parts[at:])
        tag = r.choice(["div", "section", "div class=x", "div class=has-sidebar", "div id=b7", "center"])
        return f"<{tag}>{inner}</{tag.split()[0]}>" if r.random() < 0.7 else inner

    parts = r.sample(LONG, r.randint(3, 10))
    around = [r.choice(noise[1:]) for _ in range(4)]
    page = f"<html><body>{around[0]}{around[1]}<div>{nested(parts)}</div>{around[2]}{around[3]}<footer>Imprint</footer></body></html>"
    assert html_text.main_text(page).split("\n") == [p.strip() for p in parts]


def test_deep_pages_are_read_in_linear_time():
    page = "".join(f"<div>{p}" for p in LONG * 2000)
    started = time.monotonic()
    assert html_text.main_text(page).split("\n") == [p.strip() for p in LONG] * 2000
    assert time.monotonic() - started < 20
