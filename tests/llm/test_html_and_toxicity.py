from __future__ import annotations

import html
import random
import re

import time

import pytest

from tamperlens.llm.common import table
from tamperlens.llm.html_text import extract_text, main_text
from tamperlens.llm.textcells import words_of
from tamperlens.llm.toxicity import Automaton, ToxicityModel, learn_lexicon, score_toxicity, sketched, without_toxic

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1><nav><a href="/a">Home</a> <a href="/b">About</a></nav></header>
<div class="cookie-notice"><p>We use cookies, many cookies, and more cookies, so many.</p></div>
<div id="wrap"><div class="sidebar"><p>Side, text, with, commas, that, would, score, high, on, its, own, words.</p></div>
<div class="content"><h2>The title</h2><p>First&nbsp;paragraph with <b>bold</b>,
  and a <a href="y">link</a>. More &lt;text&gt; here, yes.<br>Next line.<p>Second, unclosed
<ul><li>one item</li><li>two items</li></ul><div class="ad-slot">Buy now</div><blockquote>A quote, long.</blockquote>
<form><label>Mail</label><input><button>Send</button></form></div>
<section id="comments"><h3>2 Comments</h3><p>Nice, post, I, like, it, very, much, indeed, dear, friend, so, long.</p></section>
</div><footer>&copy; somebody</footer></body></html>"""


def test_page_without_its_clutter():
    assert main_text(PAGE).split("\n\n") == [
        "The title", "First paragraph with bold, and a link. More <text> here, yes. Next line.",
        "Second, unclosed", "one item", "two items", "A quote, long.",
    ]


def test_odd_pages(spark):
    cases = {
        None: "", "": "", "plain": "plain", "<p>a<p>b &lt; c": "a\n\nb < c", "<p>x</b></p><p": "x\n\n<p",
        "<!-- only -->": "", "<nav>menu</nav>": "", "<script>x": "", "<div>" * 3000 + "deep": "deep",
        "<article><p>x</p><h3>Comments</h3><p>reply</p></article>": "x", "<p hidden>no</p><p>yes</p>": "yes",
    }
    for source, text in cases.items():
        assert main_text(source) == text, source
    assert len(main_text("<p>" + "word " * 100_000)) == 499_999
    rows = [(1, None, None, 0), (None, "u", "<p>a", 1), (2, "u", "<p>a", 1), (2, "u", "<p>a", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = [tuple(r) for r in extract_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, None, ""), (None, "u", "a"), (2, "u", "a"), (2, "u", "a")], key=str)
    assert extract_text(df.where("false")).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [
            " ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)
        ]
        assert r.text == "\n\n".join(b for b in blocks if b)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    lexicon = ["stupid", "idiot", "scum", "trash", "lowei*", "idiom"]
    random.seed(3)
    words = set(t.strip("*") for t in lexicon) | {"loweichen", "lowe", "lower", "idio", "diot"}
    for _ in range(6000):
        word = list(random.choice([t.strip("*") for t in lexicon]))
        for _ in range(random.randint(1, 2)):
            at = random.randrange(len(word) + 1)
            word[at : at + random.randint(0, 1)] = random.choices("abdiotrsumpz", k=random.randint(0, 1))
            word = word or ["a"]
        words.add("".join(word))
    words = sorted(words)
    found = {}
    hit, term, used = Automaton(lexicon).match(w := words_of([" ".join(words)]))
    for i, t, e in zip(hit.tolist(), term.tolist(), used.tolist()):
        found[bytes(w.data[w.start[i] : w.end[i]]).decode()] = (e, t)
    for word in words:
        real = []
        for t, entry in enumerate(lexicon):
            if entry.endswith("*"):
                real += [(0, t)] if word.startswith(entry[:-1]) else []
            elif len(entry) >= 5 and word[0] == entry[0]:
                real += [(edits(word, entry), t)] if edits(word, entry) <= 1 else []
            elif word == entry:
                real.append((0, t))
        assert found.get(word, (None,))[0] == (min(real)[0] if real else None), word


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic texts hold one of two invented insults; a copied text must teach nothing more."""
    random.seed(8)
    plain = ["".join(random.choices("bcdfglmnprt", k=1)) + "".join(random.choices("aeioulnrst", k=random.randint(2, 7))) for _ in range(900)]
    rows = []
    for i in range(900):
        words = random.choices(plain, k=40)
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["blarghed", "zuckow" + random.choice(["en", "er", "ig"])]))
        rows.append((i, " ".join(words), toxic))
    copy = "the one text that was copied again and again blarghed over all these many pages of words"
    rows += [(1000 + i, copy + f" {i}", 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    return docs, labels


def test_lexicon(marked):
    docs, labels = marked
    sample = sketched(docs.join(labels, "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(sample)
    assert any(t.startswith("blargh") for t in lexicon) and any(t.startswith("zuck") for t in lexicon)
    assert not {"copied", "again", "pages"} & {t.strip("*") for t in lexicon}


def test_held_out_rows_and_contexts(spark, marked, odd_documents, no_documents):
    docs, labels = marked
    extra = [
        (5000, "you blarghed of the town"), (5001, "you blarghad of the blargheed town"),
        (5002, 'the old word "blarghed" is a term'), (5003, None), (5004, ""),
    ]
    docs = docs.unionAll(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert held and all(got[i].predicted == truth[i] for i in held)
    assert got[5000].predicted == got[5001].predicted == 1 and got[5001].n_edited == 2
    assert got[5002].n_quoted == 1 and got[5002].score < got[5000].score
    assert got[5003].predicted == got[5004].predicted == 0 and got[5003].score == got[5004].score
    kept = without_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    nothing = labels.where("false")
    assert score_toxicity(odd_documents, nothing).where("predicted = 1").count() == 0
    odd = without_toxic(odd_documents, spark.createDataFrame([(1, None), (None, 1), (2, 0), (6, 1)], "doc_id bigint, toxic int"))
    assert odd.columns == odd_documents.columns and odd.count() == odd_documents.count()
    assert without_toxic(no_documents, labels).count() == score_toxicity(no_documents, labels).count() == 0


def test_model_separates_the_table(spark, documents, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = score_toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic == 0) == 0


def test_model_without_lexicon(odd_documents):
    scored = ToxicityModel([]).annotate(odd_documents.select("doc_id", "text"))
    assert scored.where("score < 0.5").count() == odd_documents.count()


def matches(automaton, text):
    words = words_of([text])
    hit, term, used = automaton.match(words)
    found = {bytes(words.data[words.start[i] : words.end[i]]).decode(): (automaton.lexicon[t], e) for i, t, e in zip(hit, term, used)}
    return found


def test_inflected_forms_leave_misspellings(spark):
    plain = "the quiet river runs along a small old town with many green hills"
    rows = [(f"{plain} t{i} {'idiot' if i < 100 else 'idiots'} x{i}", 1) for i in range(130)]
    rows += [(f"{plain} c{i} y{i}", 0) for i in range(700)]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    found = matches(Automaton(lexicon), "idjot iddiot idot idiots idiotic idiot river")
    assert "river" not in found
    assert [found[w][1] for w in ("idjot", "iddiot", "idot")] == [1, 1, 1]
    assert [found[w][1] for w in ("idiots", "idiotic", "idiot")] == [0, 0, 0]


def test_beginning_beside_the_whole_word():
    found = matches(Automaton(sorted(["lowe*", "loweichen", "idiot", "idiot*"])), "lowi lower loweichon idiotic idiot idiut idiutic")
    assert found == {
        "lower": ("lowe*", 0), "loweichon": ("lowe*", 0), "idiotic": ("idiot*", 0), "idiot": ("idiot", 0), "idiut": ("idiot", 1)
    }


def test_only_near_copies_leave_the_sample(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, copy = fresh(60), fresh(100)
    rows = [(f"{passage} {fresh(60)}", 1) for _ in range(120)]  # Jaccard about 0.3
    rows += [(f"{copy} {fresh(2)}", 1) for _ in range(50)] + [(copy, 0), ("", 1), ("!", 1)]
    kept = [tuple(r) for r in sketched(spark.createDataFrame(rows, "text string, toxic int")).collect()]
    assert sum(t.startswith(passage) for t, _ in kept) == 120
    assert sum(t.startswith(copy) for t, y in kept if y) == 1 and (copy, 0) in kept
    assert sum(not t.strip("!") for t, _ in kept) == 1


def test_edits_by_characters_and_at_the_start():
    automaton = Automaton(["idiot", "moron", "trottél", "xq"], any_first=True, known=["motor", "boron"])
    wanted = {"idíot": 1, "1diot": 1, "diot": 1, "aidiot": 1, "xoron": 1, "trottel": 1, "trottél": 0, "xq": 0, "моron": None}
    found = matches(automaton, " ".join([*wanted, "boron", "xqa", "日本"]))
    assert {w: e for w, (_, e) in found.items()} == {w: e for w, e in wanted.items() if e is not None}
    random.seed(9)
    terms = ["idiot", "trottél", "дурак"]
    words = set(terms)
    for _ in range(4000):
        word = list(random.choice(terms))
        for _ in range(random.randint(1, 2)):
            at = random.randrange(len(word) + 1)
            word[at : at + random.randint(0, 1)] = random.choices("idotréдкí1", k=random.randint(0, 1))
        words.add("".join(word) or "a")
    found = matches(Automaton(terms, any_first=True), " ".join(sorted(words)))
    for word in words:
        least = min(edits(word, t) for t in terms)
        assert found[word][1] == least if least <= 1 else word not in found, word


def test_short_terms_and_known_words(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, f"{fresh(9)} {'xq' if i % 2 else 'trasch'} {fresh(9)}", 1) for i in range(200)]
    rows += [(200 + i, f"{fresh(9)} {'crasch' if i % 9 == 0 else 'fine'} {fresh(9)}", 0) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    extra = [(5000, "a xq b"), (5001, "a drasch b"), (5002, "a crasch b")]
    got = {r.doc_id: r for r in score_toxicity(docs.unionAll(spark.createDataFrame(extra, docs.schema)), labels).collect()}
    assert (got[5000].n_exact, got[5001].n_edited, got[5002].n_edited) == (1, 1, 0)
    assert all(got[i].predicted == t for i, _, t in rows)


ARTICLE = "<h1>Title</h1><p>First, of the paragraphs, with commas.</p><p>Second, of them, and longer than the first.</p>"
KEPT = ["Title", "First, of the paragraphs, with commas.", "Second, of them, and longer than the first."]


def test_names_do_not_cut_the_content():
    remark = "<p>I, too, like, this, very, much, indeed, and, say, so, often, enough.</p>" * 9
    extra = '<div class="share"><p>Share this</p></div>'
    pages = [
        f"<div class='layout no-sidebar'><article>{ARTICLE}{extra}</article></div>",
        f"<p>Welcome</p><div class='layout no-sidebar'><article>{ARTICLE}</article></div><p>Bye</p>",
        f"<div class='social'><div class='story'>{ARTICLE}</div>{extra}</div>",
        f"<div id='discussion'><article>{ARTICLE}</article></div>",
        f"<article>{ARTICLE}</article><section id='comments'><article class='c'>{remark}</article></section>",
        f"<div class='content'>{ARTICLE}</div><section id='comments'>{remark}</section>",
        f"<article>{ARTICLE}</article><div class='related'><article class='teaser'><p>Other</p></article></div>",
    ]
    for page in pages:
        assert [t for t in main_text(f"<body>{page}</body>").split("\n\n") if t not in ("Welcome", "Bye")] == KEPT, page
    assert main_text("<div class='hidden'><p>a</p></div><div class='ad'><p>b</p></div>") == "a"  # not empty


def test_links_and_sections_of_the_article_stay():
    links = "<ul><li><a href='a'>Smith 2001</a></li><li><a href='b'>Jones 2002</a></li></ul>"
    table = "<table><tr><td><a href='c'>Berlin</a></td><td>3</td></tr></table>"
    menu = "<div class='nav'><a href='d'>Home</a></div>"
    text = main_text(f"<article>{ARTICLE}<h2>Comments</h2><h3>Bob</h3><p>reply</p><h2>References</h2>{links}{table}{menu}</article>")
    assert text.split("\n\n") == [*KEPT, "References", "Smith 2001", "Jones 2002", "Berlin", "3"]


@pytest.mark.parametrize(
    "page",
    [
        "<b></i>" * 140_000, "<span><p>" * 110_000, "<b x " * 200_000, "<b x='" * 170_001, "<b>" * 150_000 + "<header></header>" * 30_000,
        "<u><div>" + "<b>" * 120_000 + "</u>" * 120_000, "<article><h2>Comments</h2>" + "<div>text here, " * 60_000, "< " * 500_000,
    ],
    ids=["stray ends", "unclosed spans", "unclosed tags", "unclosed quotes", "headers", "far ends", "silenced", "no tags"],
)
def test_broken_pages_take_linear_time(page):
    """A megabyte of each; a walk over the open elements at every tag would take minutes."""
    started = time.process_time()
    main_text(page)
    assert time.process_time() - started < 15


def test_article_below_an_unclosed_quote():
    page = "<article><p title='open>First paragraph, with some words, and more.</p><p>Second one, as long as that, or so.</p></article>"
    assert "Second one" in main_text(page)
