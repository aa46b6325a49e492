import random
import time

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import html_extraction, toxicity
from tests.llm.conftest import prose

PAGES = [
    ("", ""),
    (None, ""),
    ("<p>a &amp; b<br>c</p>  <p> d\n e</p>", "a & b c\n\nd e"),
    ("<nav><ul><li>x</ul></nav><article><h1>T &lt;</h1><p>one<p>two <b>bold</b></article><footer>f</footer>", "T <\n\none\n\ntwo bold"),
    ('<body><div class="cookie-notice">x</div><main><header>H</header><p>a</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table><div id="comments"><p>c</p></div></main>', "a\n\none\n\ntwo\n\n1 2"),
    ('<script>var t="</p>";</script><article><p>x</p><style>p{}</style><form>f</form><!-- c --><div class="ad">ad</div>y</article>', "x\n\ny"),
    ("<article><p>unclosed <i>all", "unclosed all"),
    ("a < b and c &am d &copy 5", "a < b and c &am d © 5"),
    ("</p></div><p>stray</b></p>", "stray"),
    ("<article><p data-x=it's>alpha</p><p>keep me</p><p>don't stop</p></article>", "alpha\n\nkeep me\n\ndon't stop"),
    ('<p title=5">alpha</p><p title=\'a>b\' id="c>d">beta</p>', "alpha\n\nbeta"),
    ("<article><section class='social-science'>one</section><p class='notice-board'>two</p><div class='overlay-network'>three</div></article>", "one\n\ntwo\n\nthree"),
    ("<article><header class=header><h1>Head</h1></header><p hidden>x</p><p style='display: none'>x</p><div class='ad-slot'>x</div><div id=userComments>x</div><p>y</p></article>", "Head\n\ny"),
    ("<main><p>x</p><article><p>y</p></article></main><article><p>z</p></article>", "y\n\nz"),
    ("<article><p class='share'>a rise in <span class='social'>social</span> media use</p><ul><li class=notice>x</li></ul></article>", "a rise in social media use\n\nx"),
    ("<article><h2 id='comments'>Comments</h2><p>a</p><h2 id=sharing class=share>Sharing</h2><p>b</p><h3 id='notification'>Notification</h3><h2 class='promo'>On sale</h2></article>", "Comments\n\na\n\nSharing\n\nb\n\nNotification\n\nOn sale"),
    ("<article><section id='menus'><h2>Menus</h2><p>of restaurants</p></section><section id='sharing-2'><h2>Sharing</h2>x</section><section id='comments'><h2>12 readers said</h2><p>c</p></section></article>", "Menus\n\nof restaurants\n\nSharing\n\nx"),
    ("<body><header><a href=/>Logo</a><h1>Title</h1><nav>n</nav></header><p>text</p></body>", "Logo Title\n\ntext".replace("Logo Title", "Logo\n\nTitle")),
    ("<body><div class='post-header'><h1>Title</h1></div><p>text</p><div class='header'>again</div></body>", "Title\n\ntext"),
    ("<body><header><h1>Site</h1></header><h1>Title</h1><p>text</p></body>", "Title\n\ntext"),
    ("<article><p>own</p></article><article class='comment'><p>theirs</p></article><article class='comment-reply depth-2' id=comment-3><p>more</p></article>", "own"),
    ("<main><p>own</p><article class='comment'><p>theirs</p></article></main>", "own"),
    ("<article><p>own</p><ol class='comment-list'><li><article class=comment><p>theirs</p></article></li></ol><div id='respond'><form>f</form>Leave a reply</div></article>", "own"),
    ("<body><p class='cookie-notice'>c</p><p id='notice'>kept</p><p>text</p></body>", "kept\n\ntext"),
    ("<b><article>one</b> two<p>three</article>", "one two\n\nthree"),
    ("x<!-->y<!--->z<!-- a > b --!>w<!bogus>v<?php ?>u</>t", "xyzwvut"),
    ("<p>tail <a href='never ends>lost", "tail"),
    ("<svg><title>t</title><svg>u</svg>v</svg>z", "z"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert html_extraction.main_text(html_extraction.parse(html or "")) == want


@pytest.mark.parametrize("bad", ["<a " * 350_000, "<b>" * 100_000 + "</i>" * 100_000, '<a href="' * 100_000, "<!--" * 250_000, "<" * 500_000, "<i>" + "<b>" * 50_000 + "<div>" + "</i>" * 50_000, "<p " + " x" * 300_000])
def test_time_is_linear(bad):
    began = time.process_time()
    html_extraction.main_text(html_extraction.parse(bad))
    assert time.process_time() - began < 5


def outline(element):
    """A subtree spelt out, in place of its hash."""
    return (element.tag, element.name, *(" ".join(c.split()) if isinstance(c, str) else outline(c) for c in element.children))


def expected_texts(pages, least=html_extraction.LEAST_PAGES, share=html_extraction.SHARE):
    """Brute force: subtrees are counted by what they hold, on one page for each distinct article of a host."""
    trees = [(url.split("://")[1].split("/")[0], html_extraction.parse(html)) for _, url, html in pages]
    skip = html_extraction.is_boilerplate

    def walk(element, inside, found, articles):
        for child in element.children:
            if not isinstance(child, str) and child.tag not in html_extraction.RAW and not skip(child, inside):
                if child.tag == "article" and not inside:
                    articles.append(outline(child))
                walk(child, inside or child.tag == "article", found, articles)
                if child.tag in ("div", "ul", "section", "table") or child.tag in ("p", "li") and not inside:
                    found.add(outline(child))

    seen = {}
    for host, root in trees:
        found, articles = set(), []
        walk(root, False, found, articles)
        seen.setdefault(host, {}).setdefault(tuple(articles) or outline(root), set()).update(found)
    out = []
    for host, root in trees:
        pages_of = seen[host]
        gone = {x for own in pages_of.values() for x in own if (n := sum(x in o for o in pages_of.values())) >= least and n >= share * len(pages_of)}
        blocks = []

        def text(element, inside, kept, gone=gone, blocks=blocks):
            for child in element.children:
                if isinstance(child, str):
                    if kept and child.strip():
                        blocks.append(" ".join(child.split()))
                elif not skip(child, inside) and not (outline(child) in gone and (child.tag in ("div", "ul", "section", "table") or child.tag in ("p", "li") and not inside)):
                    text(child, inside or child.tag == "article", kept or child.tag == "article")

        text(root, False, not any(e[0] == "article" for e in articles_of(root)))
        out.append("\n\n".join(blocks))
    return out


def articles_of(element):
    found = []
    for child in element.children:
        if not isinstance(child, str):
            found += [outline(child)] * (child.tag == "article") + articles_of(child)
    return found


def test_templates_against_brute_force(spark):
    rng = random.Random(6)
    boxes = [f"<div><p>{prose(4, rng)}</p></div>" for _ in range(6)] + [f"<ul><li>{prose(3, rng)}</li><li>more</li></ul>" for _ in range(3)] + [f"<p>{prose(6, rng)}</p>" for _ in range(4)]
    rows = []
    for k in range(160):
        host = rng.choice(["a.com", "a.com", "b.org", "c.net", "d.io"]) if k < 157 else "few.com"
        inner = "".join(rng.choice(boxes) if rng.random() < 0.5 else f"<p>{prose(5, rng)}</p>" for _ in range(rng.randint(1, 5)))
        around = [rng.choice(boxes) if rng.random() < 0.6 else "" for _ in range(2)]
        body = f"{around[0]}<article>{inner}</article>{around[1]}" if rng.random() < 0.7 else around[0] + inner
        rows.append((k, f"http://{host}/{k}", f"<html><body>{body}</body></html>"))
    rows += [(200 + k, f"http://b.org/{k}", rows[3][2]) for k in range(60)]  # copies of one page
    got = {r.page_id: r.text for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = expected_texts(rows)
    assert [got[r[0]] for r in rows] == want
    whole = [html_extraction.main_text(html_extraction.parse(r[2])) for r in rows]
    assert sum(a != b for a, b in zip(want, whole, strict=True)) > 10


def test_site_templates(spark):
    rng = random.Random(1)
    rows = []
    for k in range(30):
        host = "a.com" if k < 20 else "b.com"
        box = "<div><p>Read more from this site</p></div>" if host == "a.com" else f"<div><p>{prose(5, rng)}</p></div>"
        same = "<p>a quoted line</p>"
        rows.append((k, f"http://{host}/{k}", f"<body>{box}<article>{same}<p>{prose(8, rng)}</p>{box}</article></body>", "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extraction.extract_text(pages).collect()}
    assert all("Read more" not in got[k].text and got[k].text.startswith("a quoted line\n\n") for k in range(20))
    assert all(len(got[k].text.split("\n\n")) == 3 for k in range(20, 30))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_cases(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "x", ""), (None, "http://h/", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extraction.extract_text(pages).collect()) == ["", "", "a"]
    assert html_extraction.extract_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = prose(30, rng).split()
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "stupid", "moron"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, corpus):
    docs, labels = corpus
    hidden = ["you 1d10t here", "an i d i o t now", "so stuuuupid it is", "what a m0r0n", "a s.t.u.p.i.d man", "plain words here", "", None, "count 4736962573099581"]
    more = docs.unionByName(spark.createDataFrame([(1000 + k, f"the river stone {t}" if t else t) for k, t in enumerate(hidden)], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.toxicity(more, labels).collect()}
    assert [got[1000 + k].predicted for k in range(len(hidden))] == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    tested = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert len(tested) > 50 and all(r.predicted == (r.doc_id % 4 == 0) for r in tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.drop_toxic(more, labels)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_long_and_joined_disguises(spark, corpus):
    docs, labels = corpus
    hidden = [
        "what a s t u p i d man",
        "i d i o t m o r o n walks",
        "a " + " ".join("theriverstonehousegreenwalks" * 3 + "stupid" + "underlightcoldwater" * 3) + " man",
        "so st" + "u" * 700 + "pid",
        "you s" + "." * 80 + "t.u.p.i.d",
        "a " + " ".join("theriverstonehousegreenwalks" * 3) + " man",
        "w a t e r",
    ]
    more = docs.unionByName(spark.createDataFrame([(1000 + k, f"the river stone {t}") for k, t in enumerate(hidden)], "doc_id long, text string"))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(more, labels).collect()}
    assert [got[1000 + k] for k in range(len(hidden))] == [1, 1, 1, 1, 1, 0, 0]


def channel_of(text):
    c = toxicity.classes(f" {text} ")
    codes = ((c[:-2] * toxicity.WIDTH + c[1:-1]) * toxicity.WIDTH + c[2:]).tolist()
    return toxicity.Channel({code: codes.count(code) for code in codes})


def test_tokens_of_signs_and_numbers():
    channel = channel_of("an ass and a pass as the glass was in 1999 and 2024 at 455 or 12 of 37 " * 20)
    assert "ass" in channel.words("@$$") and "ass" in channel.words("a$$")
    assert channel.words("455") == channel.words("1999") == channel.words("--") == ()


def test_spacing_of_any_kind(spark, corpus):
    docs, labels = corpus
    hidden = [
        "what a s  t  u  p  i  d man",
        "what a s\t\tt\tu p\n i d man",
        "what a s\u200bt\u200bu\u200bp\u200bi\u200bd man",
        "what a s\u200b t\u200b u\u200b p\u200b i\u200b d man",
        "what a stu\u00adpid man",
        "here\u200bstupid\u200bwalks",
        "what a stu pid man",
        "what a st up id, man",
        "what a stu p1d man",
        "an (id iot) walks",
        "the stu. pid walks",
        "w  a  t  e  r",
        "wa\u200bter and so ft ly",
    ]
    more = docs.unionByName(spark.createDataFrame([(1000 + k, f"the river stone {t}") for k, t in enumerate(hidden)], "doc_id long, text string"))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(more, labels).collect()}
    assert [got[1000 + k] for k in range(len(hidden))] == [1] * 10 + [0] * 3


def test_split_words_are_joined_by_the_lattice():
    channel = channel_of("the pen is on the table and a pen is here as the stupid one is at the penis of it " * 20 + "a pen is in the den is on " * 60)
    wanted = toxicity.Lexicon({"penis": 0.9, "stupid": 0.9, "stup*": 0.9, "ass": 0.9})
    assert channel.split_words("the pen is here stu pid one a ss stu".split(), wanted, {}) == ["stupid"]
    assert channel.split_words([], wanted, {}) == channel.split_words(["stu"], wanted, {}) == []
    assert wanted.lengths == [5, 6]


def test_wide_gaps_end_words():
    channel = channel_of("the stupid man walks by the river " * 20)
    assert {"stupid", "man"} <= set(channel.spaced_words("s t u p i d   m a n"))
    began = time.process_time()
    assert toxicity._SPACED.search("a" + " " * 500_000 + "b" + " " * 500_000 + "cc") is None
    assert time.process_time() - began < 2


def test_decoding_in_pieces(monkeypatch):
    channel = channel_of("the idiot and the stupid moron walk by the river stone house " * 20)
    token = "the1d10tandthe5tup1dmoron" * 40
    whole = channel.decode(token)
    assert whole == "theidiotandthestupidmoron" * 40
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity, "OPEN", 32)
    assert channel.decode(token) == whole


def test_decoding_against_enumeration():
    """The reading of least cost among all paths of the lattice."""
    channel = channel_of("the idiot and the stupid moron walk by the cold river stone house as glass passes " * 20)

    def best(token, gap, doubles):
        found = [(0.0, 0, 0, "")]
        for options in [*channel.lattice(token, gap, doubles), [(" ", 0.0)]]:
            longer = []
            for cost, a, b, text in found:
                for out, noise in options:
                    c = int(toxicity.classes(out)[0]) if out else None
                    own = cost + noise + (channel.cost[(a * toxicity.WIDTH + b) * toxicity.WIDTH + c] if out else 0.0)
                    longer.append((own, b, c, text + out) if out else (own, a, b, text))
            found = longer
        least = min(found)[0]
        return {text.strip() for cost, _, _, text in found if cost < least + 1e-9}

    rng = random.Random(4)
    tokens = ["1d10t", "s.t.u", "i d i o", "@$$", "m0r0n", "stuuup", "5.t.u.p", "g l @ s s", "4$$"] + ["".join(rng.choices("as5$.1i0o t", k=rng.randint(2, 7))).strip() or "a" for _ in range(60)]
    for token in tokens:
        for gap, doubles in ((2.0, False), (-0.5, False), (2.0, True)):
            assert channel.decode(token, gap, doubles) in best(token, gap, doubles), token


def test_evidence_adds_up_and_scores_are_rates(spark, corpus):
    docs, labels = corpus
    more = docs.unionByName(spark.createDataFrame([(1000, "a river idiot"), (1001, "a river idiot stupid moron"), (1002, "a river"), (1003, "a river " * 300)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(more, labels).collect()}
    assert got[1002] < 0.5 < got[1000] < got[1001] and got[1002] != got[1003]
    mean = sum(got[k] for k in range(400)) / 400
    assert 0.2 < mean < 0.35  # a quarter is toxic, and counts more


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels = corpus
    other = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_toxicity_cases(spark, corpus):
    docs, labels = corpus
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    rows = [(None, "you idiot"), (None, None), (5, "x" * 300_000), (5, "a i d i o t " + "river stone " * 30_000), (6, ""), (6, "")]
    odd = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, toxic string")
    got = toxicity.toxicity(docs.withColumns({"score": F.lit(0.0), "toxic": F.lit("")}).unionByName(odd), labels).filter("doc_id IS NULL OR doc_id IN (5, 6)").collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1] and {r.held_out for r in got if r.doc_id is None} == {True}
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))).unionByName(labels.limit(3))
    assert toxicity.toxicity(docs, twice).count() == 400


def test_pages_with_known_text(spark):
    """Pages put together from articles' pieces and boilerplate of many shapes; what belongs to the text is known by construction."""
    rng = random.Random(12)
    word = lambda n: prose(n, rng)

    def piece():
        t = word(rng.randint(2, 9))
        slug = rng.choice(["comments", "sharing", "menus", "related", "news", "footer-notes"])
        return rng.choice([
            (f"<p>{t}</p>", [t]),
            (f"<p class='{rng.choice(['share', 'lead', 'notice'])}'>{t}</p>", [t]),
            (f"<h2 id='{slug}'>{slug.replace('-', ' ').title()}</h2><p>{t}</p>", [slug.replace("-", " ").title(), t]),
            (f"<p>so <span class='{rng.choice(['social', 'ad', 'x'])}'>{t}</span> it is</p>", [f"so {t} it is"]),
            (f"<section id='{slug}'><h3>{slug.replace('-', ' ').title()}</h3><div>{t}</div></section>", [slug.replace("-", " ").title(), t]),
            (f"<ul><li>{t}</li><li class='item'>{t} 2</li></ul>", [t, f"{t} 2"]),
            (f"<blockquote class='social-quote'>{t}</blockquote>", [t]),
            (f"<div class='content-body'><p>{t} &amp; on</p></div>", [f"{t} & on"]),
        ])

    def junk():
        t = word(rng.randint(2, 9))
        return rng.choice([
            f"<nav><ul><li><a href=/>{t}</a></li></ul></nav>",
            f"<div class='ad-slot'>{t}</div>",
            f"<aside><h2>More</h2>{t}</aside>",
            f"<div class='cookie-notice' id=c>{t}</div>",
            f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{t}</p></article></section>",
            f"<div id='sidebar'>{t}</div>",
            f"<form><p>{t}</p><input></form>",
            f"<div role='alert'>{t}</div>",
            f"<script>{t}</script><style>{t}</style>",
            f"<ul class='social-links'><li>{t}</li></ul>",
        ])

    rows, want = [], {}
    for k in range(300):
        parts, texts = [], []
        for _ in range(rng.randint(1, 8)):
            if rng.random() < 0.4:
                parts.append(junk())
            else:
                html, own = piece()
                parts.append(html)
                texts += own
        title, inner = word(4), "".join(parts)
        shape = k % 3
        head = f"<header><h1>{title}</h1></header>"
        body = [f"{junk()}<article>{head}{inner}</article>{junk()}<article class='comment'><p>{word(5)}</p></article>", f"<main>{head}{inner}</main>{junk()}", f"{head}{inner}{junk()}"][shape]
        rows.append((k, f"http://h{k}.org/", f"<html><head><title>t</title></head><body>{body}<footer>{word(3)}</footer></body></html>"))
        want[k] = [title, *texts]
    got = {r.page_id: r.text.split("\n\n") for r in html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    missed = sum(b not in got[k] for k, own in want.items() for b in own)
    leaked = sum(b not in want[k] for k, own in got.items() for b in own)
    whole = sum(map(len, want.values()))
    # Only paragraphs and list items that a class calls a notice or a share, outside an article, are missed.
    assert missed <= 0.06 * whole and leaked == 0
    assert all(got[k] == want[k] for k in want if k % 3 == 0)
