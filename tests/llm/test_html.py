import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tarnlight.llm import html

LONG = " ".join(["The main text of this page goes on for a good while."] * 8)
SF = "/root/testdata/sf0.001"


def test_broken_markup_never_raises_and_leaves_no_markup(spark):
    assert html.main_text("<p>a <![ b</p>") == "a"
    assert html.main_text("<p>x</p><![ <b") == "x"
    assert html.main_text("<article><p>b <![1 c</p></article>") == "b"
    assert html.main_text("<p>a</p><![CDATA[b]]><p>c</p>") == "a\n\nc"
    assert html.main_text("<p>a</p><!-- never closed <p>b</p>") == "a"
    assert html.main_text("<p>a</p><!--><p>b</p><!-- x --!><p>c</p>") == "a\n\nb\n\nc"
    assert html.main_text("<p>a</p><div class='x") == "a" and html.main_text("<p>a</p></div") == "a"
    assert html.main_text("<p>1 < 2 &lt;b&gt; &amp;c</p>") == "1 < 2 <b> &c"
    rng = random.Random(2)
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(12).collect()]
    junk = ["<![", "<!", "<!--", "-->", "</", "<?", "<", ">", "]]>", "&#", "&", "<p", "<![if", "<!doctype", '"', "<script", "</script", "\x00", "<a b='"]
    for page in pages:
        for _ in range(60):
            text = page[: rng.randrange(len(page))] if rng.random() < 0.4 else page
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(junk) + text[at:]
            got = html.main_text(text)
            assert "<!--" not in got and "<![" not in got and not re.search(r"</?(?:p|div|article|a|b|h1|li|ul|nav|span)\b[^<]*>", got)


def brute_scores(lines: list[tuple[int, int, bool]]) -> tuple[list[float], float]:
    """Ratio, Gaussian over two neighbours on either side, the mark, and the threshold half way between two means."""
    ratio = [chars / max(tags, 1) for chars, tags, _ in lines]
    smooth = []
    for i, (_, _, marked) in enumerate(lines):
        own = [j for j, x in enumerate(lines) if x[2] == marked]
        here = own.index(i)
        near = [(math.exp(-((own.index(j) - here) ** 2) / 2), ratio[j]) for j in own if abs(own.index(j) - here) <= 2]
        smooth.append(sum(a * b for a, b in near) / sum(a for a, _ in near) * (2 if marked else 1))
    low, high = min(smooth), max(smooth)
    if high < 4 * low + 1:
        return smooth, low
    for _ in range(20):
        a, b = [v for v in smooth if v < (low + high) / 2], [v for v in smooth if v >= (low + high) / 2]
        low, high = (sum(a) / len(a) if a else low), (sum(b) / len(b) if b else high)
    return smooth, (low + high) / 2


def test_ratios_smoothing_and_threshold_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        blocks = [(rng.choice([2, 9, 40, 300]), rng.randrange(4), rng.random() < 0.5) for _ in range(rng.randint(1, 9))]
        blocks.sort(key=lambda b: b[2])  # one article behind the unmarked blocks
        cells = [(f"<div class='c{i}'><p>" + "<i></i>" * links + "x" * n + "</p></div>", marked) for i, (n, links, marked) in enumerate(blocks)]
        page = "".join(c for c, m in cells if not m) + ("<article>" + "".join(c for c, m in cells if m) + "</article>" if any(m for _, m in cells) else "")
        first = next((i for i, b in enumerate(blocks) if b[2]), -1)
        scores, cut = brute_scores([(n, 2 + links + (i == first), m) for i, (n, links, m) in enumerate(blocks)])
        high = [i for i, v in enumerate(scores) if v >= cut]
        kept = set(high)
        for marked in (False, True):  # blocks between content of their container stay
            own = [i for i in high if blocks[i][2] == marked]
            kept |= set(range(min(own), max(own) + 1)) if own else set()
        inner = [i for i in high if not blocks[i][2]]
        if any(blocks[i][2] for i in high) and inner:  # the article is a part like the others
            kept |= set(range(min(inner), first))
        assert html.main_text(page).split("\n\n") == ["x" * blocks[i][0] for i in sorted(kept)]


def test_the_ratio_decides_over_marks():
    teaser = "<article><p><a href='/1'>More</a> <a href='/2'>and</a> <a href='/3'>more</a></p></article>"
    story = f"<div class='story'><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(teaser + story + teaser) == f"{LONG}\n\n{LONG}"
    assert html.main_text(f"<main><p>{LONG}</p></main><div><p><a href='/1'>A</a> <a href='/2'>b</a></p></div>") == LONG


def test_tables(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<p>w</p>" * 60000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and html.extract(pages.limit(0)).count() == 0
    found = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got.collect())
    assert found == [(0, "", 0), (1, LONG[:9], len(LONG)), (1, LONG[:9], len(LONG)), (2, "", 0), (3, "w\n\nw\n\nw\n\n", 60000 * 3 - 2)]


def test_articles_of_the_tables_with_and_without_marks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    with_marks, without = ({r.page_id: r.text for r in html.extract(p).collect()} for p in (pages, bare))
    assert with_marks == without and all(with_marks.values())


def test_names_count_on_every_block_element_and_end_with_it():
    keep = f"<p>{LONG}</p>"
    bad = ("<p class='advert'>Buy.", "<blockquote class='comment'><p>I liked it.</p></blockquote>", "<details class='comments'><summary>Two</summary>A reader.</details>", "<h3 class='ad'>Buy</h3>", "<dl id='related'><dt>a<dd>b</dl>", "<p role='search'>Find</p>", "<ul><li class='promo'>Buy</ul>", "<pre hidden>x</pre>")
    for hold in ("article", "div"):
        for b in bad:
            assert html.main_text(f"<{hold}>{keep}{b}{keep}<p>The end.</p></{hold}>") == f"{LONG}\n\n{LONG}\n\nThe end."
    assert html.main_text(f"{keep}<ul><li>one<li class=ad>buy<li>three</ul><p>x<p class=advert>ad<p>y") == f"{LONG}\n\none\n\nthree\n\nx\n\ny"
    assert html.main_text(f"{keep}<blockquote class=comment>a<blockquote>b</blockquote>c</blockquote><p>d") == f"{LONG}\n\nd"


def test_an_article_in_two_containers_of_other_classes():
    story = f"<div class='a'>{f'<p>{LONG} {LONG}</p>' * 3}<p>Some more.</p><p>And so on.</p><p>Well.</p></div>"
    assert html.main_text(story + "<div class='b'><p>A short closing paragraph ends it.</p></div>").endswith("Well.\n\nA short closing paragraph ends it.")
    for other in ("© 2024 by some company.", "<a href='/x'>More stories you may like here.</a>", "Tags"):
        assert html.main_text(story + f"<div class='b'><p>{other}</p></div>").endswith("Well.")


def test_pages_without_any_helpful_tag_or_class(spark):
    """Everything but text blocks is a bare div: all of the article must stay, and little else."""
    kept = right = wanted = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub(r"<(/?)(?:article|main|header|footer|nav|aside|section|form|figure)\b([^>]*)>", r"<\1div\2>", r.html)
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        want, got = (Counter(html.main_text(x).split()) for x in (r.html, bare))
        kept, right, wanted = kept + sum(got.values()), right + sum((want & got).values()), wanted + sum(want.values())
    assert right == wanted and right / kept > 0.94
