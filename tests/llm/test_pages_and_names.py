"""Wrappers, comments and adverts of pages; coreference, formats and clashing columns of surrogates."""

import re

import pytest
from pyspark.sql import functions as F

from reportloom.llm import op2_pii_surrogates as op2
from reportloom.llm import op4_html_text as op4

TEXT = " ".join(f"word{i}" for i in range(30))
PARAGRAPH = f"<p>{TEXT}</p>"


def text(html):
    return " ".join(t for k, t in op4.blocks_of(html) if k != op4.ELSEWHERE)


@pytest.mark.parametrize("wrapper", ['div class="wrap has-sidebar"', 'div class="no-sidebar"', 'div class="with-nav"', 'div class="ad-free"', 'div class="share-count-enabled"', 'div class="entry-content sponsored-post"', 'form id="aspnetForm"', 'div class="widget page"', 'div class="comments-open"'])
@pytest.mark.parametrize("inner", [f"<article>{PARAGRAPH}</article>", f"<main>{PARAGRAPH}</main>", PARAGRAPH])
def test_wrappers_hold_their_text(wrapper, inner):
    tag = wrapper.split()[0]
    html = f'<html><body><{wrapper}><div class="sidebar">menu</div>{inner}<form><input> mail me</form></{tag}><footer>foot</footer></body></html>'
    assert text(html) == TEXT


@pytest.mark.parametrize("name", ["comments-area", "commentlist", "comment-respond", "comments", "reader-comments", "disqus_thread", "respond", "advert-box", "ad-slot", "ad", "ads", "google-ads", "adsbygoogle", "sponsored-content", "taboola-below"])
def test_comments_and_adverts_go(name):
    bad = "bad here " * 100  # more than the article: no vote brings it back
    for html in (f"<article>{PARAGRAPH}<div class='{name}'>{bad}</div></article>", f"<body><div>{PARAGRAPH}<section id='{name} x'><p>{bad}</p></section></div></body>", f"<article><div class='post {name}'>{bad}</div>{PARAGRAPH}</article>"):
        assert text(html) == TEXT


def test_forms_labels_and_buttons():
    page = "<article><p>See <label>this</label> word, press <button>Save</button> now</p><button>Share</button><form>mail <input> <label>name</label></form><article class='comment'>bad</article></article>"
    assert text(page) == "See this word, press Save now"
    assert text(f"<body><form><p>Sign up</p><select><option>a</select></form><div>{PARAGRAPH}</div></body>") == TEXT
    assert text("<article><p>one <select><option>two</option></select> three</p></article>") == "one three"


def test_wrapped_pages_reach_the_array(spark, monkeypatch):
    """Pages of one host in wrappers and forms, without article: what repeats goes, by the suffix array."""
    notice = "<div><p>" + " ".join(f"notice{i}" for i in range(30)) + "</p></div>"
    own = lambda i: "<p>" + " ".join(f"own{i}x{j}" for j in range(40)) + "</p>"
    pages = [(i, f"http://h{i % 2}.org/{i}", f'<body><form id="f"><div class="wrap sidebar-page widget">{notice}{own(i)}</div></form></body>') for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    strings = df.select(F.lit(1).cast("long").alias("host"), F.xxhash64("page_id").alias("page"), "html").mapInArrow(op4.page_entries, "bucket long, check long, page long, judged boolean")
    assert strings.filter("judged").groupBy("bucket").agg(F.count_distinct("page").alias("n")).filter("n = 8").count() > 0
    got = {r.page_id: r.text for r in op4.main_texts(df).collect()}
    assert got == {i: " ".join(f"own{i}x{j}" for j in range(40)) for i in range(8)}


def remainder(iban):
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def test_mentions_corefer(spark):
    rows = [
        (1, "Frau Anna Müller kam. Frau Müller ging. Herr Müller auch."), (2, "Mr. John Smith and Mr. Smith; Mr Paul Smith, Mrs Smith"), (3, "+49 1512 3456789 and 01512 345 6789 and 01512/3456789 +4915123456789"),
        (4, "+49 (1512) 345-6789 tel"), (5, "IBAN DE89 3704 0044 0532 0130 00 ok DE89370400440532013000 end GB82WEST12345698765432"), (6, "plain 2024-01-02 10:30, 12.5, v3.4.5, 1,234,567 EN 12"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = {r.doc_id: r.text for r in op2.replace_pii(df, "key").collect()}
    assert t[6] == rows[5][1]
    a = re.fullmatch(r"Frau (\w+) (\w+) kam\. Frau (\w+) ging\. Herr (\w+) auch\.", t[1])
    assert a[2] == a[3] == a[4] != "Müller" and a[1] in op2.GIVEN["latin", "f"].split()
    b = re.fullmatch(r"Mr\. (\S+) (\w+) and Mr\. (\w+); Mr (\S+) (\w+), Mrs (\w+)", t[2])
    assert b[2] == b[3] == b[5] == b[6] != "Smith" and b[1] != b[4]
    c = re.fullmatch(r"\+49 (\d{4}) (\d{7}) and 0(\d{4}) (\d{3}) (\d{4}) and 0(\d{4})/(\d{7}) \+49(\d{11})", t[3])
    numbers = {c[1] + c[2], c[3] + c[4] + c[5], c[6] + c[7], c[8], re.sub(r"\D", "", t[4])[2:]}
    assert len(numbers) == 1 and numbers != {"15123456789"} and re.fullmatch(r"\+49 \(\d{4}\) \d{3}-\d{4} tel", t[4])
    d = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) ok (DE\d{20}) end (GB\d\d[A-Z]{4}\d{14})", t[5])
    assert d[1].replace(" ", "") == d[2] and {remainder(d[2]), remainder(d[3])} == {1} and "3704" not in t[5] and "WEST" not in t[5]


def test_parts_of_names_are_distinct(spark):
    """Many names of few given and family names: parts map one to one, whole names too."""
    given = [f"{a}{b}" for a in ("An", "Be", "Ca", "Do", "Er") for b in ("na", "ta", "ra", "lo", "mi", "so", "ku", "vi")]
    family = [f"{a}{b}" for a in ("Mor", "Kel", "Van", "Tis") for b in ("gan", "ler", "dyk", "son", "ova")]
    names = [f"Mrs. {g} {f}" for g in given for f in family]
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    new = [r.text.split(" ") for r in sorted(op2.replace_pii(df, "k").collect(), key=lambda r: r.doc_id)]
    assert len({tuple(x) for x in new}) == len(names) and all(x[0] == "Mrs." for x in new)
    for i, real in ((1, given), (2, family)):
        to = {}
        for n, x in zip(names, new, strict=True):
            assert to.setdefault(n.split(" ")[i], x[i]) == x[i]
        assert len(set(to.values())) == len(to) and not set(to.values()) & set(real)


def test_columns_of_any_name_pass(spark):
    clash = ["n_entities", "n_entities_1", "_found", "found", "uid", "_uid", "gaps", "new", "key", "id", "kind", "canon", "pos", "e", "other_0"]
    df = spark.createDataFrame([(1, "mail joe@x.org"), (2, "none")], "doc_id long, text string").withColumns({c: F.lit(c) for c in clash})
    out = op2.replace_pii(df, "k")
    assert out.columns == [*df.columns, "n_entities_2"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].n_entities_2 == 1 and rows[2].n_entities_2 == 0 and "joe@" not in str(rows) and all(rows[i][c] == c for i in (1, 2) for c in clash)
