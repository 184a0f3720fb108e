"""op8 against a plain version over made pages, and the cases that a ratio or a name decides."""

import random

import pytest
from pyspark.sql import functions as F

from fnatlas.llm import main_text
from tests.llm import brute

PROSE = "Long plain prose about many things of the world and more. " * 4
P = "".join(f"<p>{PROSE}</p>" for _ in range(3))
LINKS = "".join(f"<a href='/{i}'>link {i}</a> " for i in range(30))


def page(r: random.Random) -> str:
    words = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))

    def part(depth: int) -> str:
        kind = r.randrange(9)
        if kind < 3:
            return f"<p>{words(r.choice([1, 4, 30, 90]))}{' <b>' + words(2) + '</b>' if r.random() < 0.3 else ''}</p>"
        if kind == 3:
            return "<ul>" + "".join(f"<li><a href='x'>{words(r.randrange(1, 3))}</a></li>" for _ in range(r.randrange(1, 7))) + "</ul>"
        if kind == 4:
            return f"<h1>{words(3)}</h1>"
        if kind == 5:
            return f"<div class='{r.choice(['ad', 'comments', 'share-price', 'intro'])}'><p>{words(r.choice([3, 40]))}</p></div>"
        if kind == 6:
            return f"<div>{words(r.randrange(3))}{''.join(f'<a>{words(1)}</a> ' for _ in range(r.randrange(6)))}</div>"
        if depth > 2:
            return f"<p>{words(8)}</p>"
        return f"<div>{''.join(part(depth + 1) for _ in range(r.randrange(1, 5)))}</div>"

    body = "".join(part(0) for _ in range(r.randrange(1, 6)))
    if r.random() < 0.5:
        body += f"<article>{''.join(part(1) for _ in range(r.randrange(1, 6)))}</article>{part(0)}"
    return f"<html><body>{'<nav><ul><li>menu</li></ul></nav>' if r.random() < 0.5 else ''}{body}</body></html>"


def test_against_a_plain_version():
    r = random.Random(8)
    pages = [page(r) for _ in range(600)]
    got = [main_text.main_text(p) for p in pages]
    for p, text in zip(pages, got, strict=True):
        assert text == brute.page_text(p), p
    assert sum(text != brute.page_text(p, flat=True) for p, text in zip(pages, got, strict=True)) > 60  # the ratios matter


@pytest.mark.parametrize(
    ("inside", "around", "want"),
    [
        ("<section id='discussion'><p>Talk.</p></section>", "", "Talk."),
        ("<div class='share-price'>Price 12</div>", "", "Price 12"),
        ("<div class='article-header'><h1>Title</h1></div>", "", "Title"),
        ("<header><h1>Title</h1></header>", "<header><h1>Site</h1></header>", "Title"),
        (f"<div>{LINKS}</div><p>End.</p>", "", "End."),
        ("", f"<div class='comments'>{P}</div><aside>{P}</aside><div>{P}</div>", ""),
        ("<p>One <a href='x'>link</a>.</p>", f"<form>{P}</form>", "One link."),
    ],
)
def test_articles(inside, around, want):
    prose = " ".join([PROSE.strip()] * 3)
    assert main_text.main_text(f"<html><body><article>{P}{inside}</article>{around}</body></html>") == f"{prose} {want}".strip()


def test_pages_without_an_article():
    prose = " ".join([PROSE.strip()] * 3)
    read = main_text.main_text
    assert read(f"<html><body><nav><a>x</a></nav><div>{P}<p>Bye.</p></div></body></html>") == f"{prose} Bye."
    assert read(f"<html><body>{P}<p>Bye.</p></body></html>") == f"{prose} Bye."
    menu = "<ul>" + "".join(f"<li><a>link {i}</a></li>" for i in range(30)) + "</ul>"
    assert read(f"<html><body><div>{menu}</div><h1>Title</h1><div>{P}</div><p>Bye.</p></body></html>") == f"Title {prose} Bye."
    assert read("<p>Hi</p>") == "Hi" and read("") == "" and read(None) == "" and read("<nav>x</nav>") == ""
    assert read("<p>a &amp; b&#228;&nbsp;c<br>d") == "a & bä c d"


def test_rows(spark):
    long = "<html><body><article>" + "".join(f"<p>{PROSE}{i}</p>" for i in range(12_000)) + "</article></body></html>"
    rows = [(1, "u", long), (2, None, None), (2, None, None), (None, "v", f"<div>{P}</div>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    out = main_text.extract(d).collect()
    assert len(out) == 4 and all(x["n_chars"] == len(x["text"]) for x in out)
    assert {x["page_id"]: x["n_chars"] for x in out}[1] == len(" ".join(f"{PROSE}{i}" for i in range(12_000))) and sum(x["text"] == "" for x in out) == 2
    assert main_text.extract(d.filter("false")).count() == 0
