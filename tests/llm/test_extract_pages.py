"""Content extraction on pages that are broken or hold markup where no tag is."""

import numpy as np
import pytest

from tallyframe.llm import extract
from tallyframe.llm.extract_pages import pages

LONG = "The harbour was quiet in the morning and the boats came in one after the other with the catch of the night. "


def main_text(spark, html):
    d = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    return extract.extract(d).first().text


def page(inner):
    return f"<html><body><nav class='menu'><a href='/'>Home</a> <a href='/x'>News</a></nav><article><h1>Title</h1>{inner}</article></body></html>"


@pytest.mark.parametrize("odd", ['<div data-y="abc">{}</div>', '<p y="10%">{}</p>', '<p y=>{}</p>', "<div class='a' y='7'><p>{}</p></div>"])
def test_attributes_of_pages_are_no_labels(spark, odd):
    assert LONG.strip() in main_text(spark, page(odd.format(LONG) + f"<p>{LONG}</p>"))


def test_scripts_hold_no_tags(spark):
    got = main_text(spark, page(f"<p>{LONG}one</p><script>if (a <b) x='it'; // don't</script><p>{LONG}two</p><p>{LONG}three</p>"))
    assert all(LONG + w in got for w in ("one", "two", "three")) and "<" not in got and "don't" not in got


def test_media_and_formulas(spark):
    got = main_text(spark, page(f"<p>{LONG}one</p><svg><path d='M0 0'><p>{LONG}two</p><p>{LONG}three</p>"))
    assert all(LONG + w in got for w in ("one", "two", "three"))
    got = main_text(spark, page(f"<p>{LONG}with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it</p><p>{LONG}<svg><title>icon</title></svg>end</p>"))
    assert "with x=2 in it" in got and "icon" not in got and LONG + "end" in got


def test_mutated_pages_do_not_crash():
    g = np.random.default_rng(1)
    made = pages()
    for html in [made[i] for i in g.integers(0, len(made), 40)]:
        for _ in range(6):
            a, b = sorted(g.integers(0, len(html) + 1, 2))
            piece = ["", "<", ">", "'", '"', "<svg>", "<script>", "<b y=x", " y='?' ", "</p", "<!--", "&#x;", "\0"][g.integers(0, 13)]
            html = html[:a] + piece + html[b if b - a < 30 else a:]
        p = extract.Page(html)
        assert len(p.parent) == len(p.marks) == len(p.depth)
