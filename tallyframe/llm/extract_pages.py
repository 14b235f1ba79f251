"""Labelled pages for the content model: small hand-written documents in which ``y="0"``
opens a region that is no part of the article and ``y="1"`` one that is; a region holds
until an inner element opens another. Frames around an article count as 1: content may
stand in them. They cover the parts that pages wrap around an article."""

from __future__ import annotations

_LONG = ("A long paragraph of running text tells the story in several sentences, with commas, and with "
         "a full stop at the end of each of them. It goes on for some time so that it looks like prose.")
_SHORT = "Short line of text."
#: Texts of many lengths, so that length alone says little.
_SIZES = ["One.", "Two words.", "A line of six short words.", "A line that is a little longer than the one before it.",
          "A sentence of some length, such as may stand in a caption, in a notice or in a heading of a page.", _LONG, f"{_LONG} {_LONG}"]
_LINK = '<a href="/x">Link text</a>'


def _items(n: int) -> str:
    return "".join(f"<li>{_LINK}</li>" for _ in range(n))


#: Class, id and role words of regions around an article, by the tag that holds them.
BOILERPLATE = [
    ("div", "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner"),
    ("div", "notice notices alert cookie cookies consent gdpr popup modal overlay toast announcement disclaimer warning"),
    ("div", "comment comments commentlist replies reply respond discussion disqus reader feedback"),
    ("div", "sidebar side aside widget widgets related recommended recommendations popular trending teaser more"),
    ("div", "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc"),
    ("div", "header masthead banner logo branding site top"), ("div", "footer foot bottom copyright legal credits imprint"),
    ("div", "share sharing social follow subscribe subscription newsletter signup login search form contact survey poll"),
    ("div", "author byline meta tags categories hidden print skip"),
]
#: Words of parts that pages also build from article elements.
REPEATED = ["comment", "comments", "reply", "replies", "related", "teaser"]
CONTENT = ["article", "content", "main", "post", "entry", "story", "text", "body", "articlebody", "maincontent", "prose"]


def pages() -> list[str]:
    nav = f'<nav y="0"><ul>{_items(6)}</ul></nav>'
    head = f'<header y="0"><h1>Site name</h1><p>{_SHORT}</p>{nav}</header>'
    foot = f'<footer y="0"><p>&copy; site.example</p>{_SHORT}</footer>'
    ad = f'<div class="ad" y="0">{_SHORT} {_SHORT}</div>'
    aside = f'<aside y="0"><h2>More</h2><p>{_SHORT}</p><ul>{_items(4)}</ul></aside>'
    form = f'<form y="0"><p>{_SHORT}</p><label>Name</label><input><button>Send</button></form>'
    ladder = "".join(f"<p>{t}</p><h2>{t}</h2><li>{t}</li>{t}" for t in _SIZES)
    loose = "".join(f"<p>{t}</p><h3>{t}</h3><li>{t}</li><div>{t}</div>" for t in _SIZES[:-1])
    body = (f"{ladder}<h1>Title of the article</h1><p>{_LONG}</p><p>{_SHORT}</p><h2>Part</h2><p>{_LONG}</p><p>{_SHORT}</p>"
            f"<ul><li>{_SHORT}</li><li>{_LONG}</li></ul><blockquote><p>{_LONG}</p></blockquote><pre>{_SHORT}</pre>"
            f"<h3>Last</h3><p>{_LONG}</p><ol><li>{_SHORT}</li></ol><table><tr><th>{_SHORT}</th><td>{_SHORT}</td></tr></table>"
            f"<p>{_LINK}</p><p>{_LONG} {_LINK}</p><ul>{_items(2)}</ul><figure><figcaption>{_SHORT}</figcaption></figure><dl><dt>{_SHORT}</dt><dd>{_LONG}</dd></dl><p>{_SHORT}</p>")
    out, wrap = [], "wrap wrapper container layout inner outer page row col"
    holders = [f'<article y="1">{body}</article>', f'<main y="1">{body}</main>', f'<main><article>{body}</article></main>',
               f'<section y="1">{body}</section>']
    holders += [f'<div class="{c}" y="1">{body}</div>' for c in CONTENT] + [f'<div id="{c}" y="1"><p>{_SHORT}</p>{body}</div>' for c in CONTENT]
    for i, h in enumerate(holders):
        out.append(f'<html><body><div class="{wrap}" id="page">{head if i % 2 else nav}{ad}{h}{aside if i % 3 else form}{foot}</div></body></html>')
    for tag, words in BOILERPLATE:
        for w in words.split():
            region = f'<{tag} class="{w}" y="0"><h3>{_SHORT}</h3><p>{_LONG}</p><p>{_SHORT}</p>{_SHORT}{loose}</{tag}>'
            within = f'<section class="{w}" y="0"><p>{_LONG}</p></section>'
            if w in REPEATED:
                within += f'<article class="{w}" y="0"><p>{_SHORT}</p></article>'
            end = f'<ul class="{w}" y="0"><li>{_LONG}</li></ul><p class="{w}" y="0">{_SHORT}</p><span id="{w}" y="0">{_SHORT}</span>'
            out.append(f'<html><body><div class="{wrap}" id="page">{nav}<article y="1">{body}{region}{within}{end}<p>{_LONG}</p></article>{region}{foot}</div></body></html>')
            out.append(f'<html><body><div class="{wrap}" id="page">{head}<article y="1"><h1>Title</h1>{ladder}<p>{_LONG}</p>{aside}<p>{_LONG}</p>{form}<p>{_SHORT}</p>{foot}{nav}</article>{ad}</div></body></html>')
    return out
