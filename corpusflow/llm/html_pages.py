"""Labelled pages for the HTML model: layouts of many kinds, each drawn from a seed.

``data-y`` marks elements: 1 for the article, 0 for what is around or inside it and
isn't part of it. What lies below a mark has its label; elements above all marks,
such as the body or layout tables, have the label of most of the text below them.
"""

from __future__ import annotations

import random

_FILL = """the a of and to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each
about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may
water long little very after words called just where most know house world town river night day old great country year wind stone field""".split()
_CONTENT = ["article", "content", "main", "post", "entry", "story", "body", "text", "main-content", "article-body", "post-content", "entry-content", "page-text", "prose", "markdown", "news-story"]
_NEUTRAL = ["wrapper", "container", "row", "col", "inner", "outer", "page", "site", "grid", "box", "block", "left", "right", "center", "section", "column", "clearfix", "layout", "group", "panel"]
_AROUND = {
    "menu": ["menu", "nav", "navigation", "navbar", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "pagination", "pager", "tabs", "tags", "categories", "toc"],
    "header": ["header", "site-header", "masthead", "page-header", "top-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "disclaimer", "imprint"],
    "side": ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more-stories", "aside", "teaser", "archive", "links", "blogroll", "author-bio"],
    "notice": ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "banner", "notice", "alert", "warning", "popup", "modal", "overlay", "paywall", "announcement"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "ad-slot", "banner-ad", "commercial", "partner"],
    "share": ["share", "social", "sharing", "follow", "social-links", "share-buttons"],
    "comments": ["comments", "comment", "comment-list", "responses", "replies", "reply", "disqus", "discussion", "reviews", "feedback"],
    "form": ["search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "subscription"],
}
_SAID = {
    "footer": ["&copy; 2020 Some Site. All rights reserved.", "Copyright by the publisher", "Terms of use and privacy policy", "&copy; example.com &middot; imprint"],
    "notice": ["We use cookies to make this site better. Accept cookies?", "This site uses cookies. By staying you agree to our privacy policy.", "Please enable JavaScript.", "Subscribe to go on reading."],
    "share": ["Share this", "Follow us", "Tweet"],
    "advert": ["Advertisement", "Sponsored", "Buy now, save half!"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        ws = [self.r.choice(_FILL) for _ in range(self.r.randint(low, high))]
        return (" ".join(ws)).capitalize() + self.r.choice(".....!?")

    def long(self) -> str:
        return " ".join(self.words(8, 22) for _ in range(self.r.randint(2, 7)))

    def text(self) -> str:
        return self.r.choice([self.long, self.long, lambda: self.words(6, 18), lambda: self.words(1, 4)])()

    def rich(self) -> str:
        t = self.text()
        if self.r.random() < 0.4:
            t += " " + self.r.choice([f"<b>{self.words(1, 5)}</b>", f"<i>{self.words(1, 3)}</i>", f'<a href="/x">{self.words(1, 3)}</a>', f"<em>{self.words(1, 3)}</em>", f"<span>{self.words(2, 6)}</span>", "<br>"]) + " " + self.text()
        return t

    def links(self) -> list[str]:
        return [f'<a href="/{k}">{self.r.choice(["Home", "News", "About", "Contact", "More", self.words(1, 3)])}</a>' for k in range(self.r.randint(2, 9))]

    def attrs(self, names: list[str], p: float = 0.9) -> str:
        if self.r.random() > p:
            return ""
        key = self.r.choice(["class", "class", "id"])
        own = self.r.sample(names, min(len(names), self.r.choice([1, 1, 2])))
        return f' {key}="{" ".join(own + (self.r.sample(_NEUTRAL, 1) if self.r.random() < 0.3 else []))}"'

    # parts of an article

    def block(self, tag: str) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            return f"<{tag}>{self.rich()}</{tag}>"
        if kind < 0.70:
            return (lambda h: f"<{h}>{self.words(1, 6)}</{h}>")(r.choice(["h2", "h3", "h4"]))
        if kind < 0.80:
            return (lambda u: f"<{u}>" + "".join(f"<li>{self.rich()}</li>" for _ in range(r.randint(2, 5))) + f"</{u}>")(r.choice(["ul", "ol"]))
        if kind < 0.84:
            return f"<blockquote>{r.choice(['<p>%s</p>', '%s']) % self.long()}</blockquote>"
        if kind < 0.88:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.91:
            return f"<pre><code>{self.words(3, 12)}</code></pre>"
        if kind < 0.94:
            return f"<figure><img src=x.png><figcaption>{self.words(3, 9)}</figcaption></figure>"
        if kind < 0.97:
            return f"<dl><dt>{self.words(1, 2)}</dt><dd>{self.words(4, 12)}</dd></dl>"
        return f"<div{self.attrs(_NEUTRAL, 0.3)}>{self.rich()}</div>"

    def article(self, inside: bool) -> str:
        r = self.r
        tag = r.choice(["p"] * 6 + ["div"] * 2)
        out = [self.block(tag) for _ in range(r.randint(1, 7))] + ([f"<p>{self.long()}</p>"] if r.random() < 0.7 else [])
        if r.random() < 0.1:  # plain text with line breaks
            out = ["<br>".join(self.rich() for _ in range(r.randint(1, 5)))]
        if r.random() < 0.7:
            head = f"<h1>{self.words(2, 9)}</h1>"
            out.insert(0, f"<header>{head}</header>" if r.random() < 0.3 and inside else head)
        if r.random() < 0.2:
            k = len(out) // 2
            out = [f"<section>{''.join(out[:k])}</section>", f"<section>{''.join(out[k:])}</section>"]
        if inside:
            for _ in range(r.choice([0, 0, 1, 2])):
                out.insert(r.randint(1, len(out)), self.around(r.choice(["side", "advert", "share", "form", "menu", "comments", "notice"]), True))
        return "".join(out)

    # parts around it

    def around(self, kind: str, inside: bool = False) -> str:
        r = self.r
        ls = self.links()
        listed = "<ul>" + "".join(f"<li>{a}</li>" for a in ls) + "</ul>"
        flat = r.choice([" | ", " ", "<br>", " &middot; "]).join(ls)
        said = r.choice(_SAID.get(kind, [self.words(3, 14)]))
        named = lambda tag, p=0.9: f"{tag}{self.attrs(_AROUND[kind], p)}"
        mark = " data-y=0"
        box = lambda tag, what: f"<{tag}{mark}>{what}</{tag.split(' ')[0]}>"
        if kind == "menu":
            return box(r.choice(["nav", named("nav", 0.5), named("div"), named("ul"), "div", "ul"]), r.choice([listed, flat]) if r.random() < 0.9 else flat + f"<p>{self.words(2, 8)}</p>")
        if kind == "header":
            return box(r.choice(["header", named("header", 0.5), named("div", 1)]), (lambda h: f"<{h}>{self.words(1, 4)}</{h}>")(r.choice(["h1", "h2", "div", "p"])) + r.choice(["", listed, flat, f"<p>{self.words(2, 8)}</p>"]))
        if kind == "footer":
            return box(r.choice(["footer", named("footer", 0.5), named("div", 1)]), r.choice([said, f"<p>{said}</p>", f"<p>{said} {self.text()}</p>{flat}", listed + f"<p>{said}</p>", self.text(), f"<p>{self.long()}</p>"]))
        if kind == "side":
            what = [f"<h3>{self.words(1, 4)}</h3>", r.choice([listed, f"<p>{self.text()}</p>", f"<p>{self.long()}</p>{flat}", self.text()])]
            return box(r.choice(["aside", named("aside", 0.5), named("div", 1)]), "".join(what[r.randint(0, 1) :]))
        if kind == "notice":
            return box(r.choice([named("div", 1), named("section", 1), "dialog", named("p", 1)]), r.choice([said, self.text(), f"{said} <button>OK</button>"]))
        if kind == "advert":
            return box(r.choice([named("div", 1), named("section", 1), named("aside", 0.7), named("p", 1)]), r.choice([said, self.text(), f"<p>{self.text()}</p><a href=x>{self.words(1, 3)}</a>"]))
        if kind == "share":
            return box(named(r.choice(["div", "ul"]), 1), said + flat)
        if kind == "comments":
            each = lambda: r.choice(["<li class=comment>%s</li>", '<div class="comment">%s</div>', "<article class=comment>%s</article>", "<p>%s</p>"]) % r.choice([self.text(), f"<p>{self.text()}</p>", f"<b>{self.words(1, 2)}</b> {self.long()}"])
            return box(r.choice([named("div", 1), named("section", 1), named("ol", 1)]), r.choice(["", f"<h3>{r.randint(1, 40)} Comments</h3>"]) + "".join(each() for _ in range(r.randint(1, 4))))
        return box(named("form", 0.5), f"<label>{self.words(1, 2)}</label><input name=q>" + r.choice(["", f"<p>{self.words(3, 9)}</p>", "<select><option>all</option></select>"]) + "<button>Go</button>")

    def page(self) -> str:
        r = self.r
        shape = r.choice(["article"] * 4 + ["main", "main article", "named", "named", "named", "section", "div", "div", "neutral", "neutral", "body", "body", "table", "deep", "font"])
        bare = shape in ("body",)
        what = self.article(not bare and r.random() < 0.6)
        y = " data-y=1"
        if shape in ("article", "main", "section"):
            what = f"<{shape}{self.attrs(_CONTENT + _NEUTRAL, 0.4)}{y}>{what}</{shape}>"
        elif shape == "main article":
            what = f"<main{y}><article>{what}</article></main>"
        elif shape == "named":
            what = f"<div{self.attrs(_CONTENT, 1)}{y}>{what}</div>"
        elif shape == "div":
            what = f"<div{y}>{what}</div>"
        elif shape == "neutral":
            what = f"<div{self.attrs(_NEUTRAL, 1)}{y}>{what}</div>"
        elif shape == "table":
            what = f"<table><tr><td>{self.around('menu')}</td><td{y}>{what}</td></tr></table>"
        elif shape == "deep":
            what = f"<div{self.attrs(_NEUTRAL, 0.5)}><div{self.attrs(_NEUTRAL, 0.5)}><div{self.attrs(_CONTENT + _NEUTRAL, 0.5)}{y}>{what}</div></div></div>"
        elif shape == "font":
            what = f"<center><font{y}>{what}</font></center>"
        before = [self.around(k) for k in r.sample(["menu", "header", "notice", "advert", "form", "menu", "side"], r.choice([0, 1, 2, 3, 4]))]
        after = [self.around(k) for k in r.sample(["footer", "side", "comments", "advert", "form", "menu", "share", "footer"], r.choice([0, 1, 2, 3, 4]))]
        if r.random() < 0.3 and (before or after) and not bare:
            what = f"<div{self.attrs(_NEUTRAL, 0.8)}>{''.join(before[1:])}{what}{''.join(after[:-1])}</div>"
            before, after = before[:1], after[-1:]
        head = f"<head><title>{self.words(2, 6)}</title><meta charset=utf-8><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
        return f"<html>{head}<body{y if bare else ''}>{''.join(before)}{what}{''.join(after)}</body></html>"


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    return [_Maker(seed * 100_003 + k).page() for k in range(n)]
