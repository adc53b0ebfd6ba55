"""Labelled pages that the HTML model is trained on: parts of common page designs, marked y="1" (content) or y="0"."""

from __future__ import annotations

import random

NOISE = [
    '<header y="0"><div class="logo"><a href="/">Daily {w}</a></div><p>{s}</p></header>',
    '<header class="masthead" y="0"><h2><a href="/">{w} {w}</a></h2></header>',
    '<div id="header" y="0"><a href="/">{w}</a> <span>{s}</span></div>',
    '<header y="0"><h1>{w}</h1><p>{s}</p></header>',
    '<header y="0"><h1><a href="/">{w} {w}</a></h1><nav><a href="/a">{w}</a> <a href="/b">{w}</a></nav></header>',
    '<header class="site" y="0"><h1>{w} {w} {w}</h1></header>',
    '<nav y="0"><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li><li><a href="/c">{w} {w}</a></li></ul></nav>',
    '<div class="navbar menu" y="0"><a href="/a">{w}</a> | <a href="/b">{w}</a> | <a href="/c">{w}</a></div>',
    '<ul class="breadcrumbs" y="0"><li><a href="/">{w}</a></li><li>{w}</li></ul>',
    '<div role="navigation" y="0"><a href="/p">{w}</a><a href="/q">{w}</a></div>',
    '<ul id="menu" y="0"><li><a href="/x">{w}</a></li><li><a href="/y">{w}</a></li></ul>',
    '<div class="cookie-banner" y="0"><p>{s}</p><button>{w}</button></div>',
    '<div id="consent" class="notice" y="0">{s} <a href="/privacy">{w}</a></div>',
    '<div class="alert popup" role="alert" y="0"><p>{s}</p></div>',
    '<div class="cookie-notice" role="dialog" y="0">{s} {s}</div>',
    '<div id="cookieBar" y="0"><p>{s} {s}</p></div>',
    '<p class="notification" y="0">{s}</p>',
    '<div class="ad" y="0">{s}</div>',
    '<div class="ads" y="0">{s} {s}</div>',
    '<div class="advert sponsored" y="0"><p>{s}</p><p>{s}</p></div>',
    '<section class="promo" y="0"><h3>{w}</h3><p>{s}</p></section>',
    '<div class="advertisement" id="ad-2" y="0"><a href="/buy">{s}</a></div>',
    '<aside y="0"><h3>{w}</h3><p>{s}</p><ul><li><a href="/1">{s}</a></li></ul></aside>',
    '<aside class="sidebar" y="0"><p>{s} {s}</p></aside>',
    '<div class="sidebar widget" y="0"><h4>{w}</h4><p>{s}</p><p>{s} {s}</p></div>',
    '<div id="related" class="recommended" y="0"><h3>{w}</h3><ul><li><a href="/1">{s}</a></li><li><a href="/2">{s}</a></li></ul></div>',
    '<div class="share social" y="0"><a href="/t">{w}</a><a href="/f">{w}</a></div>',
    '<form class="newsletter subscribe" y="0"><label>{s}</label><input name="m"><button>{w}</button></form>',
    '<form action="/search" y="0"><p>{s}</p><select><option>{w}</option><option>{w}</option></select></form>',
    '<div class="login-form" y="0"><form><p>{s}</p><input><button>{w}</button></form></div>',
    '<section class="comments" y="0"><h3>{w}</h3><div class="comment"><p>{s} {s}</p></div><div class="comment"><p>{s}</p></div></section>',
    '<div id="comments" y="0"><ol class="comment-list"><li class="comment"><b>{w}</b><p>{s} {s} {s}</p></li></ol></div>',
    '<div id="disqus_thread" class="discussion replies" y="0"><article class="reply"><p>{s} {s}</p></article></div>',
    '<section id="reader-comments" y="0"><article class="user-comment"><p>{s}</p></article><article class="user-comment"><p>{s} {s}</p></article></section>',
    '<footer y="0"><p>&copy; {w}. {s}</p><a href="/imprint">{w}</a></footer>',
    '<footer y="0">&copy; {w} &middot; {s}</footer>',
    '<div class="site-footer" y="0"><p>{s}</p></div>',
    '<div id="footer" role="contentinfo" y="0">&copy; {w} {s}</div>',
]
#: What stands between the paragraphs of an article without being part of it.
INNER = [
    '<p class="notice" y="0">{s}</p>', '<p class="comment" y="0">{s}</p>', '<p class="advert" y="0">{s}</p>',
    '<p class="cookie" y="0">{s} {s}</p>', '<p class="share" y="0"><a href="/t">{w}</a></p>', '<div class="ad" y="0">{s}</div>',
    '<div class="comment" y="0"><p>{s}</p></div>', '<div class="notice" y="0"><p>{s} {s}</p></div>', '<footer y="0">{s}</footer>',
    '<aside y="0"><p>{s}</p></aside>', '<div class="related" y="0"><a href="/1">{s}</a></div>', '<p class="promo" y="0">{s}</p>',
    '<form y="0"><p>{s}</p><input><button>{w}</button></form>', '<nav y="0"><a href="/a">{w}</a> <a href="/b">{w}</a></nav>',
    '<p class="copyright" y="0">&copy; {w} {s}</p>', '<section class="comments" y="0"><p class="comment">{s}</p></section>',
    '<p class="newsletter" y="0">{s}</p>', '<p class="sidebar" y="0">{s}</p>', '<p class="reply" y="0">{s}</p>',
]
WRAPPERS = [
    '<article y="1">{body}</article>',
    '<article class="post" y="1"><header><h1>{w} {w}</h1></header>{body}</article>',
    '<main y="1"><article>{body}</article></main>',
    '<main id="content" y="1">{body}</main>',
    '<div id="content" class="article-body" y="1">{body}</div>',
    '<div class="entry-content" y="1">{body}</div>',
    '<section class="story" y="1">{body}</section>',
    '<div class="post" y="1"><div class="text">{body}</div></div>',
    '<div y="1">{body}</div>',
]
CONTENT = [
    "<p>{s}</p>", "<p>{s} {s} {s}</p>", "<p><b>{s}<br><p>{s} {s}</p>", "<p>{w}.</p>", "<h2>{w} {w}</h2>",
    "<p>{s} <a href='/r'>{w}</a> {s}</p>", "<ul><li>{s}</li><li>{s}</li></ul>", "<blockquote><p>{s}</p></blockquote>",
    "<pre>{s}</pre>", "<table><tr><td>{w}</td><td>{s}</td></tr></table>", "<div><p>{s} {s}</p></div>",
    "<figure><img src='x'><figcaption>{s}</figcaption></figure>", "<section><h3>{w}</h3><p>{s} {s}</p></section>",
]


def labelled_pages(count: int = 320, seed: int = 3) -> list[str]:
    """Pages put together from the parts above; the same arguments give the same pages."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(("ta", "re", "mon", "li", "ver", "so", "qui", "an")) for _ in range(rng.randint(1, 4)))

    def sentence() -> str:
        return (" ".join(word() for _ in range(rng.randint(3, 30)))).capitalize() + "."

    def fill(part: str) -> str:
        while "{w}" in part:
            part = part.replace("{w}", word(), 1)
        while "{s}" in part:
            part = part.replace("{s}", sentence(), 1)
        return part

    pages = []
    for number in range(count):
        before = [rng.choice(NOISE) for _ in range(rng.randint(0, 4))]
        after = [rng.choice(NOISE) for _ in range(rng.randint(0, 4))]
        body = ["<h1>{w} {w} {w}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 9)):
            body.append(rng.choice(CONTENT))
            if rng.random() < 0.15:
                body.append(rng.choice([n for n in NOISE if not n.startswith("<header")]))
        if rng.random() < 0.5:  # short articles with a lot in between
            body = body[: rng.randint(1, 4)] if rng.random() < 0.6 else body
            for _ in range(rng.randint(1, 5)):
                body.insert(rng.randint(0, len(body)), rng.choice(INNER))
        middle = WRAPPERS[number % len(WRAPPERS)].replace("{body}", "".join(body))
        inner = "".join([*before, middle, *after])
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{inner}</div>'
        pages.append(fill(f"<html><head><title>{{w}}</title></head><body>{inner}</body></html>"))
    return pages
