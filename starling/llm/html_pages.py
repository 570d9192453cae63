"""Labelled pages for the extractor: layouts of the web as fixed data, filled with random words.

Each layout is a list of parts; a part is (is it main text, HTML with one %s for its
text, least and most words). Parts open and close containers where their HTML does.
"""

from __future__ import annotations

import random

# Parts by kind; True marks main text.
HEADS = [
    [(False, "<nav><ul>", 0, 0), *[(False, '<li><a href="/x">%s</a></li>', 1, 2)] * 6, (False, "</ul></nav>", 0, 0)],
    [(False, '<header class="site-header"><div class="logo"><a href="/">%s</a></div>', 1, 3), (False, '<p class="tagline">%s</p></header>', 3, 8)],
    [(False, '<div id="menu" class="menu navbar">', 0, 0), *[(False, '<a href="/x">%s</a>', 1, 2)] * 4, (False, "</div>", 0, 0)],
    [(False, '<header><h1 class="site-title"><a href="/">%s</a></h1></header>', 1, 3), (False, '<div class="breadcrumbs breadcrumb"><a href="/">%s</a> &rsaquo; ', 1, 2), (False, "<span>%s</span></div>", 1, 3)],
    [(False, '<div class="topbar header"><span>%s</span></div>', 2, 6), (False, '<form class="search" action="/s"><label>%s</label><input name="q"></form>', 1, 3)],
    [],
]
NOTICES = [
    [(False, '<div class="ad">%s</div>', 4, 12)],
    [(False, '<div class="cookie-notice notice banner" role="dialog"><p>%s</p></div>', 8, 30)],
    [(False, '<div class="advert advertisement sponsored promo"><p>%s</p></div>', 4, 20)],
    [(False, '<div id="cookie-consent" class="consent popup"><p>%s</p><button>ok</button></div>', 6, 25)],
    [(False, '<div class="alert notice">%s</div>', 5, 20)],
    [],
]
WRAPPERS = ["", "", "", '<div id="wrapper" class="site page">', '<div class="site-container page-wrapper">', '<div id="root"><div class="app layout">', '<div id="container" class="outer">', '<div class="page theme">']
OPENINGS = ["<article>", '<main><article class="post">', '<div id="content" class="content main"><div class="post-content entry-content article-body">', '<main id="main">', '<section class="article story"><div class="body text">', '<div class="wrapper container"><div class="article">', '<div id="content-area" class="site-content"><div class="post single-post">', '<div class="main-column"><div class="story-body">']
CLOSINGS = ["</article>", "</article></main>", "</div></div>", "</main>", "</div></section>", "</div></div>", "</div></div>", "</div></div>"]
TITLES = ["<h1>%s</h1>", '<h1 class="title headline entry-title">%s</h1>', "<h2>%s</h2>", '<header class="entry-header"><h1 class="entry-title">%s</h1></header>']
MAIN = [
    ("<p>%s</p>", 8, 120), ("<p>%s</p>", 8, 60), ("<p>%s</p>", 1, 8), ("<p><b>%s</b><br>", 20, 80), ("<h2>%s</h2>", 2, 8), ("<h3>%s</h3>", 2, 6), ("<blockquote>%s</blockquote>", 6, 40),
    ("<ul><li>%s</li>", 3, 20), ("<li>%s</li></ul>", 3, 20), ("<ol><li>%s</li></ol>", 3, 20), ("<pre>%s</pre>", 4, 30), ("<table><tr><td>%s</td></tr></table>", 2, 10),
    ("<p>%s <a href='/y'>x</a></p>", 10, 60), ("<figure><figcaption>%s</figcaption></figure>", 4, 15), ("<div>%s</div>", 15, 80), ("%s<br><br>", 10, 60),
]
INSIDE = [  # between or after paragraphs, within the article
    [(False, '<div class="ad advert">%s</div>', 3, 12)],
    [(False, '<aside class="related"><p><a href="/r">%s</a></p></aside>', 3, 10)],
    [(False, '<div class="share social share-buttons"><a href="/s">%s</a></div>', 1, 3)],
    [(False, '<form class="newsletter subscribe"><p>%s</p><label>e-mail</label><input><button>go</button></form>', 5, 20)],
    [(False, '<ul class="tags"><li><a href="/t">%s</a></li></ul>', 1, 2)],
    [(False, '<div class="promo"><p>%s</p></div>', 5, 20)],
    [], [],
]
COMMENTS = [
    [(False, '<section class="comments" id="comments"><h2>%s</h2>', 1, 3), *[(False, '<div class="comment"><p>%s</p></div>', 5, 50)] * 3, (False, "</section>", 0, 0)],
    [(False, '<ol class="commentlist comment-list"><li class="comment"><div class="comment-body"><p>%s</p></div></li>', 5, 40), (False, '<li class="comment"><p>%s</p></li></ol>', 5, 40)],
    [(False, '<div class="comments-area"><div class="comment-content"><p>%s</p></div></div>', 5, 50)],
    [(False, '<div id="disqus_thread" class="responses replies"><p>%s</p></div>', 5, 60)],
    [(False, '<div class="user-comments"><h3>%s</h3>', 1, 3), (False, '<div class="reply"><p>%s</p></div></div>', 8, 60)],
    [], [], [],
]
ASIDES = [
    [(False, '<aside class="sidebar"><h3>%s</h3><ul>', 1, 3), *[(False, '<li><a href="/x">%s</a></li>', 2, 8)] * 4, (False, "</ul></aside>", 0, 0)],
    [(False, '<div id="sidebar" class="sidebar widget widget-area"><h4>%s</h4>', 1, 3), (False, "<p>%s</p></div>", 5, 30)],
    [(False, '<div class="related recommended more-stories"><h3>%s</h3>', 1, 4), (False, '<p><a href="/m">%s</a></p></div>', 3, 12)],
    [(False, "<aside><p>%s</p></aside>", 4, 40)],
    [], [],
]
FOOTS = [
    [(False, "<footer>&copy; %s</footer>", 3, 14)],
    [(False, '<footer class="site-footer"><p>%s</p></footer>', 3, 25), (False, '<div class="copyright">&copy; %s</div>', 2, 8)],
    [(False, '<div id="footer" class="footer"><p>&copy; %s &middot; <a href="/p">x</a></p></div>', 2, 12)],
    [(False, '<footer><ul><li><a href="/a">%s</a></li><li><a href="/b">y</a></li></ul></footer>', 1, 3)],
    [],
]
SYLLABLES = "an be co du el fa gi ho in ja ke lo mu na or pa qui re sa ti un ve wo xe yo zu th er on st".split()
STOPS = [".", ".", ".", "?", "!", ""]


def labelled_pages(n: int = 400, seed: int = 7):
    """Pairs of a page's HTML and the words of its main text; each word is unique within its page."""
    rng = random.Random(seed)
    for _ in range(n):
        used = 0

        def text(least: int, most: int) -> list[str]:
            nonlocal used
            out = []
            for _ in range(rng.randint(least, most)):
                used += 1
                out.append("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + f"{used:x}")
            return out

        html, main = ["<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"], set()

        def put(is_main: bool, part: str, least: int, most: int):
            words = text(least, most)
            if "%s" in part:
                if is_main:
                    main.update(words)
                said = " ".join(words)
                part = part.replace("%s", (said[:1].upper() + said[1:] if most > 3 else said) + (rng.choice(STOPS) if most > 12 else ""))
                if is_main:
                    main.add(words[0][:1].upper() + words[0][1:]) if words else None
            html.append(part)

        html.append(rng.choice(WRAPPERS))
        for group in (rng.choice(HEADS), rng.choice(NOTICES)):
            for part in group:
                put(*part)
        k = rng.randrange(len(OPENINGS))
        html.append(OPENINGS[k])
        put(True, rng.choice(TITLES), 3, 12)
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            put(True, *rng.choice(MAIN[:4] if rng.random() < 0.7 else MAIN))
            if rng.random() < 0.12:
                for part in rng.choice(INSIDE):
                    put(*part)
        if rng.random() < 0.3:
            for part in rng.choice(COMMENTS):
                put(*part)
        html.append(CLOSINGS[k])
        for group in rng.sample((rng.choice(COMMENTS), rng.choice(ASIDES), rng.choice(NOTICES)), 3):
            for part in group:
                put(*part)
        for part in rng.choice(FOOTS):
            put(*part)
        yield "".join(html) + ("</body></html>" if rng.random() < 0.8 else ""), main
