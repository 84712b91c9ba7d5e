"""Labelled pages that the field of ``html_crf`` is trained on.

Layouts of articles, shop pages, blogs, forums and portals, written for this package. Between ``[[`` and ``]]`` stands
what a reader would call the article; everything else is menus, headers, footers, sidebars, notices, adverts, forms
and reader comments. Marks are replaced by invented text: {P} a paragraph, {S} a short one, {H} a heading, {L} a few
linked words, {W} a word or two, {N} a number. Each layout is filled several times, so that no wording is learnt.
"""

from __future__ import annotations

import random

from sitesieve.llm.html_blocks import Block, blocks

_LINKS = "<ul>" + '<li><a href="/x">{W}</a></li>' * 5 + "</ul>"
_NAV = f"<nav>{_LINKS}</nav>"
LAYOUTS = [
    # plain article pages, with the parts that surround them in different markup
    f"<body>{_NAV}<div class='ad'>{{S}}</div><article>[[<h1>{{H}}</h1><p><b>{{H}}<br><p>{{P}}</p><p>{{P}}</p><p>{{W}}.</p><p><b>{{P}}<br><p>{{P}}]]</article><footer>&copy; {{W}} {{S}}</footer></body>",
    f"<body><header><div class='logo'>{{W}}</div>{_NAV}</header><main>[[<h1>{{H}}</h1><p>{{P}}</p><h2>{{H}}</h2><p>{{P}}</p><ul><li>{{S}}</li><li>{{S}}</li></ul><p>{{P}}</p>]]</main><aside><h3>{{W}}</h3><p>{{S}}</p><ul><li><a href='#'>{{L}}</a></li><li><a href='#'>{{L}}</a></li></ul></aside><footer><p>{{S}}</p><p>&copy; {{N}} {{W}}</p></footer></body>",
    f"<body><div id='header'><h2>{{W}}</h2><p class='tagline'>{{S}}</p></div><div id='menu'>{_LINKS}</div><div id='content'>[[<h1>{{H}}</h1><p>{{P}}</p><p>{{S}}</p><blockquote>{{P}}</blockquote><p>{{P}}</p>]]<div class='share'>{{W}} <a href='#'>{{W}}</a></div><div class='comments'><h3>{{N}} {{W}}</h3><div class='comment'><p class='author'>{{W}}</p><p>{{P}}</p></div><div class='comment'><p>{{S}}</p></div></div></div><div id='sidebar'><p>{{P}}</p></div><div id='footer'>{{S}}</div></body>",
    f"<body><div class='cookie-notice'><p>{{P}}</p><button>{{W}}</button></div><div class='navbar'>{_LINKS}</div><div class='container'><div class='post'>[[<h1 class='title'>{{H}}</h1>]]<div class='meta'>{{W}} {{N}} <a href='#'>{{W}}</a></div><div class='entry-content'>[[<p>{{P}}</p><p>{{P}}</p><h3>{{H}}</h3><p>{{P}}</p>]]<div class='advert'><p>{{S}}</p></div>[[<p>{{P}}</p>]]</div></div><div class='widget'><h4>{{W}}</h4><p>{{S}}</p></div></div><div class='copyright'>© {{N}} {{W}}</div></body>",
    f"<body>{_NAV}<article>[[<h1>{{H}}</h1><p>{{P}}</p>]]<aside>{{P}}</aside>[[<p>{{P}}</p>]]<div class='ad'>{{P}}</div>[[<p>{{S}}</p>]]<section class='comments'><h2>{{W}}</h2><article class='comment'><p>{{P}}</p></article><article class='comment'><p>{{S}}</p></article><form><label>{{W}}</label><textarea>{{S}}</textarea><button>{{W}}</button></form></section></article><footer>{{S}}</footer></body>",
    f"<body><header><p>{{S}}</p><form><input><label>{{W}}</label></form></header>{_NAV}<section>[[<h2>{{H}}</h2><p>{{P}}</p><p>{{P}}</p><table><tr><th>{{W}}</th><th>{{W}}</th></tr><tr><td>{{W}}</td><td>{{N}}</td></tr></table><p>{{P}}</p>]]</section><section class='related'><h3>{{W}}</h3><ul><li><a href='#'>{{L}}</a></li><li><a href='#'>{{L}}</a></li></ul></section><section class='newsletter'><h3>{{W}}</h3><p>{{S}}</p><form><p>{{S}}</p><button>{{W}}</button></form></section><footer><ul><li><a href='#'>{{W}}</a></li></ul><p>{{P}}</p></footer></body>",
    "<body><div class='breadcrumb'><a href='#'>{W}</a> › <a href='#'>{W}</a></div><div class='alert notice'>{P}</div><div class='story-body'>[[<h1>{H}</h1><div>{P}</div><div>{P}</div><div>{S}</div><div>{P}</div>]]</div><div class='sponsored'><div>{P}</div></div><div class='promo banner'>{S}</div><div class='pagination'><a href='#'>{N}</a> <a href='#'>{N}</a></div><div class='disclaimer legal'>{P}</div></body>",
    f"<body><div class='top'>{_LINKS}</div>[[<h1>{{H}}</h1><p>{{P}}</p><p>{{P}}</p><p>{{P}}</p>]]<hr><p><a href='#'>{{L}}</a> | <a href='#'>{{L}}</a> | <a href='#'>{{L}}</a></p><p>&copy; {{N}} {{W}}</p></body>",
    f"<body>{_NAV}<main><article>[[<header><h1>{{H}}</h1></header><p>{{P}}</p><figure><img><figcaption>{{S}}</figcaption></figure><p>{{P}}</p><pre>{{S}}</pre><ol><li>{{P}}</li><li>{{S}}</li></ol>]]<footer><p>{{W}} <a href='#'>{{W}}</a></p></footer></article><div id='disqus_thread' class='discussion replies'><div class='reply'>{{P}}</div><div class='reply'>{{S}}</div></div></main><div class='popup modal overlay'><p>{{P}}</p></div><footer>{{S}}</footer></body>",
    f"<body><div role='banner'>{{S}}</div><div role='navigation'>{_LINKS}</div><div role='main'>[[<h1>{{H}}</h1><p>{{P}}</p><p>{{P}} <a href='#'>{{W}}</a> {{S}}</p><p>{{P}}</p>]]</div><div role='complementary'><p>{{P}}</p></div><div role='contentinfo'><p>{{S}}</p></div></body>",
    f"<body><div id='page'><div class='masthead'>{{W}}</div>{_NAV}<div class='notice'><p>{{P}}</p></div><div class='article-body'>[[<p>{{P}}</p><p>{{P}}</p><h2>{{H}}</h2><p>{{P}}</p>]]</div><div class='author-bio'><p>{{S}}</p></div><div class='user-comments'><ul class='comment-list'><li>{{P}}</li><li>{{P}}</li><li>{{S}}</li></ul></div><div class='subscribe'><p>{{S}}</p></div></div></body>",
    f"<body>{_NAV}<div class='sidebar'><div>{{P}}</div><div>{{S}}</div></div><article>[[<h1>{{H}}</h1>{{P}}<p>{{W}}</p><p>{{P}}</p><div>{{P}}</div><p>{{W}}.</p>]]</article><section id='comments'><div>{{P}}</div><div>{{P}}</div></section><div class='advertisement'>{{P}}</div><footer><div>{{P}}</div><div>{{W}}</div></footer></body>",
    f"<body>{_NAV}<div class='ad'>{{P}}</div><article>[[<h1>{{W}}</h1><p>{{W}}</p>]]</article><footer>{{S}}</footer></body>",
    f"<body>{_NAV}<div class='ad'>{{S}}</div><footer>{{S}}</footer></body>",
    f"<body><header><h1>{{W}}</h1></header>{_NAV}<article>[[<h1>{{H}}</h1><h2>{{W}}</h2><p>{{P}}</p>]]<form><p>{{P}}</p><p>{{S}}</p></form><nav><a href='#'>{{L}}</a></nav>[[<p>{{P}}</p>]]</article><aside class='widget'>{{P}}</aside><div class='notice'>{{S}}</div><div class='comments'><p>{{P}}</p><p>{{S}}</p></div><footer>{{P}}</footer></body>",
]
#: Times that each layout is filled.
FILLS = 6
_SYLLABLES = "ka lo mi ten sur va ne qui tor es ard in ol um bre chen dal ü é ño ist wer pla gno".split()


def _filled(layout: str, rng: random.Random) -> str:
    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).replace(" ", ", ", rng.randint(0, 2)).capitalize() + rng.choice(".....!?")

    make = {
        "{P}": lambda: " ".join(sentence(3, 18) for _ in range(rng.choice((1, 2, 4, 7)))),
        "{S}": lambda: sentence(2, 12),
        "{H}": lambda: words(2, 9).capitalize() + rng.choice(("", "", ".")),
        "{L}": lambda: words(2, 6).capitalize(),
        "{W}": lambda: words(1, 2).capitalize() + rng.choice(("", "", ",", ".")),
        "{N}": lambda: str(rng.randint(1, 2030)),
    }
    for mark, f in make.items():
        while mark in layout:
            layout = layout.replace(mark, f(), 1)
    return layout


def labelled_pages(seed: int = 2) -> list[tuple[list[Block], list[bool]]]:
    """Blocks of every filled layout, and whether each is main text."""
    rng, out = random.Random(seed), []
    for layout in LAYOUTS * FILLS:
        page = _filled(layout, rng)
        inside, labels = False, []
        marked = blocks(page.replace("[[", "<div>\ue000</div>").replace("]]", "<div>\ue001</div>"))
        plain = [b for b in marked if b.text not in ("\ue000", "\ue001")]
        for b in marked:
            if b.text == "\ue000":
                inside = True
            elif b.text == "\ue001":
                inside = False
            else:
                labels.append(inside)
        out.append((plain, labels))
    return out
