"""Labelled pages that the weights of ``htmltext`` are learned from.

Templates with the marks ``keep`` (content) and ``drop`` on elements; what has no
mark above it is boilerplate. ``@p`` stands for a paragraph, ``@s`` for a sentence,
``@w`` for a few words and ``@l`` for linked words, filled from a seeded generator.
Every template comes with its class, id and role attributes and without them, and
with its article and main elements as they are and as plain ``div`` elements.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: Page layouts with their labels.
TEMPLATES = [
    """<nav><ul><li>@l<li>@l<li>@l</ul></nav><article keep><h1>@w</h1><p>@p</p><p>@p</p><p>@s</p><p>@p</p></article><footer><p>@s</p><p>@w</p></footer>""",
    """<header><div>@w</div><ul><li>@l</li><li>@l</li></ul></header><div class="ad">@s</div><article keep><h1>@w</h1><p>@w</p><p>@p</p><h2>@w</h2><p>@p</p>
    <ul><li>@s</li><li>@w</li><li>@s</li></ul><p>@p</p></article><aside><h3>@w</h3><p>@s</p><ul><li>@l</li><li>@l</li></ul></aside><footer>@s</footer>""",
    """<div id="header"><div>@w</div></div><div class="main-menu"><ul><li>@l</li><li>@l</li><li>@l</li></ul></div><div id="main" keep><div class="search-results-intro"><p>@p</p></div>
    <h2>@w</h2><p>@p</p><p>@p @l @s</p><p>@s</p></div><div class="sidebar"><h4>@w</h4><p>@s</p><p>@l</p></div><div id="footer"><p>@p</p><p>@l</p></div>""",
    """<div class="cookie-notice"><p>@s</p><button>@w</button></div><main><article class="post related-topic" keep><h1>@w</h1><p>@p</p><blockquote>@s</blockquote><p>@p</p>
    <pre>@w</pre><p>@s</p></article><section class="comments"><h2>@w</h2><div><p>@w</p><p>@s</p></div><div><p>@w</p><p>@p</p></div></section></main><footer><p>@w</p></footer>""",
    """<nav>@l @l @l</nav><div class="entry-content" keep><h1>@w</h1><p>@s</p><p>@p</p><table><tr><th>@w<th>@w<tr><td>@w<td>@s<tr><td>@w<td>@w</table><p>@p</p></div>
    <div class="related-posts"><h3>@w</h3><ul><li>@l</li><li>@l</li><li>@l</li></ul></div><div class="share-box">@l @l</div><div class="site-footer"><p>@s</p></div>""",
    """<header><nav>@l @l</nav></header><main keep><h1>@w</h1><p>@p</p><dl><dt>@w<dd>@s<dt>@w<dd>@p</dl><figure><figcaption>@s</figcaption></figure><p>@p</p></main>
    <form><label>@w</label><p>@s</p></form><footer><ul><li>@l</li><li>@l</li></ul><p>@s</p></footer>""",
    """<div class="topbar">@l @l</div><div class="newsletter"><h3>@w</h3><p>@s</p></div><article keep><header><h1>@w</h1><p>@w</p></header><p>@p</p><div drop class="ad-slot"><p>@s</p></div><p>@p</p>
    <aside drop><p>@s</p></aside><p>@s</p><p>@p</p><footer drop>@w</footer></article><div class="banner"><p>@s</p></div><footer>@w</footer>""",
    """<ul class="breadcrumb"><li>@l</li><li>@l</li></ul><div class="story" keep><h1>@w</h1><p>@p</p><p>@l @s</p><h3>@w</h3><p>@p</p><ol><li>@p</li><li>@s</li></ol></div>
    <div id="disqus"><p>@p</p><p>@s</p></div><div class="widget"><p>@w</p><p>@l</p></div><div role="contentinfo"><p>@s</p></div>""",
    """<nav><a href="/">@w</a></nav><article keep><h1>@w</h1><p>@w</p></article><footer>@w</footer>""",
    """<div>@l @l @l</div><div keep><p>@p</p><p>@p</p><p>@w</p><p>@p</p><p>@p</p></div><div>@l @l</div><div>@w</div>""",
    """<div><div>@l</div><div>@l</div></div><div keep><h1>@w</h1><div>@p</div><div>@s</div><div>@p</div></div><div class="promo"><p>@s</p></div><div class="legal"><p>@p</p></div><div>@w</div>""",
    """<nav><ul><li>@l</li></ul></nav><section keep><h2>@w</h2><p>@p</p><p>@p</p></section><section keep><h2>@w</h2><p>@s</p><p>@p</p></section><section class="subscribe"><h2>@w</h2><p>@s</p></section>
    <footer><h4>@w</h4><p>@p</p><p>@l</p></footer>""",
]
WORDS = "stone river cloud paper window garden morning letter winter harbour quiet narrow people found before almost carried between water light under".split()


def _fill(template: str, rng: random.Random) -> str:
    def sentence(n: int) -> str:
        return " ".join(rng.choices(WORDS, k=n)).capitalize() + rng.choice(".....!?")

    made = {
        "p": lambda: " ".join(sentence(rng.randint(6, 18)) for _ in range(rng.randint(2, 6))), "s": lambda: sentence(rng.randint(3, 14)),
        "w": lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 5))), "l": lambda: f'<a href="/">{" ".join(rng.choices(WORDS, k=rng.randint(1, 3)))}</a>',
    }
    return re.sub("@([pswl])", lambda m: made[m[1]](), template)


def labelled_pages(fills: int = 4, seed: int = 1) -> Iterator[str]:
    """Pages whose elements have ``data-keep`` 1 or 0 where a label starts."""
    for n, template in enumerate(TEMPLATES):
        marked = re.sub(r" (keep|drop)(?=[ >])", lambda m: f' data-keep="{int(m[1] == "keep")}"', template)
        bare = re.sub(r' (?:class|id|role)="[^"]*"', "", marked)
        plain = lambda t: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", t)
        for k, form in enumerate((marked, bare, plain(marked), plain(bare))):
            for fill in range(fills):
                yield f"<html><body>{_fill(form, random.Random(f'{seed} {n} {k} {fill}'))}</body></html>"
