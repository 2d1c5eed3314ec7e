"""Generated web pages for training: layouts of many kinds, with known main text."""

from __future__ import annotations

import random

#: Names that sites give to parts of a page, by part.
NAMES = {
    "menu": "menu nav navigation navbar topbar main-menu site-nav breadcrumbs breadcrumb tabs skip-links toolbar",
    "header": "header site-header masthead top page-header branding logo",
    "footer": "footer site-footer bottom colophon page-footer copyright legal credits",
    "side": "sidebar side widget widgets related related-posts rail secondary recommended popular trending more-links tags archive",
    "notice": "notice cookie cookie-notice cookies consent gdpr banner alert message popup modal overlay paywall",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbox commercial",
    "form": "newsletter subscribe signup search search-form login contact-form poll",
    "share": "share social sharing social-links follow",
    "comments": "comments comment comment-list reader-comments discussion replies responses disqus comment-body thread",
    "main": "content post entry article article-body story post-content entry-content main text body-copy page-content",
}
_NAMES = {part: names.split() for part, names in NAMES.items()}
#: Words that such parts often hold, among others.
_WORDS = {
    "menu": "Home About Contact News Products Blog Login Services Accueil Kontakt Inicio".split(),
    "header": "Welcome Login Search Home".split(),
    "footer": "Copyright © All rights reserved Privacy Terms Impressum Imprint ·".split(),
    "side": "Related Popular Recent Tags Archive More Latest Read".split(),
    "notice": "cookies Accept consent privacy policy We use".split(),
    "ad": "Sponsored Advertisement Buy now Sale Offer".split(),
    "form": "Email Subscribe Search Submit Name Password Sign".split(),
    "share": "Share Tweet Facebook Email Print".split(),
    "comments": "Reply says comment said Like Report ago".split(),
}
_SYLLABLES = "an be con de en er es for gen ha in ion la le men nt on or pa que re sch st ta th ti un ver wh é ö ñ".split()


def sample_pages(seed: int, count: int) -> list[tuple[str, frozenset[str]]]:
    """Pages and the texts of their main blocks; the same arguments give the same pages."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(count)]


def _words(rng: random.Random, low: int, high: int, part: str = "") -> str:
    made = []
    for _ in range(rng.randint(low, high)):
        if part and rng.random() < 0.25:
            made.append(rng.choice(_WORDS[part]))
        else:
            word = "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 5)))
            made.append(word + rng.choice(["", "", "", "", ",", ".", "***", "###"]) if rng.random() < 0.3 else word)
    text = " ".join(made)
    return text[:1].upper() + text[1:] + rng.choice(["", ".", "."])


def _named(rng: random.Random, part: str, tags: str) -> str:
    """A start tag for a part: an element that says so, a name that says so, or both."""
    tag = rng.choice(tags.split())
    if tag == "div" or rng.random() < 0.4:
        name = rng.choice(_NAMES[part])
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}{rng.choice(("", "", " box", " c12", "-wrap"))}">'
    return f"<{tag}>"


def _links(rng: random.Random, part: str) -> str:
    items = [f'<li><a href="/{i}">{_words(rng, 1, 4, part)}</a></li>' for i in range(rng.randint(2, 9))]
    if rng.random() < 0.3:
        return " ".join(f'<a href="/{i}">{_words(rng, 1, 3, part)}</a>' for i in range(rng.randint(2, 7)))
    return f"<ul>{''.join(items)}</ul>"


def _close(start: str) -> str:
    return f"</{start[1:-1].split()[0]}>"


def _aside(rng: random.Random, part: str) -> str:
    """A part of the page that is not main text."""
    if part == "menu":
        start = _named(rng, part, "nav nav div ul")
        return start + _links(rng, part) + _close(start)
    if part == "header":
        start = _named(rng, part, "header div")
        return start + f"<div>{_words(rng, 1, 6, part)}</div>" + (_links(rng, "menu") if rng.random() < 0.5 else "") + _close(start)
    if part == "footer":
        start = _named(rng, part, "footer footer div")
        inner = _words(rng, 3, 20, part)
        return start + rng.choice([inner, f"<p>{inner}</p>", f"&copy; {inner}" + _links(rng, "menu")]) + _close(start)
    if part == "form":
        start = rng.choice(["<form>", _named(rng, part, "div section")])
        return f"{start}<label>{_words(rng, 1, 4, part)}</label><input><button>{_words(rng, 1, 2, part)}</button>{_close(start)}"
    if part == "comments":
        start = _named(rng, part, "section div div ol")
        name = rng.choice(("comment", "reply", "c", "item"))
        each = "".join(
            rng.choice(
                [
                    f'<div class="{name}"><p>{_words(rng, 3, 60, part)}</p></div>',
                    f"<li><b>{_words(rng, 1, 2)}</b> <p>{_words(rng, 3, 60, part)}</p></li>",
                    f"<article><h4>{_words(rng, 1, 3, part)}</h4><p>{_words(rng, 3, 60)}</p></article>",
                ]
            )
            for _ in range(rng.randint(1, 6))
        )
        if "section" not in start and "comment" not in start and "class" not in start and "id" not in start:
            start = '<div class="comments">'
        elif start == "<section>":
            start = f'<section id="{rng.choice(_NAMES[part])}">'
        return f"{start}<h3>{_words(rng, 1, 3, part)}</h3>{each}{_close(start)}"
    start = _named(rng, part, "aside aside div section" if part == "side" else "div div section aside")
    if start in ("<section>", "<aside>") and part != "side":
        start = f'{start[:-1]} class="{rng.choice(_NAMES[part])}">'
    elif start == "<section>":
        start = '<section class="related">'
    inner = rng.choice([_words(rng, 2, 40, part), f"<p>{_words(rng, 2, 40, part)}</p>", f"<h3>{_words(rng, 1, 3, part)}</h3>{_links(rng, part)}"])
    return start + inner + _close(start)


def _main(rng: random.Random, main: set[str]) -> str:
    """The main text with its own element; its blocks go to ``main``."""

    def say(low: int, high: int) -> str:
        text = _words(rng, low, high)
        main.add(" ".join(text.split()))
        return text

    start = rng.choice(["<article>", "<article>", "<article>", "<main>", _named(rng, "main", "div"), _named(rng, "main", "article section main")])
    if start == "<section>":
        start = '<section class="content">'
    out = [start]
    title = say(2, 12)
    out.append(rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>"]))
    for _ in range(rng.choice([0, 1, 2, 4, 8, 16, 30])):
        roll = rng.random()
        if roll < 0.72:
            text = say(1, rng.choice([4, 30, 120]))
            out.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}</p>", f"<div>{text}</div>"]))
        elif roll < 0.8:
            out.append(f"<h{(k := rng.randint(2, 4))}>{say(1, 7)}</h{k}>")
        elif roll < 0.86:
            out.append(f"<ul>{''.join(f'<li>{say(1, 15)}</li>' for _ in range(rng.randint(1, 5)))}</ul>")
        elif roll < 0.89:
            out.append(f"<blockquote><p>{say(3, 40)}</p></blockquote>")
        elif roll < 0.91:
            out.append(f"<figure><img src=x><figcaption>{say(2, 12)}</figcaption></figure>")
        elif roll < 0.93:
            out.append(f"<table><tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr></table>")
        elif roll < 0.94:
            out.append(f"<pre>{say(2, 12)}</pre>")
        else:
            out.append(_aside(rng, rng.choice(("ad", "side", "form", "share", "notice"))))
    if rng.random() < 0.1:
        out.append(_aside(rng, rng.choice(("comments", "share", "side"))))
    return "".join(out) + (_close(start) if rng.random() < 0.95 else "")


def _page(rng: random.Random) -> tuple[str, frozenset[str]]:
    main: set[str] = set()
    body: list[str] = []
    for part, chance in (("notice", 0.2), ("header", 0.4), ("menu", 0.8), ("ad", 0.6), ("side", 0.2), ("form", 0.1)):
        if rng.random() < chance:
            body.append(_aside(rng, part))
    if rng.random() < 0.98:
        body.append(_main(rng, main))
    for part, chance in (("share", 0.2), ("side", 0.4), ("ad", 0.3), ("comments", 0.5), ("form", 0.2), ("menu", 0.1), ("footer", 0.9), ("notice", 0.15)):
        if rng.random() < chance:
            body.append(_aside(rng, part))
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(("wrap", "page", "container", "row"))}">{inner}</div>'
    head = f"<head><title>{_words(rng, 2, 10)}</title><style>p{{}}</style></head>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>", frozenset(main)
