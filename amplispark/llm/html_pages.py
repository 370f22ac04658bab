"""Labelled pages for training: layouts of several kinds around invented text.

Every element that opens a region bears ``data-content="1"`` (main text) or
``"0"``; the elements inside inherit it. Generated by rule from a seed.
"""

from __future__ import annotations

import itertools
import random

_SYLLABLES = "ba co de fi gu la me no pi ra so tu ve wi xa yo en ter is on al".split()
_WORDS = ["".join(x) for n in (1, 2, 3) for x in itertools.product(_SYLLABLES, repeat=n)][::7]

#: Names of the kinds of regions beside the main text; the tests use others.
ADVERTS = "ad ad ad ads advert advertisement adverts sponsored sponsor promo promotion banner commercial adsense adslot ad-slot ad-wrapper adwrap ad-container adzone dfp gpt-ad taboola outbrain native-ad adverbox leaderboard skyscraper mpu doubleclick adLabel sponsors sponsorship adbox adunit advertising partner-offer offer deal marketing teads criteo affiliate"
NOTICES = "cookie cookies notice notice cookie-banner cookieNotice alert newsletter newsletterBox subscribe subscription subscribe-box signup sign-up consent consent-layer gdpr popup modal overlay paywall privacy disclaimer toast announcement warning optin cookiebar cookie-bar gdpr-layer notification flash message infobox hint callout lightbox dialog interstitial donate donation"
SIDEBARS = "sidebar sidebar side-column related related relatedposts related-links widget widgets share sharebar sharing social social-links tags tag-cloud recommended recommendations toc more more-news popular trending teaser latest aside side sidecol rail see-also read-more further-reading author-bio byline-box archive rss feed"
COMMENTS = "comments comments comment-list comments-area commentbox discussion responses respond reply-list replies disqus disqus_thread talkback guestbook readers-say fb-comments comment-section comment-form usercomments reactions feedback forum livefyre"
MENUS = "menu menubar mainmenu nav nav navigation nav-bar navbar nav-main topnav sitenav breadcrumb crumbs topbar toolbar links pager pagination subnav sidenav leftnav submenu tabs skip-link jump sitemap categories"
FOOTERS = "footer site-footer footer-bar foot copyright copy legal imprint colophon"
ARTICLES = "content post entry-content article-body articletext story story-body main main-text body-copy page-content text post-body"

#: What stands before and behind a name in one word, for regions of all kinds.
BEFORE = "user page top side sub my the site inner block left right new"
AFTER = "box bar s wrap area list block inner section panel 2 row holder unit"


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return self.rng.choice(_WORDS)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(_WORDS, k=self.rng.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(3, 14)
        if self.rng.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + "."

    def paragraph(self) -> str:
        if self.rng.random() < 0.12:  # some write without full stops
            return self.words(4, 40)
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8))))

    def pick(self, *of: str) -> str:
        return self.rng.choice(of)

    def maybe(self, share: float, s: str) -> str:
        return s if self.rng.random() < share else ""

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{self.word()}">{self.words(1, 3)}</a></{item}>' for _ in range(n))

    def menu(self) -> str:
        inner = f"<ul>{self.links(self.rng.randint(3, 8))}</ul>"
        return self.pick(
            f'<nav data-content="0">{inner}</nav>',
            f'<div data-content="0" {self.named(MENUS)}>{inner}</div>',
            f'<header data-content="0"><div class="logo">{self.words(1, 2)}</div>{inner}</header>',
            f'<header data-content="0" id="{self.pick("masthead", "header", "site-header")}"><p>{self.words(2, 6)}</p></header>',
        )

    def named(self, words: str) -> str:
        """A class or an id of one of the words, by itself or as part of a longer name."""
        name = self.pick(*words.split())
        if self.rng.random() < 0.35:  # one word made of two, as pages of all kinds have
            name = self.pick(name + self.pick(*AFTER.split()), self.pick(*BEFORE.split()) + name)
        name = self.pick(name, name, name, f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}")
        return f'{self.pick("class", "class", "id")}="{name}"'

    def boxed(self, inner: str) -> str:
        """Sometimes in a box without a telling name."""
        return f'<div{self.maybe(0.5, f" class={self.word()}")}>{inner}</div>' if self.rng.random() < 0.25 else inner

    def text_of(self) -> str:
        """What a region beside the main text may say, short or long."""
        return self.pick(self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.paragraph()}</p>", f"<p>{self.paragraph()}</p><p>{self.sentence()}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.paragraph()}</p>")

    def advert(self) -> str:
        t = self.pick("div", "div", "div", "section", "aside", "p", "p")
        inner = self.sentence() if t == "p" else self.boxed(self.text_of()) + self.maybe(0.3, f'<a href="/{self.word()}">{self.words(1, 3)}</a>')
        return f'<{t} data-content="0" {self.named(ADVERTS)}>{inner}</{t}>'

    def notice(self) -> str:
        t = self.pick("div", "div", "div", "section", "p", "p")
        inner = self.sentence() if t == "p" else self.boxed(self.text_of()) + self.maybe(0.4, f"<button>{self.word()}</button>")
        return f'<{t} data-content="0" {self.named(NOTICES)}>{inner}</{t}>'

    def sidebar(self) -> str:
        t = self.pick("aside", "div")
        inner = f"<h3>{self.words(1, 3)}</h3><ul>{self.links(self.rng.randint(2, 6))}</ul>{self.maybe(0.4, f'<p>{self.sentence()}</p>')}"
        return f'<{t} data-content="0" {self.named(SIDEBARS)}>{self.boxed(self.pick(inner, inner, self.text_of()))}</{t}>'

    def comments(self) -> str:
        each = "".join(f'<{(t := self.pick("div", "li", "article"))} class="{self.pick("comment", "reply", "response", "comment-body")}"><span class="author">{self.word()}</span><p>{self.paragraph()}</p></{t}>' for _ in range(self.rng.randint(1, 5)))
        return f'<{(t := self.pick("section", "div", "ol"))} data-content="0" {self.named(COMMENTS)}><h2>{self.words(1, 2)}</h2>{each}</{t}>'

    def navbox(self) -> str:
        """A menu within the main text, of links or of words about the way."""
        t = self.pick("div", "div", "nav", "ul", "p")
        inner = self.links(self.rng.randint(2, 6)) if t == "ul" else self.sentence() if t == "p" else self.pick(f"<ul>{self.links(3)}</ul>", self.boxed(self.text_of()))
        return f'<{t} data-content="0" {self.named(MENUS)}>{inner}</{t}>'

    def form(self) -> str:
        return f'<form data-content="0" action="/{self.word()}"><label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button>{self.maybe(0.4, f"<p>{self.sentence()}</p>")}</form>'

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.word()}.example &middot; {self.sentence()}", f"<p>{self.sentence()}</p><ul>{self.links(3)}</ul>", f"<p>{self.paragraph()}</p>")
        return self.pick(f'<footer data-content="0">{inner}</footer>', f'<footer data-content="0">{inner}</footer>', f'<div data-content="0" {self.named(FOOTERS)}>{inner}</div>')

    def body_text(self) -> str:
        out = [self.maybe(0.8, f"<h1>{self.words(2, 9).capitalize()}{self.maybe(0.4, '.')}</h1>")]
        for _ in range(self.rng.choice((1, 2, 3, 6, 12))):
            out.append(
                self.pick(*[f"<p>{self.paragraph()}</p>"] * 6, f"<p><b>{self.paragraph()}<br>", f"<h2>{self.words(1, 6)}</h2>", f"<p>{self.words(1, 2)}.</p>", f"<p>{self.sentence()} <a href='/x'>{self.words(1, 3)}</a>, {self.paragraph()}</p>",
                          f"<blockquote><p>{self.paragraph()}</p></blockquote>", f"<ul>{''.join(f'<li>{self.sentence()}</li>' for _ in range(3))}</ul>", f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>", f"<pre>{self.words(4, 9)}</pre>")
            )
        if self.rng.random() < 0.06:  # verses, logs and other texts of many short lines
            out += [f"<p>{self.words(1, 3)}{self.maybe(0.7, '.')}</p>" for _ in range(self.rng.randint(10, 60))]
        inside = [self.advert, self.advert, self.sidebar, self.sidebar, self.sidebar, self.notice, self.notice, self.form, self.comments, self.navbox]
        for _ in range(self.rng.choice((0, 1, 2, 3))):
            out.insert(self.rng.randint(1, len(out)), self.rng.choice(inside)())
        return "".join(out) + self.maybe(0.15, self.comments())

    def plain_menu(self) -> str:
        """Links in an element without a telling name."""
        t = self.pick("div", "ul", "p")
        inner = self.links(self.rng.randint(3, 8)) if t == "ul" else " | ".join(f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(3, 8)))
        return f'<{t} data-content="0"{self.maybe(0.3, f" class={self.word()}")}>{self.maybe(0.3, self.words(1, 2))} {inner}</{t}>'

    def plain_footer(self) -> str:
        t = self.pick("div", "p", "center")
        return f'<{t} data-content="0">{self.pick("&copy; ", "Copyright ", "")}{self.word()} {self.rng.randint(1990, 2030)} {self.pick("", self.words(1, 5), f"<a href=/x>{self.words(1, 2)}</a>")}</{t}>'

    def parts(self) -> list[str]:
        """A main text in pieces, each with a heading or without."""
        return [self.maybe(0.4, f"<h2>{self.words(1, 5)}</h2>") + "".join(f"<p>{self.paragraph()}</p>" for _ in range(self.rng.randint(1, 3))) if self.rng.random() < 0.6 else " ".join(self.paragraph() for _ in range(self.rng.randint(1, 3))) for _ in range(self.rng.choice((1, 2, 2, 3, 4)))]

    def plain(self) -> str:
        """The body of a page whose elements tell little: plain containers, table cells, or none at all."""
        of = lambda: self.maybe(0.3, f' class="{self.word()}"') + self.maybe(0.1, f' id="{self.word()}"')
        menu = self.menu() if self.rng.random() < 0.5 else self.plain_menu()
        foot = self.footer() if self.rng.random() < 0.5 else self.plain_footer()
        title = self.maybe(0.5, f'<h1 data-content="1">{self.words(2, 8)}</h1>')
        extra = self.rng.choice((self.advert, self.notice, self.sidebar, self.comments))() if self.rng.random() < 0.4 else ""
        kind = self.rng.choice((0, 0, 1, 1, 2, 2, 2, 3))
        if kind == 0:
            pieces = [f'<div data-content="1"{of()}>{x}</div>' for x in self.parts()]
            pieces.insert(self.rng.randint(0, len(pieces)), extra)
            return menu + title + "".join(pieces) + foot
        if kind == 1:
            pieces = [f'<div data-content="1">{x}</div>' for x in self.parts()]
            pieces.insert(self.rng.randint(0, len(pieces)), extra)
            return f"<div{of()}>{menu}<div{of()}>{title}{''.join(pieces)}</div>{foot}</div>"
        if kind == 2:
            cells = [f'<td data-content="0"{of()}>{self.pick(self.links(self.rng.randint(3, 6), "div"), self.links(self.rng.randint(3, 6), "p"), " ".join(f"<a href=/x>{self.words(1, 2)}</a>" for _ in range(4)), self.words(1, 4))}</td>', f'<td data-content="1"{of()}>{"".join(self.parts())}</td>']
            row = "".join(cells if self.rng.random() < 0.7 else cells[::-1]) + self.maybe(0.3, f'<td data-content="0">{extra or self.plain_menu()}</td>')
            return f'<table{of()}>{self.maybe(0.5, f'<tr><td data-content="0" colspan=2>{self.words(1, 3)}</td></tr>')}<tr>{row}</tr>{self.maybe(0.5, f'<tr><td data-content="0">{self.plain_footer()}</td></tr>')}</table>'
        blocks = [f'<p data-content="1">{self.paragraph()}</p>' for _ in range(self.rng.randint(2, 7))]
        blocks.insert(self.rng.randint(1, len(blocks)), extra)
        return menu + title + "".join(blocks) + foot

    def page(self) -> str:
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        if self.rng.random() < 0.35:
            return f"{head}<body>{self.plain()}</body></html>"
        text = self.body_text()
        main = self.pick(
            *[f'<article data-content="1">{text}</article>'] * 4,
            f'<main data-content="1">{text}</main>',
            f'<main><article data-content="1">{text}</article>{self.sidebar()}</main>',
            f'<div data-content="1" {self.named(ARTICLES)}>{text}</div>',
            f'<div id="wrapper"><section data-content="1">{text}</section>{self.maybe(0.5, self.sidebar())}</div>',
            f'<div class="{self.word()}"><div data-content="1">{text}</div></div>',
        )
        before = [self.menu()] + [f() for f in (self.advert, self.notice, self.form) if self.rng.random() < 0.35]
        after = [f() for f in (self.sidebar, self.comments, self.advert, self.notice) if self.rng.random() < 0.3] + [self.footer()]
        return f"{head}<body>{''.join(before)}<!-- {self.word()} -->{main}{''.join(after)}</body></html>"


def labelled_pages(n: int = 2000, seed: int = 5) -> list[str]:
    return [_Writer(seed * 100_000 + i).page() for i in range(n)]
