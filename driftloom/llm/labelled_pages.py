"""Small pages whose main text is known: the elements marked data-main="1" hold it, less what data-main="0" holds.

An x-main element stands for nothing but its mark. The extraction learns its weights from them. A few are written out; labelled_pages() makes any number more, each of a
layout, parts and names drawn at random, so that some can be held out."""

import random

PAGES = [
    """<html><head><title>Harbour news</title><style>p{color:red}</style></head><body><header class="masthead"><a href="/">Harbour news</a> <span>Daily since 1911</span></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Tides and weather</a></li><li><a href="/c">Jobs</a></li></ul></nav>
<article data-main="1"><h1>New pier opens after two years</h1><p>The new pier opened on Monday after two years of work, and the first ferry left at noon with ninety people on board.</p>
<p>The harbour master said the old timber had rotted below the water line, so that nothing short of a new frame would do.</p><p>Tickets cost the same as before.</p></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks by the sea</a></li><li><a href="/2">Where to eat mussels</a></li></ul></aside>
<footer><p>&copy; Harbour news. All rights reserved. <a href="/terms">Terms</a></p></footer></body></html>""",
    """<html><body><div id="top"><a href="/">Start</a> | <a href="/shop">Shop</a> | <a href="/help">Help</a></div><div class="cookie-notice">We use cookies to make this site better. <button>Accept all</button></div>
<div id="content"><div data-main="1"><h2>How to oil a hinge</h2><p>Lift the pin with a nail and a light hammer until it stands clear of the barrel.</p><ul><li>Wipe off the old grease with a rag.</li><li>Put three drops of oil on the pin.</li></ul>
<div data-main="0" class="ad">Hinges at half price, today only! <a href="/buy">Buy now</a></div><p>Push the pin home and swing the door a few times, so that the oil spreads along the whole barrel.</p></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> <p>This helped me a lot, thank you so much.</p></div><div class="comment"><b>Bo</b> <p>Mine still squeaks.</p></div><form><textarea>Your comment</textarea><input type="submit" value="Send"></form></div></div>
<div class="footer">Contact | Imprint | Privacy</div></body></html>""",
    """<html><body><nav><a href="/">Recipes</a><a href="/soups">Soups</a><a href="/cakes">Cakes</a></nav><main data-main="1"><h1>Leek soup</h1><p>Wash four leeks well and cut them into rings as thick as a pencil.</p><br><p>Cook them gently in butter for ten
minutes, add a litre of broth and two potatoes, and let all of it simmer until soft.</p><blockquote>My grandmother never stirred it.</blockquote><p>Season and serve hot with bread.</p></main>
<div class="share"><a href="#">Share</a> <a href="#">Pin it</a></div><div class="newsletter"><form>Get a recipe every Friday <input name="mail"><button>Subscribe</button></form></div><footer>Recipes 2020</footer><script>track("leek");</script></body></html>""",
    """<html><body><table class="layout"><tr><td class="menu"><a href="/1">Index</a><br><a href="/2">Letters</a><br><a href="/3">Maps</a></td><td data-main="1"><p>In the spring of that year the river rose higher than anyone remembered, and the lower town stood under water for nine days.</p>
<p>The mill was lost. Its wheel was found in the reeds a mile below the bridge, and stands in the square today.</p></td></tr></table><div class="related"><p>You may also like</p><ul><li><a href="/x">The great frost</a></li><li><a href="/y">A short history of the bridge</a></li></ul></div></body></html>""",
]

# Names that pages commonly give to their parts: what the made pages draw from, for each kind of part.
_NAMES = {
    "menu": "nav navbar main-nav menu main-menu navigation site-navigation topnav nav-list breadcrumb breadcrumbs crumbs pager pagination toolbar tabs dropdown-menu skip-links",
    "head": "header site-header masthead page-header topbar branding logo header-wrap login-box",
    "foot": "footer site-footer page-footer foot bottom copyright colophon footer-links imprint article-footer post-footer entry-footer",
    "side": "sidebar side-bar left-sidebar sidebar-content rail right-rail side widget widget-area secondary",
    "advert": "ad ads advert adverts advertisement ad-slot ad-banner adsense sponsored sponsor promo promotion promoted-links banner banner-ad",
    "notice": "cookie-notice cookies cookie-banner consent gdpr notice site-notice alert alert-box notification paywall modal popup overlay toast disclaimer",
    "comments": "comments comment-list commentlist comment-content comment responses replies respond discussion disqus reader-comments reviews-list",
    "related": "related related-posts recommended recommendations most-read popular-posts trending teaser teasers more-stories see-also-links",
    "share": "share sharing social social-links share-buttons follow-us tools print-tools",
    "form": "newsletter signup subscribe subscription search search-box login-form contact-form",
    "article": "content article post entry story main article-body entry-content post-content story-body main-content text body-text content-area single",
    "inner": "intro lead summary caption note warning tip popular-science recommended-dose quote pull-quote highlight section-2 chapter box figure abstract footnotes article-header entry-header post-header entry-title headline byline dateline social-history side-effects header-note menu-of-the-day commentary sponsor-history notice-of-intent searching related-work",
    "wrapper": "page wrapper container has-sidebar with-sidebar no-sidebar layout site outer row col column has-ads two-columns app root",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_ROLES = {"menu": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "advert": "complementary", "notice": "alert dialog alertdialog", "form": "form search", "comments": "complementary"}
_TAGS = {"menu": "nav div ul menu", "head": "header div", "foot": "footer div", "side": "aside div section", "advert": "div aside section ins", "notice": "div section dialog p", "comments": "section div ol", "related": "div aside section ul", "share": "div ul p", "form": "form div section"}
_SYLLABLES = "al an ber con da del en er fir ga han in ka lo mar ne or per qua ro sen ti un ver wo zu é ü ñ".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return text.capitalize() + r.choice([".", ".", "", "!", " |", "&amp;"])

    def link(self, low: int = 1, high: int = 4) -> str:
        return f"<a href='/{self.r.randint(1, 99)}'>{self.words(low, high)}</a>"

    def links(self, tag: str) -> str:
        some = [self.link() for _ in range(self.r.randint(2, 9))]
        return "".join(f"<li>{x}</li>" for x in some) if tag in ("ul", "ol", "menu") else f"<ul>{''.join(f'<li>{x}</li>' for x in some)}</ul>" if self.r.random() < 0.5 else self.r.choice([" | ", " ", "<br>"]).join(some)

    def paragraph(self) -> str:
        r = self.r
        parts = [self.words(3, 25) for _ in range(r.randint(1, 4))]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), r.choice([self.link(1, 6), f"<b>{self.words(1, 4)}</b>", f"<em>{self.words(1, 4)}</em>", f"<span>{self.words(1, 4)}</span>", f"<code>{self.words(1, 2)}</code>", "<img src='x.png'>", "<br>"]))
        return " ".join(parts)

    def aside(self, kind: str, mark: str = "") -> str:
        """A part that isn't main text: told by its element, its names, its role or its looks."""
        r = self.r
        tag = r.choice(_TAGS[kind].split())
        plain = tag in ("nav", "footer", "aside", "form", "menu", "dialog") or (tag == "header" and not mark)
        attrs = ""
        if not plain or r.random() < 0.5:
            how = r.random()
            name = r.choice(_NAMES[kind]) + (f" {r.choice(['clearfix', 'box', 'left', 'block', 'wide'])}" if r.random() < 0.2 else "")
            attrs = f" role='{r.choice(_ROLES[kind].split())}'" if how < 0.12 and kind in _ROLES else f" id='{name.split()[0]}'" if how < 0.35 else f" class='{name}'"
        if kind == "menu":
            body = self.links(tag)
        elif kind in ("head", "foot"):
            body = r.choice([self.link(), f"<span>{self.words(2, 6)}</span>", f"<p>{self.words(3, 14)}</p>", f"&copy; {self.words(2, 16)}", f"<h1>{self.link()}</h1><p>{self.words(2, 6)}</p>" if kind == "head" else f"<p>{self.words(2, 6)} {self.link()}</p>"])
        elif kind == "related":
            body = (f"<h3>{self.words(1, 3)}</h3>" if tag != "ul" else "") + r.choice([self.links(tag), f"<p>{self.words(4, 14)}</p>" if tag != "ul" else self.links(tag)])
        elif kind == "comments":
            one = r.choice(["<div class='comment'><b>{a}</b> <p>{t}</p></div>", "<article><p>{t}</p></article>", "<li>{t}</li>", "<p>{a}</p><p>{t}</p>", "<article class='comment'><header>{a}</header><p>{t}</p></article>"])
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(one.format(a=self.words(1, 2), t=self.words(3, 40)) for _ in range(r.randint(1, 5))) + r.choice(["", "<form><label>" + self.words(1, 2) + "</label><textarea></textarea><button>" + self.words(1, 1) + "</button></form>"])
        elif kind == "form":
            body = f"{self.words(2, 9)} <label>{self.words(1, 2)}</label> <input name='a'><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
            if tag != "form":
                body = f"<form>{body}</form>" if r.random() < 0.7 else f"<p>{self.words(3, 9)}</p>" + f"<button>{self.words(1, 2)}</button>"
        elif kind == "share":
            body = " ".join(self.link(1, 2) for _ in range(r.randint(1, 5)))
        else:
            text = self.words(3, 30)
            body = text if tag == "p" else r.choice([text, f"<p>{text}</p>", f"<b>{self.words(1, 3)}</b> {text}", f"{text} {self.link(1, 3)}", f"<h3>{self.words(1, 3)}</h3><ul><li>{self.link()}</li><li>{self.link()}</li></ul>" if kind == "side" else f"{text} <button>{self.words(1, 2)}</button>"])
        if r.random() < 0.04:
            tag, attrs = "div", r.choice([" hidden", " aria-hidden='true'", " style='display:none'"])
        return f"<{tag}{attrs}{mark}>{body}</{tag}>"

    def inside(self) -> str:
        """One block of an article."""
        r, pick = self.r, self.r.random()
        name = f" class='{r.choice(_NAMES['inner'])}'" if r.random() < 0.3 else ""
        if pick < 0.6:
            return f"<p{name}>{self.paragraph()}" + r.choice(["</p>", "</p>", "</p>\n", ""])
        if pick < 0.68:
            return f"<h2{name}>{self.words(1, 7)}</h2>"
        if pick < 0.76:
            return f"<ul{name}>" + "".join(f"<li>{r.choice([self.words(1, 14), self.link(1, 6) + ' ' + self.words(1, 9)])}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if pick < 0.82:
            return f"<blockquote{name}>{r.choice([self.words(4, 30), '<p>' + self.words(4, 30) + '</p>'])}</blockquote>"
        if pick < 0.86:
            return f"<figure{name}><img src='a.jpg'><figcaption>{self.words(2, 12)}</figcaption></figure>"
        if pick < 0.9:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 8)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if pick < 0.96:
            return f"<{(t := r.choice(['div', 'section']))}{name}>{r.choice([self.paragraph(), '<p>' + self.paragraph() + '</p>'])}</{t}>"
        return f"<pre{name}>{self.words(2, 20)}</pre>"

    def article(self, root: str, tag: str) -> str:
        r = self.r
        attrs = "" if root == "" and r.random() < 0.7 else f" {r.choice(['class', 'class', 'id'])}='{r.choice(_NAMES['article'])}'"
        if tag in ("div", "section", "td") and r.random() < 0.75:
            attrs = f" {r.choice(['class', 'class', 'id'])}='{r.choice(_NAMES['article'])}'"
        blocks = [self.inside() for _ in range(r.randint(1, 14))]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.aside(r.choice(["advert", "advert", "related", "share", "form", "side", "notice", "foot", "menu", "comments"]), " data-main='0'"))
        title = f"<h1>{self.words(1, 9)}</h1>"
        title = r.choice([title, title, title, f"<header>{title}<p>{self.words(1, 6)}</p></header>" if tag in ("article", "main") else title, f"<div class='article-header'>{title}</div>", ""])
        return f"<{tag}{attrs} data-main='1'>{title}{''.join(blocks)}</{tag}>"

    def bare(self) -> str:
        """A page, or a piece of one, whose main text stands in no element of its own; x-main only marks it."""
        r = self.r
        body = r.choice([self.words(1, 40), self.words(1, 3), "".join(self.inside() for _ in range(r.randint(1, 6))), f"<h1>{self.words(1, 6)}</h1>" + "".join(self.inside() for _ in range(r.randint(1, 6))), self.words(3, 20) + "<br>" + self.words(3, 20)])
        parts = [self.aside(k) for k in ("head", "menu", "advert") if r.random() < 0.3], [self.aside(k) for k in ("comments", "related", "foot") if r.random() < 0.3]
        whole = "".join(parts[0]) + f"<x-main data-main='1'>{body}</x-main>" + "".join(parts[1])
        return r.choice([whole, f"<html><head><title>{self.words(1, 4)}</title></head><body>{whole}</body></html>", f"<body>{whole}</body>", f"<div>{whole}</div>"])

    def page(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.bare()
        before = [self.aside(k) for k in ("notice", "head", "menu", "advert", "menu", "form") if r.random() < 0.45]
        after = [self.aside(k) for k in ("share", "comments", "related", "side", "advert", "form", "notice", "foot") if r.random() < 0.4]
        if r.random() < 0.4:
            r.shuffle(before)
        if r.random() < 0.3:
            before.append(self.aside("side"))
        tag = r.choice(["article", "article", "article", "main", "main", "div", "div", "div", "section", "td"])
        # The more general parts of an article's page now and then hold it.
        body = "".join(self.article("", tag) for _ in range(r.choice([1, 1, 1, 1, 2])))
        if tag == "td":
            body = f"<table><tr><td class='{r.choice(_NAMES['menu'] + _NAMES['side'])}'>{self.links('td')}</td>{body}</tr></table>"
        elif r.random() < 0.3:
            hold = r.choice(["main", "div", "section"]) if tag != "main" else "div"
            more = self.aside(r.choice(["comments", "related", "share", "advert"])) if r.random() < 0.6 else ""
            name = f" {r.choice(['class', 'id'])}='{r.choice(_NAMES['article'] + _NAMES['wrapper'])}'" if r.random() < 0.6 else ""
            body = f"<{hold}{name}>{body}{more}</{hold}>"
        if tag in ("article", "main") and r.random() < 0.25:  # beside an article, text without any name isn't of it
            after.append(f"<div>{self.words(2, 20)}</div>")
        whole = "".join(before) + body + "".join(after)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            whole = f"<div {r.choice(['class', 'class', 'id'])}='{' '.join(r.sample(_NAMES['wrapper'], r.randint(1, 2)))}'>{whole}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title><script>a('<p>')</script></head><body>{whole}</body></html>"


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    """The written pages and count made ones; another seed gives others."""
    return [*PAGES, *(_Maker(seed * 1_000_003 + k).page() for k in range(count))]
