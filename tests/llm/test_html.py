"""Main text of generated pages: each page is built as a tree together with its main text."""

import html
import random
import time

import pytest

from glyphgrid.llm.html_extract import main_text

WORDS = "river stone market winter letter garden engine morning paper window teacher & <b> café naïve 10 % street village doctor history".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def noise(rnd):
    """An inline or block piece that isn't main text."""
    text = html.escape(prose(rnd, rnd.randint(1, 12)))
    return rnd.choice([f"<span class='ad'>{text}</span>", f"<button>{text}</button>", f"<script>var x = '{rnd.random()} <p>no</p>';</script>", f"<style>p {{}} /* {rnd.random()} */</style>",
                       f"<span hidden>{text}</span>", f"<label>{text} <input name=q></label>", f"<textarea>{text}</textarea>", f"<select><option>{text}<option>{text}</select>", f"<!-- {text} -->", f"<i style='display: none'>{text}</i>"])


def inline(rnd, text):
    """The text as markup: references, inline elements, line breaks, odd white space and noise between words."""
    out = []
    for w in text.split(" "):
        w = rnd.choice([html.escape(w), "".join(f"&#{ord(c)};" for c in w), html.escape(w)])
        out.append(rnd.choice([w, w, w, f"<em>{w}</em>", f"<a href='/x'>{w}</a>" if rnd.random() < 0.2 else w]))
        if rnd.random() < 0.03:
            out.append(noise(rnd))
    return "".join(p + rnd.choice([" ", " ", "\n", "\t ", " <br> "]) for p in out)


def block(rnd, tag, text):
    return f"<{tag}>{inline(rnd, text)}</{tag}>"


def article(rnd, neutral):
    parts, text = [], []
    title = prose(rnd, 4)
    parts.append(block(rnd, "h1", title))
    text.append(title)
    for k in range(rnd.randint(6, 12)):
        t = prose(rnd, rnd.randint(30, 90) if k % 3 else rnd.randint(1, 60) if k else 50)
        parts.append(block(rnd, "p", t))
        text.append(t)
        if rnd.random() < 0.2:
            items = [prose(rnd, 3) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{inline(rnd, i)}" for i in items) + "</ul>")
            text += items
        if rnd.random() < 0.2 and k:
            h = prose(rnd, 3)
            parts.append(block(rnd, "h2", h))
            t = prose(rnd, 40)
            parts.append(block(rnd, "p", t))
            text += [h, t]
        if not neutral and rnd.random() < 0.2:
            parts.append(rnd.choice(["<aside>{}</aside>", "<div class='advert-box'>{}</div>", "<form action=x><p>{}</p><input></form>", "<div class='commentList'><p>{}</p></div>", "<div role=complementary>{}</div>"]).format(html.escape(prose(rnd, 20))))
    return "".join(parts), text


def menu(rnd):
    return "<ul>" + "".join(f"<li><a href='/{i}'>{html.escape(prose(rnd, 2))}</a></li>" for i in range(rnd.randint(5, 25))) + "</ul>"


def page(seed):
    rnd = random.Random(seed)
    neutral = seed % 2 == 1
    body, text = article(rnd, neutral)
    small = lambda: html.escape(prose(rnd, rnd.randint(2, 6)))
    comments = "".join(f"<div><b>{small()}</b> <i>{small()}</i><p>{small()}</p></div>" for _ in range(rnd.randint(1, 6)))
    if neutral:  # no names and no elements that tell what is what
        wrap = rnd.choice(["div", "section"])
        return f"<html><head><title>{small()}</title></head><body><div class=a1>{menu(rnd)}</div><{wrap} class=a2>{body}</{wrap}><div class=a3>{comments}</div><div class=a4>{menu(rnd)}<div>{small()} | {small()}</div><div>&copy; 2024 {small()}</div></div></body></html>", text
    before = rnd.choice(["<nav>{}</nav>", "<div class='main-menu'>{}</div>", "<div role='navigation'>{}</div>"]).format(menu(rnd))
    around = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content-sidebar-wrap'><article>{}</article></div>", "<form id='aspnet'><article>{}</article></form>"]).format(body)
    after = rnd.choice(["", f"<section class='comments'>{comments}</section>"]) + f"<aside><p>{small()}</p></aside><footer>&copy; {small()}</footer>"
    return f"<!doctype html><html><head><title>{small()}</title><style>p{{}}</style><body><header><h2>{small()}</h2></header>{before}<div class='cookie-notice'>{small()}</div>{around}{after}{noise(rnd)}", text


@pytest.mark.parametrize("seed", range(300))
def test_generated_pages(seed):
    made, text = page(seed)
    assert main_text(made) == "\n".join(text)


@pytest.mark.parametrize(("made", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("<nav><a href=x>only a menu</a></nav>", ""),
    ("<article><p>Body <button>Send now</button></p><p>a <span class='ad'>Buy now</span> b</p><textarea>draft</textarea></article>", "Body\na b"),
    ("<article><p>one<br>two<br/>three&nbsp;&amp;&#x20AC;</p></article>", "one two three &€"),  # br is white space inside a block
    ("<article><p>kept <b>bold<p>next</article>", "kept bold\nnext"),
    ("<article><p>before</p><!-- open <p>gone</p></article>", "before"),
    ("<article><p>a</p><![if x]><p>b</p><![endif]><![CDATA[c]]></article>", "a\nb\nc"),
    ("<article><h1>T</h1><p>text</p><article class=comment><p>nice</p></article></article>", "T\ntext"),
    ("<table><tr><td><p>cell one</div></td><td>cell two</table>", "cell one\ncell two"),
])
def test_small_pages(made, text):
    assert main_text(made) == text


@pytest.mark.parametrize("unit", ["<div>", "<p>t</p><b>", "<font>x</i>", "<article>x ", "<ul><li>x", "<table><tr><td>", "<!-- ", "<?", "<!", "</", "<a ", '<a b="', "<![CDATA[", "<![x", "&#", "<", "<script>"])
def test_time_is_linear_on_broken_pages(unit):
    main_text(unit * 2000)
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        main_text(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5
