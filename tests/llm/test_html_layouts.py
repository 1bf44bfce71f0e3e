"""Layouts of pages whose short blocks belong to the text."""

import time

import pytest

from tidemill.llm.html_text import main_text

LONG = "A long sentence of content that goes on. " * 6
TEXT = LONG.strip()


def test_nested_regions_are_one():
    page = f"<main><h1>Title</h1><p>Short lead.</p><article><p>{LONG}</p><p>{LONG}</p><section><article><p>Small.</p></article></section></article></main>"
    assert main_text(page) == f"Title\nShort lead.\n{TEXT}\n{TEXT}\nSmall."
    two = f"<article><h2>One</h2><p>{LONG}</p></article><article><p>x</p></article>"
    assert main_text(two) == f"One\n{TEXT}"


def test_short_blocks_beside_a_cluster_stay():
    menu = "<div><a>x</a><a>y</a></div>" * 6
    page = f"<body>{menu}<h1>Title</h1><div><p>Short first.</p><div class=share>Share</div><p>{LONG}</p><p>{LONG}</p><p>Short last.</p></div>{menu}"
    assert main_text(page) == f"Title\nShort first.\n{TEXT}\n{TEXT}\nShort last."
    other = f"<div><p>Elsewhere</p></div>{menu}<div><h2>Head</h2><p>{LONG}</p></div><p>Outside</p>{menu}"
    assert main_text(other) == f"Head\n{TEXT}"


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p class="ad">Buy<p>{LONG}<p>Short.</article>',
        f'<article><p class="ad">Buy<div>{LONG}</div><p>Short.</article>',
        f'<article><ul><li class="share">Share<li>{LONG}<li>Short.</ul></article>',
        f'<article><dl><dt class="ad">Buy<dd>{LONG}<dd>Short.</dl></article>',
        f'<article><table><tr><td class="ad">Buy<td>{LONG}<tr><td>Short.</table></article>',
        f'<article><table><tr class="ad"><td>Buy<tr><td>{LONG}<tr><td>Short.</table></article>',
    ],
)
def test_an_open_block_ends_where_the_next_starts(page):
    assert main_text(page) == f"{TEXT}\nShort."


def test_inner_lists_and_tables_do_not_end_outer_items():
    page = f"<article><ul><li class=share>Share<ul><li>Inner</ul>Rest<li>{LONG}</ul><table><tr class=ad><td><table><tr><td>In</table>Out<tr><td>Short.</table></article>"
    assert main_text(page) == f"{TEXT}\nShort."


@pytest.mark.parametrize("label", ["page-with-sidebar", "social-science", "related-work", "newsletter"])
def test_clusters_overrule_labels_around_them(label):
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p>"
    want = f"Title\n{TEXT}\n{TEXT}\nEnd."
    comments = f"<div class=comments><p>{LONG}</p><p>{LONG}{LONG}{LONG}</p></div>"
    assert main_text(f"<body><nav>m</nav><div class={label}><article>{inner}</article></div><footer>f</footer>") == want
    assert main_text(f"<body><div class={label}>{inner}{comments}</div>") == want
    assert main_text(f"<form><nav>m</nav><main>{inner}</main></form>") == want
    assert main_text(f"<form><div class={label}><article>{inner}</article></div></form>{comments}") == want
    beside = f"<div class={label}><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<article>{inner}</article>{beside}") == want


def test_notices_and_forms_alone_are_no_content():
    assert main_text(f"<div class=cookie><p>{LONG}</p></div>") == ""
    assert main_text("<form><label>Name</label><input></form>") == ""
    assert main_text(f"<div class=comments><p>{LONG}</p><p>{LONG}</p></div>") == ""


def test_closing_blocks_of_a_cluster_stay_and_links_go():
    page = f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div>Closing</div><blockquote>Quote</blockquote><ul><li>Item</ul><div><a>Next</a></div><div>x</div></div>"
    assert main_text(page) == f"Title\n{TEXT}\n{TEXT}\nClosing\nQuote\nItem"


def test_comments_without_an_end_are_text():
    assert main_text(f"<article><p>{LONG}</p><!-- a --><!-- x <p>{LONG}</p>") == f"{TEXT}\nx\n{TEXT}"


@pytest.mark.parametrize("part", ["<div><p>x", "<b></i>", "<!-- x", "<ul><li>x", "<div class=ad><p>x", "<table><tr><td>x"])
def test_time_follows_the_length(part):
    def seconds(n):
        started = time.process_time()
        main_text(part * n)
        return time.process_time() - started

    seconds(100)
    assert seconds(40_000) < 10 * seconds(10_000) + 0.5
