"""Main text: what is read once, and what a host's suffix array decides."""

from rasterloom.llm import htmltext


def test_pages_are_read_once_and_like_tags_judged_once(monkeypatch):
    read, told = [], []
    tokens, attributes = htmltext._tokens, htmltext._attributes
    monkeypatch.setattr(htmltext, "_tokens", lambda page: (read.append(page), tokens(page))[1])
    monkeypatch.setattr(htmltext, "_attributes", lambda raw: (told.append(raw), attributes(raw))[1])
    page = '<article class="read-once">' + '<p class="once">one <a href="/x1">two</a> <b>three</b></p>' * 50 + "</article>"
    found, marked = htmltext.blocks(page)
    assert marked and found == [("one two three", False)] * 50
    assert len(read) == 1 and len(told) < 20


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_suffix_array_decides_all_but_the_largest_marked_article(spark):
    """Teasers marked as articles, and lines inside main or a content class, go where the host repeats them and stay where it does not."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    teaser = "our reporters have found out what the city council hid from its citizens for years"
    notice = "write to our editors at any time and we will print the best of your letters here"
    pages = {
        "http://teasers/": lambda i: f"<article><p>{own(i)}</p></article><article><p>{teaser}</p></article>",
        "http://main/": lambda i: f"<main><p>{own(i)}</p><p>{notice}</p></main>",
        "http://class/": lambda i: f'<div class="content"><p>{own(i)}</p><p>{notice}</p></div>',
    }
    rows, want = [], {}
    for n, (host, page) in enumerate(pages.items()):
        said = notice if n else teaser
        for i in range(10 * n, 10 * n + 8):
            rows.append((i, host, page(i)))
            want[i] = own(i)
        for i in range(100 + 10 * n, 102 + 10 * n):  # only two pages of this host have it
            rows.append((i, host, page(i).replace(said, said[::-1])))
            want[i] = f"{own(i)}\n\n{said[::-1]}"
    assert extracted(spark, rows) == want


def test_a_largest_article_keeps_what_its_host_repeats(spark):
    """The contract keeps an article whole: a line that three of a host's articles quote is theirs."""
    line = "the council has said that the old bridge will be closed from may until the end of june"
    body = {i: [" ".join(f"w{i}x{k}" for k in range(30)), line] for i in range(4)}
    got = extracted(spark, [(i, "http://h/", "<article>" + "".join(f"<p>{t}</p>" for t in parts) + "</article>") for i, parts in body.items()])
    assert got == {i: "\n\n".join(parts) for i, parts in body.items()}
