from strandloom.llm import html as H


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string").repartition(2)


def test_blocks():
    text = H.main_text(
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><!-- note --><div class='ad'>buy</div>"
        "<article><h1>A &amp; B</h1><p><b>one\n  two<br><p>three &#233;&nbsp;&lt;x&gt;<p>li<ul><li>a<li>b</ul><aside>side</aside><form>q<input></form><script>var t='</p>'</script>"
        "<table><tr><td>1<td>2</table><section class='comments'><article>bad</article></section></article><footer>f</footer>", {})
    assert text == "A & B\none two\nthree é <x>\nli\na\nb\n1\n2"
    assert H.main_text("", {}) == "" and H.main_text("plain <i>te</i>xt", {}) == "plain text" and H.main_text("<p>a</p></div></p>b<", {}) == "a\nb<"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.main_text(deep, {}) == "x"


def test_style_tree_finds_boilerplate_without_names(spark):
    pages = [(f"http://h.example/{i}", f"<html><body><div id='top'><div>always the same words</div></div><div id='body'><div><p>story number {i} with words {i * 7}</p>{'<p>more ' + str(i) + '</p>' * (i % 4)}</div></div></body></html>") for i in range(30)]
    pages += [("http://one.example/", "<body><div>always the same words</div><p>x</p></body>"), (None, None), ("odd url", "<p>a &copy; b</p>")]
    got = {r.page_id: r for r in H.extract_main_text(rows(spark, pages)).collect()}
    assert len(got) == len(pages)
    assert all("always" not in got[i].text and got[i].text.startswith(f"story number {i} with") for i in range(30))
    assert got[30].text == "always the same words\nx" and got[31].text == "" and got[31].n_chars == 0 and got[32].text == "a © b"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_rare_paths_count_in_the_tree(spark):
    kinds = ["gardening", "cooking", "travel", "music", "chess", "boats", "birds", "maps"]
    pages = []
    for i in range(24):  # three pages of a kind
        kind = kinds[i % 8]
        text = f"story {i} of {kind}"
        story = f"<p>{text}</p>" if i % 8 > 3 else text
        pages.append((f"http://h.example/{i}", f"<div class='story'><section class='topic-{kind}'>{story}</section></div><div class='box'><section class='topic-{kind}'>all about {kind}</section></div>"))
    # a path seen once on a host with pages enough
    pages.append(("http://h.example/x", "<div class='story'><section class='topic-odd'>story of its own</section></div>"))
    got = {r.page_id: r.text for r in H.extract_main_text(rows(spark, pages)).collect()}
    assert got == {**{i: f"story {i} of {kinds[i % 8]}" for i in range(24)}, 24: "story of its own"}


def test_copies_of_one_article_stay(spark):
    page = "<html><body><nav>m</nav><article><h1>Title</h1><p>the same story</p></article></body></html>"
    got = H.extract_main_text(rows(spark, [("http://h.example/", page)] * 40)).collect()
    assert {r.text for r in got} == {"Title\nthe same story"}


def test_shuffled_trees_and_empty(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_ROWS", -1)
    pages = [(f"http://h.example/{i}", f"<div><div>same</div></div><p>w {i}</p>") for i in range(20)]
    assert {r.text for r in H.extract_main_text(rows(spark, pages)).collect()} == {f"w {i}" for i in range(20)}
    assert H.extract_main_text(rows(spark, pages).limit(0)).count() == 0


def test_names_take_no_content():
    """A heading in an article's header stays; class words inside other names drop nothing."""
    assert H.main_text("<article><header><h1>Title</h1></header><p>body</p><div class='related-work'>prior art</div></article>", {}) == "Title\nbody\nprior art"
    assert H.main_text("<div class='post-content search-engines'><p>body</p></div>", {}) == "body"
    assert H.main_text("<div class='comments-list'>c</div><div class='related-posts'>r</div><div class='site-header'>h</div><div id='respond'>x</div><p>body</p>", {}) == "body"
    assert H.main_text("<article><p>body</p><div class='share'>s</div><section class='comments'><p>c</p></section><footer>f</footer></article>", {}) == "body"
    assert H.main_text("<form id='all'><article><p>body</p></article><input></form><form><p>q</p></form>", {}) == "body"
    assert H.main_text("<p>one<br>two</p>", {}) == "one two"


def plain_tree(pages):
    """path -> (pages, presentation, content) from the definitions, over the parsed pages of one host."""
    import math
    from collections import Counter

    styles, texts = {}, {}
    for page in pages:
        seen = {}

        def visit(node):
            shown, said = seen.setdefault(node.path, (set(), set()))
            shown.add(tuple((c.tag, c.names) for c in node.children))
            own = "".join(p for p in node.parts if isinstance(p, str)).strip()
            if own:
                said.add(" ".join(own.split()))
            for c in node.children:
                visit(c)

        visit(H.parse(page))
        for path, (shown, said) in seen.items():
            styles.setdefault(path, Counter()).update(shown)
            texts.setdefault(path, Counter()).update(said)
    out = {}
    for path, c in styles.items():
        m = sum(c.values())
        shown = 1.0 if m == 1 else -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m)
        t = texts[path]
        out[path] = (m, shown, (len(t) + 1) / (sum(t.values()) + 1) if t else None)
    return out


def plain_text(page, tree):
    """The blocks of a page outside branches that are of low importance throughout."""
    def importance(node):  # (own, the greatest of the branch)
        _, shown, said = tree[node.path]
        below = [importance(c) for c in node.children]
        parts = [b[0] for b in below] + ([said] if said is not None else [])
        share = H.DECAY ** len(below)
        own = (1 - share) * shown + share * sum(parts) / len(parts) if parts else 0.0
        # of two paths alike in content only the one of little content is judged
        if said is not None and said >= H.MIN_IMPORTANCE:
            own = max(own, 1.0)
        return own, max([own, *(b[1] for b in below)])

    out = []

    def visit(node):
        if node.tag == "div" and importance(node)[1] < H.MIN_IMPORTANCE:
            return
        out.extend(" ".join(p.split()) for p in node.parts if isinstance(p, str) and p.strip())
        for c in node.children:
            visit(c)

    visit(H.parse(page))
    return "\n".join(out)


def test_tree_against_the_definitions(spark):
    import random

    rng = random.Random(5)
    pool = [f"buy {i} now" for i in range(6)]
    pages = []
    for host, n in (("a", 40), ("b", 12), ("c", 7)):
        for i in range(n):
            menu = "<div class='alpha'>" + "".join(f"<div>{t}</div>" for t in rng.sample(pool, rng.randint(1, 3))) + "</div>"
            extra = f"<div class='beta'><div>{rng.choice(pool)}</div></div>" if rng.random() < 0.6 else ""
            body = "".join(f"<p>{host} {i} says {rng.random()}</p>" for _ in range(rng.randint(1, 5)))
            odd = f"<div class='gamma'><div>{rng.choice(pool + [str(rng.random())])}</div></div>" if rng.random() < 0.3 else ""
            pages.append((f"http://{host}.example/{i}", f"<body>{menu}<div class='delta'>{body}</div>{extra}{odd}</body>"))
    got = {r.url: r.text for r in H.extract_main_text(rows(spark, pages), by_name=False).collect()}
    dropped = 0
    for host in "abc":
        mine = [(u, h) for u, h in pages if f"//{host}." in u]
        tree = plain_tree([h for _, h in mine])
        for url, page in mine:
            want = plain_text(page, tree if len(mine) >= H.MIN_PAGES else {k: (m, s, None if c is None else 1.0) for k, (m, s, c) in tree.items()})
            assert got[url] == want, url
            dropped += "buy" not in want
    assert dropped > 20


def test_the_tree_alone_extracts_the_driver_pages(spark):
    """Ablation: without any names, on the hosts of most pages, the tree leaves the article alone."""
    src = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("lower(url) like '%//blog.tionsh.example.com/%'")
    both = {r.page_id: r.text for r in H.extract_main_text(src).collect()}
    alone = {r.page_id: r.text for r in H.extract_main_text(src, by_name=False).collect()}
    none = {r.page_id: H.main_text(r.html, {}, by_name=False) for r in src.collect()}
    assert len(both) > 200 and both == alone and all(len(none[k]) > len(t) for k, t in both.items())


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>{i} words of a long page</p>" for i in range(30_000)) + "</article>"
    page = "<article><p>p</p></article>"
    src = spark.createDataFrame(
        [(1, "http://h.example/1", page, "x", "y", 1), (1, "http://h.example/1", page, "x", "y", 1), (None, "http://h.example/2", page, "x", "y", 2), (3, None, None, "x", "y", 3), (4, "http://h.example/4", long, None, None, 4)],
        "page_id long, url string, html string, host string, text string, path int",
    )
    got = sorted(((r.page_id, r.url, r.text) for r in H.extract_main_text(src).collect()), key=str)
    assert [g[2] for g in got if g[0] == 1] == ["p", "p"] and [g[2] for g in got if g[0] is None] == ["p"] and [g[2] for g in got if g[0] == 3] == [""]
    assert [g[2].count("\n") for g in got if g[0] == 4] == [29_999]
