import random
from html.parser import HTMLParser

from corpusweave.operators import sections as H


class Plain(HTMLParser):
    """Another way to the same tree: a parser of the standard library, and parents found by looking back over closed nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.title, self.silent = [["page", 0, None, "", ""]], [0], False, None

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in H.SILENT:
            self.silent = tag
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            while self.nodes[self.open[-1]][0][0] == "h" and self.nodes[self.open[-1]][0][1:].isdigit() and self.nodes[self.open[-1]][0] >= tag:
                self.open.pop()
            self._push(tag)
            self.title = True
        elif tag in H.ELEMENTS:
            self.title = False
            self._push(tag)
        else:
            self.handle_data(" ")

    def _push(self, tag):
        self.nodes.append([tag, len(self.open), self.open[-1], "", ""])
        self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if self.silent:
            self.silent = None if tag == self.silent else self.silent
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.title = False
        elif tag in H.ELEMENTS:
            self.title = False
            if tag in [self.nodes[i][0] for i in self.open[1:]]:
                while self.nodes[self.open.pop()][0] != tag:
                    pass
        else:
            self.handle_data(" ")

    def handle_data(self, data):
        if not self.silent:
            self.nodes[self.open[-1]][3 if self.title else 4] += data


def _plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return [(i, parent, depth, tag, " ".join(title.split()), " ".join(text.split())) for i, (tag, depth, parent, title, text) in enumerate(p.nodes)]


def test_trees_equal_those_of_a_parser(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert [n[:6] for n in H.section_tree(r.html)] == _plain(r.html)


def test_random_nesting():
    rng = random.Random(1)
    parts = ["<section>", "</section>", "<article class='a>b'>", "</article>", "<h1>", "</h1>", "<h2 id=\"x\">", "</h2>", "<h3>", "</H3>", "<p>", "</p>", "one ", "two &amp; ", "<br/>", "<nav>", "</nav>", "<script>if (a) b</script>", "<style>p</style>", "<!-- <h1> -->", "&lt;h1&gt;"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert [n[:6] for n in H.section_tree(page)] == _plain(page), page


def test_bounds_and_odd_pages(spark):
    page = "<p>intro</p><h1>A</h1>x<h2>B</h2>y<h3>C</h3>z<h2>D</h2><h1>E</h1>"
    tree = H.section_tree(page)
    assert [(t[3], t[1], t[2], t[4], t[5]) for t in tree] == [("page", None, 0, "", "intro"), ("h1", 0, 1, "A", "x"), ("h2", 1, 2, "B", "y"), ("h3", 2, 3, "C", "z"), ("h2", 1, 2, "D", ""), ("h1", 0, 1, "E", "")]
    assert page[tree[2][6] : tree[2][7]] == "<h2>B</h2>y<h3>C</h3>z" and tree[0][7] == len(page)
    deep = "<section>" * 20_000 + "x"
    assert H.section_tree(deep)[-1][2:6] == (20_000, "section", "", "x") and len(H.section_tree("<!-- never shut <h1>x")) == 1
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<h1>a")], "page_id long, html string")
    assert sorted((str(r.id), r.tag, r.title) for r in H.section_rows(rows).collect()) == [("1", "page", ""), ("2", "page", ""), ("None", "h1", "a"), ("None", "page", "")]
    assert H.section_rows(rows.limit(0)).count() == 0


def test_headings_decode_what_the_sql_decodes(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.oracle import compare, connection

    titles = ["a &amp; b", "cut &amp", "&quot;c&quot; &lt;d", "&amp;quot; &amp;amp; &#65;", "no\u00a0break \t two  blanks", "none"]
    pages = spark.createDataFrame([(i, f"u{i}", f"<nav>x</nav><h1>{t}</h1><p>y</p>") for i, t in enumerate(titles)], "page_id long, url string, html string")
    pages.coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(entry.queries()["section_headings"](spark, str(tmp_path)), connection(str(tmp_path)), entry.oracle_sql()["section_headings"])
    assert H.section_tree("<h1>a &amp b&quot;")[1][4] == 'a & b"'
