import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import dom, html_main, knn_join, queries, url_filter
from docquarry.llm.training_pages import labelled_pages

from .cases import CLASHING


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)] + [(None, rows[0][1]), (2000, None), (2001, [float("nan")] * 6), (2002, [None] + [1.0] * 5), (2003, [1.0]), (2050, []), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING if c != "rank"})
    got = sorted(map(tuple, knn_join.knn_join(frame, F.col("vec_id") % 50 == 0, 5, n_pivots=8, block_rows=40, group_queries=3).collect()))
    good = [(k, np.floor(256 * np.array(v))) for k, v in rows if k is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    want = []
    for k, q in good:
        if k % 50 == 0:
            best = sorted((-int(q @ v), i) for i, v in good if i != k)[:5]
            want += [(k, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_knn_of_an_identifier_with_several_vectors(spark):
    rows = [(50, [2.0, 0.0]), (50, [1.0, 3.0]), (50, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [0.5, 0.5])]
    want = [(50, 1, 2, 256 * 512), (50, 2, 1, 128 * 256 + 128 * 512), (50, 3, 1, 256 * 256)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, knn_join.knn_join(frame, F.col("vec_id") % 50 == 0, 5).collect())) == want


def test_knn_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn_join.knn_join(few, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1, 256 * 128)]
    assert knn_join.knn_join(few.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def enumerate_marginals(model, nodes):
    """Sum over all states of all nodes."""
    import itertools

    total, inside = 0.0, np.zeros(len(nodes))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        p = 1e-6 if states[0] else 1.0
        for i, node in enumerate(nodes):
            if node.parent >= 0:
                p *= model.edge[model.kind(nodes[node.parent])][states[node.parent]][states[i]]
            if states[i]:
                for f in html_main.features(node):
                    p *= model.ratio.get(f, 1.0)
        total += p
        inside += p * np.array(states)
    return inside / total


def test_messages_give_exact_marginals():
    model = html_main.DomModel(labelled_pages(60, seed=4))
    page = "<body><nav><ul><li><a>x</a><li><a>y</a></ul></nav><article><h1>Title</h1><p>Some text here.</p></article><footer>c</footer></body>"
    nodes, _ = dom.read(page)
    assert np.allclose(model.marginals(nodes), enumerate_marginals(model, nodes), atol=1e-9)


def test_main_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/a'>Menu item</a></li></ul></nav>"
        "<div class=\"ad\">Buy this now and save.</div><article><h1>A &amp;  B</h1><p><b>First&nbsp;block.<br><p>Second\n block, with <a href=x>a link</a> in it.</p></article>"
        "<section class='comments'><p>I think so too, thanks.</p></section><form><p>Sign up for news.</p></form><footer>&copy; site</footer></body>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p"), (5, "u", "plain < text"), (6, "u", "<div>" * 3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHING})
    got = html_main.main_text(frame).collect()
    first = next(r for r in got if r["page_id"] == 1)
    assert first["text"] == "A & B\n\nFirst block.\n\nSecond block, with a link in it." and first["n_chars"] == len(first["text"])
    assert len(got) == len(rows) and all(r["text"] is not None for r in got) and next(r for r in got if r["page_id"] == 2)["n_chars"] == 0
    assert html_main.main_text(frame.limit(0)).count() == 0


def test_held_out_pages():
    model = html_main.DomModel(labelled_pages())
    right = wrong = missed = 0
    for page in labelled_pages(150, seed=99):
        nodes, blocks = dom.read(page)
        inside, state = model.marginals(nodes), []
        for node in nodes:
            state.append({"content": 1, "other": 0}.get(node.label, state[node.parent] if node.parent >= 0 else 0))
        for i, _ in blocks:
            right += state[i] and inside[i] > 0.5
            wrong += not state[i] and inside[i] > 0.5
            missed += state[i] and inside[i] <= 0.5
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.97


def test_held_out_pages_of_another_make():
    from .other_pages import other_pages

    model = html_main.DomModel(labelled_pages())
    right = wrong = missed = 0
    for page in other_pages(200, seed=7):
        nodes, blocks = dom.read(page)
        inside, state = model.marginals(nodes), []
        for node in nodes:
            state.append({"content": 1, "other": 0}.get(node.label, state[node.parent] if node.parent >= 0 else 0))
        for i, _ in blocks:
            right += state[i] and inside[i] > 0.5
            wrong += not state[i] and inside[i] > 0.5
            missed += state[i] and inside[i] <= 0.5
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.95


VALUES = st.sampled_from(["it's", 'say"so', "'a>b'", '"c>d"', "''", '""', "plain", "a=b", '"x\'y"', "'x\"y'"])
TAGS = st.tuples(st.sampled_from("p div em span b i section".split()), st.lists(st.tuples(st.sampled_from(["title", "data-x", "id"]), st.sampled_from(["=", " = ", "= "]), VALUES), max_size=3), st.sampled_from(["", " ", "/", " '", ' "']))
PIECES = st.one_of(st.text(alphabet="ab '\"=/1.", min_size=1, max_size=8), TAGS.map(lambda t: f"<{t[0]}" + "".join(f" {k}{e}{v}" for k, e, v in t[1]) + f"{t[2]}>"), st.sampled_from(["</p>", "</div>", "</em>", "<!-- > ' -->"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12))
def test_no_text_is_lost_whatever_the_attributes(pieces):
    """Against Python's parser: the same characters outside tags, in the same order."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_data(self, data):
            self.out.append(data)

    page = "".join(pieces)
    plain = Text()
    plain.feed(page)
    plain.close()
    got = "".join(text for _, text in dom.read(page)[1])
    assert "".join(got.split()) == "".join("".join(plain.out).split())


@pytest.mark.parametrize("odd", ["<p title=it's>", "<svg><path d='x'>", "<video src=x>", "<object>", "<select><option>a", "<option>a", "<canvas>", "<noscript>", "<template>", "<iframe src=x>", "<textarea>"])
def test_what_nothing_closes_takes_no_text(odd):
    blocks = [text for _, text in dom.read(f"<article><p>one</p>{odd}<p>I don't</p><p>three</p></article>")[1]]
    assert [t for t in blocks if t != "a"] == ["one", "I don't", "three"]


def test_formulas_are_text():
    assert dom.read("<p>x <math><mi>y</mi><annotation>tex</annotation></math> z</p>")[1] == [(1, "x y z")]


RULES = queries.URL_RULES
URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"), "HTTPS://B.Example.NET/en/1?q=/de/": ("b.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.com/de/1#x": ("example.com", "/de/1", "example.com/de/", "block"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "x://y.org/fr/?a": ("y.org", "/fr/", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://é.org/fr": ("é.org", "/fr", None, "allow"), "http://h.org?x://y/z": ("h.org", "", None, "allow"),
}


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, next(iter(URLS)))]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASHING})
    got = url_filter.judge_urls(frame, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(URLS.values())[r["page_id"]]
    assert url_filter.judge_urls(frame.limit(0), RULES).count() == 0


def test_url_templates(spark):
    """Blocked under numbered sections of one kind: the template that covers them is rejected."""
    rules = [(("block"), f"h.com/spam/{i}/") for i in range(30)] + [("allow", f"h.com/news/{i}/") for i in range(30)]
    urls = [f"http://h.com/{kind}/{i}/page" for kind in ("spam", "news") for i in range(40)] + ["http://other.com/spam/99/page"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(frame, rules).collect()}
    assert [got[i][1] for i in range(30, 40)] == ["block"] * 10 and all(got[i][0] is None for i in range(30, 40))
    assert [got[40 + i][1] for i in range(40)] == ["allow"] * 40 and got[80] == (None, "allow")
    assert url_filter.keep_allowed(frame, rules).count() == 41


@pytest.mark.parametrize("others", [19, 20, 21, 50])
def test_url_verdicts_do_not_depend_on_the_number_of_branches(spark, others):
    """Beside one blocked branch any number of branches without labels, or of allowed ones."""
    unknown = [f"http://a.com/s{k}/{i}" for k in range(others) for i in range(3)]
    blocked = [f"http://{h}.com/de/{i}" for h in "ab" for i in range(10)] + ["http://b.com/de/x"]
    allowed = [f"http://b.com/ok{k}/{i}" for k in range(others) for i in range(3)]
    rules = [("block", "a.com/de/")] + [("block", f"b.com/de/{i}") for i in range(10) if i != 7] + [("allow", "b.com/ok")]
    more = ["http://b.com/de/77"]
    urls = unknown + blocked + allowed + more
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge_urls(frame, rules).collect()}
    assert {got[u] for u in unknown} == {"allow"} and {got[u] for u in allowed} == {"allow"}
    assert got["http://a.com/de/1"] == "block" and got["http://b.com/de/77"] == "block" and got["http://b.com/de/x"] == "allow"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    import os

    import duckdb

    from tests.test_queries import rows

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {p["doc_id"] for p in pieces}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids <= set(texts) and len(ids) > 0.8 * len(set(texts.values()))
    assert len(ids) == len({texts[i] for i in ids})
    for p in pieces:
        assert p["offset"] + p["length"] <= 2048
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert docs.columns == stage(spark, docs, "").columns, name


def test_merged_branches_pool_what_lies_below(spark):
    """Each user has one labelled page of a kind, too few to judge by; together they tell."""
    rules = [("block", f"h.com/user/u{i}/offer/1") for i in range(6)] + [("allow", f"h.com/user/u{i}/diary/1") for i in range(6)]
    urls = [f"http://h.com/user/u{i}/{kind}/{n}" for i in range(6) for kind in ("offer", "diary") for n in (1, 2)] + ["http://h.com/user/u9/offer/2"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge_urls(frame, rules).collect()}
    assert {url for url, verdict in got.items() if verdict == "block"} == {url for url in urls if "/offer/" in url and "u9" not in url}


def test_url_trees_against_sql(spark):
    import duckdb

    rng = np.random.default_rng(8)
    words = ["en", "de", "fr", "shop", "a", "b", "12", "77", "0123456789abcdef", "*", ""]
    hosts = ["example.net", "x.example.net", "example.com", "www.example.com", "q.org"]
    urls = ["/".join([f"http://{hosts[rng.integers(5)]}", *(words[i] for i in rng.integers(0, len(words), rng.integers(0, 6)))]) for _ in range(1500)]
    deep = "http://example.com/" + "s/" * 3000
    urls += [deep, deep + "t", deep + "u", urls[0], urls[0], None, "http://example.com/de/" + "x" * 100_000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = frame.filter("length(url) < 1000 OR url IS NULL").toPandas()  # noqa: F841
    want = sorted(map(str, duckdb.sql(queries.OP9_SQL).fetchall()))
    got = url_filter.judge_urls(frame, queries.URL_RULES).drop("template_rejected").collect()
    assert len(got) == len(urls)
    assert sorted(str(tuple(r)) for r in got if len(urls[r["page_id"]] or "") < 1000) == want
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got)


def test_filters_keep_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/y")], "page_id long, url string")
    frame = frame.withColumns({c: F.lit(1) for c in ("_host", "_path", "host", "path", "rule", "verdict", "raw")})
    kept = url_filter.keep_allowed(frame, queries.URL_RULES)
    assert kept.columns == frame.columns and [r["page_id"] for r in kept.collect()] == [2]


@pytest.mark.parametrize("piece", ["<p x=", "<a ", "<!x", "</", "<?x", "<a", '<p x="a>" ', "<p x=\"<p y='", "<p x='\"", "<script></script ", "<textarea>", "<button></x>", "<td><div>", "<p a", "= "])
def test_reading_takes_time_that_grows_with_the_length(piece):
    """A square of the length would be minutes."""
    import time

    for page in (piece * (1_000_000 // len(piece)), piece * (500_000 // len(piece)) + ">" + "</ul></b></button></textarea>" * 20_000, "<table><td>" + "<div>" * 20_000 + piece * 20_000):
        start = time.process_time()
        dom.read(page)
        assert time.process_time() - start < 8


def test_deep_url_traps_take_few_rounds(spark):
    """Each level has a page and a further level; labelled ones are blocked at every level."""
    import time

    trap = [f"http://example.com/de/{'a/' * d}b{d}" for d in range(400)] + [f"http://example.com/xx/{'a/' * d}b{d}" for d in range(400)] + ["http://q.org/" + "c/" * 400, "http://q.org/fr/x"]
    frame = spark.createDataFrame(list(enumerate(trap)), "page_id long, url string")
    start = time.time()
    got = [r["verdict"] for r in url_filter.judge_urls(frame, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == ["block"] * 400 + ["allow"] * 402 and time.time() - start < 60


@pytest.mark.parametrize("reject", [0.8, 0.4, 0.3])
def test_url_trees_with_mixed_labels_against_sql(spark, reject):
    """Blocked and allowed pages below the same nodes, merged ones included."""
    import duckdb

    rng = np.random.default_rng(3)
    urls = ["/".join(["http://h.com", *(str(rng.choice(["u", "v", "w", "*", "x1", "x2"])) for _ in range(rng.integers(0, 6)))]) for _ in range(400)]
    urls += [f"http://g.com/{a}/{b}/{c}" for a in ("p", "q") for b in "klmn" for c in ("one", "two", "three")]
    rules = [("block", "h.com/u/v/"), ("block", "h.com/v/u/"), ("allow", "h.com/u/x1/"), ("allow", "h.com/v/w/"), ("block", "h.com/x1/"), ("allow", "h.com/x1/u/")]
    rules += [("block", f"g.com/{a}/{b}/one") for a in ("p", "q") for b in "klm"] + [("allow", f"g.com/{a}/{b}/two") for a in ("p", "q") for b in "klm"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = frame.toPandas()  # noqa: F841
    sql = queries.OP9_SQL.replace(f"> {url_filter.REJECT})", f"> {reject})")
    for column in (0, 1):
        sql = sql.replace(queries._rule_sql(column), queries._rule_sql(column, rules))
    want = sorted(map(str, duckdb.sql(sql).fetchall()))
    got = url_filter.judge_urls(frame, rules, reject=reject).drop("template_rejected").collect()
    assert sorted(str(tuple(r)) for r in got) == want
