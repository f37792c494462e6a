import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costdocs.functions import markup
from costdocs.functions.splitter import SEPARATORS, split_text
from costdocs.operators import chunks, dedup, headings, links
from costdocs.plans import chunk_index, chunk_store, snapshots
from costdocs.sources import pages as page_source

PAGE = """<!DOCTYPE html><html><head><title>
 A &amp; B </title><style>p{}</style><script>var t = "<h1>no</h1><a href='/sagemaker'>x</a>";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/sagemaker/home">Home</a></nav>
<div class="left sidebar"><h2>Side</h2></div><div class="page-toc">Contents</div>
<p>Before</p><!-- <h2>not me</h2> --><h1 id="x">Main <b>Title</b></h1><p>Same line</p><p>One &lt;two&gt;</p>
<h2>Part one</h2><p>Same line</p><p>Ｆｕｌｌ width</p>
<h3>Detail</h3><p>Uses Amazon SageMaker Studio Classic and sagemaker hyperpod.</p>
<div class="big topics"><ul><li><a href="a.html">First</a></li><li><a>No target</a></li><li><a href="../b.html#s">Second <i>one</i></a></li></ul><div><a href="/c">In</a></div></div>
<a href="later.html">After SageMaker</a><a href="">SageMaker empty</a><aside>Aside</aside><footer>Foot</footer></body></html>"""


def page_table(spark, *html):
    rows = [(i, f"https://x.org/docs/page-{i}.html?a=1", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


# ---- markup ------------------------------------------------------------------------------


def test_page_text_drops_boilerplate_and_repeated_lines():
    lines = markup.page_text(PAGE).split("\n")
    assert lines[:7] == ["A & B", "Contents", "Before", "Main", "Title", "Same line", "One <two>"]
    assert "Full width" in lines and lines.count("Same line") == 1
    assert not {"Site", "Home", "Side", "Aside", "Foot", "not me"} & set(lines)


def test_sections_are_cut_at_headings_outside_boilerplate():
    parts = markup.page_parts(PAGE)
    assert parts["title_tag"] == "A &amp; B"
    assert (parts["H1"], parts["H2"], parts["H3"]) == ("Main Title", "Part one", "Detail")
    sections = parts["sections"]
    assert [s["own_header"] for s in sections] == [None, "Main Title", "Part one", "Detail"]
    assert [s["section_order"] for s in sections] == [0, 1, 2, 3]
    assert sections[0]["content"] == "A & B\nBefore"
    assert sections[2]["content"] == "Part one\nFull width"


def test_blank_sections_are_left_out_and_orders_are_dense():
    parts = markup.page_parts("<h1>A</h1><h2> </h2><h2>A</h2><p>text</p>")
    assert [(s["section_order"], s["content"]) for s in parts["sections"]] == [(0, "A"), (1, "text")]


def test_markup_cleaning_keeps_the_rest():
    out = markup.page_markup(PAGE)
    for gone in ("<script", "<style", "<nav", "<footer", "<aside", "sidebar", "page-toc"):
        assert gone not in out
    for kept in ("<!DOCTYPE html>", "<header>", '<h1 id="x">', "One &lt;two&gt;", "A &amp; B", "<!-- <h2>not me</h2> -->"):
        assert kept in out
    assert markup.page_markup(out) == out


def test_unclosed_dropped_element_ends_with_its_parent():
    assert markup.page_text("<div><nav>gone<p>too</div><p>kept") == "kept"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["<", ">", "</", "<!", "<!--", "-->", "<![", "[", "]]>", "<?", "<div", "<nav>", "</nav>", "<h1>", "</h1>", "<script>", "</script>",
     "<a href=y>", "</a>", "&amp;", "&#", "41;", "&#99999999999;", "text", " ", "\n", "\x00", "é", '"', "=", "/>", "<![if IE]>", "<svg><title>"]
), max_size=25))
def test_no_page_stops_the_job(parts):
    html = "".join(parts)
    for walk in (markup.page_parts, markup.page_facts, markup.page_markup, markup.page_text, markup.topic_links):
        walk(html)
    orders = [s["section_order"] for s in markup.page_parts(html)["sections"]]
    assert orders == list(range(len(orders)))


def test_malformed_declarations_are_comments():
    assert markup.page_text("<p>a</p><![foo bar]><p>b</p><![if !IE]>c<![endif]>") == "a\nb\nc"


def test_facts_see_the_whole_page():
    facts = markup.page_facts(PAGE)
    assert facts["title"] == "A & B"
    assert facts["H1"] == ["Site", "Main Title"] and facts["H2"] == ["Side", "Part one"]
    assert {"text": "Second one", "href": "../b.html#s"} in facts["links"]
    assert all(link["href"] != "/sagemaker" for link in facts["links"])
    assert "not me" not in facts["text"] and "var t" not in facts["text"]


def test_topics_are_those_of_the_first_box(spark):
    rows = links.page_topics(page_table(spark, PAGE, "<p>none</p>")).orderBy("position").collect()
    assert [(r["text"], r["url"]) for r in rows] == [
        ("First", "https://docs.aws.amazon.com/sagemaker/latest/dg/a.html"),
        ("Second one", "https://docs.aws.amazon.com/sagemaker/latest/b.html#s"),
        ("In", "https://docs.aws.amazon.com/c"),
    ]


def test_matching_links(spark):
    rows = links.page_links(page_table(spark, PAGE)).orderBy("position").collect()
    assert [(r["text"], r["url"], r["href"]) for r in rows] == [
        ("Home", "https://docs.aws.amazon.com/sagemaker/home", "/sagemaker/home"),
        ("After SageMaker", "https://docs.aws.amazon.com/sagemaker/latest/dg/later.html", "later.html"),
    ]


@pytest.mark.parametrize(
    "href",
    ["a.html", "/a", "../a", "../../../../a/", "./a/./b/../c", "a/..", "a/.", "#frag", "?q=1", "//other.org/x", "http://o.org/y", "mailto:x@y", "a/b?x=../c#d/..", "..", "/a/../../b"],
)
def test_links_resolve_as_urljoin_does(spark, href):
    from urllib.parse import urljoin

    df = spark.createDataFrame([(href,)], "h string")
    assert df.select(links.absolute_url(df.h)).first()[0] == urljoin(links.BASE_URL, href)


def test_services_and_structure(spark, tmp_path):
    table = page_table(spark, PAGE, "<p>nothing</p>")
    found = links.service_mentions(table).collect()
    assert {r["service"] for r in found} == {"Amazon SageMaker Studio", "Amazon SageMaker Studio Classic", "SageMaker HyperPod"}
    records = links.page_structures(table)
    first, second = records.orderBy("page_id").collect()
    assert first["title"] == "A & B" and first["headers"]["H3"] == ["Detail"]
    assert (first["sagemaker_links_count"], first["found_services_count"]) == (2, 3)
    assert second["title"] == "Unknown" and second["sagemaker_links"] == []
    page_source.write_structures(records, str(tmp_path / "s"))
    urls = {r[0] for r in page_source.read_link_urls(spark, str(tmp_path / "s")).collect()}
    assert urls == {x["url"] for x in first["sagemaker_links"]}


def test_indented_structure_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "title": "x",\n "sagemaker_links": [{"url": "u1"}, {"url": ""}, {"text": "t"}, {"url": "u1"}]\n}')
    (tmp_path / "b.json").write_text('{\n "title": "no links"\n}')
    urls = page_source.read_link_urls(spark, str(tmp_path), multi_line=True)
    assert [r[0] for r in urls.collect()] == ["u1"]


@pytest.mark.parametrize(
    "url, source",
    [
        ("https://x.org/docs/whatis.html?a=1#b", "whatis.html"),
        ("https://x.org/docs/", "docs.html"),
        ("https://x.org/", "index.html"),
        ("https://x.org", "index.html"),
        ("https://x.org/a.tar.gz", "a.tar.html"),
        ("https://x.org/.hidden", ".hidden.html"),
        ("https://x.org/a.b/c;p=1", "c.html"),
    ],
)
def test_file_names(spark, url, source):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(page_source.page_source(df.u)).first()[0] == source


def test_document_rows(spark):
    row = page_source.page_documents(page_table(spark, PAGE)).first()
    assert row["source"] == "page-0.html" and row["title"] == "A & B" and row["headers"]["H2"] == ["Side", "Part one"]
    assert "<nav" not in row["html"] and len(row["scraped_at"]) == 19
    assert page_source.page_documents(page_table(spark, "a", "b", "c"), limit=2).count() == 2


def test_heading_patterns(spark):
    table = page_table(spark, "<TITLE>\n x </TITLE><h1 class='a'>A <b>b</b></h1><H2>C</H2><h2>D\nE</h2>", "<p>")
    assert [r["t"] for r in table.select(headings.title_tag(table.html).alias("t")).collect()] == ["x", None]
    rows = {(r["level"], r["position"]): r["text"] for r in headings.page_headings(table).collect()}
    assert rows == {("H1", 0): "A b", ("H2", 0): "C", ("H2", 1): "D\nE"}
    counts = headings.heading_counts(table).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in counts] == [(1, 2, 0), (0, 0, 0)]


def test_plain_text_pattern(spark):
    table = page_table(spark, "<p>ﬁne</p>\n<p> &lt;b&gt; </p>\r\n<i>ﬁne</i>")
    text = table.select(headings.plain_text(table.html, markup.nfkc_udf).alias("t")).first()["t"]
    assert text == "fine\n<b>"


# ---- chunks ------------------------------------------------------------------------------


def test_known_split():
    text = (
        "Hi.\n\nI'm Harrison.\n\nHow? Are? You?\nOkay then f f f f.\n"
        "This is a weird text to write, but gotta test the splittingggg some how.\n\nBye!\n\n-H."
    )
    assert split_text(text, 10, 1) == [
        "Hi.", "I'm", "Harrison.", "How? Are?", "You?", "Okay then", "f f f f.", "This is a", "weird", "text to",
        "write,", "but gotta", "test the", "splitting", "gggg", "some how.", "Bye!", "-H.",
    ]


def test_overlap_carries_whole_pieces():
    assert split_text("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert split_text(None) is None and split_text(" \n ") == []
    with pytest.raises(ValueError):
        split_text("a", 5, 6)


def brute_force_split(text, size, overlap, separators):
    """The splitting rule written down naively: positions of separators, and full re-joins at every step."""
    separator = next(s for s in separators if s in text)
    rest = separators[separators.index(separator) + 1 :]
    if separator == "":
        pieces = list(text)
    else:
        cuts = [0, *(m.start() for m in re.finditer(re.escape(separator), text)), len(text)]
        pieces = [text[i:j] for i, j in zip(cuts, cuts[1:]) if i < j]
    out, group = [], []

    def flush():
        current = []
        for piece in group:
            if current and len("".join(current + [piece])) > size:
                out.append("".join(current).strip())
                while current and (len("".join(current)) > overlap or len("".join(current + [piece])) > size):
                    current = current[1:]
            current = current + [piece]
        if current:
            out.append("".join(current).strip())
        group.clear()

    for piece in pieces:
        if len(piece) < size:
            group.append(piece)
        else:
            flush()
            out += brute_force_split(piece, size, overlap, rest) if rest else [piece.strip()]
    flush()
    return [c for c in out if c]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(2, 12), st.integers(0, 5))
def test_split_equals_brute_force(text, size, overlap):
    overlap = min(overlap, size)
    assert split_text(text, size, overlap) == brute_force_split(text, size, overlap, list(SEPARATORS))


def test_split_of_the_documents_equals_brute_force(spark, sf_dir):
    """All texts of the smallest tables."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = chunks.recursive_chunks(documents, "doc_id", "text").collect()
    expected = {
        (d["doc_id"], i, c)
        for d in documents.collect()
        for i, c in enumerate(brute_force_split(d["text"], 1200, 120, list(SEPARATORS)))
    }
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(2, 12), st.integers(0, 5))
def test_split_properties(text, size, overlap):
    overlap = min(overlap, size)
    found = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in found)
    # Nothing is lost: every chunk is a part of the text, in order, and covers all letters.
    at, covered = 0, set()
    for c in found:
        place = text.find(c, max(0, at - size))
        assert place >= 0
        at = place
    for c in found:
        start = 0
        while (place := text.find(c, start)) >= 0:
            covered.update(range(place, place + len(c)))
            start = place + 1
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", max_size=60), st.integers(2, 9), st.integers(0, 4))
def test_split_without_separators_is_fixed_windows(text, size, overlap):
    overlap = min(overlap, size - 1)
    step = size - overlap
    count = max(1, -(-(len(text) - overlap) // step))
    windows = [text[i * step : i * step + size].strip() for i in range(count)]
    assert split_text(text, size, overlap, [""]) == [w for w in windows if w]


def test_windows_equal_the_splitter_on_spark(spark):
    texts = ["", " ", "a", "x" * 1200, "y" * 1201, "é😀" * 900, "ab cd\n" * 700, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((1200, 120), (10, 7), (5, 0)):
        windows = {tuple(r) for r in chunks.window_chunks(df, "i", "t", size, overlap).collect()}
        expected = {
            (i, n, c) for i, t in enumerate(texts) if t is not None for n, c in enumerate(split_text(t, size, overlap, [""]))
        }
        assert windows == expected, (size, overlap)
    with pytest.raises(ValueError):
        chunks.window_chunks(df, "i", "t", 5, 5)


def test_chunk_ids_and_metadata(spark):
    pages = page_table(spark, PAGE, "<p>" + "word " * 600 + "</p>", "<title>T</title><h1> </h1><h3>Third</h3>")
    rows = chunk_index.page_chunks(pages, "2025-08-01").collect()
    first = {r["id"]: r for r in rows if r["page_id"] == 0}
    assert set(first) == {f"page-0#s{i:02d}#0000" for i in range(4)}
    assert {(r["title"], r["section"]) for r in first.values()} == {("Main Title", "Part one")}
    second = sorted(r["id"] for r in rows if r["page_id"] == 1)
    assert second == ["page-1#s00#0000", "page-1#s00#0001", "page-1#s00#0002"]
    assert {(r["title"], r["section"], r["order"]) for r in rows if r["page_id"] == 1} == {("Page 1", "General", i) for i in range(3)}
    assert {(r["title"], r["section"]) for r in rows if r["page_id"] == 2} == {("T", "Third")}
    assert all(r["version_date"] == "2025-08-01" and r["doc_type"] == "developer-guide" and r["chunk_id"] == r["id"] for r in rows)


def test_default_url(spark):
    pages = page_table(spark, "<p>a</p>").withColumn("url", F.lit(None).cast("string"))
    sections = chunks.sections(pages.withColumn("source", F.lit("my-page_x.html")))
    row = chunks.attach_metadata(chunks.chunk(sections), "v").first()
    assert row["url"] == chunks.DEFAULT_URL and row["title"] == "My Page X"


def test_flat_metadata(spark):
    df = spark.sql("SELECT 1 AS n, cast(NULL AS string) AS s, map('a', 'b') AS m, named_struct('x', 1) AS t")
    assert tuple(chunks.flat_metadata(df).first()) == (1, "", '{"a":"b"}', '{"x":1}')


# ---- copies ------------------------------------------------------------------------------


def test_first_copy_wins(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, " b")], "id long, content string")
    kept = dedup.dedup_by_hash(dedup.with_text_hash(df), ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]
    assert kept.columns == ["id", "content", "text_hash"]
    assert sorted(r["id"] for r in dedup.dedup_by_prefix(df, "content", ["id"]).collect()) == [1, 2]


def test_prefix_is_cut_before_it_is_trimmed(spark):
    df = spark.createDataFrame([(1, "x" * 100 + "a"), (2, "x" * 100 + "b"), (3, " " + "x" * 99 + "c"), (4, "x" * 99)], "id long, t string")
    assert sorted(r["id"] for r in dedup.dedup_by_prefix(df, "t", ["id"]).collect()) == [1, 3]


def test_hot_copies_merge_before_the_shuffle(spark):
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("content"))
    kept = dedup.dedup_by_hash(dedup.with_text_hash(df), ["id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert kept.count() == 20001 and kept.where("content = 'copy'").first()["id"] == 0


def test_store_grows_only_by_new_chunks(spark, tmp_path):
    from costdocs.checks.text import word_vector

    path = str(tmp_path / "store")
    pages = page_table(spark, PAGE, PAGE)
    manifest = chunk_index.add_pages(spark, pages, path, "v1", word_vector).first()
    assert (manifest["num_docs"], manifest["num_chunks"]) == (2, 8)
    assert chunk_index.read_store(spark, path).count() == 4
    more = page_table(spark, PAGE, "<p>Brand new</p>")
    again = chunk_index.add_pages(spark, more, path, "v2", word_vector).first()
    assert (again["num_docs"], again["num_chunks"]) == (2, 5)
    stored = chunk_index.read_store(spark, path)
    assert stored.count() == 5 and stored.where("version_date = 'v2'").first()["content"] == "Brand new"


def test_vectors_may_come_from_a_table(spark, tmp_path):
    path = str(tmp_path / "store")
    pages = page_table(spark, "<p>One</p>", "<p>Two</p>")
    vectors = spark.createDataFrame([("One", [1.0])], "content string, embedding array<double>")
    chunk_index.add_pages(spark, pages, path, "v1", vectors=dedup.with_text_hash(vectors))
    assert [(r["content"], r["embedding"]) for r in chunk_index.read_store(spark, path).collect()] == [("One", [1.0])]
    with pytest.raises(ValueError):
        chunk_index.add_pages(spark, pages, path, "v1")


def test_pages_to_contexts(spark, tmp_path):
    from costdocs.checks.text import word_vector
    from costdocs.operators import search

    path = str(tmp_path / "store")
    pages = page_table(spark, PAGE, "<title>Zoo</title><h1>Zoo</h1><p>zebra lion zebra</p>", "<h1>Bread</h1><p>flour water salt</p>")
    chunk_index.add_pages(spark, pages, path, "2025-08-01", word_vector)
    asked = spark.createDataFrame([(1, "zebra lion"), (2, "flour")], "query_id long, question string")
    queries = asked.withColumn("embedding", word_vector("question"))
    rows = {(r["query_id"], r["rank"]): r for r in search.search_store(chunk_index.read_store(spark, path), queries, 2, 1).collect()}
    assert rows[1, 1]["id"] == "page-1#s01#0000" and rows[1, 1]["text"] == "zebra lion zebra"
    assert rows[2, 1]["metadata"]["title"] == "Bread" and rows[2, 1]["metadata"]["version_date"] == "2025-08-01"
    assert len(rows) == 2


@pytest.mark.parametrize("piece", ["<a href=x>word ", "<h2>word ", "<div><a>word ", "<p>word</x> "])
def test_open_elements_do_not_make_a_page_slow(piece):
    from time import process_time

    from costdocs.functions import markup

    html = piece * 100_000
    for read in (markup.page_facts, markup.page_parts, markup.topic_links, markup.page_document):
        begin = process_time()
        read(html)
        assert process_time() - begin < 12
    assert [x["text"] for x in markup.page_facts("<a href=x>one <a href=y>two")["links"]] == ["one", "two"]


def test_one_parse_gives_markup_and_facts():
    from costdocs.functions import markup

    html = "<title>T</title><nav><h2>N</h2></nav><h1>A<b>x</b></h1><p>t<!--c--><a href='q'>l"
    found = markup.page_document(html)
    assert found["html"] == markup.page_markup(html) and found["H2"] == ["N"] and found["title"] == "T"
    assert {k: v for k, v in found.items() if k != "html"} == {k: v for k, v in markup.page_facts(html).items() if k in found}


def test_filters_on_pages_reach_the_scan(spark, sf_dir):
    from costdocs.operators import chunks, links
    from costdocs.sources import pages

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plans = [links.page_links(table, "the"), pages.page_documents(table), links.page_structures(table), chunks.sections(table.withColumn("source", F.lit("s")))]
    for df in plans:
        text = df.where("page_id = 3")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(page_id,3)" in text.split("PushedFilters: [")[1].split("]")[0]
        assert text.count("ArrowEvalPython") == 1


def hashed_rows(spark, first, count):
    return dedup.with_text_hash(spark.range(first, first + count).select(F.col("id").cast("string").alias("content")))


def test_store_folders_are_few_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_store, "DIGITS", 1)
    path = str(tmp_path / "store")
    for n in range(20):
        chunk_store.append(spark, path, lambda near, n=n: hashed_rows(spark, 40 * n, 40))
        if n in (7, 9, 19):
            assert chunk_store.read(spark, path).select("content").distinct().count() == chunk_store.read(spark, path).count() == 40 * (n + 1)
    _, rows = chunk_store._record(spark, path)
    files = {}
    for r in rows:
        files[r["hash_prefix"]] = files.get(r["hash_prefix"], 0) + r["files"]
    assert len(files) == 16 and max(files.values()) <= chunk_store.MAX_FILES
    assert sum(r["rows"] for r in rows) == 800
    some = chunk_store.read(spark, path, ["h0", "hf"])
    assert {r[0][0] for r in some.select("text_hash").collect()} == {"0", "f"}
    plan = some.select("text_hash")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "hash_prefix" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "ReadSchema: struct<text_hash:string>" in plan


def test_two_appends_at_once_store_nothing_twice(spark, tmp_path):
    path, inside = str(tmp_path / "store"), []
    rows = hashed_rows(spark, 0, 30)

    def fresh(near):
        if not inside:
            inside.append(1)
            chunk_store.append(spark, path, lambda _: hashed_rows(spark, 10, 10))
        known = near(rows)
        return rows if known is None else dedup.drop_known(rows, known)

    chunk_store.append(spark, path, fresh)
    assert sorted(int(r["content"]) for r in chunk_store.read(spark, path).collect()) == list(range(30))


def test_an_append_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    chunk_store.append(spark, path, lambda near: hashed_rows(spark, 0, 5))
    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            chunk_store.append(spark, path, lambda near: hashed_rows(spark, 5, 5))
    assert chunk_store.read(spark, path).count() == 5 and len(list((tmp_path / "store" / "data").iterdir())) == 1
    assert chunk_store.read(spark, str(tmp_path / "none")) is None
