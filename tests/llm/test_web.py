import base64
import hashlib
import heapq
import random
import re
import time
import zlib

import odd  # noqa: F401  (shared path)
import pytest
from conftest import same_as_duck
from hypothesis import given, settings
from hypothesis import strategies as st
from opalgrid.llm import html, registry, warc


@given(st.lists(st.lists(st.integers(0, 50), max_size=20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_loser_tree_merges(runs):
    sources = [[((x, i), (i, j)) for j, x in enumerate(sorted(r))] for i, r in enumerate(runs)]
    got = list(warc.LoserTree([iter(s) for s in sources]))
    assert [k for k, _ in got] == [k for k, _ in heapq.merge(*sources)]
    assert sorted(got) == sorted(x for s in sources for x in s)


def test_loser_tree_keeps_the_order_of_ties():
    got = list(warc.LoserTree([iter([(1, "a"), (2, "b")]), iter([(1, "c")]), iter([]), iter([(1, "d"), (2, "e")])]))
    assert [v for _, v in got] == ["a", "c", "d", "b", "e"]


def test_url_keys():
    assert warc.url_key("https://WWW2.Example.com:443/A?b=2&a=1#top") == "com,example)/a?a=1&b=2"
    assert warc.url_key("http://a.b.org:8080") == "org,b,a:8080)/"
    assert warc.url_key("a.b/c d") == "b,a)/c d"
    assert [warc.url_key(x) for x in (None, "", "  ")] == [""] * 3
    assert warc.url_key("http://[bad") and warc.url_key("http://x:99999/")


def test_records_survive():
    for payload in (b"", b"x", "é\r\n\r\nWARC/1.1\r\n\r\n".encode() * 50, bytes(range(256)) * 100):
        digest = warc.base32_sha1(payload)
        assert digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for revisit in (False, True):
            raw = warc.encode_record(5, "http://a/ü b\n", payload, digest, 9 if revisit else None, revisit)
            fields, http, back = warc.decode_record(raw)
            assert back == (b"" if revisit else payload) and int(http["content-length"]) == len(payload)
            assert fields["warc-payload-digest"] == f"sha1:{digest}" and fields["warc-type"] == ("revisit" if revisit else "response")
            assert warc._page(fields["warc-record-id"]) == 5 and warc._page(fields.get("warc-refers-to")) == (9 if revisit else None)
            assert zlib.decompress(warc._member(raw), 31) == raw
    with pytest.raises(ValueError):
        warc.decode_record(raw[:-1])


PAGES = [(1, "http://a.com/x", "same"), (2, "http://b.com/x", "same"), (3, "http://a.com/x", "other"), (4, None, None), (5, "", ""), (7, "http://a.com/x", "same"), (7, "http://a.com/x", "same"), (None, "http://a.com/n", "same"), (None, "http://c.com/", "lone \r\n\r\n"), (8, "http://c.com/", "long " * 200_000)]


def expected(pages):
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, u, h in pages:
        raw, top = (h or "").encode(), best.get(h or "")
        revisit = top is not None and i != top
        out.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", top if revisit else None, warc.url_key(u)))
    return sorted(map(str, out))


@pytest.mark.parametrize("fan_in", [64, 2])
def test_archives_and_index(spark, fan_in):
    rng = random.Random(1)
    pages = PAGES + [(100 + i, f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", rng.choice(["a", "b", f"page {i}"])) for i in range(400)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'mine' as _keep", "'mine' as archive").repartition(6)
    folder = warc.fresh_path(spark, "test")
    archives = warc.write_archives(frame, folder, archive_bytes=2000)
    assert archives.count() > 6
    out = warc.capture_histories(warc.read_archives(archives.repartition(5), folder), fan_in=fan_in, rows_per_range=100)
    rows = out.collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key)) for r in rows) == expected(pages)
    # in the order of the rows as they come, over all partitions, and of what is written
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and len({r.range_id for r in rows}) > 1 and [r.range_id for r in rows] == sorted(r.range_id for r in rows)
    parts = out.selectExpr("spark_partition_id() as p", "range_id").distinct().collect()
    assert sorted((r.p, r.range_id) for r in parts) == [(r, r) for r in sorted({r.range_id for r in rows})]


def test_a_hot_key_is_cut_by_time(spark):
    """A third of all captures of one URL, over several ranges, merged in three passes."""
    pages = [(i, "http://hot.org/" if i % 3 else f"http://x.org/{i}", f"p{i % 50}") for i in range(900)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(9)
    folder = warc.fresh_path(spark, "test")
    archives = warc.write_archives(frame, folder, archive_bytes=3000)
    n = archives.count()
    out = warc.capture_histories(warc.read_archives(archives.repartition(n), folder), fan_in=2, rows_per_range=150)
    rows = out.collect()
    assert [(r.url_key, r.captured) for r in rows] == sorted((r.url_key, r.captured) for r in rows) and len(rows) == 900
    assert len({r.range_id for r in rows if r.url_key == "org,hot)/"}) > 1


def test_runs_out_of_order_are_found(spark):
    frame = spark.createDataFrame([(i, "http://a/", "x") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder, runs = warc.fresh_path(spark, "test"), warc.fresh_path(spark, "test")
    captures = warc.read_archives(warc.write_archives(frame, folder), folder)
    captures.coalesce(1).sortWithinPartitions("page_id", ascending=False).write.parquet(runs)
    found = warc.segments(spark, [(0, 0, f) for f in warc.files_of(spark, runs)], [])
    with pytest.raises(Exception, match="not in order"):
        warc.merge_segments(found, 1, warc.F.col("range_id")).collect()


def test_archives_of_nothing(spark):
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_archives_are_found(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    folder = warc.fresh_path(spark, "test")
    archives = warc.write_archives(frame, folder)
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(archives.selectExpr("archive", "records + 1"), folder).collect()


def test_index_query(spark, tiny, duck):
    assert same_as_duck(registry.queries()["op1_warc_index"](spark, tiny), duck, registry.oracle_sql()["op1_warc_index"]) == spark.read.parquet(f"{tiny}/pages.parquet").count()


CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("one <b>two</b>  <i>three</i>\nfour", "one two three four"),
    ("x<b>y</b>z", "xyz"),
    ("<ul><li>one<li>two<ul><li>x</ul><li>three</ul>after", "- one\n- two\n  - x\n- three\n\nafter"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<ul><li><p>para</p><p>two</p></li></ul>", "- para\n\n  two"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name      | n\nlong name | 1"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td>c<td>d</table>", "r | a\n  | b\nc | d"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>aa<td>b<td>c</table>", "wide   | z\naa | b | c"),
    ("<table><tr><td>一<td>x<tr><td>abc<td>y</table>", "一  | x\nabc | y"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("a<script>x<p>y</script><style>s</style><!-- c -->b<noscript>n</noscript>", "ab"),
    ("<span hidden>h</span><div style='color:red; display: none'>q<p>r</p></div><p style='visibility:hidden'>s</p>t", "t"),
    ("<pre>\n a\n  b\n</pre>x", " a\n  b\n\nx"),
    ("<title>t</title><body>b", "b"),
    ("<head><meta charset=x><p>in body", "in body"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("&amp;&lt;&nbsp;&eacute;&#x41;&bogus;", "&< éA&bogus;"),
    ("a</p>b</div></table></li>c", "a\n\nbc"),
    ("<td>loose</td> text", "loose\ntext"),
    ("<p>unclosed <b>bold <p>next", "unclosed bold\n\nnext"),
    ("<input type=hidden value=h><input type=submit value=Go><img alt=pic src=x>", "Gopic"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<h1>Head</h1>text<hr>more", "Head\n\ntext\n\nmore"),
    ("<", "<"),
    (None, ""),
    ("", ""),
    ("   \n ", ""),
]


@pytest.mark.parametrize("source, text", CASES)
def test_layout(source, text):
    assert html.extract(source) == text


@given(st.text(alphabet="<>/pbultdr ai=\"'!-&;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_is_taken(source):
    assert isinstance(html.extract(source), str)


def test_depth_and_length_are_bounded_by_memory_alone():
    assert html.extract("<div>" * 30_000 + "deep") == "deep"
    assert html.extract("<table><tr><td>" * 2_000 + "deep").endswith("deep")
    assert len(html.extract("<p>word " * 50_000).split()) == 50_000


def test_html_operator(spark, tiny):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None), (2, "", "y"), (3, "<p>" + "long " * 100_000, "z")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string").selectExpr("page_id", "html", "text", "'mine' as tag")
    out = html.with_text(frame)
    assert out.columns == ["page_id", "html", "tag", "text"]
    assert sorted(str((r.page_id, r.text[:3], r.tag)) for r in out.collect()) == sorted(map(str, [(1, "a", "mine"), (1, "a", "mine"), (None, "", "mine"), (2, "", "mine"), (3, "lon", "mine")]))
    assert html.with_text(frame.where("false")).count() == 0
    got = {r.page_id: (r.text, r.n_chars, r.n_lines) for r in registry.queries()["op8_html_text"](spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        text = html.extract(r.html)
        assert got[r.page_id] == (text, len(text), len(text.split("\n")) if text else 0)


@pytest.mark.parametrize("page, want", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
    ("<p>see <math><semantics><mi>y</mi><annotation>why</annotation></semantics></math> here</p>", "see y here"),
    ("<p>a <svg><title>no</title><desc>no</desc><style>no{}</style><defs><text>no</text></defs><path d='M0'/><text x='1'>drawn</text></svg> b</p>", "a drawn b"),
    ("<p>a <svg><defs/><title/><text>drawn</text></svg> b</p>", "a drawn b"),
    ("<p>a <object data='x'><param name='n'>instead</object> b</p>", "a instead b"),
    ("<p>a <svg/> b</p><p>c <desc>kept</desc></p>", "a b\n\nc kept"),
])
def test_formulas_drawings_and_fallbacks_are_shown(page, want):
    assert html.extract(page).strip() == want


@pytest.mark.parametrize("page, want", [
    ("<style>.x{display:none}</style><p class=x>hid<p>shown", "shown"),
    ("<style>/* .y{ */ p.x , #q {color:red;display : none !important}</style><p class='a x'>hid<p id=q style='display:block'>hid too<p class=y>shown", "shown"),
    ("<style>p{display:none} .on{display:block} #off{display:none}</style><p>no<p class=on>yes<p class=on id=off>no", "yes"),
    ("<style>div p{display:none} a:hover{display:none} @media print{p{display:none}} @media screen{.z{visibility:hidden}}</style><div><p>one</div><p class=z>two", "one"),
    ("<style media=print>p{display:none}</style><p>shown", "shown"),
    ("<style>.h{display:none}</style><style>.h{display:inline}</style>a <b class=h>b</b>", "a b"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<i style='visibility:inherit'>d</i></div>e", "b\ne"),
    ("<div hidden>a</div><div hidden style='display:block'>b</div><div hidden=until-found>c</div>", "b\nc"),
    ("<details><summary>more</summary><p>inside</details><details open><summary>s</summary><p>seen</details>", "more\ns\n\nseen"),
    ("<table><tr><td rowspan=0>r<td>a<tr><td>b<tr><td>c</table>", "r | a\n  | b\n  | c"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
])
def test_what_styles_hide(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("page", ["<p>" + "<span>" * 9000 + "</p>" * 9000, "<p>" * 9000 + "<b>" * 9000 + "<div>x</div>" * 3000, "<div>" * 4000 + "<p>a" * 4000, "<ul><li>" * 3000 + "<b></i>" * 3000])
def test_closing_under_deep_nesting_is_not_quadratic(page):
    began = time.time()
    html.parse(page)
    assert time.time() - began < 3


def test_many_rules_take_no_time_per_element():
    css = "".join(f".c{i}{{display:none}} #i{i}{{display:none}}" for i in range(3000))
    began = time.time()
    shown = html.extract(f"<style>{css}</style>" + "".join(f"<p class='x{i} {'c7' if i % 2 else ''}'>w{i}" for i in range(6000)))
    assert shown.split() == [f"w{i}" for i in range(0, 6000, 2)] and time.time() - began < 5


GAP = object()


def page_of(rng, depth=0):
    """A random page and, computed from its parts and not from its source, the lines that it shows, with GAP for a margin."""
    words = lambda: " ".join(rng.choice(["alpha", "be", "Gam", "x", "12"]) for _ in range(rng.randint(1, 5)))
    source, lines = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "h2", "div", "ul", "ol", "table", "pre", "hidden", "inline"] if depth < 3 else ["p", "inline", "h2"])
        t = words()
        if kind in ("p", "h2"):
            source.append(f"<{kind}>{t.replace(' ', rng.choice([' ', '  ', chr(10)]), 1)}</{kind}>")
            lines += [GAP, t, GAP]
        elif kind == "inline":
            source.append(f"<div><b>{t}</b> <i>{t}</i></div>")
            lines.append(f"{t} {t}")
        elif kind == "div":
            inner, own = page_of(rng, depth + 1)
            source.append(f"<div>{inner}</div>")
            lines += own
        elif kind == "hidden":
            source.append(rng.choice(["<script>{}</script>", "<div hidden>{}</div>", "<!-- {} -->", "<p style='display:none'>{}</p>"]).format(t))
        elif kind == "pre":
            source.append(f"<pre>{t}\n  {t}</pre>")
            lines += [GAP, t, "  " + t, GAP]
        elif kind == "table":
            cells = [[words() for _ in range(3)] for _ in range(rng.randint(1, 3))]
            source.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>")
            widths = [max(len(row[i]) for row in cells) for i in range(3)]
            lines += [GAP, *[" | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells], GAP]
        else:
            items = [words() for _ in range(rng.randint(1, 3))]
            source.append(f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>")
            lines += [GAP, *[("- " if kind == "ul" else f"{i}. ") + x for i, x in enumerate(items, 1)], GAP]
    return "".join(source), lines


@pytest.mark.parametrize("seed", range(120))
def test_random_pages_show_their_parts(seed):
    source, lines = page_of(random.Random(seed))
    want = []
    for i, x in enumerate(lines):
        if x is not GAP:
            want.append(x)
        elif want and want[-1] != "" and any(y is not GAP for y in lines[i:]):
            want.append("")
    assert html.extract(source) == "\n".join(want)


def test_pages_show_all_words_and_no_others(tiny):
    """Real pages, against the words that are left when tags and what never shows are cut out of the source."""
    import html as entities

    import pyarrow.parquet as pq

    checked = 0
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        if not source or re.search(r"hidden|display|visibility|<details|<input|<img|<select|<ol|<svg", source, re.IGNORECASE):
            continue
        plain = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|title|iframe)\b.*?</\1\s*>", " ", source)
        plain = re.sub(r"(?s)<!?/?[a-zA-Z][^<>]*>", "", plain)
        joined = lambda t: re.sub(r"[\s|]+", "", t)
        assert joined(re.sub(r"(?m)^ *- ", "", html.extract(source))) == joined(entities.unescape(plain))
        checked += 1
    assert checked > 10
