import base64
import hashlib
import io
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import htmlextract, queries, shared, urlfilter, warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sample, name):
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.execute(f"create view {t} as select * from '{sample}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sample)
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("://", "", "", None, "allow"),
        ("http://WWW.Example.COM/en/712?x", "www.example.com", "/en/712", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"), ("http://x.net/de/9", "x.net", "/de/9", "net/de/", "allow"),
        ("https://org/es/", "org", "/es/", "org/es/", "block"), ("https://org/EN", "org", "/EN", None, "allow"),
        ("http://casino.fr/a", "casino.fr", "/a", None, "block"), ("http://casinos.fr/a", "casinos.fr", "/a", None, "block"), ("http://casinova.fr/a", "casinova.fr", "/a", None, "allow"),
        ("http://freeporn.fr/", "freeporn.fr", "/", None, "block"), ("http://pornhubs.fr/", "pornhubs.fr", "/", None, "allow"),
        ("http://free-software.fr/download", "free-software.fr", "/download", None, "allow"), ("http://farm.fr/loan", "farm.fr", "/loan", None, "allow"),
        ("http://track.fr/win", "track.fr", "/win", None, "allow"), ("http://bet.fr/bets", "bet.fr", "/bets", None, "allow"), ("http://free.fr/poker-slots", "free.fr", "/poker-slots", None, "block"),
        ("http://cheap.fr/a", "cheap.fr", "/a", None, "allow"), ("http://cheap.fr/cheap", "cheap.fr", "/cheap", None, "allow"), ("http://cheap.fr/PILLS", "cheap.fr", "/PILLS", None, "block"),
        ("x://h#/casino", "h", "", None, "allow"), ("http://a/b?c://d", "a", "/b", None, "allow"), ("http://é.fr/é", "é.fr", "/é", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = pages(spark, [(1, url, None)]).withColumn("host", F.lit("clash"))
    assert tuple(urlfilter.filter_urls(df).first()) == (1, host, path, rule, verdict)


def test_repeated_urls_null_ids_and_long_urls(spark):
    long = "http://h.fr/" + "a/" * 200_000 + "casino"
    got = urlfilter.filter_urls(pages(spark, [(1, "http://xxx.fr", None), (1, "http://xxx.fr", None), (None, "http://a.fr", None), (2, long, None)])).collect()
    assert sorted((str(r["id"]), r["verdict"]) for r in got) == [("1", "block"), ("1", "block"), ("2", "block"), ("None", "allow")]


def test_urls_of_an_empty_table(spark):
    assert urlfilter.filter_urls(pages(spark, [])).collect() == []


def text_of(source):
    return htmlextract.main_text([source], htmlextract.model())[0]


def test_held_out_pages():
    held = list(htmlextract.training_pages(300, seed=1234))
    got = htmlextract.main_text([s for s, _ in held], htmlextract.model())
    exact = sum(g == "\n".join(b) for g, (_, b) in zip(got, held, strict=True))
    assert exact >= 0.95 * len(held)


class Article(HTMLParser):
    """The blocks of a page's article element, by the standard library's parser."""

    ENDS = frozenset("p h1 h2 h3 li ul div table tr td blockquote section article".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.part, self.blocks = False, 0, [], []
        self.feed(source)
        self.end()

    def end(self):
        if text := " ".join("".join(self.part).split()):
            self.blocks.append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.raw += tag in ("script", "style")
        if tag in self.ENDS:
            self.end()
        if tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.end()
        self.inside &= tag != "article"
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.part.append(data)


def test_pages_of_the_table_give_their_articles_exactly(spark, sample):
    df = spark.read.parquet(f"{sample}/pages.parquet")
    want = {r["page_id"]: "\n".join(Article(r["html"] or "").blocks) for r in df.collect()}
    got = {r["id"]: r for r in htmlextract.extract(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


_PLAIN = "The harbour was quiet that morning, and the boats lay still on grey water while gulls turned above the long stone pier without a sound. "
_BLOCKS = ["Title of it", (_PLAIN * 3).strip(), "Part two", (_PLAIN * 2).strip(), "Short one.", "first thing here", "second thing here", (_PLAIN * 2).strip()]
_ARTICLE = "<h1>{}</h1><p>{}</p><h2>{}</h2><p>{}</p><p>{}</p><ul><li>{}</li><li>{}</li></ul><p>{}</p>".format(*_BLOCKS)
_LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home News Sport Culture Travel About".split()) + "</ul>"
_SIDE = "<h3>Most read</h3><ul>" + "".join(f'<li><a href="/x">{w} in the news today</a></li>' for w in "Storm Market Theatre Football".split()) + "</ul>"
_NOTES = "".join(f"<div class=c1><b>{w}</b><p>{t}</p></div>" for w, t in (("Ann", "I liked this piece a lot."), ("Bob", "Not sure about the second part."), ("Cem", "Thanks for writing it."), ("Dee", "Where was the photo taken?")))


@pytest.mark.parametrize(
    "body",
    [
        f"<div class=hd>The Daily Site {_LINKS}</div><div class=row><div class=col-8>{_ARTICLE}</div><div class=col-4>{_SIDE}</div></div><div class=ft>&copy; 2020 The Daily Site. All rights reserved.</div>",
        f"<table><tr><td class=menu>{_LINKS}</td><td>{_ARTICLE}</td><td>{_SIDE}</td></tr></table>",
        f"<nav>{_LINKS}</nav><article>{_ARTICLE}</article><div class=x9><h3>4 replies</h3>{_NOTES}</div><footer>&copy; x</footer>",
        f"<nav>{_LINKS}</nav><div class=wrap>{_ARTICLE}<div class=x9><h3>4 replies</h3>{_NOTES}</div></div><footer>&copy; x</footer>",
        f"<header><h1>The Daily Site</h1></header><main><article>{_ARTICLE}</article><aside>{_SIDE}</aside></main><footer><p>Imprint and contact</p></footer>",
        _ARTICLE,
        f"<div class='cookie-notice'><p>We use cookies to make this site work.</p><button>OK</button></div><div id=content>{_ARTICLE}</div><form action=/s><p>Sign up for our letter</p><input></form>",
    ],
)
def test_pages_written_by_hand_give_exact_texts(body):
    assert text_of(f"<html><body>{body}</body></html>") == "\n".join(_BLOCKS)


@pytest.mark.parametrize("n", [150, 200, 201, 3000])
def test_groups_of_any_number_of_children_are_compared(n):
    source = f"<body><div>{'<section><p>a</p></section>' * (n - 10)}{'<h2>b</h2>' * 10}</div></body>"
    page = htmlextract.Page(source)
    shares = htmlextract.node_features(page)[:, len(htmlextract.TAG_GROUPS) + 22]
    assert shares[page.tag.index("div")] == (n - 10) / n


def test_whole_make_ups_are_compared():
    source = f"<body><div>{'<section><p>a</p><p>b</p><p>c</p><h2>d</h2></section><section><p>a</p><p>b</p><p>c</p><ul></ul></section>' * 3}</div></body>"
    page = htmlextract.Page(source)
    assert htmlextract.node_features(page)[page.tag.index("div"), len(htmlextract.TAG_GROUPS) + 22] == 0.5


_NOTE_FORMS = ("<div class=c1><b>{}</b><p>{}</p></div>", "<div><h4>{}</h4><p>{}</p></div>", "<ul><li><b>{}</b> <p>{}</p></li></ul>", "<article class=c1><p><a href=/u>{}</a></p><p>{}</p></article>")
_VOICES = (("Ann", "I liked this piece a lot."), ("Bob", "Not sure about the second part."), ("Cem", "Thanks for writing it. " + _PLAIN), ("Dee", "Where was the photo taken?"))


@pytest.mark.parametrize("n", [5, 50, 199, 201, 300, 2000])
@pytest.mark.parametrize("form", _NOTE_FORMS)
def test_long_runs_of_comments_stay_out(form, n):
    notes = "".join(form.format(*_VOICES[k % 4]) for k in range(n)).replace("</ul><ul>", "")
    assert text_of(f"<html><body><nav>{_LINKS}</nav><article>{_ARTICLE}</article><div class=x9><h3>{n} replies</h3>{notes}</div><footer>&copy; x</footer></body></html>") == "\n".join(_BLOCKS)
    assert text_of(f"<html><body><nav>{_LINKS}</nav><div class=wrap>{_ARTICLE}<div class=x9><h3>{n} replies</h3>{notes}</div></div><footer>&copy; x</footer></body></html>") == "\n".join(_BLOCKS)


@pytest.mark.parametrize("n", [5, 199, 201, 2000])
@pytest.mark.parametrize("open_, part, close", [("", "<p>{}</p>", ""), ("<ul>", "<li>{}</li>", "</ul>"), ("<table>", "<tr><td>{}</td></tr>", "</table>")])
def test_long_runs_of_an_article_stay_in(open_, part, close, n):
    blocks = [f"Part {k} of the long account. " + _PLAIN.strip() for k in range(n)]
    run = open_ + "".join(part.format(b) for b in blocks) + close
    source = f"<html><body><nav>{_LINKS}</nav><div class=wrap>{_ARTICLE}{run}</div><div class=x9><h3>4 replies</h3>{_NOTES}</div><footer>&copy; x</footer></body></html>"
    assert text_of(source) == "\n".join(_BLOCKS + blocks)


def test_markup_references_and_white_space():
    body = "<p>First   <b>bo</b>ld&nbsp;&amp; &lt;tag&gt;\n line</p><p>a &copy; b<br>c</p><script>var x='<p>no</p>';</script><p>3 < 5 and 7 > 6, it was said by all of them.</p><!-- <p>hidden</p> --><p>Unclosed and long enough to be seen"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1>{body}</article><footer>&copy; x</footer></body></html>"
    assert text_of(page) == "Title here\nFirst bold & <tag> line\na © b c\n3 < 5 and 7 > 6, it was said by all of them.\nUnclosed and long enough to be seen"


@pytest.mark.parametrize("source", ["", None, " \n", "<", "<p", "<a href='", "<!--", "</p></p>", "<script>", "&", "<table><tr><td>", "<p>" * 20000, "<div>" * 3000 + "x" + "</div>" * 10, "<<<>>>", "<html><body></body></html>"])
def test_odd_pages_have_a_defined_text(source):
    assert isinstance(text_of(source), str)
    if not (source or "").strip():
        assert text_of(source) == ""


def test_a_decoding_never_comes_back_into_a_dropped_part(sample):
    source = "<body><div class=content><p>one two three</p><aside><p>ad <ul><li>x<li>y</ul></aside><section><p>a</p><div><p>b</p></div></section></div></body>"
    page = htmlextract.Page(source)
    for seed in range(200):
        logits = np.random.default_rng(seed).normal(0, 4, len(page.tag))
        kept = htmlextract.decode(page, logits)
        for k in range(1, len(page.tag)):
            path, at = [], k
            while at >= 0:
                path.append(bool(kept[at]))
                at = page.parent[at]
            assert sum(a != b for a, b in zip([False, *path], [*path, False])) <= 2


def test_extraction_of_odd_tables(spark):
    df = pages(spark, [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>")]).withColumn("text", F.lit(3))
    rows = htmlextract.extract(df).collect()
    assert len(rows) == 3 and [r["text"] for r in rows if r["page_id" if "page_id" in rows[0] else "id"]] == ["", ""]
    assert htmlextract.extract(df.limit(0)).collect() == []


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "", None), (8, "x y\n", ""), (None, "n", "same"), (1, "big", "é" * 300_000), (3, "http://b", "same")]
    df = pages(spark, rows).withColumns({"payload": F.lit(1), "first": F.lit(2), "id": F.lit("z")})
    archives = warc.write_archives(df)
    got = warc.read_archives(archives, payloads=True).collect()
    assert archives.agg(F.sum("records")).first()[0] == len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for page_id, url, html in rows:
        r = by[page_id][0]
        first = {"same": 3, None: 7, "": 7}.get(html, page_id)
        assert r["payload_digest"] == b32(html) and r["payload_bytes"] == len((html or "").encode())
        assert r["record_type"] == ("response" if page_id == first else "revisit") and r["refers_to"] == (None if page_id == first else first)
        assert r["payload"] == ((html or "").encode() if page_id == first else None)
    assert by[9][0]["url"] is None and by[7][0]["url"] == "" and by[8][0]["url"] == "x%20y%0A"


@pytest.mark.parametrize("few", [0, 500_000])
def test_archives_are_read_by_as_many_tasks_as_there_are(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "joined_to_few", lambda a, b, key: shared.joined_to_few(a, b, key, few))
    df = pages(spark, [(k, "u", f"text {k % 40}") for k in range(120)]).repartition(6)
    archives = warc.write_archives(df)
    read = warc.read_archives(archives)
    tasks = read.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks >= min(4, archives.count()) and read.count() == 120 and read.where("record_type = 'response'").count() == 40


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")]), min_revisit_bytes=4).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.round_trip(pages(spark, [])).collect() == []


def archive():
    out = io.BytesIO()
    w = warc.Writer(out, warc.make_dictionary([b"<p>some text</p>"] * 3))
    for k in range(3):
        w.add(warc.encode_record(k, "http://x", b"<p>payload</p>" * k, None, False))
    return out.getvalue()


def test_archives_are_checked():
    data = archive()
    assert [r.page_id for r in warc.read_archive(io.BytesIO(data))] == [0, 1, 2]
    for broken in (data[8:], data[:-3], data[:6], b"", data[: len(data) // 2] + b"\0" + data[len(data) // 2 + 1 :]):
        with pytest.raises(Exception):
            list(warc.read_archive(io.BytesIO(broken)))
    good = warc.encode_record(1, "u", b"payload", None, False)
    for a, b in ((b"Content-Length: 7", b"Content-Length: 8"), (b"WARC/1.1", b"WRAC/1.1"), (b"payload", b"Payload"), (b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.decode_record(good.replace(a, b, 1))


def test_an_archive_starts_with_its_dictionary(spark):
    path = warc.write_archives(pages(spark, [(1, "a", "<p>x</p>")])).first()["path"]
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        assert f.read(4) == warc.DICT_MAGIC.to_bytes(4, "little")


LONG = "The first paragraph of the article runs over a good many words, so that it is plain text of the page. " * 3


@pytest.mark.parametrize(
    "source, inside",
    [
        (f"<!doctype html><head><title>t</title><article><p>{LONG}</p><p>{LONG}</p></article>", "first paragraph"),
        (f"<head><title>t</title><style>p{{}}</style> {LONG}", "first paragraph"),
        (f"<body><article><p>{LONG}</p><p>so <math><mi>q</mi><mo>=</mo><mn>17</mn></math> holds. {LONG}</p></article>", "so q=17 holds."),
        (f"<body><article><p>{LONG}</p><xmp>if a < b &amp; c: <b>go</b></xmp><p>{LONG}</p></article>", "if a < b &amp; c: <b>go</b>"),
    ],
)
def test_text_without_head_ends_and_formulas_stay(source, inside):
    got = htmlextract.main_text([source], htmlextract.model())[0]
    assert inside in got and "style" not in got


def test_titles_and_styles_stay_out_of_an_open_head():
    page = htmlextract.Page("<head><title>t</title><meta x> <script>s</script><style>y</style><p>word")
    assert [text for _, text in page.blocks] == ["word"]
