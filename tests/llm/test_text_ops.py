"""BPE, decontamination, HTML, WARC: against libraries, brute force and round trips, with the hard cases."""

import gzip
import hashlib
import io
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from quern.llm import bpe, decontam, html_text, warc
from quern.llm._text import Words, shingles, text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "a" * 3000, "  two  spaces \n\n end ", "<|endoftext|>x<|endoftext|>", "don't we'll 12345 ½² ﬀ", "日本語テスト 😀😀‍", "\x00\x1c\x85\xa0　", "né́ ß ſ", "the the the", "=" * 257 + "\t" * 33]


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH) as f:
        return bpe.Tokenizer.parse(f.read())


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def ids(tokenizer, text):
    return np.frombuffer(tokenizer.encode(text), np.int32).tolist()


def test_bpe_matches_library(tokenizer, library, sf):
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() + [t for t in HARD if t is not None]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(tokenizer, t) == want
        assert tokenizer.decode(np.array(want, np.int64), np.array([0, len(want)])) == [library.decode(want, skip_special_tokens=False)]


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=60))
def test_bpe_any_text(tokenizer, library, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(tokenizer, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(list("abcehinostu'")), max_size=40).map("".join))
def test_bpe_backtracks(tokenizer, library, text):
    assert ids(tokenizer, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_frame(spark):
    rows = [(i, t, "own") for i, t in enumerate(HARD)] + [(1, "", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, PATH).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode_documents(df.where("false"), PATH).count() == 0
    broken = spark.createDataFrame([([50256, 220],), ([],), (None,), ([187, 220],)], "ids array<int>")
    assert [r[0] for r in broken.select(bpe.bpe_decode(spark, broken["ids"], PATH)).collect()] == ["<|endoftext|> ", "", "", tokenizer_bytes(187) + " "]


def test_bpe_query(spark, library, sf, tmp_path):
    """All columns of the query against the library, and a plan that calls Python once."""
    rows = pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pylist() + [{"doc_id": 10_000 + i, "text": t} for i, t in enumerate(HARD)]
    spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = bpe.op1_bpe(spark, str(tmp_path))
    plan = query._jdf.queryExecution().executedPlan().toString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in rows:
        own = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(own), sha(",".join(map(str, own))), sha(library.decode(own, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in query.collect()} == want
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_bpe_memory_is_bounded(library, monkeypatch):
    """Forgetting pieces and pairs changes no result."""
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    with open(PATH) as f:
        own = bpe.Tokenizer.parse(f.read())
    text = "one two three one " + "x" * 500 + " unbelievable " * 20
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids
    assert own.held < 100 and len(own.fits) <= 3


def tokenizer_bytes(i):
    return bytes([next(b for c, b in bpe.byte_letters().items() if Library.from_file(PATH).id_to_token(i) == c)]).decode("utf-8", "replace")


def naive_decontam(text, items, size=10):
    words = [text[a:b].lower() if text[a:b].isascii() else text[a:b].translate(decontam._UPPER) for a, b in decontam.word_spans(text or "")] if text else []
    hit, own = set(), set()
    for item, t in items:
        w = [t[a:b].translate(decontam._UPPER) for a, b in decontam.word_spans(t or "")] if t else []
        if not w:
            continue
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                own |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(own)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(3, LONG), (20, "Short ÄÖ one!"), (100, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (7, None), (8, "..."), (None, "x y"), (9, "one"), (20, "short äö one"), (20, "w9 w10 w11"), (None, "post")]
TEXTS = [None, "", "...", LONG.upper() + " tail", "Pre, w3 W4-w5 w6. w7 w8 w9 w10 w11 w12 w13 w14 w15; post", "short ÄÖ ONE short äö one", "one One ONE", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "phone one", "long " * 5000 + LONG]


@pytest.mark.parametrize("most", [decontam.AUTOMATON_BYTES, 1])
def test_decontam(spark, most, monkeypatch):
    """Items that repeat an id or have none, rows that repeat: the same in one part and in many."""
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", most)
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], -1)], "doc_id long, text string, n_hit int")
    got = decontam.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = naive_decontam(r["text"], ITEMS)
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == want
        covered = sum(len(decontam.word_spans(r["text"][s["start"] : s["end"]])) for s in r["hit_spans"])
        assert covered == r["n_hit"]


def test_decontam_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).first()["n_hit"] == 0
    assert [len(w) for w, _ in decontam.benchmark_parts(spark.createDataFrame([(i, f"a{i} b") for i in range(5)], "item_id long, text string"), 12)] == [2, 2, 1]
    assert decontam.decontaminate(docs.where("false"), none).count() == 0


def test_words_and_shingles():
    texts = ["Ab, cd! ab", "", "é9 x", "one two three four five six"]
    import pyarrow as pa

    w = Words(*text_bytes(pa.array([None, *texts])))
    assert w.counts().tolist() == [0, 3, 0, 2, 6] and w.hash[0] == w.hash[2] != w.hash[1]
    alone = [Words(*text_bytes(pa.array([t]))).hash.tolist() for t in texts]
    assert w.hash.tolist() == [h for a in alone for h in a]
    assert np.diff(shingles(w)[1]).tolist() == [0, 1, 0, 1, 2]


HTML = [
    ("<p>One<p>Two <b>bold</b>\n text<br>next", "One\n\nTwo bold text\nnext"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Pear tree<td>1<tr><td>Fig</table>", "Name       N\nPear tree  1\nFig"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "wide cell  z\n1  2  3"),
    ("<head><title>t</title></head><script>if (a</p>) '<b>'</script><style>x</style>y", "y"),
    ("<div hidden>no</div><p style='DISPLAY: none'>no</p><span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
    ("a &amp; b &lt;p&gt; &copy;&nbsp;x &#65; &bogus;", "a & b <p> ©\xa0x A &bogus;"),
    ("x<!-- <p>no --> y <!doctype html> z</p>w", "x y z\n\nw"),
    ("<a href='1>2'>t</a> 1 < 2 <b", "t 1 < 2"),
    ("<select><option>a<option>b</select><dl><dt>k<dd>v</dl>", "a\nb\n\nk\n  v"),
    ("<noscript>no</noscript><template>no</template><input value=no><input type=submit value=go><textarea>t <b></textarea>", "got <b>"),
    ("<table><tr><td rowspan=2>Fruit<td>pear<tr><td>fig<tr><td>x<td>y</table>", "Fruit  pear\n       fig\nx      y"),
    ("<table><tr><td rowspan=0>a<td colspan=99999999>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td><p>a<p>b<td>c<tr><td>d<td>e</table>", "a  c\n\nb\nd  e"),
    ("<details><summary>more</summary>hidden<table><tr><td>no</table></details><details open><summary>s</summary>shown</details>", "more\ns\nshown"),
    ("<table><tr><td>a<table><tr><td>b<td>c<tr><td>dd</table><td>e</table>", "a      e\n\nb   c\ndd"),
    ("", ""), (None, ""), ("plain", "plain"), ("<p></p><div></div>", ""), ("<td>loose</td></table>", "loose"),
]


@pytest.mark.parametrize(("source", "want"), HTML)
def test_html(source, want):
    assert html_text.visible_text(source) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<br>", "word", " ", "\n", "&amp;", "<", "<div hidden>", "</div>", "<a b='", "'>", "<script>", "</script>"]), max_size=30).map("".join))
def test_html_never_fails(source):
    html_text.visible_text(source)


def test_html_deep_and_long():
    assert html_text.visible_text("<div>" * 50_000 + "x") == "x"
    assert html_text.visible_text("<table><tr><td>" * 2_000 + "x") == "x"
    assert len(html_text.visible_text("<p>word " * 100_000)) > 500_000
    tables = "<table><tr><td>" * 3_000 + "x" + "</table>" * 3_000
    assert html_text.visible_text(tables) == "x"


def test_html_time_is_linear():
    def seconds(n):
        source = "<b>x</b>" * n
        began = time.process_time()
        assert html_text.visible_text(source) == "x" * n
        return time.process_time() - began

    small = seconds(60_000)
    assert seconds(240_000) < 8 * small


def test_html_frame(spark, sf):
    rows = [(1, "<p>a", "keep"), (1, "<p>a", "keep"), (2, None, "keep"), (3, "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(df).collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert html_text.extract(df.where("false")).count() == 0
    pages = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for r in pages:  # all words of paragraphs, in order, and no script
        import html
        import re

        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script>.*?</script>", "", r["html"])
        assert r["text"].replace("\n- ", "\n").removeprefix("- ").split() == html.unescape(re.sub(r"<[^<>]*>", lambda m: "" if m[0] in ("<b>", "</b>") or m[0].startswith(("<a", "</a")) else "\n", body)).split()


def members(rows):
    return b"".join(warc.member({"page_id": i, "url": f"http://x/{i}", "record_type": "response", "payload": p, "payload_bytes": len(p), "payload_digest": hashlib.sha1(p).hexdigest(), "refers_to": None}, "2024-01-01T00:00:00Z", 6) for i, p in rows)


def stored(rows):
    """Members with names of 9,000 letters in their gzip headers, whose payloads are stored as they are."""
    out = b""
    for i, p in rows:
        block = b"HTTP/1.1 200 OK\r\n\r\n" + p
        body = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        sink = io.BytesIO()
        with gzip.GzipFile("n" * 9000, "wb", 0, sink) as f:
            f.write(body)
        out += sink.getvalue()
    return out


def test_warc_nested(spark, tmp_path):
    """Whole archives within payloads are payload at every split, and long gzip headers hide no record."""
    inner = stored([(900 + i, b"inner") for i in range(3)])
    rows = [(i, b"x" * 3000 + inner + b"y" * 3000) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(stored(rows))
    for split in (1000, 20_000, 50_000, 1 << 20):
        got = warc.read_warc(spark, f"file://{tmp_path}", splitBytes=split).collect()
        assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == rows


def test_warc_one_member(spark, tmp_path):
    """A file that is one member gives its records one at a time; bytes that are no member fail the read."""
    bodies = b"".join(gzip.decompress(members([(i, bytes([65 + i]) * 200_000)])) for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(bodies))
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read_warc(spark, f"file://{tmp_path}", splitBytes=500).orderBy("page_id").collect()] == [(i, 200_000) for i in range(5)]
    file = pa_fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz"))
    one = warc.Member(file, 0)
    assert next(warc.records(one, ""))["page_id"] == 0 and len(one.held) < 2_000_000
    (tmp_path / "a.warc.gz").write_bytes(members([(1, b"a")]) + b"junk" + members([(2, b"b")]))
    with pytest.raises(Exception, match="is none"):
        warc.read_warc(spark, f"file://{tmp_path}").count()
    assert warc.read_warc(spark, f"file://{tmp_path}", damaged="skip").count() == 2


def test_warc_overwrite(spark, tmp_path):
    rows = lambda i: spark.createDataFrame([(i, "u", "response", b"p", 1, "a9993e364706816aba3e25717850c26c9cd0d89d", None)], warc.SCHEMA)
    path = f"file://{tmp_path}/w"
    warc.write_warc(rows(1), path)
    warc.write_warc(rows(2), path)
    assert warc.read_warc(spark, path).count() == 2
    warc.write_warc(rows(3), path, "overwrite")
    assert [r["page_id"] for r in warc.read_warc(spark, path).collect()] == [3]


def test_warc_splits(spark, tmp_path):
    """Any split gives each record once, with gzip magic and a whole nested header inside payloads."""
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, n, np.uint8).tobytes() + b"\x1f\x8b\x08\x00" * 5 + gzip.compress(b"WARX/") + b"\r\n\r\nWARC/1.1\r\n\r\n" for n in (0, 10, 5000, 70_000, 3)]
    data = members(enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "_hidden.warc.gz").write_bytes(b"junk")
    for split in (50, 997, 1 << 20):
        got = warc.read_warc(spark, f"file://{tmp_path}", splitBytes=split).collect()
        assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == list(enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data[:-20])
    assert warc.read_warc(spark, f"file://{tmp_path}", damaged="skip").count() == 4
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, f"file://{tmp_path}").count()


def read_splits(path, split):
    """All records of a file, range by range as tasks read them."""
    reader = warc.WarcReader({"path": f"file://{path}", "splitbytes": str(split)})
    return [r["page_id"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


def test_warc_every_record_or_an_error(tmp_path):
    """A file that is cut or damaged at any member, read in splits of any size, fails; as it was, it gives each record once."""
    rng = np.random.default_rng(2)
    data = members((i, rng.integers(0, 256, int(rng.integers(100, 900)), np.uint8).tobytes()) for i in range(30))
    starts = [i for i in range(len(data)) if data.startswith(warc.MAGIC, i) and warc.is_member(pa_fs.LocalFileSystem().open_input_file(_put(tmp_path, data)), i)]
    assert len(starts) == 30
    for split in (300, 1000, 5000, 1 << 25):
        assert read_splits(_put(tmp_path, data), split) == list(range(30))
        for k in range(30):
            end = [*starts, len(data)][k + 1]
            with pytest.raises((zlib.error, EOFError, ValueError)):
                read_splits(_put(tmp_path, data[: end - 20]), split)
            bad = bytearray(data)
            bad[starts[k] + 60 : starts[k] + 75] = bytes(15)
            with pytest.raises((zlib.error, EOFError, ValueError)):
                read_splits(_put(tmp_path, bytes(bad)), split)


def _put(folder, data):
    path = folder / "x.warc.gz"
    path.write_bytes(data)
    return str(path)


def test_warc_long_archive_in_a_payload(tmp_path):
    """An archive of many members stored in a payload: each outer record once, or an error, at any split."""
    rng = np.random.default_rng(3)
    inner = members((100 + i, rng.integers(0, 256, 400, np.uint8).tobytes()) for i in range(40))
    path = _put(tmp_path, members([(0, b"a"), (1, inner), (2, b"b"), (3, rng.integers(0, 256, 9000, np.uint8).tobytes())]))
    whole = 0
    for split in (200, 700, 3000, 9000, 1 << 25):
        try:
            assert read_splits(path, split) == [0, 1, 2, 3]
            whole += 1
        except ValueError as e:
            assert "larger splitBytes" in str(e)  # noqa: PT017
    assert whole and read_splits(path, 1 << 25) == [0, 1, 2, 3]


def test_warc_two_jobs_at_once(tmp_path):
    """Jobs that append to one path have temporary folders of their own."""
    one, two = (warc.WarcWriter({"path": f"file://{tmp_path}"}, False) for _ in range(2))
    (tmp_path / two.job / "part-x").write_bytes(b"x")
    one.commit([])
    two.commit([warc.Written("part-x", 1)])
    assert [p.name for p in tmp_path.iterdir()] == ["part-x"]


def test_html_spans_and_wide_cells():
    """Spans cost no more than the cells that there are, and a wide cell is whole without widening the rows beside it."""
    for page in ("<table>" + "<tr><td rowspan=65534 colspan=1000>" * 2000, "<table>" + "".join(f"<tr><td rowspan={2000 - i} colspan=1000>x<td>y" for i in range(2000))):
        began = time.time()
        html_text.visible_text(page)
        assert time.time() - began < 4
    page = "<table><tr><td>" + "w" * 50_000 + "<td>z" + "<tr><td>a<td>b" * 200
    text = html_text.visible_text(page)
    assert len(text) < 2 * len(page) and "w" * 50_000 + "  z" in text and text.endswith("a  b")
    page = "<table><tr>" + ("<td>" + "x" * 120) * 400 + "<tr><td colspan=399>a<td>b" * 2000
    assert len(html_text.visible_text(page)) < 100 * len(page)
    page = "<ul><li>x" * 3000
    assert len(html_text.visible_text(page)) < 100 * len(page)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<pre>\na\n\nb</pre>", "a\n\nb"),
        ("<textarea>\r\n\nx</textarea>", "\nx"),
        ('<p style="display:\nnone">no<p>yes', "yes"),
        ('<ol><li>a<li style="display:none">b<li>c</ol>', "1. a\n2. c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td rowspan=3>b<td>c<tr><td>d<tr><td>e<tr><td>f</table>", "a  b  c\n      d\n      e\n   f"),
    ],
)
def test_html_details(source, want):
    assert html_text.visible_text(source) == want


def test_decontam_long_item(spark):
    """A part of the benchmark holds no more than its bound, also within one item, and the cut changes nothing."""
    item = " ".join(f"w{i}" for i in range(20_000))
    bench = spark.createDataFrame([(1, item), (2, "w5 w6")], "item_id long, text string")
    parts = list(decontam.benchmark_parts(bench, 100_000))
    assert len(parts) > 5 and all(sum(map(len, w)) <= 100_000 for w, _ in parts)
    assert len({w for part, _ in parts for w in part}) == 19_992
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(500, 4000))), (2, "w5 w6 w7"), (3, "w1 w3")], "doc_id long, text string")
    want = sorted(map(tuple, decontam.decontaminate(docs, bench).select("doc_id", "n_hit", "hit_items").collect()))
    found = decontam._scanned_in_parts(docs, iter(parts))
    assert want == sorted(map(tuple, found.select("doc_id", "n_hit", "hit_items").collect())) == [(1, 3500, ["1"]), (2, 2, ["2"]), (3, 0, [])]


def test_warc_many_records_in_a_member(tmp_path):
    data = gzip.compress(gzip.decompress(members([(1, b"a")])) + gzip.decompress(members([(2, b"b" * 5)])))
    assert [r["page_id"] for r in warc.records(warc.Member(Buffer(data), 0), "")] == [1, 2]


class Buffer(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a b%/", big), (2, None, big), (5, "u", big), (5, "u", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u\r\nX: y", "x\r\n\r\ny" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS payload_digest")
    warc.write_warc(warc.revisits(pages), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == sorted(
        [(1, "revisit", 5, 1200), (2, "revisit", 5, 1200), (5, "response", None, 1200), (5, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (0, "response", None, 1200), (8, "response", None, 1800)]
    )
    by = {r["page_id"]: r for r in got}
    assert by[1]["url"] == "http://a b%/" and by[2]["url"] is None and by[8]["url"] == "u\r\nX: y" and bytes(by[8]["payload"]).decode() == "x\r\n\r\ny" * 300
    assert by[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    warc.write_warc(warc.revisits(pages.where("false")), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
