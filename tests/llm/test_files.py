import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapledger.llm import arc, token_output, warc, wavelet
from snapledger.llm.common import scratch_path
from snapledger.llm.html_main import Page, extract, main_text
from snapledger.llm.wavelet import Shard, WaveletMatrix, dump


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_wavelet_matrix_equals_the_list(n, monkeypatch):
    monkeypatch.setattr(wavelet, "PART", 512)
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n).astype(np.uint16)
    s = Shard(dump(WaveletMatrix.build(ids, 6), np.arange(3), np.array([n, 0, 0]), 4) + b"\n")
    m = s.matrix
    assert (m.decode() == ids).all() and s.number == 4 and s.n == n
    at = rng.integers(0, n, 50) if n else np.empty(0, int)
    assert (m.access(at) == ids[at]).all()
    for token in (0, 7, 39, 40, 63, 64, 1000):
        where = np.flatnonzero(ids == token).tolist()
        assert m.rank(token) == len(where) and m.locate(token) == where
        assert m.rank(token, n // 2) == sum(w < n // 2 for w in where)
    with pytest.raises(IndexError):
        m.select(7, n + 1)


def test_damaged_shards_are_refused():
    whole = dump(WaveletMatrix.build(np.arange(9, dtype=np.uint16), 4), np.arange(1), np.array([9]), 0)
    with pytest.raises(ValueError, match="short"):
        Shard(whole[:-3]).matrix
    with pytest.raises(ValueError, match="version"):
        Shard(b"XXXX" + whole[4:])


def token_rows():
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "Über", "x1", "foo\nbar", "it's"]) for _ in range(rnd.randrange(60)))) for i in rnd.sample(range(10_000), 60)]
    return rows + [(20_000, None), (20_001, ""), (20_002, " two  spaces \n\n and\ttabs "), (20_003, "<|endoftext|> é"), (20_004, "long " * 20_000), (20_004, "again")]


def test_token_files_hold_every_document(spark):
    rows = token_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    plain = Tokenizer.from_file(token_output.public_tokenizer())
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    path = scratch_path(spark, "test-tokens")
    token_output.write_token_shards(docs, path, token_output.public_tokenizer(), shard_bytes=30_000)
    got = sorted(token_output.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r["doc_id"]]}
    token = ids[20_004][0][0] if len(ids[20_004][0]) > 100 else ids[20_004][1][0]
    want = sorted((i, k) for i, lists in ids.items() for x in lists for k, t in enumerate(x) if t == token)
    found = token_output.token_occurrences(spark, path, token).collect()
    assert sorted((r["doc_id"], r["position"]) for r in found) == want
    assert token_output.token_count(spark, path, token).agg(F.sum("occurrences")).first()[0] == len(want)


def test_pieces_give_the_ids_of_the_plain_tokenizer(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 300)
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "Ünï", "\u00a0", "\u3000", "\u2028", " b", "'s", "don't", "123", "日本", ".", "!!", "\x00", "\x1c", "\x85", "\u200b", "\u0301", "<|endoftext|>", "<|endoftext", "word " * 30]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(4000)]
    enc, plain = token_output.Encoder(token_output.public_tokenizer()), Tokenizer.from_file(token_output.public_tokenizer())
    for some in (texts, texts[:7], [], ["", ""], ["<|endoftext|>", "", "<|endoftext|>x"], texts[100:]):
        ids, counts = enc.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_token_files_of_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.tokenized(empty).collect() == []
    got = token_output.tokenized(spark.createDataFrame([(None, "a"), (5, "b")], "doc_id long, text string")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(None, 0, 2), (5, 2, 2)]


def page_rows():
    big = "<p>" + "same text " * 30 + "</p>"
    rows = [(i, f"http://a.example/{i % 3}", big if i % 3 == 0 else f"<b>{i}</b>" * 20) for i in range(30)]
    return rows + [(100, None, None), (101, "http://x y/\n", ""), (102, "u", "tiny"), (103, "u", "tiny"), (104, "é", "ünïcode\r\n\r\nWARC/1.1\r\n" * 10), (105, "u", "big " * 100_000), (0, "again", big)]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    smallest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            smallest[b] = min(i, smallest.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = smallest.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    got = warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archived(pages.limit(0)).collect() == []


def arc_file(version, records):
    names = arc.FIELDS[version].split()
    block = f"{version} 0 test\n{arc.FIELDS[version]}\n".encode()
    out = f"filedesc://t 0.0.0.0 20000101000000 text/plain {len(block)}\n".encode() + block
    for url, date, body in records:
        fields = {"URL": url, "IP-address": "1.2.3.4", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(body))}
        out += " ".join(fields.get(n, "-") for n in names).encode() + b"\n" + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_are_parsed_by_declared_length(version):
    records = [("http://a/", "19990203040506", b"HTTP/1.0 200 OK\r\n\r\nhttp://b/ 1.1.1.1 2000 text/html 3\nabc"), ("http://b c/", "1999", b""), ("http://d/", "199902030405", b"x\n\n")]
    data = arc_file(version, records)
    for raw in (data, zlib_gzip(data)):
        got = list(arc.read_arc(arc.opened(raw)))
        assert [(r.url, r.date, r.block) for r in got] == records
    with pytest.raises(ValueError, match="cut short"):
        list(arc.read_arc(io.BufferedReader(io.BytesIO(data[:-4]))))


def zlib_gzip(data):
    import gzip

    half = len(data) // 2
    return gzip.compress(data[:half]) + gzip.compress(data[half:]) + b"\n"


def test_unknown_versions_are_refused():
    data = arc_file(1, []).replace(b"1 0 test", b"9 0 test")
    with pytest.raises(ValueError, match="version 9"):
        list(arc.read_arc(arc.opened(data)))


def test_dates_and_identifiers():
    assert arc.warc_date("19990203040506") == "1999-02-03T04:05:06Z" and arc.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert arc.record_id("a", "b") == arc.record_id("a", "b") != arc.record_id("ab", "")


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a="</p><p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>home</a><li>about</ul></nav><div class="cookie-notice">We use cookies and {n}</div>
<{main}><h1>The title &amp; more</h1><p>First   paragraph with <b>bold</b> and<br>a break, quite long so that it counts for something here.<p>Second one.</p>
<div class="ad">Buy this now</div><form><p>your mail</p></form><ul><li>item one</li><li>item two</li></ul><section id="comments"><p>I liked it a lot, truly, really so very much indeed</p></section></{end}>
<aside><p>{n}</p></aside><footer>&copy; somebody</footer></body></html>"""
WANT = "The title & more\nFirst paragraph with bold and a break, quite long so that it counts for something here.\nSecond one.\nitem one\nitem two"


@pytest.mark.parametrize("main", ["article", "main", 'div class="post-body"', 'section id="content"'])
def test_main_text_of_several_layouts(main):
    page = PAGE.format(main=main, end=main.split()[0], n="some other words " * 12)
    weights = {t: -6.0 for t in ("nav", "ul", "li", "a", "div", "footer", "header")} | {"p": -0.4, "h1": -0.4, "b": -0.4, "br": -0.4}
    assert main_text(Page(page), weights) == WANT
    assert main_text(Page(page), {}) == WANT


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &lt;b&gt;"), (4, "u", "<nav>menu only</nav>"), (5, "u", "<p>a" * 3000), (6, "u", "<a href=\"x><p>broken quote here"), (7, "u", "<" * 2000), (1, "u", "<article><p>again</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["text"][:20], r["n_chars"]) for r in extract(pages).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "just text <b>", 13), (4, "", 0), (1, "again", 5), (6, "broken quote here", 17)} <= got
    assert (5, "a\na\na\na\na\na\na\na\na\na\n", 5999) in got
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "tag",
    [
        "<video-js>", "<svg-icon name=a></svg-icon>", "<title-bar>", "<select-menu>", "<svg/>", "<svg />", "<math/>", '<svg class="menu"/>', "<svg hidden/>",
        "<object data=a>", '<video src="a" class="banner">', "<canvas>", "<audio hidden>", "<select>", "<template>", "<svg width=10/>", "<iframe src='a'/>", "<iframe allowfullscreen/>",
        "<svg><title>no</title><path d='M0'/></svg>", "<object><object>no</object>no<p>no</p></object>", "<select><option>no<option>no</select>", "<iframe src=a/>no</iframe>",
        "<video src=a><p>Your browser is too old</p></video>", "<style>no</style >", "<script>no</script x>",
    ],
)
@pytest.mark.parametrize("around", ["{}", "<div>{}</div>"])
def test_embedded_elements_do_not_cut_the_page(tag, around):
    tag = around.format(tag)
    page = f"<html><body>{tag}<div class=story><h1>A title</h1>{tag}<p>First paragraph of the story, with words enough.</p>{tag}<p>Second one.</p></div></body></html>"
    assert main_text(Page(page), {}) == "A title\nFirst paragraph of the story, with words enough.\nSecond one."


def test_raw_elements_run_to_their_end_tag():
    for name in ("script", "style", "title", "textarea", "noscript", "iframe"):
        assert main_text(Page(f"<p>words before it <{name} a=b/c>x </p> <svg> </{name}x> y</{name}> and after <{name}>to the end"), {}) == "words before it and after"
