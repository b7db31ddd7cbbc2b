"""WARC derivatives against a plain page reader, on hostile markup, odd charsets and cut files."""

import gzip
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from graphloom.llm import warc


class Plain(HTMLParser):
    """Another way to the same: the standard parser, with the visible text collected by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden, self.raw, self.title, self.titles, self.links, self.lang = [""], 0, None, "", 0, [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in warc.HIDDEN:
            self.hidden += 1
        if tag == "title":
            self.titles += 1
            self.raw = "title"
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"])
        if tag == "html":
            self.lang = attrs.get("lang")
        if tag in warc.BLOCKS and not self.hidden:
            self.lines.append("")

    def handle_startendtag(self, tag, attrs):
        if tag in warc.BLOCKS and not self.hidden:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in warc.HIDDEN:
            self.hidden -= 1
            self.lines[-1] += " "
        if tag == "title":
            self.raw = None
        if tag in warc.BLOCKS and not self.hidden:
            self.lines.append("")

    def handle_comment(self, data):
        if not self.hidden:
            self.lines[-1] += " "

    def handle_data(self, data):
        if self.raw == "title" and self.titles == 1:
            self.title += data
        if not self.hidden:
            self.lines[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)


def random_page(rng):
    words = lambda: " ".join(rng.choice(["ab", "c&amp;d", "e é", "1 &lt; 2", "x\ny", "&nbsp;z", "a  b"]) for _ in range(rng.randint(0, 4)))

    def node(depth):
        kind = rng.randint(0, 9) if depth else 0
        if kind < 3:
            return words()
        if kind == 3:
            return f"<!-- {words()} <p>no</p> -->"
        if kind == 4:
            return f"<script type='x'>if (a < b && c > d) {{ '<p>' }}</script>"
        if kind == 5:
            return f"<a class=k href={rng.choice(['/u', chr(34) + '/v?a=1&amp;b=2' + chr(34), chr(39) + '/w' + chr(39)])}>{words()}</a>"
        if kind == 6:
            return rng.choice(["<br>", "<hr/>", "<img src=i>"])
        tag = rng.choice(["p", "div", "b", "li", "H2", "span", "noscript", "td"])
        return f"<{tag} id='n'>{''.join(node(depth - 1) for _ in range(rng.randint(0, 3)))}</{tag}>"

    title = f"<title>{words()}</title>" if rng.random() < 0.7 else ""
    return f"<!DOCTYPE html><html lang='{rng.choice(['en', 'pt-BR'])}'><head>{title}<style>p > b {{}}</style></head><body>{''.join(node(4) for _ in range(6))}</body></html>"


def test_pages_are_read_as_a_plain_parser_does():
    rng = random.Random(31)
    for _ in range(400):
        page = random_page(rng).replace("\n", " ")
        plain, got = Plain(), warc.read_page(page)
        plain.feed(page)
        plain.close()
        nested = page.count("<noscript") > 1  # where hidden elements nest, the first end tag ends them here
        if not nested:
            assert got.text == plain.text(), page
            assert (got.title or "") == " ".join(plain.title.split()) and got.language == plain.lang
        assert list(got.links) == plain.links, page


@pytest.mark.parametrize("bad", ["<title>", "<a ", "<script ", "<!--", "<script>", "<", "</title", "<a href='", "<a href=\"x", "<style></style ", "<head>", "<p", "&lt", "<title><a ", "<!-- -->"])
def test_hostile_markup_takes_linear_time(bad):
    took = []
    for n in (200_000, 800_000):
        for end in ("", ">"):
            began = time.perf_counter()
            warc.read_page(bad * (n // len(bad)) + end)
            took.append(time.perf_counter() - began)
    assert max(took) < 3


def test_charsets():
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={}"
    assert warc.decoded(head.format("iso-8859-1"), b"\xe9") == "é" and warc.decoded(head.format("no-such"), "é".encode()) == "é"
    assert warc.decoded("HTTP/1.1 200 OK", b"<meta charset='windows-1252'>\x93") == "<meta charset='windows-1252'>“" and warc.decoded("", b"\xff") == "�"


def test_dates_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'long ' * 5000}{i} WARC/1.1 inside\r\n\r\n</p>", f"2024-02-{i + 1:02d}T00:00:00Z") for i in range(9)], "page_id long, url string, html string, at string")
    made = warc.responses(pages, F.col("at"))
    assert {r.warc_date for r in made.collect()} == {f"2024-02-{i + 1:02d}T00:00:00Z" for i in range(9)}
    every = made.union(warc.derive(made)).repartition(3).cache()
    warc.save(every, str(tmp_path / "w"), True)
    assert warc.load(spark, str(tmp_path / "w")).exceptAll(every).count() == 0 and warc.load(spark, str(tmp_path / "w")).count() == 27
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    parts = data.split(b"WARC/1.1\r\n")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "each.warc.gz").write_bytes(gzip.compress(data[:1000]) + gzip.compress(data[1000:70_000]) + gzip.compress(data[70_000:]))  # members that cut records
    assert warc.load(spark, str(tmp_path / "m")).exceptAll(every).count() == 0 and len(parts) > 27
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cut.warc").write_bytes(data[:-30_000])
    with pytest.raises(Exception, match="cut off"):
        warc.load(spark, str(tmp_path / "c")).count()
