"""Readers of pages, responses and files, on small inputs written here."""

import io
import json
import random
import zipfile
import zlib

from loomrank.sources import files, pages, payloads
from loomrank.sources import pdf as pdf_

ROW = '<tr><td><a href="/posting/{0}?jobId={0}">{1}</a></td><td>{2}</td><td>Toronto</td><td>Builds things for people every day</td></tr>'
TABLE = "<html><body><nav><a href='/home'>Home page of jobs</a></nav><table>" + "".join(ROW.format(12345 + k, f"Software Developer {k}", f"Acme {k} Labs") for k in range(5)) + "</table></body></html>"


def test_listed_jobs(spark):
    got = pages.listed_jobs(TABLE, "https://h.example/")
    assert [j["title"] for j in got] == [f"Software Developer {k}" for k in range(5)]
    assert got[0]["url"] == "https://h.example/posting/12345?jobId=12345" and got[0]["company"] == "Acme 0 Labs" and got[0]["location"] == "Toronto"
    assert pages.listed_jobs(None) == [] and pages.listed_jobs("") == []
    df = spark.createDataFrame([(1, "https://h.example/", TABLE), (2, "https://h.example/", None)], "page_id long, url string, html string")
    assert pages.jobs(df).count() == 5


def test_row_url():
    """The id parameter counts 120, the row's number 90, a posting's path 40; folder, print and apply 80 less."""
    from loomrank.sources.dom import parse as tree

    def best(*links):
        row = next(e for e in tree("<table><tr><td>12345</td><td>" + "".join(f'<a href="{u}">Software Developer</a>' for u in links) + "</td></tr></table>").elements() if e.tag == "tr")
        return pages.row_url(row, row.find_all("a")[0], "https://h.example/")

    assert best("/posting/12345/print?jobId=12345", "/posting/12345?x=1", "/jobs/x?jobId=12345") == "https://h.example/jobs/x?jobId=12345"
    assert best("/job/folder/1", "/job/2") == "https://h.example/job/2"
    assert best("/job/1", "/job/2") == "https://h.example/job/1"


def test_posting_bullets(spark):
    html = "<main><h3>Technical skills</h3><ul><li>Experience with Python required</li><li>short</li></ul><p>More.</p></main>"
    assert pages.posting_parts(html)["bullets"] == ["Experience with Python required"]
    df = pages.postings(spark.createDataFrame([(1, html), (2, None)], "id long, html string"))
    assert [r["bullets"] for r in df.orderBy("id").collect()] == [["Experience with Python required"], []]


def test_ratings(spark):
    html = (
        "<section><h2>Hires by faculty</h2><ul><li>Engineering: 55%</li><li>Arts: 10%</li></ul></section><script>var c = {title: 'work term', labels: ['Term 1', 'Term 2'], data: [3, 1]}</script>"
        "<table><tr><th>Term</th><th>Students hired</th></tr><tr><td>Fall</td><td>14</td></tr><tr><td>Winter</td><td>9</td></tr><tr><td>Spring</td><td>4</td></tr></table>"
    )
    shares, hires = pages.rating_tables(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r["kind"]: [(x["label"], x["percent"]) for x in r["dist"]] for r in shares.collect()}
    assert got["faculty"] == [("Engineering", 55.0), ("Arts", 10.0)] and got["term"] == [("Term 1", 75.0), ("Term 2", 25.0)]
    assert [(r["term"], r["hires"]) for r in hires.orderBy("seq").collect()] == [("Fall", 14), ("Winter", 9), ("Spring", 4)]


def test_payloads():
    long = "Required: " + "python and sql " * 20
    assert long.strip() in payloads.payload(json.dumps({"a": {"description": long}}))
    xml = f"<?xml version='1.0'?><partial-response><changes><update>{long}</update></changes></partial-response>"
    assert payloads.payload(xml) == " ".join(long.split())
    assert payloads.payload("plain") == "plain" and payloads.payload(None) == ""
    urls = payloads.posting_urls("12345", "https://h.example/myaccount/co-op/direct/jobs.htm", contexts=["load('/myaccount/co-op/direct/jobs.htm?jobId=1')"])
    assert urls and all("12345" in u for u in urls) and len(urls) <= payloads.GETS
    calls = payloads.ajax_sources(["PrimeFaces.ab({s:'f:open',u:'panel'});"])
    assert calls[0]["source"] == "f:open" and calls[0]["update"] == "panel"


def docx(*lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(text):
    data = zlib.compress(f"BT ({text}) Tj ET".encode("latin-1"))
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream\nendobj\n"


def test_files(spark):
    words = "Education at a university and experience as a developer with projects and skills in python work on github " * 4
    rows = [("a.txt", b"Python developer"), ("b.docx", docx("Jane", "Knows SQL")), ("c.pdf", pdf(words)), ("d.docx", b"no zip"), ("e.pdf", b""), ("f.txt", None)]
    got = {r["path"]: r for r in files.resume_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"]["text"] == "Python developer" and got["b.docx"]["text"] == "Jane\nKnows SQL"
    assert "university" in got["c.pdf"]["text"] and got["c.pdf"]["error"] is None
    assert got["d.docx"]["text"] is None and "DOCX" in got["d.docx"]["error"] and got["e.pdf"]["text"] is None and got["f.txt"]["text"] == ""
    assert pdf_.Lexer(rb"(a\(b\)\101(c)\n)").next() == b"a(b)A(c)\n" and pdf_.decode(b"\xfe\xff\x00a") == "a"


def test_pdf_pages():
    """A file with a tree of pages, a length in another object, a font with its own codes, an object stream and moves."""
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <01> <1a> <0061> endbfrange 1 beginbfchar <20> <0020> endbfchar"
    content = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm <0102> Tj 30 0 Td <03> Tj 0 -12 Td [<04> -300 <05> 20 <06>] TJ ET q 1 0 0 1 0 -100 cm BT /F1 10 Tf 50 700 Td <07> Tj ET Q BI /W 1 ID (x) Tj EI"
    packed = zlib.compress(content)
    inner = b"10 0 11 26 << /F1 12 0 R >>            << /Type /Page /Parent 2 0 R /Contents 4 0 R >>"
    first = inner.index(b"<<")
    inner = b"10 0 11 %d " % (inner.index(b"<< /Type") - first) + inner[first - 0 :]
    first = inner.index(b"<<")
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [11 0 R] /Resources << /Font 10 0 R >> >> endobj",
        b"4 0 obj << /Length 5 0 R /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream endobj", b"5 0 obj %d endobj" % len(packed),
        b"6 0 obj << /Type /ObjStm /N 2 /First %d /Length 9999 >> stream\n" % first + inner + b"\nendstream endobj",
        b"12 0 obj << /Type /Font /Subtype /TrueType /ToUnicode 13 0 R /FirstChar 0 /Widths [0 500 500 500 500 500 500 500] >> endobj", b"13 0 obj << >> stream\n" + cmap + b"\nendstream endobj",
    ]
    pages_ = pdf_.page_pieces(pdf_.Document(b"%PDF-1.5\n" + b"\n".join(parts)))
    assert len(pages_) == 1 and [p.text for p in pages_[0]] == ["ab", "c", "d ef", "g"]
    assert pdf_.laid_out(pages_[0]) == "ab c\nd ef\ng" and pages_[0][3].y == 600
    gen = random.Random(1)
    whole = b"%PDF-1.5\n" + b"\n".join(parts)
    for _ in range(150):  # damaged files give something or ValueError, nothing else
        cut = bytearray(whole)
        for _ in range(gen.randint(1, 12)):
            cut[gen.randrange(len(cut))] = gen.randrange(256)
        files.pdf_texts(bytes(cut[: gen.randint(1, len(cut))]))


def test_form_fields():
    got = pages.form_fields('<form><label for="n">Full name</label><input id="n" name="nm"><label>Mail <input type="email"></label></form>')
    assert [(f["label"], f["type"]) for f in got] == [("Full name", "text"), ("Mail", "email")]
