import sqlite3
import zipfile

from inkstone.sources import containers


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="urn:p"><manifest><item id="x" href="x.html"/><item id="y" href="y.html"/><item id="z" href="z.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/><itemref idref="z"/></spine></package>')
        z.writestr("OPS/x.html", "<html><head><title>t</title></head><body><p>Second &amp; last.</p></body></html>")
        z.writestr("OPS/y.html", "<h1>One</h1><p>First.</p><p>More.</p>")
        z.writestr("OPS/z.html", "<body> </body>")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    rows = sorted(containers.epub_chapters(spark, str(tmp_path)).collect(), key=lambda r: (r.error or "", r.part or 0))
    assert [(r.title, r.text) for r in rows[:2]] == [("One", "One\n\nFirst.\n\nMore."), (None, "Second & last.")]
    assert len(rows) == 3 and rows[2].error.startswith("BadZipFile")


def test_manuscripts(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>words.</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.md").write_text("lead\n# A\none\n\ntwo\n## B\nthree\n")
    (tmp_path / "c.txt").write_text("a b c d e")
    got = {}
    for r in containers.manuscripts(spark, str(tmp_path), window=2).orderBy("path", "part").collect():
        got.setdefault(r.path[-4:], []).append((r.title, r.text))
    assert got["docx"] == [("Top", "Some words.")]
    assert got["b.md"] == [(None, "lead"), ("A", "one\n\ntwo"), ("B", "three")]
    assert got[".txt"] == [(None, "a b"), (None, "c d"), (None, "e")]


def test_mbox(spark, tmp_path):
    (tmp_path / "m.mbox").write_text(
        "From x\nMessage-ID: <1@a>\nFrom: Me <ME@a.org>\nDate: Thu, 01 Jan 1970 00:01:00 +0000\nSubject: s\n\nHello.\n>From here\n-- \nsig\n\n"
        "From x\nMessage-ID: <2@a>\nReferences: <1@a> <9@a>\nFrom: you@a.org\nDate: what\nSubject: r\n\nMine.\n> theirs\nOn Monday, someone wrote:\n> old\n"
    )
    rows = containers.mbox_messages(spark, str(tmp_path)).orderBy("part").collect()
    assert [(r.message_id, r.thread, r.sender, r.sent, r.text) for r in rows] == [("<1@a>", "<1@a>", "me@a.org", 60.0, "Hello.\nFrom here"), ("<2@a>", "<1@a>", "you@a.org", None, "Mine.")]
    assert containers.mbox_messages(spark, str(tmp_path), "Me@a.org").count() == 1


def test_chat(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "c.db")
    con.execute("CREATE TABLE m (contact TEXT, at REAL, mine INT, text TEXT)")
    con.executemany("INSERT INTO m VALUES (?, ?, ?, ?)", [("a", 100, 1, "second"), ("a", 50, 1, "first"), ("a", 60, 0, "other"), ("a", 90000, 1, "next"), ("b", 10, 1, None)])
    con.commit()
    con.close()
    rows = containers.sqlite_rows(spark, str(tmp_path), "SELECT contact, at, text FROM m WHERE mine = 1", "contact string, at double, text string")
    assert [(r.contact, str(r.day), r.n, r.text) for r in containers.chat_days(rows).orderBy("day").collect()] == [("a", "1970-01-01", 2, "first\nsecond"), ("a", "1970-01-02", 1, "next")]
