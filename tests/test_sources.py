import json

from pyspark.sql import functions as F

from evidex.sources import markup as M


def test_html_skips_what_is_hidden_and_reads_tables():
    t = """<html><head><title>x</title><script>var t="<p>no</p>";</script><style>p{}</style></head><body><h1>A &amp; B</h1>
    <p>one <b>two</b><br>three</p><ul><li>i1</li><li>i2</li></ul><pre>a
  b</pre><table><tr><th>h</th><th></th></tr><tr><td> 1 </td><td>2</td></tr><tr><td></td></tr></table><div>loose</div><template><p>t</p></template></body>"""
    assert M.html_blocks(t) == [("heading", 1, "A & B"), ("paragraph", 0, "one two three"), ("paragraph", 0, "i1"), ("paragraph", 0, "i2"), ("paragraph", 0, "a\n  b"), ("table", 0, "h | \n1 | 2")]


def test_html_unclosed_paragraphs():
    t = "<div><p>a <b>b<p>c</div><p>d"
    assert [b[2] for b in M.html_blocks(t)] == ["a b", "c", "d"]
    assert [b[2] for b in M.html_blocks(t, autoclose=False)] == ["a bc", "d"]


def test_markdown():
    t = "# One *two* [l](u)\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n# code\n```\n- **#id** `x`\n  - **#sub** y\n~~~\nopen"
    assert M.markdown_blocks(t) == [("heading", 1, "One two l"), ("paragraph", 0, "text\nmore"), ("table", 0, "| a | b |\n|---|---|\n| 1 | 2 |"), ("code", 0, "# code"), ("heading", 1, "id"), ("heading", 2, "sub"), ("code", 0, "open")]
    assert M.clean_title("x" * 200) == "x" * 120 + "…"


def test_email_and_notebook():
    mail = 'Subject: Hi\nFrom: a@x.org\nTo: b@x.org\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/html\n\n<p>Hello</p>\n--q\nContent-Type: text/csv\nContent-Disposition: attachment; filename="f.csv"\n\n1\n--q--\n'
    assert M.email_blocks(mail) == [("heading", 1, "Hi"), ("paragraph", 0, "Sender: a@x.org\nReceiver: b@x.org\nDate: 2024-01-01T10:00:00+00:00"), ("paragraph", 0, "Hello"), ("paragraph", 0, "Attachments: f.csv")]
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["## T\n", "x"]}, {"cell_type": "code", "source": "1+1"}, {"cell_type": "code", "source": ""}, {"cell_type": "markdown", "source": "p"}]})
    assert M.notebook_blocks(nb) == [("heading", 2, "T"), ("code", 0, "1+1"), ("paragraph", 0, "p")]


def test_a_broken_file_is_a_row(spark):
    df = spark.createDataFrame([("a", "{"), ("b", None), ("c", '{"cells": []}')], "path string, t string")
    got = sorted((r.path, r.type) for r in M.parsed(df, "path", "t", "notebook").collect())
    assert got == [("a", "error"), ("b", "error")]
    assert M.parsed(df.limit(0), "path", "t", "html").count() == 0


def test_formats_and_encodings(spark):
    names = spark.createDataFrame([(n,) for n in ("a.HTM", "b.doc", "c.pptm", "d.zip", None)], "p string")
    assert [r[0] for r in names.select(M.format_of(F.col("p"))).collect()] == ["html", "error:legacy_format", "error:macro_format", "error:unsupported_format", "error:unsupported_format"]
    raw = spark.createDataFrame([("é".encode(),), ("﻿a".encode(),), ("文件".encode("big5"),), (b"\xff\xfe\xe9x",), (None,)], "b binary")
    got = [r[0] for r in raw.select(M.decoded(F.col("b"))).collect()]
    assert got[:3] == ["é", "a", "文件"] and got[3] is not None and got[4] is None


def test_html_elements_carry_ids_classes_and_links(spark):
    from evidex.sources import markup

    html = """<h1 id="top" class="big  red">Title <a href="/a">one  <b>two</b></a></h1><div id="no"><p>text<script>x</script> <a>none</a> <a href="/b">B</a> and <a href="/c"></a></p></div><ul><li class=x>item</li></ul>"""
    rows = markup.html_elements(spark.createDataFrame([(1, html), (2, None), (3, "plain")], "k long, h string"), "k", "h").orderBy("id", "pos").collect()
    got = [(r.id, r.type, r.body, r.element_id, r.classes, [tuple(x) for x in r.links]) for r in rows]
    assert got == [
        (1, "heading", "Title one two", "top", ["big", "red"], [("/a", "one two")]), (1, "paragraph", "text none B and", None, [], [("/b", "B"), ("/c", "")]), (1, "paragraph", "item", None, ["x"], []),
    ]


REPO = {
    "pkg/__init__.py": "from .service import Service as Main\n",
    "pkg/repository.py": "class Store:\n    def close(self):\n        pass\n\nclass Repository(Store):\n    def get(self, key):\n        return self.find(key)\n    def find(self, key):\n        self.close()\n        return key\n",
    "pkg/service.py": "import json\nfrom .repository import Repository\n\nclass Service:\n    def __init__(self, repository: Repository):\n        self.repository = repository\n    def run(self, key):\n        return json.dumps(self.repository.get(key))\n",
    "pkg/api.py": "from pkg import service as s\nfrom pkg.repository import Repository\n\ndef endpoint(key):\n    svc = s.Service(Repository())\n    return svc.run(key)\n",
    "tests/test_api.py": "import pkg.api\n\ndef test_endpoint():\n    assert pkg.api.endpoint(1) and helper(2).go() and lonely(3)\n",
    "broken.py": "def (:",
}


def test_references_are_resolved_by_import_type_class_base_and_name(spark):
    from evidex.operators import graph, resolve
    from evidex.sources import code

    files = spark.createDataFrame([*REPO.items(), ("other.py", "def lonely(x):\n    return x\n")], "path string, content string")
    rows = code.parsed(files)
    got = {(r.owner, r.name): (r.status, r.target) for r in resolve.code_references(rows, code.bindings(files)).collect()}
    assert got[("pkg.service.Service.run", "self.repository.get")] == ("RESOLVED", "pkg.repository.Repository.get")
    assert got[("pkg.api.endpoint", "svc.run")] == ("RESOLVED", "pkg.service.Service.run")
    assert got[("pkg.api.endpoint", "s.Service")] == ("RESOLVED", "pkg.service.Service") and got[("pkg.api.endpoint", "Repository")] == ("RESOLVED", "pkg.repository.Repository")
    assert got[("pkg.repository.Repository.get", "self.find")] == ("RESOLVED", "pkg.repository.Repository.find")
    assert got[("pkg.repository.Repository.find", "self.close")] == ("RESOLVED", "pkg.repository.Store.close")
    assert got[("pkg.repository", "Store")] == ("RESOLVED", "pkg.repository.Store")
    assert got[("pkg.service.Service.run", "json.dumps")] == ("EXTERNAL", "json.dumps")
    assert got[("tests.test_api.test_endpoint", "pkg.api.endpoint")] == ("RESOLVED", "pkg.api.endpoint")
    assert got[("tests.test_api.test_endpoint", "lonely")] == ("POSSIBLE", "other.lonely") and got[("tests.test_api.test_endpoint", "helper")] == ("UNRESOLVED", None)
    edges = resolve.code_references(rows, code.bindings(files)).where("status = 'RESOLVED'").select(F.col("target").alias("source"), F.col("owner").alias("target"))
    impact = {r.node for r in graph.bounded_bfs(edges, spark.createDataFrame([("pkg.repository.Repository.get",)], "node string"), 5).collect()}
    assert {"pkg.service.Service.run", "pkg.api.endpoint", "tests.test_api.test_endpoint"} <= impact
    assert resolve.code_references(code.parsed(files.limit(0)), code.bindings(files.limit(0))).count() == 0


def test_many_targets_of_a_name_are_left_open(spark):
    from evidex.operators import resolve
    from evidex.sources import code

    some = lambda n: spark.createDataFrame([("use.py", "def f(x):\n    x.go()\n"), *((f"m{i}.py", "class C:\n    def go(self):\n        pass\n") for i in range(n))], "path string, content string")
    for n, status in ((8, "POSSIBLE"), (9, "UNRESOLVED")):
        f = some(n)
        r = resolve.code_references(code.parsed(f), code.bindings(f)).where("name = 'x.go'").first()
        assert (r.status, r.n) == (status, n)
