"""Source text to symbols, calls and imports: whole small files, and a file with most of the rows."""

from __future__ import annotations

import hashlib

from provenant.sources import parsing as P

JS = """import { a } from "x";
// class Hidden {
/* function no() {
   } */
export default class Shop extends Base {
  async buy(x) { // {
    const s = "}{ g(" + '}';
    if (x) { this.cart.add(x, k()); }
  }
  get total() {
    return sum(this.items);
  }
}
const f = async (a) => {
  app.get("/x", f);
};
function tail() { return 1; }
"""
PY = '''import os
from a import b

class A(Base):
    """ doc {
    def no():
    """
    x = call_at_class()

    def m(self):
        # comment(
        return os.path.join("a(", b())

    async def n(self): pass

def top():
    def inner():
        go()
    return inner
'''
RB = "require 'x'\nclass K\n  def run\n    foo.bar(1)\n  end\nend\n"
GO = "package m\nfunc (s *T) Run(a int) error {\n\treturn s.do(a)\n}\ntype T struct {\n}\n"


def test_parse(spark):
    files = spark.createDataFrame([("a/x.js", JS), ("b.py", PY), ("c.rb", RB), ("e.go", GO), ("d.sql", "select 1;\nselect 2;\n"), ("none.js", None), ("plain", "")], "path string, content string")
    found = P.parse(files)
    symbols = sorted((r["path"], r["line"], r["end_line"], r["qualified"], r["kind"]) for r in found.symbols.collect())
    assert symbols == sorted([
        ("a/x.js", 5, 13, "Shop", "class"), ("a/x.js", 6, 9, "Shop.buy", "method"), ("a/x.js", 10, 12, "Shop.total", "method"), ("a/x.js", 14, 16, "f", "function"), ("a/x.js", 17, 17, "tail", "function"),
        ("b.py", 4, 14, "A", "class"), ("b.py", 10, 12, "A.m", "function"), ("b.py", 14, 14, "A.n", "function"), ("b.py", 16, 19, "top", "function"), ("b.py", 17, 18, "top.inner", "function"),
        ("c.rb", 2, 6, "K", "class"), ("c.rb", 3, 5, "K.run", "function"), ("e.go", 2, 4, "Run", "function"), ("e.go", 5, 6, "T", "type"), ("d.sql", 1, 2, "d.sql", "file"), ("plain", 1, 1, "plain", "file")])
    rows = {r["qualified"]: r for r in found.symbols.collect()}
    assert rows["A.m"]["content_hash"] == hashlib.sha256("\n".join(PY.split("\n")[9:12]).encode()).hexdigest()
    assert (rows["Shop.buy"]["signature"], rows["A.n"]["signature"], rows["Run"]["signature"]) == ("async buy(x)", "async def n(self)", "func (s *T) Run(a int) error")
    calls = sorted((r["path"], r["line"], r["caller"], r["callee"]) for r in found.calls.collect())
    assert calls == sorted([
        ("a/x.js", 8, "Shop.buy", "this.cart.add"), ("a/x.js", 8, "Shop.buy", "k"), ("a/x.js", 11, "Shop.total", "sum"), ("a/x.js", 15, "f", "app.get"), ("b.py", 8, "A", "call_at_class"), ("b.py", 12, "A.m", "os.path.join"),
        ("b.py", 12, "A.m", "b"), ("b.py", 18, "top.inner", "go"), ("c.rb", 4, "K.run", "foo.bar"), ("e.go", 3, "Run", "s.do")])
    assert sorted((r["path"], r["text"]) for r in found.imports.collect()) == [("a/x.js", 'import { a } from "x";'), ("b.py", "from a import b"), ("b.py", "import os"), ("c.rb", "require 'x'")]
    assert [tuple(r) for r in found.routes.select("path", "line_no", "route").collect()] == [("a/x.js", 15, "GET /x")]
    assert {r["target"] for r in found.references.where("path = 'b.py' AND source = 'A.m'").collect()} == {"os", "path", "join", "b"}
    assert P.parse(files, 2).references.where("path = 'b.py'").count() == 2


def test_a_file_with_most_rows(spark):
    body = "".join(f"  m{i}(a) {{\n    other.m{i + 1}(a);\n  }}\n" for i in range(4000))
    files = spark.createDataFrame([("big.js", "class Big {\n" + body + "}\n"), ("small.js", "function s() {\n}\n")], "path string, content string")
    found = P.parse(files)
    got = {r["qualified"]: (r["line"], r["end_line"]) for r in found.symbols.collect()}
    assert len(got) == 4002 and got["Big"] == (1, 12_002) and all(got[f"Big.m{i}"] == (2 + 3 * i, 4 + 3 * i) for i in range(4000))
    assert sorted((r["caller"], r["callee"]) for r in found.calls.collect()) == sorted((f"Big.m{i}", f"other.m{i + 1}") for i in range(4000))


def test_files_are_parsed_where_they_lie(spark):
    """No line is shuffled, sorted or joined; line ends of other systems, unknown languages and missing paths are read as Spark's functions do."""
    files = spark.createDataFrame([
        ("w.py", "class K:\r\n    def m(self):  # x(\r\n        return f(1)\r\n"), ("v.JS", "function f(a) {\u2028  g(a); // h(\u0085}\n} k(`(`)\n"), (None, "q(1)\n\n"), ("x.py", None), ("y.py", "x = \"\"\" a(\nb( \"\"\" + c('(')\nd(\n")],
        "path string, content string")
    found = P.parse(files)
    assert sorted((r["path"], r["line"], r["caller"], r["callee"]) for r in found.calls.collect()) == [
        ("v.JS", 1, "f", "g"), ("v.JS", 1, "f", "h"), ("v.JS", 2, "v.JS", "k"), ("w.py", 3, "K.m", "f"), ("y.py", 2, "y.py", "c"), ("y.py", 3, "y.py", "d")]
    assert sorted((str(r["path"]), r["qualified"], r["kind"], r["line"], r["end_line"]) for r in found.symbols.collect()) == [
        ("None", None, "file", 1, 2), ("v.JS", "f", "function", 1, 1), ("w.py", "K", "class", 1, 3), ("w.py", "K.m", "function", 2, 3)]
    for df in (found.symbols, found.calls, found.references, found.imports, found.routes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Exchange", "Sort", "Join"))
    only = P.parse(files, wanted=["calls"])
    assert only.calls.count() == 6 and only.symbols.isEmpty() and only.references.isEmpty()
