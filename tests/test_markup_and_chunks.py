"""Page structure and chunkers on literal texts."""

from pyspark.sql import functions as F

from corpuslab.functions import chunks, markup, text
from corpuslab.operators import chunk, parse

PAGE = """<html><head><title>T &amp; U</title><script>var a='<p>no</p>'</script></head><body><nav><p>menu</p></nav>
<article><h1>Top</h1><p>First <b>bold</b><br>line.</p><h2>Sub</h2><p>lost<p>kept</p><pre class="language-py">x = 1
</pre><table><tr><th>A</th><th>B|C</th></tr><tr><td>1</td></tr></table><h2>Other</h2><p>end</p></article><footer><p>foot</p></footer></body></html>"""


def test_html_structure():
    built = markup.structure(markup.html_items(PAGE))
    assert [s["path"] for s in built["sections"]] == [["Top"], ["Top", "Sub"], ["Top", "Other"]]
    assert built["sections"][0]["text"] == "First bold line."
    assert built["code_blocks"] == [{"heading": "Sub", "lang": "py", "code": "x = 1"}]
    assert built["tables"][0]["markdown"].split("\n") == ["| A | B\\|C |  |", "| --- | --- | --- |", "| 1 |  |  |"]
    assert "lost" not in built["text"] and "kept" in built["text"] and "menu" not in built["text"] and "foot" not in built["text"]
    assert "[代码示例 py]" in built["text"] and "x = 1" in markup.structure(markup.html_items(PAGE), True)["text"]


def test_main_region():
    assert markup.main_region('<div class="x"><p>a<p>b</div><div class="icms-help-docs-content z">in <div>deep</div> side</div>') == "in <div>deep</div> side"
    assert markup.main_region("<main><p>1</p></main>") == "<main><p>1</p></main>"
    assert markup.main_region("<b/><div><p>1<p>2</div><div id=2><p>1<p>2<p>3</div>").startswith("<div id=2>")


def test_escapes_are_undone_in_order(spark):
    cases = {'a \\"b\\" \\n\\/': 'a "b" \n/', "a\\/b": "a\\/b", "\\\\n": "\\\n", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "page string")
    assert [r["x"] for r in df.select(text.unescaped(F.col("page")).alias("x")).collect()] == list(cases.values())


def test_headings_take_the_text_behind_them():
    kinds = lambda page: [(i["type"], i.get("text")) for i in markup.html_items(page)]
    assert kinds("<p>a<h2>b</h2>c</p>d") == [("p", "a"), ("h", "b"), ("p", "c")]
    assert kinds("<h1>lost<h2>b</h2><h3>open<p>x") == [("h", "b"), ("h", "openx")]
    assert kinds("<ul><li>no</li></ul><p>a<li>b<br>c") == [("p", "a b c")]
    assert kinds("<nav><div><p>n</div></nav><script>'<p>s'</script><p>y</p>") == [("p", "y")]


def test_markdown_edges():
    assert markup.markdown_items("```\nnever closed\n\nx") == [{"type": "code", "lang": "", "code": "never closed\n\nx"}]
    assert [i["text"] for i in markup.markdown_items("  # not one\n#\n#no\n| pipe\n> gone\n")] == ["# not one", "#", "#no", "| pipe"]
    assert markup.table_markdown([["a"], ["b|", "c"]]) == "| a |  |\n| --- | --- |\n| b\\| | c |" and markup.table_markdown([]) == ""


def test_short_pieces_and_touching_atoms():
    assert chunks.short_joined(["a" * 90, "b" * 10, "c" * 30, "d" * 10], 100) == ["a" * 90 + "b" * 10, "c" * 30 + "d" * 10]
    assert chunks.short_joined(["a" * 125, "b" * 10], 100) == ["a" * 125, "b" * 10]
    text = "x\n| a |\n```\ncode\n```\ny known block of code here z"
    assert [text[a:b] for a, b in chunks.atoms(text, ["known block of code here", "short"])] == ["| a |\n```\ncode\n```", "known block of code here"]


def test_markdown_structure():
    page = "# Title\n> quote\nlead\n\n## Part\n| a | b |\n|---|---|\n| 1 | 2 |\n```python\ncode\n\nmore\n```\n[x](#x) [y](#y)\ntail"
    items = markup.markdown_items(page)
    assert [i["type"] for i in items] == ["h", "p", "h", "table", "code", "p"]
    assert items[3]["rows"] == [["a", "b"], ["1", "2"]] and items[4]["code"] == "code\n\nmore" and items[5]["text"] == "tail"


def test_heading_levels_are_remembered_by_text():
    items = [{"type": "h", "level": 1, "text": "A"}, {"type": "h", "level": 2, "text": "B"}, {"type": "p", "text": "x"}, {"type": "h", "level": 2, "text": "C"}, {"type": "p", "text": "y"}]
    assert [s["path"] for s in markup.structure(items)["sections"]] == [["A", "B"], ["A", "C"]]


def test_parse_gate(spark):
    long = "<article><h1>H</h1>" + "<p>" + "word " * 100 + "</p><p>b</p></article>"
    code = "<article><p>a</p><p>b</p><pre>" + "x = 1\n" * 100 + "</pre></article>"
    rows = [("d1", "s", "http://h/one", long, "html", None), ("d2", "s", "http://h/two", code, "html", None), ("d3", "s", "http://h/three", "<p>short</p>", "html", None), ("d4", "s", "u", None, "html", None), ("d5", "s", "u", long, "html", "fetch failed"), ("d6", "s", "http://h/six", "# M\n" + "word " * 100, "markdown", None)]
    df = spark.createDataFrame(rows, "doc_id string, source string, url string, body string, kind string, reason string")
    got = {r["doc_id"]: r for r in parse.parse(df).collect()}
    assert got["d1"]["doc_type"] == "tutorial" and got["d1"]["title"] == "H" and got["d1"]["n_tokens_est"] == 131
    assert got["d2"]["doc_type"] == "reference" and got["d2"]["title"] == "two" and "x = 1" in got["d2"]["text"]
    assert got["d3"]["reason"].startswith("too short") and got["d4"]["reason"] == "file missing" and got["d5"]["reason"] == "fetch failed"
    assert got["d6"]["title"] == "M"


def test_urls(spark):
    assert spark.createDataFrame([("http://h/a b/é?q=1 2",)], "u string").select(parse.encoded_path(F.col("u"))).first()[0] == "http://h/a%20b/%C3%A9?q=1 2"
    index = spark.createDataFrame([("s", "x (https://h/a.md) y (https://h/b#c) (https://h/b)")], "source string, text string")
    got = parse.normalise_urls(parse.discover(index, "llms"), drop_md=True).orderBy("pos").collect()
    assert [r["url"] for r in got] == ["https://h/a", "https://h/b"] and all(len(r["doc_id"]) == 12 for r in got)


def test_fixed_and_recursive():
    assert [len(c) for c in chunks.fixed("x" * 1200, 500, 50)] == [500, 500, 300]
    text = "para one. " * 30 + "\n\n" + "para two. " * 80
    cut = chunks.recursive(text, 500, 50)
    assert "".join(cut) == text and max(map(len, cut)) <= 650
    assert chunks.recursive("   ", 500, 50) == [] and chunks.recursive("x" * 1100, 500, 0) == ["x" * 500, "x" * 500, "x" * 100]


def test_atomic():
    rows = "\n".join(f"| {i} | value {i} |" for i in range(60))
    table = "| a | b |\n|---|---|\n" + rows
    cut = chunks.atomic("intro text\n\n" + table + "\n\noutro", [], 500, 50)
    assert sum(c.startswith("| a | b |\n|---|---|") or "\n| a | b |\n|---|---|" in c for c in cut) >= 2
    code = "```\n" + "line\n" * 200 + "```"
    assert any(code in c for c in chunks.atomic("before\n" + code + "\nafter", [], 300, 30))
    known = "def f():\n    return 1234567890"
    assert any(known in c for c in chunks.atomic("a " * 240 + known + " b" * 240, [known], 500, 50))


def test_structural_and_strategies(spark):
    docs = spark.createDataFrame([("d", "x " * 400, [("h", ["h"], "short section"), ("g", ["g"], "y " * 400), ("e", ["e"], " ")], [("g", "", "z" * 30)], "reference")], "doc_id string, text string, sections array<struct<heading:string,path:array<string>,text:string>>, code_blocks array<struct<heading:string,lang:string,code:string>>, doc_type string")
    sizes = {s: len(chunk.chunk(docs, s).first()["pieces"]) for s in chunk.STRATEGIES}
    assert sizes["fixed"] == 2 and sizes["structural"] == 3
    about = chunk.audit(chunk.chunk(docs, "structural"), "structural").first()
    assert about["n_chunks"] == 3 and about["code_n"] == 1 and about["code_broken"] == 1.0 and about["cross_rate"] == 0.0
    built = {r["chunk_id"]: r for r in chunk.build(chunk.chunk(docs, "structural")).collect()}
    assert built["d-0000"]["section_path"] == ["h"] and set(built) == {"d-0000", "d-0001", "d-0002"}


def test_parents_and_table_flags(spark):
    docs = spark.createDataFrame([("d", ["a" * 2000, "  ", "tail"])], "doc_id string, pieces array<string>")
    rows = {r["chunk_id"]: r for r in chunk.build(docs).collect()}
    assert set(rows) == {"d-0000", "d-0000-c00", "d-0000-c01", "d-0000-c02", "d-0002"}
    assert rows["d-0000"]["role"] == "parent" and not rows["d-0000"]["vectorize"] and rows["d-0000-c01"]["parent_id"] == "d-0000" and rows["d-0002"]["role"] == "normal"
    cases = [("| a |\n|---|\n| 1 |", True, False), ("x\n| a |\n\n|---|", True, False), ("| a |\n| 1 |", True, True), ("none", False, False)]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "p string")
    assert [tuple(r) for r in df.select(chunk.has_table(F.col("p")), chunk.broken_table(F.col("p"))).collect()] == [(h, b) for _, h, b in cases]


def test_batches_are_worked_on_in_stretches(spark, monkeypatch):
    from corpuslab.operators import matching

    assert list(matching.stretches(10 << 20, 5)) == [(0, 2), (2, 4), (4, 5)] and list(matching.stretches(0, 0)) == []
    texts = [None, "", *("para one. " * n + "\n\n" + "word " * n for n in (1, 40, 300))]
    docs = spark.createDataFrame([(i, t, [] if t is None else [(t,), (None,)]) for i, t in enumerate(texts)], "doc_id long, text string, sections array<struct<text:string>>").repartition(1)
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("s").alias("source"), F.lit("u/x").alias("url"), F.concat(F.lit("<h1>t</h1><p>"), "text").alias("body"), F.lit("html").alias("kind"))
    run = lambda: [[tuple(r) for r in d.orderBy("doc_id").collect()] for d in (parse.parse(pages), *(chunk.chunk(docs, s, 200).select("doc_id", "pieces") for s in ("recursive", "structural", "atomic")))]
    whole = run()
    assert len(whole[1][4][1]) > 3
    monkeypatch.setattr(matching, "STRETCH_BYTES", 1)  # a row at a time
    assert run() == whole
