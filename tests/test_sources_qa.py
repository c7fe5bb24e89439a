"""Sources, pages, question answering, streaming, the entry and the oracles."""

from __future__ import annotations

import random
import subprocess
import sys
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quizspark.functions import lexicon as L
from quizspark.operators import qa, search
from quizspark.plans.oracles import ORACLES
from quizspark.plans.pipeline import QuizPipeline
from quizspark.plans.queries import QUERIES
from quizspark.sources import documents, web
from quizspark.streaming.documents import stream_items, stream_questions


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"x"), ("b.bin", b"%PDF-1.7"), ("c.PPTX", b"x"), ("d.dat", b"PK\x03\x04"), ("e.txt", b"caf\xc3\xa9 \xff http://x.y end"), ("f.txt", b" ")):
        (tmp_path / name).write_bytes(data)
    got = {Path(r.path).name: (r.kind, r.text, r.status) for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == got["b.bin"] == ("pdf", None, "needs a provider")
    assert got["c.PPTX"][0] == got["d.dat"][0] == "pptx"
    assert got["e.txt"] == ("text", "café end", "ok") and got["f.txt"] == ("text", "", "Empty text")
    assert got["c.PPTX"][2] == got["d.dat"][2] == "no text"

    def pages():
        return lambda data: [([("world", 50.0, 11.0), ("hello", 10.0, 9.0)], "unused"), ([], "plain page")]

    read = {Path(r.path).name: (r.text, r.status) for r in documents.read_files(spark, str(tmp_path), pages).collect()}
    assert read["a.pdf"] == read["b.bin"] == ("hello world\n\nplain page", "ok") and read["e.txt"] == ("café end", "ok")


def presentation(path, slides, layout):
    """slides: lists of (placeholder index or None, top or None, paragraphs); layout: index -> top. The second slide's file comes first."""
    names = "xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main' xmlns:p='http://schemas.openxmlformats.org/presentationml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
    rel = lambda *r: "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/{k}' Target='{t}'/>" for i, k, t in r) + "</Relationships>"

    def sp(index, top, paragraphs):
        ph = "" if index is None else f"<p:ph idx='{index}'/>" if index else "<p:ph type='title'/>"
        off = "" if top is None else f"<a:xfrm><a:off x='0' y='{top}'/></a:xfrm>"
        body = "".join("<a:p>" + "".join(f"<a:r><a:t>{run}</a:t></a:r>" for run in p.split("+")) + "</a:p>" for p in paragraphs)
        return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{off}</p:spPr><p:txBody>{body}</p:txBody></p:sp>"

    tree = lambda tag, shapes: f"<p:{tag} {names}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:{tag}>"
    order = [2, 1, *range(3, len(slides) + 1)][: len(slides)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:presentation {names}><p:sldIdLst>" + "".join(f"<p:sldId id='{256 + n}' r:id='r{n}'/>" for n in order) + "</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", rel(*((f"r{n}", "slide", f"slides/slide{n}.xml") for n in order)))
        z.writestr("ppt/slideLayouts/l.xml", tree("sldLayout", [sp(i, t, []) for i, t in layout.items()]))
        for n, shapes in zip(order, slides, strict=True):
            z.writestr(f"ppt/slides/slide{n}.xml", tree("sld", [sp(*s) for s in shapes]))
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", rel(("x", "slideLayout", "../slideLayouts/l.xml")))


def test_presentations(spark, tmp_path):
    first = [(None, 300, ["low  line", " ", "next"]), (1, None, ["from+ the layout"]), (0, 5, ["Ti+tle"])]
    presentation(tmp_path / "a.pptx", [first, [(None, None, ["alone &amp; last"])], [(2, 1, [" "])]], {0: 1, 1: 100})
    (tmp_path / "b.pptx").write_bytes(b"PK\x03\x04 broken")
    got = {Path(r.path).name: (r.text, r.status) for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got["a.pptx"] == ("[Slide 1: Title]\nfrom the layout\nlow line\nnext\n\nalone & last", "ok") and got["b.pptx"] == (None, "no text")


def test_pdf_words_and_slides(spark):
    words = spark.createDataFrame([(1, 1, "world", 50.0, 11.0), (1, 1, "hello", 10.0, 9.0), (1, 1, "below", 0.0, 40.0), (1, 2, "next", 0.0, 0.0), (1, 3, " ", 0.0, 0.0)], "doc_id long, page int, text string, x0 double, top double")
    assert documents.from_pdf_words(words).first().text == "hello world below\n\nnext"
    shapes = spark.createDataFrame([(1, 1, 50, False, ["low"]), (1, 1, 10, False, ["high", " ", "er"]), (1, 1, 99, True, ["Title"]), (1, 2, None, False, [" "])], "doc_id long, slide int, top int, is_title boolean, paragraphs array<string>")
    assert documents.from_slides(shapes).first().text == "[Slide 1: Title]\nhigh\ner\nlow"


def test_pages(spark):
    long = "w" * 70
    html = f"<p>{long}<p>short<nav><p>{long}n</p></nav><p>a &amp; {long}<b> x</b></p><script>p</script><div>{long}d</div>"
    pages = spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://netflix.com/", html), (3, "nothing", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in web.page_text(pages).collect()}
    assert got == {1: f"{long} a & {long} x", 2: "", 3: ""}


def test_qa(spark):
    docs = spark.createDataFrame([(1, "The harbour was built in stone long ago. The fox jumps over the dog today. Tiny one."), (2, "short"), (3, " ")], "doc_id long, text string")
    questions = spark.createDataFrame([(10, 1, "When was the harbour built?"), (11, 2, "What is it?"), (12, 3, "Nothing there?")], "q_id long, doc_id long, question string")
    pages = spark.createDataFrame([(1, "u1", "The harbour of the town was built of stone by the king of the north."), (2, "u2", "")], "page_id long, url string, text string")
    got = {r.q_id: r for r in qa.answer(questions, docs).collect()}
    assert got[10].answer == "The harbour was built in stone long ago." and got[12].answer == L.NOTHING_FOUND and got[11].answer == L.NO_ANSWER
    web_too = {r.q_id: r for r in qa.answer(questions, docs, pages).collect()}
    assert web_too[10].used_web and web_too[10].sources == ["u1"] and not web_too[12].used_web
    assert qa.answer(questions.limit(0), docs, pages).count() == 0

    def reader():
        return lambda rows: [("in stone", 0.91234) if "harbour" in q else (" maybe ", 0.0312) for q, _ in rows]

    read = {r.q_id: r for r in qa.answer(questions, docs, pages, reader).collect()}
    assert (read[10].answer, read[10].score) == ("in stone", 0.9123)
    assert read[11].answer == "maybe\n\n*(Low confidence — 3%. The answer may not be clear from available context.)*" and read[11].score == 0.0312
    assert read[12].answer == L.NOTHING_FOUND and read[12].score == 0.0

    def broken():
        raise OSError("no model")

    fallen = {r.q_id: r for r in qa.answer(questions, docs, reader=broken).collect()}
    assert fallen[10].answer == "The harbour was built in stone long ago." and fallen[10].score == 0.0


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_questions(stream).writeStream.format("memory").queryName("asked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = stream_questions(spark.read.parquet(str(tmp_path / "in")))
    assert spark.table("asked").count() == batch.count() > 0
    stream_items(stream, str(tmp_path / "out"), str(tmp_path / "cp"), QuizPipeline(max_questions=2)).awaitTermination(120)
    assert (tmp_path / "out").exists()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ours = QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = con.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == columns
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    want = sorted(repr(tuple(clean(r[names.index(c)]) for c in columns)) for r in theirs.fetchall())
    assert sorted(repr(tuple(clean(r[c]) for c in columns)) for r in ours.collect()) == want


def test_entry_without_the_training_data_operators(tmp_path):
    """A copy without those folders imports and keeps the other queries."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root", "PYTHONPATH": str(tmp_path / "r")})


def test_best_pages_equal_brute_force(spark):
    """Blocks, ties, frequent and rare terms, repeated ids and pages without an id; no row per shared term is made."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    draw = lambda n: sorted({words[min(399, int(rng.paretovariate(0.6)) - 1)] for _ in range(n)})
    pages = [(rng.choice((None, 7, 8)) if k % 100 == 0 else k, draw(rng.randrange(60))) for k in range(700)]
    questions = [(k, draw(rng.randrange(30))) for k in range(150)] + [(1000, ["none"]), (1001, [])]
    for rows in (pages, [p for p in pages if p[0] not in (None, 7, 8)]):
        held: dict = {}
        for p, terms in rows:
            held.setdefault(p, Counter()).update(terms)
        first = lambda p: (p is not None, p or 0)
        counted = {q: sorted(((-n, first(p), p) for p, c in held.items() if (n := sum(c[t] for t in terms))), key=lambda x: x[:2])[:4] for q, terms in questions}
        asked, read = spark.createDataFrame(questions, "q_id long, terms array<string>"), spark.createDataFrame(rows, "page_id long, terms array<string>")
        for blocks in ((32768, 16384), (40, 90)):
            found: dict = {}
            for r in search.best_pages(asked, read, 4, *blocks).collect():
                found.setdefault(r.q_id, []).append((-r.shared, first(r.page_id), r.page_id))
            assert {q: sorted(x, key=lambda x: x[:2])[:4] for q, x in found.items()} == {q: x for q, x in counted.items() if x}
    nothing = search.best_pages(asked, read.limit(0), 4)
    assert nothing.count() == 0 and search.best_pages(asked.limit(0), read, 4).count() == 0


def test_a_term_in_all_questions_and_pages(spark):
    """Shared terms by the million: the join on terms made a row for each."""
    n = 3000
    questions = spark.range(n).selectExpr("id q_id", "concat('common often usual term', id % 7) question")
    pages = spark.range(n).selectExpr("id page_id", "'u' url", "concat('common often usual term', id % 7) text")
    found = qa.page_hits(questions, pages)
    assert "SortMergeJoin [term" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [term" not in plan
    got = {(r.q_id, r.hit): (r.page_id, r.relevance) for r in found.where("q_id in (3, 2999)").collect()}
    assert got == {(q, k + 1): (q % 7 + 7 * k, 1.0) for q in (3, 2999) for k in range(4)}


def test_blocks_meet_without_a_shuffle_and_contexts_are_cut_before_they_move(spark):
    """Blocks are read from the shared folder, not sent to each other; a hit's text is needed only as far as the better ones leave room."""
    sizes = (4990, 30, 6000, 40, 0)
    texts = [("term " + "x" * n)[: max(n, 4)] for n in sizes]
    pages = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)] + [(9, "u", None)], "page_id long, url string, text string")
    questions = spark.createDataFrame([(1, "term"), (2, "none")], "q_id long, question string")
    asked, words = (df.selectExpr(f"{k}", f"split({t}, ' ') terms") for df, k, t in ((questions, "q_id", "question"), (pages, "page_id", "text")))
    assert "Exchange" not in search.best_pages(asked, words, 4)._jdf.queryExecution().executedPlan().toString()
    for some in (pages, pages.where("page_id > 0"), pages.where("page_id > 1")):
        found = qa.page_hits(questions, some)
        kept = [t for (t,) in some.where("text is not null").orderBy("page_id").select("text").collect()][:3]
        assert [r.before for r in found.orderBy("hit").collect()][:3] == [sum(map(len, kept[:k])) for k in range(len(kept))]
        assert [(r.q_id, r.web) for r in qa.web_context(found).collect()] == [(1, "\n\n".join(kept)[:5000])]
        short = qa.page_hits(questions, some, characters=qa.WEB_CHARACTERS)
        assert qa.web_context(short).collect() == qa.web_context(found).collect()
        assert short.select("hit", "before").collect() == found.select("hit", "before").collect() and short.where("length(text) > 5000").count() == 0


def test_frequent_terms_are_counted_by_flags(spark):
    """A bit a page and term; repeated ids and repeated terms add up; whole blocks of ties; the old counts took a byte a page and term."""
    rng = random.Random(6)
    n, n_words = 1500, 60
    for each in (1, 2, 5):
        lists = [sorted(k for k in {rng.randrange(n // each) for _ in range(rng.choice((3, 40, n)))} for _ in range(rng.randint(1, each))) for _ in range(n_words)]
        lists[0] = sorted(list(range(n // each)) * each)
        held = np.array([len(x) for x in lists], np.int32)
        places = zlib.compress(held.tobytes() + np.diff(np.concatenate(lists), prepend=0).astype(np.int32).tobytes())
        block = search.Block(n // each, n_words, places, np.arange(n_words))
        assert block.flags.nbytes <= (n_words * each + 1) * (n // each + 63) // 8
        questions = [[0], [], *([rng.randrange(n_words) for _ in range(rng.randrange(40))] for _ in range(150))]
        got: dict = {}
        for q, at, c in block.best(np.concatenate(questions).astype(np.int64), np.array([len(q) for q in questions]), 4):
            for k, x in zip(q.tolist(), zip(at.tolist(), c.tolist())):
                got.setdefault(k, []).append(x)
        for k, q in enumerate(questions):
            counts = Counter(x for w in q for x in lists[w])
            assert got.get(k, []) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
