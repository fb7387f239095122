"""Extraction, URL filters and archives, and the pipeline."""

import hashlib
import re

import pytest

from leafspark.llm import extract, url_filter, warc

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(("page", "wanted"), [
    (None, ""), ("", ""), ("plain words only, but enough of them to be a paragraph of their own in any page at all", "plain words only, but enough of them to be a paragraph of their own in any page at all"),
    ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One &amp;\n two&nbsp;x<p>Three<br>four</article><footer>c</footer>", "T\n\nOne & two x\n\nThree four"),
    ("<article><p>a<script>if (x</p>) y</script>b</p><!-- <p>no</p> --><style>p{}</style><p>c</article>", "ab\n\nc"),
    ("<article><p>keep</p><div class='advert'><p>buy</p></div><aside>side</aside><form>mail <button>go</button></form><section id='comments'><p>nice</p></section></article>", "keep"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>a < b and 1<2", "a < b and 1<2"), ("<article><p title='a>b'>x</p>", "x"), ("<article></article>", ""),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Text</main>", "Text"), ("<article><ul><li>one<li>two</ul></article>", "one\n\ntwo"),
])
def test_extraction(page, wanted):
    assert extract.main_text(page)[0] == wanted


def test_extraction_of_tables(spark):
    rows = [(1, "u", None), (None, None, "<article><p>é</p></article>"), (1, "u", None)]
    got = extract.extract_pages(spark.createDataFrame(rows, PAGE + "")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("é", 1)]
    assert extract.extract_pages(spark.createDataFrame([], PAGE)).count() == 0


def test_the_tree_knows_its_table():
    import numpy as np

    rows = np.array([[float(v) for v in row.split()] for line in extract.LABELLED.strip().splitlines() for row in line.split("|")])
    assert (extract.decide(extract.default_tree(), rows[:, :-1]) == rows[:, -1]).all()


def test_long_page_is_linear():
    page = "<article>" + "<p>word word</p>" * 20_000 + "<div>" * 2000
    assert extract.main_text(page)[1] == 20_000


@pytest.mark.parametrize(("url", "host", "path"), [("http://A.Com/X?y", "a.com", "/X"), ("x", "", ""), (None, "", ""), ("http://h", "h", ""), ("http://h?q/z", "h", ""), ("http://h#f/z", "h", ""), ("s://u@H:80/a#b?c", "u@h:80", "/a"), ("://", "", "")])
def test_split(url, host, path):
    assert url_filter.split_url(url) == (host, path)


@pytest.mark.parametrize(("host", "path", "rule"), [("a.com", "/en/1", "com/en/"), ("example.com", "/en/7x", "example.com/en/7"), ("w.example.com", "/en/8", "com/en/"), ("notexample.com", "/en/7", "com/en/"), ("example.net", "/de/8", "example.net/de/8"), ("b.net", "/de/8", "net/de/"), ("xnet", "/de/8", None), ("org", "/es/", "org/es/"), ("a.org", "/es", None), ("", "", None)])
def test_rules(host, path, rule):
    found = url_filter.Rules(url_filter.RULES).find(host, path)
    assert (found and found[0]) == rule


def test_longest_rule_wins_against_brute_force():
    rules = tuple((f"{h}{p}", "allow") for h in ("com", "b.com", "a.b.com") for p in ("/", "/x", "/x/y"))
    table = url_filter.Rules(rules)
    for host in ("com", "b.com", "a.b.com", "z.a.b.com", "ab.com"):
        for path in ("", "/", "/x", "/x/y/z", "/q"):
            fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
            found = table.find(host, path)
            assert (found and found[0]) == max(fits, key=len, default=None)


def test_model_separates_unseen_hosts(spark):
    m = url_filter.default_model()
    bad = ["http://best-casino-deals.example.net/a", "http://www.pills-cheap.example.org/fr/12", "https://m.win-poker.com/en/5.html"]
    good = ["https://www.ththen.example.com/en/8761", "http://blog.tionsh.example.com/es/892?page=2&ref=x", "https://garden-notes.org/a/b"]
    assert (m.block_probability(bad) > 0.5).all() and (m.block_probability(good) < 0.5).all()
    rows = [(1, None, ""), (2, "http://x.com/en/1", None)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGE)).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and got[2].verdict == "block"


@pytest.mark.parametrize("chunk", [7, 1000])
def test_archives(spark, chunk):
    same, small = "same payload, é " * 20, "tiny"
    rows = [(3, "http://a/3", same), (1, "http://a/1", same), (2, "u\r\nX: y", same), (4, None, small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (None, "u", same), (1, "again", same), (9, "u", "z" * 3000)]
    got = warc.archive_pages(spark.createDataFrame(rows, PAGE).repartition(3), chunk).collect()
    wanted = []
    for p, _, h in rows:
        b = (h or "").encode()
        refers = 1 if h == same and p != 1 else None
        wanted.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert warc.archive_pages(spark.createDataFrame([], PAGE)).count() == 0


def test_archive_is_a_warc_file_and_damage_is_seen(spark, tmp_path):
    chunks = warc.write_archives(warc.plan_records(spark.createDataFrame([(1, "http://a/", "x" * 500)], PAGE)), 100).cache()
    assert chunks.count() == 5 and {len(r.data) <= 600 for r in chunks.collect()} == {True}
    warc.export_archive(chunks, chunks.first().archive, str(tmp_path / "a.warc"))
    data = (tmp_path / "a.warc").read_bytes()
    head, _, rest = data.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n" and rest[:size].endswith(b"x" * 500)
    with pytest.raises(Exception, match="chunk"):
        warc.read_archives(chunks.where("chunk <> 2")).collect()


def test_pipeline_drops_and_keeps(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    passage = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    planted = [(90001, word(1)), (90002, word(1)), (90003, word(1).replace("w1x30 ", "")), (90004, word(2)), (90005, word(3) + " " + passage), (90006, None), (90007, ""), (90004, word(2))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = base.unionByName(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in planted], schema))
    folder = f"{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(f(spark, read, folder).columns == read.columns for _, f in corpus_pipeline.STAGES[:-1])
    kept = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id > 90000]
    assert sorted(kept) == [90001, 90004, 90006, 90007]
