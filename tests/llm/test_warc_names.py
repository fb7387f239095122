"""Names that records refer to, urls that headers can't hold, and payloads that repeat."""

from leafspark.llm import warc

PAGE = "page_id long, url string, html string, digest string, key string, n long, response long"


def test_revisits_name_their_response(spark):
    rows = [(1, "http://a/", "x" * 500), (2, None, "x" * 500), (3, "http://b/\r\nX: y", "x" * 500), (None, "", "x" * 500), (4, "u%0D", "small"), (5, "", "small"), (None, "v", "z" * 200), (None, "w", "z" * 200)]
    pages = spark.createDataFrame([(*r, "clash", "clash", 0, 0) for r in rows], PAGE)
    got = sorted(((r.page_id or -1, r.url, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=str)
    assert got == sorted([(1, "http://a/", "response", None), (2, None, "revisit", 1), (3, "http://b/\r\nX: y", "revisit", 1), (-1, "", "revisit", 1), (4, "u%0D", "response", None), (5, "", "response", None), (-1, "v", "response", None), (-1, "w", "response", None)], key=str)
    heads = [bytes(r.data).decode(errors="replace") for r in warc.write_archives(warc.plan_records(pages)).collect()]
    name = next(h for h in heads if "X-Page-ID: 1\r\n" in h).partition("WARC-Record-ID: ")[2].partition("\r\n")[0]
    assert sum(f"WARC-Refers-To: {name}\r\n" in h for h in heads) == 3
