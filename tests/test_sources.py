"""Files, tables, pages and transcripts to blocks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tidewell.sources import crawl, files, html, tabular, transcripts, workspace


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.txt").write_bytes("naïve".encode("latin-1"))
    rows = files.read_files(spark, str(tmp_path), "*.txt")
    got = {r["filename"]: r["t"] for r in rows.select("filename", files.decode_text(F.col("bytes")).alias("t")).collect()}
    assert got == {"a.txt": "naïve", "b.txt": "naïve"}


def _csv(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [r["content"] for r in tabular.csv_to_blocks(df, "text").orderBy("block_no").collect()]


def test_csv_groups_of_ten(spark):
    body = "Product,Price\n" + "".join(f"Item {i},{i}\n" for i in range(1, 16))
    first, second = _csv(spark, body)
    assert first.startswith("| Product | Price |\n| --- | --- |\n| Item 1 | 1 |")
    assert "Item 10 |" in first and "Item 11 |" not in first
    assert second.count("\n") == 6 and "| Item 15 | 15 |" in second


def test_csv_edges(spark):
    assert _csv(spark, "a,b") == ["| a | b |\n| --- | --- |"]
    assert _csv(spark, " , \nx,y") == []
    assert _csv(spark, "") == []
    assert _csv(spark, 'a,b\n"1, one",2,3\n4') == ["| a | b |\n| --- | --- |\n| 1, one | 2 |\n| 4 |  |"]


def test_sheet_rows(spark):
    rows = [("Inventory", i, f"Laptop {i}", None if i == 2 else i * 1.5) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "sheet string, no int, product string, price double")
    (block,) = tabular.rows_to_markdown(df, ["sheet"], "no", ["product", "price"], title="sheet").collect()
    lines = block["content"].split("\n")
    assert lines[:3] == ["Sheet: Inventory", "| product | price |", "| --- | --- |"]
    assert lines[4] == "| Laptop 2 |  |" and len(lines) == 8


def test_html_blocks():
    page = "<html><body><h1>T</h1><p>One <b>two</b></p><table><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert [(b["type"], b["content"]) for b in html.page_blocks(page)] == [
        ("text", "T"), ("text", "Onetwo"), ("table", "| A |  |\n| --- | --- |\n| 1 | 2 |"),
    ]


def test_html_rules():
    page = (
        "<header><p>gone</p></header><ul><li>a<ul><li>b</li></ul></li></ul><form><p>x</p></form>"
        "<p>left<p>inner</p><script>var p='<p>no</p>'</script><ol><li></li></ol>"
    )
    assert [b["content"] for b in html.page_blocks(page)] == ["- ab\n- b", "leftinner", "inner"]
    assert html.page_blocks("<div>a <!-- c --> b</div><nav>n</nav>")[0]["content"] == "a\n\nb"
    assert html.page_blocks("") == []


def test_every_page_block_is_in_its_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    blocks = html.html_to_blocks(pages)
    heads = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = blocks.select("page_id", "block_no", "content").collect()
    assert {r["page_id"] for r in rows} == set(heads)
    for r in rows:
        assert "track(" not in r["content"] and "&copy" not in r["content"]


def test_transcripts(spark):
    segments = [
        {"text": " hello there. ", "start": 10.0, "duration": 5.0},
        {"text": " ", "start": 14.0, "duration": 99.0},
        {"text": "More to come.", "start": 15.0, "duration": 4.0},
    ]
    df = spark.createDataFrame([("dir/youtube_abc.youtube", json.dumps(segments))], "f string, j string")
    df = df.select(
        transcripts.video_id_from_filename(F.col("f")).alias("video"),
        transcripts.segments_from_json(F.col("j")).alias("s"),
    )
    (block,) = transcripts.transcript_to_blocks(df, "s", "video").collect()
    assert block["content"] == "[00:10 - 00:19] hello there. More to come."
    assert block["media_path"] == "https://www.youtube.com/watch?v=abc&t=10s"
    assert block["metadata"]["video_id"] == "abc" and block["metadata"]["source"] == "youtube"


def test_transcript_limits(spark):
    segments = [{"text": "w " * 50, "start": i * 30.0, "duration": 30.0} for i in range(5)]
    segments.append({"text": "tail", "start": 3700.0, "duration": 1.0})
    df = spark.createDataFrame([("v", json.dumps(segments))], "v string, j string")
    df = df.select("v", transcripts.segments_from_json(F.col("j")).alias("s"))
    got = [r["content"][:21] for r in transcripts.transcript_to_blocks(df, "s", "v").orderBy("block_no").collect()]
    assert got[:2] == ["[00:00 - 01:00] w w w", "[01:00 - 02:00] w w w"]
    assert got[2].startswith("[02:00 - 01:01:41]")


def test_workspace_page(spark):
    blocks = [
        {"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "He"}, {"plain_text": "ad"}]}},
        {"type": "image", "image": {}},
        {"type": "bulleted_list_item", "bulleted_list_item": {"rich_text": [{"plain_text": "x"}]}},
        {"type": "paragraph", "paragraph": {"rich_text": []}},
    ]
    df = spark.createDataFrame([(json.dumps(blocks), None)], "b string, t string")
    row = workspace.page_blocks_to_text(df, "b", "t").first()
    assert row["content"] == "# Untitled Page\n\n\n## Head\n\n- x\n\n"
    assert row["filename"] == "Untitled Page.md"


def test_crawl(spark):
    def page(url, *links):
        return (url, "".join(f'<a href="{x}">l</a>' for x in links))

    pages = spark.createDataFrame(
        [
            page("http://h/a", "/b", "http://other/x", "c"), page("http://h/b", "/d", "/a"),
            page("http://h/d", "/e"), page("http://h/e", "/f"), page("http://h/c"),
        ],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("http://h/a",)], "url string")
    got = {(r["url"], r["depth"], r["fetched"]) for r in crawl.crawl_frontier(pages, seeds, 3).collect()}
    assert got == {
        ("http://h/a", 0, True), ("http://h/b", 1, True), ("http://h/c", 1, True), ("http://h/d", 2, True), ("http://h/e", 3, True),
    }


def test_batches_of_long_texts_are_bounded(spark):
    from tidewell.catalog.registry import QUERIES, query
    from tidewell.session import BATCH_BYTES

    @F.pandas_udf("long")
    def beside(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    def longest(spark, sf):
        pages = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 19).alias("html"))
        return pages.select(beside("html").alias("n"))

    try:
        query("_longest")(longest)
        most = QUERIES["_longest"](spark, "").agg(F.max("n")).first()[0]
    finally:
        QUERIES.pop("_longest", None)
    assert most <= 2 * BATCH_BYTES >> 19
