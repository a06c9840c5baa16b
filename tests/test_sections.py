from loamworks.operators import sections

TABLE = "doc_id string, page long, page_height double, title string, kind string, headers array<string>, rows array<array<string>>, n_cols int, bbox struct<x0: double, y0: double, x1: double, y1: double>"
BODY = "doc_id string, page long, reading_order int, role string, text string, n_lines int, y0 double"


def grid(page, y0, y1, n=3, title="", headers=None):
    headers = headers or [f"h{i}" for i in range(n)]
    return ("d", page, 792.0, title, "grid", headers, [[f"p{page}"] * n], n, (72.0, float(y0), 540.0, float(y1)))


def stitched(spark, *rows):
    return sorted((r.page, list(r.source_pages), len(r.rows)) for r in sections.stitch_tables(spark.createDataFrame(rows, TABLE)).collect())


def test_stitching(spark):
    assert stitched(spark, grid(5, 600, 740), grid(6, 80, 740, headers=["1", "2", "3"])) == [(5, [5, 6], 3)]
    assert stitched(spark, grid(5, 600, 740), grid(6, 80, 740)) == [(5, [5, 6], 2)]
    assert stitched(spark, grid(5, 600, 740), grid(6, 80, 300), grid(7, 80, 740)) == [(5, [5, 6], 2), (7, [7], 1)]
    assert len(stitched(spark, grid(5, 600, 740, 2), grid(6, 80, 740, 3))) == 2
    assert len(stitched(spark, grid(5, 600, 740), grid(6, 80, 740, title="Table 2"))) == 2


def blocks(spark, *texts, page=2):
    return spark.createDataFrame([("d", page, i, "paragraph", t, 1, 100.0 + i) for i, t in enumerate(texts)], BODY)


def test_headings_by_shape(spark):
    body = sections.body_blocks(blocks(spark, "1.4.2 Linearity", "6920.93 Intercept", "281.39 CAS Number", "1.5 Conclusions", "1.6 lower", "1.5 Again"))
    assert [r.num for r in sections.geometry_headings(body).orderBy("block_idx").collect()] == ["1.4.2", "1.5"]
    body = sections.body_blocks(blocks(spark, "1. Purpose", "2. Scope", "3.1. Procedure Detail"))
    assert [r.num for r in sections.geometry_headings(body).orderBy("block_idx").collect()] == ["1", "2", "3.1"]


def test_contents_split_and_owner(spark):
    body = sections.body_blocks(blocks(spark, "x" * 201, "1 Purpose", "said", "2 Scope", "more"))
    toc = spark.createDataFrame([("d", "1 Purpose", 2, 0), ("d", "2 Scope", 1, 1), ("d", "Tables", 2, 2)], "doc_id string, title string, page long, toc_ord int")
    heads = sections.headings(toc, body)
    out = sections.split(body, heads).orderBy("section_ord").collect()
    assert [r.heading for r in out] == ["Main Content", "1 Purpose", "2 Scope"] and out[1].text == "1 Purpose\nsaid"
    items = spark.createDataFrame([("d", 2, 50.0, "t0"), ("d", 2, 102.0, "t1"), ("d", 3, 0.0, "t2")], "doc_id string, page long, y double, item string")
    own = {r.item: r.section_ord for r in sections.owner(items, sections.split(body, heads)).collect()}
    assert own == {"t0": 1, "t1": 2, "t2": 3}
    none = sections.split(body, heads.limit(0)).collect()
    assert len(none) == 1
    assert sections.group_sections(sections.split(body, heads)).select("group_id").distinct().count() == 1
