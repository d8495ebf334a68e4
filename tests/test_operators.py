"""Golden values of expressions and folds."""

from pyspark.sql import functions as F

from platen.functions import cmap, files, geometry, pixels, text
from platen.operators import classify, content, edits, paint

PAGE = "file_id string, page_no int"


def test_runs_keep_the_height_of_their_first_chunk(spark):
    rows = [("f", 1, i, "c", 1.0, y, 12.0) for i, y in enumerate([100.0, 100.4, 100.8, 90.0, 90.2])] + [("f", 2, 0, "a", None, None, None), ("f", 2, 1, "b", None, None, None)]
    chunks = spark.createDataFrame(rows, PAGE + ", line_no int, chunk string, x double, y double, font_size double")
    got = [(r.page_no, r.text) for r in content.merged_runs(chunks).orderBy("page_no", "el_idx").collect()]
    assert got == [(1, "cc"), (1, "c"), (1, "cc"), (2, "a"), (2, "b")]


def test_paragraphs_reset_their_width(spark):
    widths = [100.0, 100.0, 50.0, 60.0, 40.0]
    rows = [("f", 1, i, "t", 72.0, 700.0 - 14 * i, 12.0, w) for i, w in enumerate(widths)]
    rows += [("f", 2, 0, "t", 72.0, 700.0, 12.0, 9.0), ("f", 2, 1, "t", 72.0, 664.0, 12.0, 9.0), ("f", 2, 2, "t", 72.0, 627.5, 12.0, 9.0)]
    body = spark.createDataFrame(rows, PAGE + ", el_idx int, text string, x double, y double, font_size double, width double")
    lines = classify.paragraph_lines(body)
    assert [r.para_id for r in lines.orderBy("page_no", "line_pos").collect()] == [1, 1, 1, 2, 2, 1, 1, 2]
    first = classify.paragraphs(lines).orderBy("page_no", "para_id").first()
    assert (first.width, first.y, len(first.lines)) == (100.0, 700.0, 3)


def test_long_pages_and_missing_values(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("f").alias("file_id"), F.lit(1).alias("page_no"), F.col("id").cast("int").alias("el_idx"), F.lit("t").alias("text"), F.lit(72.0).alias("x"), (-F.col("id") * 14.0).alias("y"), F.lit(12.0).alias("font_size"), F.when(F.col("id") % 10 == 9, 10.0).otherwise(100.0).alias("width"))
    last = classify.paragraph_lines(rows).agg(F.max("para_id").alias("paras"), F.count("*").alias("n")).first()
    assert (last.paras, last.n) == (n // 10, n)
    odd = spark.createDataFrame([("g", 1, 0, "a", None, None, None, None), ("g", 1, 1, "b", None, None, None, None), ("g", 1, 2, "c", None, -50.0, None, 5.0), ("g", 1, 3, "d", None, -51.0, None, None), ("g", 1, 4, "e", None, -52.0, None, 1.0)], PAGE + ", el_idx int, text string, x double, y double, font_size double, width double")
    assert [r.para_id for r in classify.paragraph_lines(odd).orderBy("line_pos").collect()] == [1, 1, 2, 2, 3]
    assert classify.paragraph_lines(odd.filter("false")).count() == 0


def test_header_rule(spark):
    rows = [("f", 1, 0, "a", 296.0, 20.0), ("f", 1, 1, "b", 72.0, 200.0), ("f", 1, 2, "c", 72.0, 467.5), ("f", 1, 3, "  ", 306.0, 1.0), ("f", 1, 4, None, 306.0, 1.0)]
    e = spark.createDataFrame(rows, PAGE + ", el_idx int, text string, x double, width double").withColumns({"y": F.lit(1.0), "font_size": F.lit(12.0)})
    assert [r.is_header for r in classify.with_kind(e).orderBy("el_idx").collect()] == [True, False, True]


def test_empty_tables(spark):
    e = spark.createDataFrame([], PAGE + ", el_idx int, text string, x double, y double, font_size double, width double")
    pages = spark.createDataFrame([("f", 1)], PAGE)
    row = classify.classification(e, pages).first()
    assert (row.header_count, row.text_count, row.paragraph_count) == (0, 0, 0)
    assert classify.page_counts(e, pages).first().text_count == 0


def test_paint_matrices(spark):
    lines = ["q", "100 0 0 50 10 20 cm", "/Im1 Do", "/Im2 Do", "Q", "/Im3 Do", "q", "2 0 0 2 0 0 cm", "Q", "/Im4 Do", "% /Im9 Do", "", "3 0 0 3 1 1 cm /Im5 Do", "4 0 0 4 0 0 cm", "q", "/Im6 Do"]
    streams = spark.createDataFrame([("f", 1, "\r\n".join(lines))], PAGE + ", content string")
    got = {r.name: r.matrix[0] for r in paint.paint_operations(paint.paint_lines(streams)).collect()}
    assert got == {"Im1": 100.0, "Im2": 1.0, "Im3": 1.0, "Im4": 1.0, "Im5": 3.0, "Im6": 4.0}


def test_coverage_and_placement(spark):
    m = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    cover = lambda a, d: geometry.coverage(m(a, 0, 0, d, 0, 0), F.lit(612.0), F.lit(792.0))
    row = spark.range(1).select(cover(612, -792).alias("a"), cover(500, 600).alias("b"), cover(0, 0).alias("c"), geometry.appearance(m(100, 0, 0, -50, 10, 300)).alias("p")).first()
    assert (row.a, row.b, row.c) == (1.0, 300000 / 484704, 0.0) and tuple(row.p) == (10.0, 250.0, 100.0, 50.0)


def test_strings(spark):
    row = spark.createDataFrame([(r"(a\(b\)c\\n)", " ﻿ x  ")], "a string, b string").select(
        text.literal_string("a").alias("a"), text.trimmed("b").alias("b"), text.unicode_hex(F.lit("00660069")).alias("c"), text.unicode_hex(F.lit("006")).alias("d"), text.unicode_hex(F.lit("660069")).alias("e"), text.index_of("a", "zz").alias("f")
    ).first()
    assert tuple(row) == ("a(b)c\n", "x", "fi", "", "", -1)
    sizes = [r[0] for r in spark.createDataFrame([(0,), (1536,), (1048576,), (None,)], "n long").select(text.file_size("n")).collect()]
    assert sizes == ["0 B", "1.5 KB", "1 MB", "0 B"]


def test_maps(spark):
    source = "1 beginbfrange\n<01> <03> <0041>\nendbfrange\nbeginbfchar\n<0a> <00660069>\nendbfchar\nbeginbfrange\n<0B> <0B> <00660069>\n<05> <04> <0041>\nendbfrange"
    got = {r.code: r.uni for r in cmap.parse_cmaps(spark.createDataFrame([("f", source)], "file_id string, cmap_text string"), ["file_id"]).collect()}
    assert got == {"01": "0041", "02": "0042", "03": "0043", "0A": "00660069", "0B": "660069"}
    assert cmap.translate("<0041424399>", {"0041": "0041", "42": "0062"}) == "Ab[?43][?99]"
    assert cmap.translate("<4142>", {}) == "[?41][?42]" and cmap.translate("", {}) == ""


def test_file_checks(spark):
    rows = spark.createDataFrame([(52_428_800, "application/pdf"), (52_428_801, "application/pdf"), (None, "x"), (1, "image/png"), (1, None)], "n long, m string")
    assert [r[0] for r in rows.select(files.rejection(F.col("n"), F.col("m"))).collect()] == [None, "too_large", "missing", "not_pdf", "not_pdf"]


def test_pixels(spark):
    row = spark.range(1).select(pixels.cmyk_to_rgb(F.array(*(F.lit(v) for v in (0, 0, 0, 128)))).alias("a"), pixels.rgb_to_rgba(F.array(F.lit(7)), 1).alias("b"), pixels.paeth(F.lit(1), F.lit(2), F.lit(3)).alias("c"), pixels.paeth(F.lit(5), F.lit(9), F.lit(5)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ([127, 127, 127], [7, 7, 7, 255], 1, 9)


def element(text, y, x=72.0):
    return {"text": text, "x": x, "y": y, "font_size": 12.0, "width": len(text) * 5.5}


def test_shift():
    s = edits.PageState([element("a", 700.0), element("b", 650.0), element("c", 600.0)])
    s.shift(649.0, 14.4)
    assert [e["y"] for e in s.elements] == [700.0, 650.0, 585.6]


def test_typing_wraps_and_backspace_merges():
    s = edits.PageState([element("aaaa bbbb", 700.0, 530.0), element("below", 600.0)])
    s.at, s.offset = 0, 9
    s.key("b")
    assert [e["text"] for e in s.elements] == ["aaaa", "bbbbb", "below"]
    assert [round(e["y"], 3) for e in s.elements] == [700.0, 685.6, 585.6] and (s.at, s.offset) == (1, 5)
    s.offset = 0
    s.key("Backspace")
    assert [e["text"] for e in s.elements] == ["aaaabbbbb", "below"] and (s.at, s.offset) == (0, 4)
    for k in ("Backspace", "ArrowLeft", "ArrowRight", "Shift"):
        s.key(k)
    assert s.elements[0]["text"] == "aaabbbbb" and s.offset == 3
    s.offset = len(s.elements[0]["text"])
    s.key("ArrowRight")
    assert (s.at, s.offset) == (1, 0)
    s.key("ArrowLeft")
    assert (s.at, s.offset) == (0, 8)


def test_replay_is_ordered_per_page(spark):
    e = spark.createDataFrame([("f", p, i, f"t{i}", 72.0, 700.0 - 20 * i, 12.0, 11.0) for p in (1, 2) for i in range(3)], edits.REPLAYED)
    log = [("f", 1, 1, "insert", 0, "new", 10.0, 72.0, 690.0), ("f", 1, 2, "remove", 2, None, None, None, None), ("f", 1, 3, "caret", 0, None, 2.0, None, None), ("f", 1, 4, "key", None, "!", None, None, None), ("f", 1, 5, "font_size", 1, "1x", None, None, None), ("f", 1, 6, "font_size", 1, "18", None, None, None), ("f", 1, 7, "shift", None, None, 5.0, None, 695.0)]
    got = edits.replay(e, spark.createDataFrame(log, "file_id string, page_no int, seq int, op string, el_idx int, text string, number double, x double, y double")).collect()
    one = sorted((r.el_idx, r.text, r.y, r.font_size) for r in got if r.page_no == 1)
    assert one == [(0, "t0!", 700.0, 12.0), (1, "new", 685.0, 18.0), (2, "t2", 655.0, 12.0)]
    assert [r.text for r in sorted((r for r in got if r.page_no == 2), key=lambda r: r.el_idx)] == ["t0", "t1", "t2"]


def test_image_shift_keeps_the_first_placement(spark):
    rows = spark.sql("select 'f' as file_id, array(named_struct('x', 1D, 'y', 10D, 'rendered_width', 1D, 'rendered_height', 1D), named_struct('x', 2D, 'y', 90D, 'rendered_width', 1D, 'rendered_height', 1D)) as appearances")
    moved = edits.shift_images_below(rows, F.lit(50.0), F.lit(5.0)).first().appearances
    assert [(a.x, a.y) for a in moved] == [(1.0, 5.0)]
