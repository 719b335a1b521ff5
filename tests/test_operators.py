import pytest
from pyspark.sql import functions as F

from folia import config
from folia.operators import confidence, gate, html, images, jobs, questions, report
from folia.plans import extraction
from folia.sources import pages as sources, providers, sinks

GATE = "doc_id string, page_number int, native_text string, ocr_text string, avg_confidence double, low_conf_ratio double, pass_similarity double, layout string"


def verdict(spark, native, ocr, confs, similarity, layout, g=None, **kw):
    high = [c for c in confs if c >= 92]
    avg, low = (sum(high) / len(high) if high else None), ((len(confs) - len(high)) / len(confs) if confs else None)
    return gate.page_quality(spark.createDataFrame([("d", 1, native, ocr, avg, low, similarity, layout)], GATE), g, **kw).first()


KARNATAKA = "KARNATAKA SCHOOL EXAMINATION AND ASSESSMENT BOARD " * 5


@pytest.mark.parametrize("native,ocr,confs,sim,layout,status,kinds", [
    (KARNATAKA, "x y", [50, 40], None, "table", "approved", {"native_sufficient"}),
    ("Substantial text " * 10, "other words", [96, 50, 50, 50, 50], 0.10, "table", "approved", {"native_sufficient", "native_fallback"}),
    ("", "a", [30], None, "noisy", "approved", {"figure"}),
    ("", "a", [96] + [50] * 9, 0.16, "table", "approved", {"figure"}),
    ("hello world", "hello world", [96, 97], 0.95, "text", "approved", {"text"}),
    ("short", "a b", [93, 50], 0.50, "text", "needs_review", {"text"}),
])
def test_gate(spark, native, ocr, confs, sim, layout, status, kinds):
    got = verdict(spark, native, ocr, confs, sim, layout)
    assert got.status == status and got.page_type in kinds


def test_gate_routes(spark):
    assert verdict(spark, "short", "x", [50], None, "text").page_type != "native_sufficient"
    regional = verdict(spark, "garbled", "other", [], None, "text", regional=True)
    assert regional.selected_source == "ocr"
    assert verdict(spark, "some native text", "different", [], None, "text").selected_source == "native"
    sarvam = verdict(spark, "x", "ಕನ್ನಡ", [], None, None, engine="sarvam", regional=True)
    assert (sarvam.status, sarvam.page_type, sarvam.selected_source, sarvam.accuracy_score) == ("approved", "sarvam", "ocr", None)
    assert verdict(spark, "", "t", [95, 92], 0.5, "table", config.gate(90)).status == "approved"


def test_gate_without_evidence_and_relaxation_has_no_effect(spark):
    got = verdict(spark, None, None, [], None, None)
    assert (got.status, got.page_type, got.avg_confidence, got.native_similarity) == ("approved", "figure", None, None)
    # Diagram-heavy pages are unreliable first, so their relaxed thresholds never decide.
    assert verdict(spark, "", "t", [96] + [50] * 9, 0.2, "noisy").page_type == "figure"


def test_statistics(spark):
    p = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_number int")
    t = spark.createDataFrame([("d", 1, "a", "95"), ("d", 1, "b", "90"), ("d", 1, " ", "99"), ("d", 1, "c", "-1"), ("d", 1, "c", "bad")], "doc_id string, page_number int, text string, confidence string")
    c = confidence.page_confidence(p, confidence.keep_tokens(t))
    got = {r.page_number: (r.total_tokens, r.avg_confidence, r.low_conf_ratio) for r in c.collect()}
    assert got == {1: (2, 95.0, 0.5), 2: (0, None, None)}
    assert confidence.doc_stats(c).first().avg_confidence == 95.0


def test_page_confidence_in_place(spark):
    p = spark.createDataFrame([("d", 1, [("a", "95"), ("b", "90"), (" ", "99"), ("c", "-1"), ("c", "bad"), (None, "99"), ("d", None)]), ("d", 2, []), ("d", 3, None), (None, 4, [("a", "0")])],
                              "doc_id string, page_number int, tokens array<struct<text:string,confidence:string>>")
    kind = ["total_tokens", "raw_avg_confidence", "avg_confidence", "low_conf_tokens", "high_sum", "high_tokens", "low_conf_ratio"]
    got = {r.page_number: r for r in confidence.page_confidence_in_place(p).select("page_number", *kind).collect()}
    rows = p.select("doc_id", "page_number", F.explode("tokens").alias("t")).select("doc_id", "page_number", "t.*")
    want = {r.page_number: r for r in confidence.page_confidence(p, confidence.keep_tokens(rows)).select("page_number", *kind).collect()}
    assert [got[k] for k in (1, 2, 3)] == [want[k] for k in (1, 2, 3)]
    assert (got[4].total_tokens, got[4].raw_avg_confidence, got[4].low_conf_ratio) == (1, 0.0, 1.0)


def test_candidates(spark):
    rows = spark.createDataFrame([("d", 1, 0, "a b c d"), ("d", 1, 1, "a b c x"), ("d", 1, 2, ""), ("d", 2, 0, "solo")], "doc_id string, page_number int, pass_id int, text string")
    scored = confidence.consensus(rows).withColumns({"score": F.lit(1.0), "n_tokens": F.lit(1)})
    got = {(r.page_number, r.pass_id): r.consensus for r in scored.collect()}
    assert got[(1, 0)] == pytest.approx((0.75 + 0.0) / 2) and got[(1, 2)] == 1.0 and got[(2, 0)] == 1.0
    best = lambda **kw: {r.page_number: r.pass_id for r in confidence.best_candidate(scored, **kw).collect()}
    assert best() == {1: 2, 2: 0} and best(fix_empty=True) == {1: 0, 2: 0}


def test_polygon(spark):
    got = spark.range(1).select(confidence.polygon_box(F.expr("array(named_struct('x', 10.0, 'y', 20.0), named_struct('x', 200.0, 'y', 50.0))")).alias("b")).first().b
    assert (got.x, got.y, got.w, got.h) == (10, 20, 190, 30)


EXAM = [("d", 1, "General Instructions to all"), ("d", 2, "I. Four alternatives are given\n8 x 1 = 8\n1. The HCF is (A) 1  (B) 3\n (C) 5 (D) 15\n2. In the figure find x  2"),
        ("d", 3, "tail of 2\n17. Prove that\n  OR\nHow many are divisible by 6?\nII. Next\n18. last")]


def test_segments(spark):
    got = questions.segments(spark.createDataFrame(EXAM, "doc_id string, page_number int, text string")).orderBy(*questions.sort_key()).collect()
    assert [(r.question_number, r.section, r.page_number) for r in got] == [(1, "I", 2), (2, "I", 2), (17, "I", 3), (18, "II", 3)]
    assert got[2].text == "17. Prove that" and got[2].or_text.startswith("How many") and got[2].has_or_alternative
    assert got[0].y_end == got[1].y_start and got[1].y_end == 1.0 and "8 x 1" not in got[0].text


def test_enrichment(spark):
    got = questions.enrich(questions.segments(spark.createDataFrame(EXAM, "doc_id string, page_number int, text string"))).orderBy("question_number").collect()
    assert [(o.label, o.text) for o in got[0].options] == [("A", "1"), ("B", "3"), ("C", "5"), ("D", "15")] and got[0].question_type == "mcq"
    assert got[1].has_figure and (got[1].marks, got[1].difficulty) == (2, "medium") and got[2].marks is None and got[2].difficulty is None


def test_bank(spark):
    tables = extraction.question_bank(spark.createDataFrame(EXAM, "doc_id string, page_number int, text string"))
    numbers = sorted(r.question_number for r in tables["questions"].collect())
    assert numbers == [1, 2, 17, 18, 17000] and tables["question_options"].count() == 4 and tables["documents"].first().total_questions == 4
    assert [(r.section, r["count"], r.marks_per_question) for r in tables["sections"].collect()] == [("I", 8, 1)]


def test_metadata(spark):
    t = "S.S.L.C. MODEL QUESTION PAPER 2024\nSubject : MATHEMATICS\nMax. Marks : 80"
    got = spark.createDataFrame([(t,)], "t string").select(*[c.alias(n) for n, c in questions.exam_metadata(F.col("t")).items()]).first()
    assert got.subject == "MATHEMATICS" and got.total_marks == 80 and "MODEL" in got.exam_title


def test_images_to_segments(spark):
    segs = spark.createDataFrame([("d", 1, 1, 1, 1, "plain", 0.0, 0.4), ("d", 1, 1, 2, 2, "in the figure", 0.4, 0.9)], "doc_id string, page_number int, page_order int, segment int, question_number int, text string, y_start double, y_end double")
    imgs = spark.createDataFrame([("d", 1, 0, 500.0, 10.0, 792.0, True), ("d", 1, 1, 5.0, 10.0, None, True), ("d", 1, 2, 5.0, 10.0, None, False)], "doc_id string, page_number int, idx int, y double, x double, page_height double, has_bbox boolean")
    assert {r.idx: r.question_number for r in questions.associate_images(imgs, segs).collect()} == {0: 2, 1: 2}
    plain = segs.withColumn("text", F.lit("plain"))
    assert {r.idx: r.question_number for r in questions.associate_images(imgs, plain).collect()} == {0: 2, 1: 1}
    diagrams = spark.createDataFrame([("d", 1, 12.0, 490.0, 0, "first"), ("d", 1, 12.0, 495.0, 1, "second")], "doc_id string, page_number int, x double, y double, ordinal int, description string")
    assert [(r.idx, r.description) for r in questions.match_diagrams(imgs, diagrams).collect()] == [(0, "first")]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ingested_at int")
    got = questions.upsert(t, spark.createDataFrame([(2, "c", 2), (3, "d", 2)], t.schema), ["k"]).collect()
    assert {(r.k, r.v) for r in got} == {(1, "a"), (2, "c"), (3, "d")}


def test_first_seen_images(spark):
    kind = "doc_id string, xref int, page_number int, idx int, width int, height int, box_w double, box_h double"
    rows = spark.createDataFrame([("d", 1, 1, 0, 10, 90, 100.0, 100.0), ("d", 1, 2, 0, 90, 90, 100.0, 100.0), ("d", 1, 3, 0, 90, 90, 100.0, 100.0), ("d", 2, 1, 1, 90, 90, None, None), ("d", 3, 1, 2, 90, 90, 10.0, 10.0)], kind)
    assert {(r.xref, r.page_number) for r in images.page_images(rows).collect()} == {(1, 2), (2, 1)}
    assert {(r.xref, r.page_number) for r in images.figures(rows, max_pages=2).collect()} == {(1, 1)}


def test_table_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0, 30, 20), (1, 5, 50, 30, 20), (1, 21, 0, 30, 20), (1, 40, 9, 30, 30)], "table_id int, y int, x int, w int, h int")
    assert [(r.y, r.row) for r in images.table_rows(rows).orderBy("y").collect()] == [(0, 0), (5, 0), (21, 1), (40, 1)]
    cells = spark.createDataFrame([(1, 0, 0, 5, "a"), (1, 0, 0, 9, "b"), (1, 1, 30, 0, "c")], "table_id int, row int, y int, x int, text string")
    assert images.table_text(cells).first().text == "a\tb\nc"
    assert spark.range(1).select(images.grid_text(F.expr("array(array(' a ', 'b'), array('c', 'd'))")).alias("t")).first().t == "a | b\nc | d"


def test_otsu_default(spark):
    bins = spark.createDataFrame([("a", 7, 5), ("b", 10, 5), ("b", 200, 5)], "k string, bin int, n int")
    assert {r.k: r.threshold for r in images.otsu(bins, "k").collect()} == {"a": 200, "b": 10}


def test_reports(spark):
    q = spark.createDataFrame([("a", 1, "approved", "text", []), ("a", 2, "needs_review", "text", ["x", "y"]), ("b", 1, "approved", "text", [])], "doc_id string, page_number int, status string, page_type string, failed_gates array<string>")
    assert {r.doc_id: (r.status, r.approved_count) for r in gate.doc_status(q).collect()} == {"a": ("needs_review", 1), "b": ("approved", 1)}
    assert {r.doc_id: (r.pages, r.failed) for r in report.batch_summary(q, rollup=True).collect()} == {"a": (2, 1), "b": (1, 0), None: (3, 1)}
    assert report.needs_review(q).first().failed_gates == "x,y"
    codes = spark.createDataFrame([("approved", None), ("needs_review", None), (None, "PdfValidationError"), (None, "ValueError")], "s string, e string")
    assert [r.c for r in codes.select(report.exit_code(F.col("s"), F.col("e")).alias("c")).collect()] == [0, 3, 1, 2]


def test_statistics_of_few_values(spark):
    rows = spark.createDataFrame([(0.5,)], "x double")
    assert report.stats(rows, "x", deviation=True).first().stdev == 0.0
    assert report.stats(rows.where("false"), "x", deviation=True).first().stdev is None


def test_jobs(spark):
    e = spark.createDataFrame([(1, "pending", "2024-01-01 00:00:00", 1), (1, "completed", "2024-01-01 00:01:00", 2), (2, "pending", "2024-01-01 00:00:30", 3)], "job_id long, status string, t string, event_id long").withColumn("updated_at", F.to_timestamp("t"))
    latest = jobs.latest(e)
    assert {r.job_id: r.status for r in latest.collect()} == {1: "completed", 2: "pending"}
    assert [r.job_id for r in jobs.evict(latest, "2024-01-01 02:00:00").collect()] == [2] and [r.job_id for r in jobs.listing(latest).collect()] == [2, 1]


def test_html(spark):
    p = spark.createDataFrame([("d", 1, '<b>"x"</b>', 612.0, 792.0), ("d", 2, "plain", None, None)], "doc_id string, page_number int, text string, page_width double, page_height double")
    g = html.geometry(p)
    blocks = spark.createDataFrame([("d", 1, 0, "text", 1.0, 2.0, 3.0, 4.0, "<i>", None, None, 255, None, None, 1.5)], "doc_id string, page_number int, idx int, type string, x double, y double, w double, h double, text string, font string, size double, color int, base64_data string, format string, scale double")
    out = html.document_html(html.page_html(g, html.block_html(blocks))).first().html
    assert "&lt;i&gt;" in out and "color:#0000ff" in out and '<pre class="fallback-text">plain</pre>' in out and out.index("page-1") < out.index("page-2") and "<i>" not in out


def test_markdown_pages(spark):
    kind = "doc_id string, name string, content string"
    many = spark.createDataFrame([("d", f"page_{i}.md", f"t{i}") for i in (10, 2, 1)] + [("d", "__MACOSX/._page_1.md", "no"), ("d", "x/__y.md", "no")], kind)
    assert [(r.page_number, r.text) for r in sources.markdown_pages(many, [5, 6, 7]).orderBy("page_number").collect()] == [(5, "t1"), (6, "t2"), (7, "t10")]
    one = spark.createDataFrame([("d", "a.md", "x\n---\ny\n---\nz")], kind)
    assert [r.text for r in sources.markdown_pages(one, [1, 2, 3]).orderBy("page_number").collect()] == ["x", "y", "z"]
    assert [r.text for r in sources.markdown_pages(spark.createDataFrame([("d", "a.md", "all")], kind), [1, 2]).collect()] == ["all", "all"]


def test_ground_truth(spark):
    raw = spark.createDataFrame([("a", '{"1": "one", "x": "no"}'), ("b", '{"pages": [{"page_number": 4, "text": "four"}]}')], "doc_id string, json string")
    assert {(r.doc_id, r.page_number, r.text) for r in sources.ground_truth(raw).collect()} == {("a", 1, "one"), ("b", 4, "four")}


def test_recognition_retries(spark):
    calls = spark.createDataFrame([("d", i) for i in range(1, 7)], "doc_id string, page_number int")

    def engine(pages):
        if any(n == 4 for _, n in pages):
            raise ValueError("page 4")
        return [f"t{n}" for _, n in pages]

    got = {r.page_number: r.text for r in providers.recognise_progressively(calls, engine, chunk=3, backoff=0.0).collect()}
    assert got == {1: "t1", 2: "t2", 3: "t3", 4: "", 5: "t5", 6: "t6"}


def test_pdf_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"1")
    (tmp_path / "c.pdf").write_bytes(b"bad")

    def reader(data):
        if data == b"bad":
            raise ValueError("broken")
        return [(1, " text ", 612.0, 792.0)]

    got = sources.native_pages(sources.pdf_files(spark, str(tmp_path)), reader).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page_number, r.char_count, r.error) for r in got] == [("a.PDF", 1, 4, None), ("c.pdf", None, None, "ValueError: broken")]
    imgs = spark.createDataFrame([("d", 1, 0, "png", bytearray(b"x")), ("d", 1, 1, "png", None)], "doc_id string, page_number int, idx int, format string, raw_bytes binary")
    saved = sinks.save_images(imgs, str(tmp_path / "img")).collect()
    assert len(saved) == 1 and (tmp_path / "img/d/page_1/img_0.png").read_bytes() == b"x"


def test_guard(spark):
    ok, errors = gate.guard_max_pages(spark.createDataFrame([("a", 5), ("b", 50)], "doc_id string, pages_total int"), 10)
    assert ok.first().doc_id == "a" and errors.first().error == "MaxPagesExceededError"


def test_language_profiles(spark):
    rows = spark.createDataFrame([(x, "eng") for x in ("kannada", " KN ", "hi", "unknown", None)], "language string, ocr_lang string")
    assert [r.profile for r in gate.resolve_language(rows).collect()] == ["kannada", "kannada", "hindi", "english", "english"]


def test_job_stream(spark, tmp_path):
    from folia.streaming.jobs import job_states

    kind = "job_id long, status string, updated_at timestamp"
    src = tmp_path / "in"
    spark.createDataFrame([(1, "pending", "2024-01-01 00:00:00"), (1, "completed", "2024-01-01 00:05:00"), (2, "pending", "2024-01-01 00:01:00")], "job_id long, status string, t string").select("job_id", "status", F.to_timestamp("t").alias("updated_at")).write.parquet(str(src))
    q = (job_states(spark.readStream.schema(kind).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("job_states")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.job_id: (r.status, r.n_events) for r in spark.sql("select * from job_states").collect() if not r.expired}
    assert got == {1: ("completed", 2), 2: ("pending", 1)}
