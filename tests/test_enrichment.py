from folia.operators import enrichment, questions
from folia.sources import providers


def test_bank_children_and_counts(spark):
    kind = "doc_id string, question_number int, section string, page_number int, text string, marks int, difficulty string, question_type string, has_or_alternative boolean, or_text string, options array<struct<label:string,text:string>>, images array<string>, sub_parts array<struct<label:string,text:string,marks:int>>"
    rows = [("d", 1, "I", 1, "q", 2, "medium", "mcq", True, "alt", [("A", "x"), ("B", "y")], ["p0", "p1"], []), ("d", 2, "I", 1, "r", None, None, "short_answer", False, None, [], [], [("a", "s", 1), ("b", "t", 2)])]
    tables = questions.bank_tables(spark.createDataFrame(rows, kind))
    assert [tuple(r) for r in tables["question_images"].orderBy("sort_order").collect()] == [("d", 1, 0, "p0"), ("d", 1, 1, "p1")]
    assert [tuple(r) for r in tables["question_parts"].orderBy("sort_order").collect()] == [("d", 2, 0, "a", "s", 1), ("d", 2, 1, "b", "t", 2)]
    assert {r.table: r.n_rows for r in questions.bank_counts(tables).collect()} == {"documents": 1, "questions": 3, "question_options": 2, "question_images": 2, "question_parts": 2}


def test_enrichment_by_batches(spark):
    asked = spark.createDataFrame([("d", k, f"text {k}") for k in range(1, 8)], "doc_id string, question_number int, text string")

    def model(prompt):
        numbers = [int(line.split(":")[0][1:]) for line in prompt.split("\n")]
        if 4 in numbers:
            raise RuntimeError("down")
        return "```json\n[" + ", ".join(f'{{"question_number": {n}, "topic": "t{n}", "marks": {n}, "difficulty": "easy"}}' for n in numbers) + "]\n```" if 7 not in numbers else '{"no": "list"}'

    got = {r.question_number: (r.topic, r.marks) for r in providers.enrich_questions(asked, model, size=3, attempts=2, backoff=0).collect()}
    assert got == {n: (f"t{n}", n) for n in (1, 2, 3)}


def test_routing_of_forced_and_blank_pages(spark):
    kind = "doc_id string, page_number int, text string, char_count int, regional boolean"
    own = spark.createDataFrame([("d", 1, "own text", 500, False), ("d", 2, "", 0, False), ("e", 1, "own", 500, True), ("e", 2, "own", 500, True)], kind)
    read = spark.createDataFrame([("e", 1, "read"), ("e", 2, " "), ("d", 1, "unused")], "doc_id string, page_number int, text string")
    engines = lambda **k: {(r.doc_id, r.page_number): (r.engine, r.text) for r in enrichment.routed(own, read, **k).collect()}
    assert engines() == {("d", 1): ("native", "own text"), ("d", 2): ("tesseract", None), ("e", 1): ("regional", "read"), ("e", 2): ("tesseract", None)}
    assert engines(force=True)[("d", 1)] == ("tesseract", None)


def test_failures(spark):
    rows = [("a", 10, 0, 0, "x"), ("b", 0, 2, 0, ""), ("c", 0, 0, 0, ""), ("d", 5, 1, 1, "  "), ("e", 0, 1, 1, "y")]
    got = {r.doc_id: r.error for r in enrichment.failures(spark.createDataFrame(rows, "doc_id string, native_chars int, pages_required int, pages_recognised int, full_text string")).collect()}
    assert got == {"a": None, "b": "PdfProcessingError", "c": "PdfProcessingError", "d": "EmptyContentError", "e": None}
