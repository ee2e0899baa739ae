"""Relations of entities and definitions, worked out by hand."""

from brookfern.operators import relations

ITEMS = "query_id int, query string, rank int, title string, page_number int, chunk_index int, text string"


def test_triples_stay_in_their_clause(spark):
    rows = [
        (1, "Docling is a tool, and it is fast. The DOCLING library of ours means well; other are not.", "Docling"),
        (2, "Docling, is not one clause", "Docling"), (3, "Undocling is none", "Docling"), (4, None, "x"), (5, "x is y", None), (6, "A+B is known as c", "A+B"), (7, "", "x"),
    ]
    df = spark.createDataFrame(rows, "id int, body string, entity string")
    found = relations.triples(df, "body", "entity", "id")
    got = sorted((r.id, r.place, r.relation, r.object, r.distance) for r in found.collect())
    assert got == [(1, 0, "is", "a tool", 0), (1, 2, "means", "well", 16), (6, 0, "is", "known as c", 0)]
    assert [(r.id, r.object) for r in relations.nearest(found, "id").orderBy("id").collect()] == [(1, "a tool"), (6, "known as c")]


def test_definitions(spark):
    rows = [
        (1, "What is Docling?", 1, "t", 1, 1, "We met Docling in a long talk about many other things here. Compared to others it was fine."),
        (1, "What is Docling?", 2, "t", 2, 1, "Docling is a library that reads documents of every kind there is. It can export them to several formats for you. Something else entirely stands in this sentence."),
        (2, "How does Docling work?", 1, "t", 1, 1, "Docling is a library that reads documents of every kind there is."),
        (3, "What is Docling?", 1, "t", 1, 1, None),
    ]
    got = {r.query_id: r.answer for r in relations.definition_answers(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {1: "Docling is a library that reads documents of every kind there is. It can export them to several formats for you [2]"} or got == {1: "Docling is a library that reads documents of every kind there is. It can export them to several formats for you. [2]"}
