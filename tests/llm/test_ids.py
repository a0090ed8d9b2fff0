"""Ids beyond 2**53 beside a null in one batch: every operator returns them as they are."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import table, words

from revpanel.llm import decontaminate, html, mixing, repeats, simhash, topk, toxicity

A, B = (1 << 60) + 1, (1 << 60) + 3
RNG = random.Random(2)
PASSAGE = words(RNG, 60)
ROWS = [(A, words(RNG, 30) + " " + PASSAGE), (B, PASSAGE + " " + words(RNG, 30)), (None, words(RNG, 80))]


@pytest.fixture
def docs(spark):
    return table(spark, ROWS).coalesce(1)


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_simhash(docs):
    assert by_id(simhash.simhash_classes(docs), "component_id") == {A: A, B: B, None: None}
    copies = docs.union(docs)
    assert sorted(by_id(simhash.simhash_classes(copies), "component_id").items(), key=repr) == sorted({A: A, B: B, None: None}.items(), key=repr)


def test_near_duplicates(docs):
    copy = docs.where(F.col("doc_id") == B).withColumn("doc_id", F.lit(A + 4))
    both = docs.union(copy).coalesce(1)
    assert by_id(simhash.near_duplicate_groups(both), "group_id") == {A: A, B: B, None: None, A + 4: B}
    assert sorted(map(repr, (r["doc_id"] for r in simhash.keep_one(both).collect()))) == sorted(map(repr, [A, B, None]))


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert set(by_id(toxicity.toxicity_scores(docs, model), "score")) == {A, B, None}


def test_contamination(spark, docs):
    items = spark.createDataFrame([(A, PASSAGE), (None, PASSAGE + " more"), (B, words(RNG, 20))], "item_id long, text string").coalesce(1)
    found = decontaminate.contamination(docs, items)
    assert by_id(found, "n_hit") == {A: 60, B: 60, None: 0}
    assert by_id(found, "items") == {A: [str(A)], B: [str(A)], None: []}


@pytest.mark.parametrize("strip", [repeats.strip_repeated_windows, repeats.strip_repeated_passages])
def test_repeats(docs, strip):
    assert by_id(strip(docs), "n_removed") == {A: 0, B: 60, None: 0}
    least = docs.withColumn("doc_id", F.when(F.col("doc_id") == B, F.lit(-(1 << 63))).otherwise(F.col("doc_id")))
    assert set(by_id(strip(least), "n_removed")) == {A, -(1 << 63), None}
    with pytest.raises(TypeError):
        strip(docs.withColumn("doc_id", F.lit("a")))


def test_pages(spark):
    pages = spark.createDataFrame([(A, "u", "<p>x</p>"), (B, None, None), (None, "u", "")], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html.extract_main_text(pages).collect()} == {A, B, None}


def test_mixing(docs):
    assert {r["doc_id"] for r in mixing.mix_documents(docs).collect()} == {A, B, None}


def test_top_k(spark):
    rows = [(A, [1.0, 0.0]), (B, [1.0, 0.5]), (None, [3.0, 3.0]), (B + 2, None)]
    found = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.lit(True))
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == {(A, B), (B, A)}


def test_repeated_rows_keep_clashing_columns(spark):
    """Columns named like those that the mix uses."""
    rows = [(i, words(RNG, 20 + i), "s", i, i, i, i, i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __h int, __i int, __copies int, h int, copies int")
    got = mixing.repeat_rows(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() >= 12


def test_labelled_rows_are_bounded(spark):
    """One labelled id that the documents repeat 3000 times is one row of the sample."""
    docs = spark.range(3000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    fitted = []
    fit = toxicity.FactorizationMachine.fit
    toxicity.FactorizationMachine.fit = lambda rows, y, **k: fitted.append(len(rows)) or fit(rows, y, **k)
    try:
        toxicity.fit_toxicity(docs, labels, max_rows=10)
    finally:
        toxicity.FactorizationMachine.fit = fit
    assert fitted == [1]


def test_one_run_in_all_items(spark):
    """Eight words that all documents and items share bring no pair of them together."""
    run = words(RNG, 8)
    docs = spark.createDataFrame([(i, f"{words(RNG, 20)} {run} {words(RNG, 20)}") for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{words(RNG, 9)} {run} {words(RNG, 9)}") for i in range(50)], "item_id long, text string")
    every, found = decontaminate.hits(docs, items)
    assert found.count() == 0 and every.where("size(w) > 0").count() > 0
    assert decontaminate.clean_documents(docs, items).count() == 200


def test_hostile_pages_take_linear_time():
    """Tags and quotes that never close, and end tags that many elements end."""
    import time

    def seconds(page):
        start = time.process_time()
        html.Forest().add(page)
        return time.process_time() - start

    for piece in ("<a ", '<a "', "<a '", "<b", "<! ", "<? ", '<a "> "x', "<a '> 'x", "<dt></dt>", "<p>", "<!--"):
        small, large = (min(seconds(piece * n + end) for _ in range(2)) for n, end in ((25_000, ">"), (100_000, ">")))
        assert large < 6 * small + 0.5, piece
    nested = lambda n: "<dt><dl>" + "<b>" * n + "<dt></dt>" * n
    assert seconds(nested(40_000)) < 6 * seconds(nested(10_000)) + 0.5
    assert seconds("<a " * 1_000_000) < 5 and seconds('<a "' * 1_000_000) < 5 and seconds("<b" * 1_000_000) < 5


def test_quotes_in_tags():
    """A tag ends at the first > outside quotes; without one, at the first > of all."""
    tags = lambda s: [(s[a:b], n) for a, b, n, *_ in html._tags(s)]
    assert tags("""<a x=">"><b y='>">'>""") == [("""<a x=">">""", "a"), ("""<b y='>">'>""", "b")]
    assert tags("""<a x="><b>c""") == [("""<a x=">""", "a"), ("<b>", "b")]
    assert tags("""<a "><i '><b>""") == [("""<a ">""", "a"), ("<i '>", "i"), ("<b>", "b")]
    assert tags("<p>a < b<!-- x > --><script>if (a<b) '</p>'</script><!-- open") == [("<p>", "p"), ("<!-- x > -->", None), ("<script>", "script"), ("</script>", "script"), ("<!-- open", None)]
    assert tags("<!doctype html><?x?><br/><a") == [("<!doctype html>", None), ("<?x?>", None), ("<br/>", "br")]
