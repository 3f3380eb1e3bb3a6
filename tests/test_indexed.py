"""Stored indexes: the rows of the plain search and the plain page, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from vocspark.operators import filters, paged_table, search_index
from vocspark.plans import flows
from vocspark.session import scratch_path

ROWS = "feedback_id string, feedback string, title string, n int"
LONG = "ab" * 40_000
AT_EDGE = "y" * (search_index.PIECE - 2) + "😀knot" + "y" * 50
TEXTS = [None, "", "a", "Slow Export of reports", "slow export", "slow\nexport", "😀 smile 😀😀", "ÀÉ über straße", "'%_\\ odd", LONG,
         AT_EDGE, LONG[:search_index.PIECE - 3] + "needle" + LONG, "slow export", "export", "x" * 300]


def table(spark, texts=TEXTS):
    rows = [(f"f{i}" if i % 4 else None, t, None if i % 3 else f"Title {i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def files_read(spark, df):
    """(files, bytes) the scans of a plan read; adaptive execution hides them, so it is off here."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                m = node.metrics()
                found.append((node.relation().location().rootPaths().apply(0).getName(), m.apply("numFiles").value(), m.apply("filesSize").value()))
        return found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def index(spark):
    return search_index.build_search_index(table(spark), scratch_path(spark, "index"), blocks=8)


@pytest.mark.parametrize("text", ["slow export", "SLOW EXPORT", "export", "needle", "bneed", "knot", "y😀k", "😀kn", "leab", "title 1", "a", "", "😀", "😀 s", "😀😀", "straße", "%_\\",
                                  "no such text", "e\ne", "xxx", "Title 12", "w e"])
def test_search_finds_what_the_scan_finds(spark, index, text):
    want = sorted(r["n"] for r in table(spark).filter(filters.search(text, ["feedback", "title"])).collect())
    got = index.search(text)
    assert got.columns == [c.split()[0] for c in ROWS.split(", ")]
    assert sorted(r["n"] for r in got.collect()) == want


def test_filtered_view_through_the_index(spark):
    full = spark.createDataFrame([(f"f{i}", t, "2024", "open" if i % 2 else None, "high") for i, t in enumerate(TEXTS)],
                                 "feedback_id string, feedback string, created string, state string, priority string")
    full = full.withColumns({c: F.lit("x") for c in filters.FACET_COLUMNS.values() if c not in full.columns})
    index = search_index.build_search_index(full, scratch_path(spark, "index"), blocks=4)
    spec = filters.FilterSpec(search="Slow Export", states=("open",))
    plain, fast = flows.filtered_view(full, spec), flows.filtered_view(full, spec, index=index)
    assert fast.rows.collect() == plain.rows.collect() != [] and fast.summary.first() == plain.summary.first()


def test_repeated_and_missing_rows(spark):
    twice = table(spark).unionAll(table(spark))
    index = search_index.build_search_index(twice, scratch_path(spark, "index"), blocks=8)
    assert index.rows().count() == 2 * len(TEXTS) and index.search("slow export").count() == 6
    empty = search_index.build_search_index(table(spark).limit(0), scratch_path(spark, "index"), blocks=8)
    assert empty.search("slow").count() == empty.search("a").count() == empty.rows().count() == 0
    again = search_index.SearchIndex(spark, index.folder, index.schema, index.columns, index.blocks)
    assert again.search("needle").count() == 2
    with pytest.raises(ValueError):
        search_index.build_search_index(table(spark).withColumn("_row", F.lit(1)), scratch_path(spark, "index"))


def test_a_rare_search_reads_few_blocks(spark):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(3000)]
    texts[1234] += " zebra crossing"
    index = search_index.build_search_index(table(spark, texts), scratch_path(spark, "index"), blocks=32)
    found = files_read(spark, index.search("zebra cross"))
    rows = [f for f in found if f[0] == "rows"]
    whole = files_read(spark, index.rows().filter(filters.search("zebra cross", ["feedback"])))
    assert [r["n"] for r in index.search("zebra cross").collect()] == [1234]
    assert len(rows) == 1 and rows[0][1] == 1 and whole[0][1] == 32 and rows[0][2] * 10 < whole[0][2]


@pytest.mark.parametrize("sort_by", ["newest", "oldest", "priority"])
def test_pages_are_those_of_the_sort(spark, sort_by):
    draw = random.Random(3)
    rows = [(f"f{i:04}", draw.choice([None, "", "2024-01-01", "2024-01-02", "2023-05-06"]), draw.choice(["critical", "high", "low", None])) for i in range(997)]
    df = spark.createDataFrame(rows, "feedback_id string, created string, priority string").repartition(5)
    pages = paged_table.write_pages(df, scratch_path(spark, "pages"), sort_by, range_rows=50)
    assert pages.total == 997 and len(pages.directory) > 10
    for number, size in ((1, 50), (7, 50), (20, 50), (21, 50), (1, 997), (3, 400), (997, 1), (998, 1)):
        want = [r["feedback_id"] for r in filters.page(df, number, size, sort_by).collect()]
        assert [r["feedback_id"] for r in pages.page(number, size).collect()] == want
        assert pages.summary(number, size).first() == filters.page_summary(df, number, size).first()
    again = paged_table.open_pages(spark, pages.folder, df.schema, sort_by)
    assert again.page(9).collect() == pages.page(9).collect()


def test_a_deep_page_reads_two_files(spark):
    df = spark.range(200_000).select(F.col("id").alias("feedback_id"), F.lit("2024").alias("created"), F.repeat(F.lit("x"), 50).alias("pad"))
    pages = paged_table.write_pages(df, scratch_path(spark, "pages"), range_rows=5_000)
    (_, files, _), = files_read(spark, pages.page(1_000))
    assert files <= 2 and [r["feedback_id"] for r in pages.page(1_000).collect()] == list(range(49_950, 50_000))


def test_pages_of_one_value_and_of_nothing(spark):
    same = spark.createDataFrame([("f", "2024")] * 600, "feedback_id string, created string").repartition(4)
    pages = paged_table.write_pages(same, scratch_path(spark, "pages"), range_rows=50)
    assert max(n for _, n in pages.directory) < 300 and sum(pages.page(i).count() for i in range(1, 14)) == 600
    none = paged_table.write_pages(same.limit(0), scratch_path(spark, "pages"))
    assert none.page(1).count() == 0 and none.page(1).columns == ["feedback_id", "created"] and none.summary(1).first()["total_count"] == 0
    with pytest.raises(ValueError):
        paged_table.write_pages(same.withColumn("_tie", F.lit(1)), scratch_path(spark, "pages"))
