import pytest

from tabulon.errors import RequestError
from tabulon.operators import grid as grids
from tabulon.operators.quality import Contract
from tabulon.plans import discovery, reports

SALES = [["Shop", "Sold", "Left"], ["Nord", "12", "3"], ["Süd", "1,500", None], [None, None, None], ["West", "7", "0"]]
BARE = [["4", "5"], ["6", "7.5"]]
KNOWN = (reports.Report("stock", ("stock list",), (reports.ReportTable("stock", ("stock list",), lambda g: {"clean": reports.Output(grids.promote_header(g), Contract(column_count=2))}),)),)


def document(spark):
    pages = [("a", 1, "Cover"), ("a", 2, "Sales by shop"), ("a", 3, "rest"), ("k", 1, "Stock list"), ("e", 1, "no tables"), *(("long", i, "x") for i in range(1, 102))]
    rows = grids.grid_of(spark, SALES, "a", 2).unionByName(grids.grid_of(spark, BARE, "a", 3, 1)).unionByName(grids.grid_of(spark, [["Item", "N"], ["nut", "9"]], "k"))
    return spark.createDataFrame(pages, "doc_id string, page int, text string"), rows


def places(found):
    return sorted({(r["page"], r["table_index"]) for r in found.collect()})


def test_grids_by_page_keyword_and_all(spark):
    pages, rows = document(spark)
    assert places(discovery.by_pages(pages, rows, "a", 1, 2)) == [(2, 0)]
    assert places(discovery.automatically(pages, rows, "a")) == [(2, 0), (3, 1)]
    assert places(discovery.by_keyword(pages, rows, "a", " SALES ")) == [(2, 0)]
    assert places(discovery.by_keyword(pages, rows, "a", "absent")) == []
    for first, last in ((0, 1), (2, 1), (1, 4)):
        with pytest.raises(RequestError):
            discovery.by_pages(pages, rows, "a", first, last)
    with pytest.raises(TypeError):
        discovery.by_pages(pages, rows, "a", True, 2)
    for refused in (lambda: discovery.by_pages(pages, rows, "long", 1, 31), lambda: discovery.automatically(pages, rows, "long"), lambda: discovery.by_keyword(pages, rows, "long", "X"), lambda: discovery.by_keyword(pages, rows, "a", " ")):
        with pytest.raises(RequestError):
            refused()


def test_a_batch_with_one_failure(spark):
    pages, rows = document(spark)
    done = discovery.batch(pages, rows, ["a", "e", "k", "missing"], KNOWN)
    assert [(o.doc_id, o.method) for o in done] == [("a", "discovery"), ("e", "failed"), ("k", "stock"), ("missing", "failed")]
    assert discovery.counts(done) == {"succeeded": 2, "failed": 2, "tables": 3}
    assert done[1].error and done[3].error
    files = discovery.downloads(done)
    assert list(files) == ["a__page_2_table_1_clean.csv", "a__page_3_table_2_clean.csv", "k__stock_clean.csv"]
    sales = files["a__page_2_table_1_clean.csv"]
    assert sales.columns[1:] == ["Shop", "Sold", "Left"]
    assert [tuple(r)[1:] for r in sales.orderBy("row_pos").collect()] == [("Nord", "12", "3"), ("Süd", "1,500", None), ("West", "7", "0")]
    bare = files["a__page_3_table_2_clean.csv"]
    assert bare.columns[1:] == ["0", "1"] and bare.count() == 2 and not done[0].warnings
    for wrong in ([], ["a"] * 11):
        with pytest.raises(RequestError):
            discovery.batch(pages, rows, wrong, KNOWN)
    with pytest.raises(RequestError):
        discovery.downloads(done[1:2])
