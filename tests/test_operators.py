"""Text functions, grid repair, reshaping, reports and files, on tables about a choir."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.errors import RequestError
from tabulon.functions import text as X
from tabulon.operators import generic, grid, quality, reshape
from tabulon.sinks import batch_names, csv_bytes, download_zip, export_csv
from tabulon.sources import pages


def judged(spark, f, cases):
    """f over the keys of cases gives their values."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()
    assert dict(zip(cases, (r[0] for r in rows), strict=True)) == cases


def table(df):
    return [tuple(r)[1:] for r in df.orderBy("row_pos").collect()]


def test_missing_and_numbers(spark):
    judged(spark, X.is_missing, {None: True, "": True, "\t": True, "\u3000": True, "0": False})
    judged(spark, X.to_number, {"7": 7, " 7 ": 7, "7.": 7, ".7": 0.7, "-7e2": -700, "7 8": None, "7f": None, "Infinity": None, "1e999": None})
    judged(spark, X.lenient_number, {"7,000": 7000, "7 %": 0.07, "seven": None})
    judged(spark, X.is_number_like, {"1,234,567.5": True, "+.5": True, "1234": True, "1,23,456": False, "5.": False, "12 000": False, None: False})
    judged(spark, X.is_data_like, {".5": True, "12.5%": True, "1/2/25": True, "2025/1/2": True, "1,23,456": False, "1.2.25": False, "alto": False})


def test_dates(spark):
    yes = ["7-3-2025", "7-3-25", "07/03/2025", "7/3/25", "7.3.2025", "7.3.25", "2025-3-7", "2025/03/07", "2025.3.7", "7-Mar-2025", "7-mar-25", "7 MAR 2025", "7 Mar 25", "7-March-2025", "7-March-25", "7 march 2025", "7 March 25", "29-2-2024"]
    no = ["29-2-2025", "32-1-2025", "7-13-2025", "7-3/2025", "2025-3", "Mar 2025", "Mar 7, 2025", "7 Mrz 2025", "7 Mar 025", "7", "", None]
    judged(spark, X.is_date_like, dict.fromkeys(yes, True) | dict.fromkeys(no, False))
    judged(spark, X.parsed_date, {"7-3-68": dt.date(2068, 3, 7), "7-3-69": dt.date(1969, 3, 7), "7 May 2025": dt.date(2025, 5, 7), "x": None})


def test_scripts_and_names(spark):
    judged(spark, X.strip_script, {"गीत song": "song", "गीत": "", "सुर (tune)": "(tune)", None: None})
    judged(spark, lambda c: X.clean_cell(c, True), {"Aगीतlto": "Alto", "Bass (गीत) two": "Bass two", " a \n b ": "a b"})
    judged(spark, X.repair_wrapped_name, {"Sopran\no": "Soprano", "Choir\nAB": "Choir AB", "First\nVoice": "First Voice"})


def test_header_rows(spark):
    suggest = lambda *rows: grid.suggested_header(grid.grid_of(spark, [list(r) for r in rows]))
    assert suggest(("Voice", "Singers", "Age"), ("Alto", "12", "31")) == [0]
    assert suggest(("12", "31", "x"), ("1", "2", "y")) == []  # data in the first row
    assert suggest(("a", "b", "c"), ("d", "e", "f")) == []  # no data
    assert suggest(("Spring concert", None, None), ("Voice", "Singers", "Age"), ("1", "2", "x")) == [1]  # a sparse row above ends it
    assert suggest(("Voice", "Singers", "Age"), ("total", None, None), ("1", "2", "x")) == [0, 1]  # a sparse one below counts
    assert suggest(("a", None, None), ("b", None, None), ("1", "2", "x")) == []
    assert suggest(*[("a", "b", "c")] * 6, ("1", "2", "x")) == [2, 3, 4, 5]


def test_header_names():
    assert grid.combined_names([["Voice", "Age", "Age"]]) == ["Voice", "Age", "Age_2"]
    assert grid.combined_names([["Voice", None, "Age"]]) == ["Voice", "Voice_2", "Age"]  # a blank goes on from the left
    assert grid.combined_names([["Concert", None, None], ["Voice", None, "age"]]) == ["Concert | Voice", "Voice", "age"]
    assert grid.combined_names([[None, "Age"]]) == ["Column_1", "Age"]


def test_detached_headers(spark):
    assert grid.split_header_columns([["Voice", None, "Age", "Town"]], [0, 3, 0, 3]) == {0: 1, 2: 1}
    assert grid.split_header_columns([["Voice", "Age"]], [0, 2]) == {}
    g = grid.grid_of(spark, [["Voice", None, "Age"], [None, "Alto", "31"], [None, "Bass", "40"]])
    assert grid.clean_grid(g).columns == ["row_pos", "Voice", "Age"] and table(grid.clean_grid(g)) == [("Alto", "31"), ("Bass", "40")]
    two = grid.grid_of(spark, [["First", None, "Second", "Age"], [None, "Alto", None, "31"]])
    assert grid.clean_grid(two).columns == ["row_pos", "First\nSecond", "Age"]


def test_suspicious_columns(spark):
    rows = spark.createDataFrame([(0, "a", "b", "c", "d", None)], "row_pos int, Ag string, Column_2 string, `Long name` string, Column_4 string, Column_5 string")
    assert grid.suspicious_columns(rows) == ["Ag", "Column_2", "Column_4"]
    assert grid.suspicious_columns(rows.select("row_pos", "Ag")) == []


def test_promoted_headers(spark):
    g = grid.grid_of(spark, [["Members"], ["Voice", "Name", "Fee"], ["Alto", "Ida", "3.5"], [None, "Eva", "4"]])
    assert grid.promote_header(g, 1).columns == ["row_pos", "Voice", "Name", "Fee"]
    with pytest.raises(RequestError):
        grid.promote_header(grid.grid_of(spark, [["Voice", None], ["Alto", "1"]]), 0)
    wide = grid.promote_levels(grid.grid_of(spark, [["Voice", "Term", "Spring", None], ["", "Name", "Fee", "Due"], ["Alto", "Ida", "1", "2"]]), [0, 1], 2)
    assert wide.headers == (("Voice", ""), ("Term", "Name"), ("Spring", "Fee"), ("Spring", "Due"))


def test_cleaned_grids(spark):
    repeated = grid.grid_of(spark, [["Voice", "Name", "Fee"], ["Alto", "Ida", "1"], ["Voice", "Name", "Fee"], [" ", "", None], ["Bass", "Per", "2"]])
    assert table(grid.clean_grid(repeated)) == [("Alto", "Ida", "1"), ("Bass", "Per", "2")]
    for title in ("Observation", "Closing remarks", "ACTION taken"):
        wrapped = grid.grid_of(spark, [["No", "Voice", "Name", title], ["1", "Alto", "Ida", "sings"], [None, None, None, "well"], ["2", "Bass", "Per", "hums"]])
        assert [r[3] for r in table(grid.clean_grid(wrapped))] == ["sings well", "hums"]
        assert len(table(grid.clean_grid(wrapped, merge_wrapped=False))) == 3
    summary = grid.grid_of(spark, [["No", "Voice", "Name", "Summary"], ["1", "Alto", "Ida", "sings"], [None, None, None, "well"]])
    assert len(table(grid.clean_grid(summary))) == 2


def test_spans_and_shapes(spark):
    three = grid.grid_of(spark, [["v", "w"], ["x", "y"]], page=3).unionByName(grid.grid_of(spark, [["p", "q", "r"]], page=5))
    assert [r["cells"] for r in grid.span(three, "doc", [3, 5]).orderBy("row_pos").collect()] == [["v", "w", None], ["x", "y", None], ["p", "q", "r"]]
    assert sorted((r["page"], r["n_rows"], r["n_columns"]) for r in grid.shape(three).collect()) == [(3, 2, 2), (5, 1, 3)]
    for wrong in ([3, 4], [5, 3], []):
        with pytest.raises(RequestError):
            grid.span(three, "doc", wrong)
    wide = grid.grid_of(spark, [["Voice", "Name"], ["Alto", "Ida"]], page=1).unionByName(grid.grid_of(spark, [["Voice", "Name"], ["Bass", "Per"]], page=2)).unionByName(grid.grid_of(spark, [["Voice", "of the choir", "Name"], ["Tenor", None, "Jon"]], page=3))
    got = [r["cells"] for r in grid.normalise_span(wide).where("page = 3").orderBy("row_pos").collect()]
    assert got == [["Voice\nof the choir", "Name"], ["Tenor", "Jon"]]


def test_filling_and_sections(spark):
    df = spark.createDataFrame([(0, None), (1, "Alto"), (2, " "), (3, "Bass"), (4, None)], "row_pos int, voice string")
    assert [r[0] for r in table(grid.forward_fill(df, ["voice"]))] == [None, "Alto", "Alto", "Bass", "Bass"]
    g = grid.grid_of(spark, [["1. Women", None, None, None], ["a", "b", "c", "d"], ["2. Men", None, None, None], ["e", "f", "g", "h"]])
    assert [(r["section_id"], r["section_title"]) for r in grid.split_sections(g).orderBy("row_pos").collect()] == [(0, "1. Women")] * 2 + [(1, "2. Men")] * 2


def test_records(spark):
    g = grid.grid_of(spark, [["page head", None, None], ["CH-07", "Sopran\no", "came late"], [None, None, "left early"], ["CH-08", "Bass", "ill"]])
    out = grid.stitch_records(g, r"^CH-[0-9]{2}$", F.array(F.col("cells")[0], X.repair_wrapped_name(F.col("cells")[1])), 2).orderBy("row_pos").collect()
    assert [(r["fields"], r["comments"]) for r in out] == [(["CH-07", "Soprano"], "came late left early"), (["CH-08", "Bass"], "ill")]


def test_reshaping(spark):
    wide = spark.createDataFrame([(0, "Alto", "Ida", "1", "2"), (1, "Bass", "Per", "3", None)], "row_pos int, Voice string, Name string, `01-09-2025` string, `08-09-2025` string")
    long = reshape.melt(wide, ["Voice", "Name"], "Hours", order="row_pos").orderBy("measure_pos", "row_pos").collect()
    assert [(r["Name"], r["Date"].day, r["Hours"]) for r in long] == [("Ida", 1, 1), ("Per", 1, 3), ("Ida", 8, 2), ("Per", 8, None)]
    with pytest.raises(RequestError):
        reshape.paired_melt(wide, {"Name": "Name"}, {"01-09-2025": ("01-09-2025", "Fee")}, {"Fee": "F", "Due": "D"})
    voices = {"Ida": "Alto", "Per": "Bass"}
    singers = spark.createDataFrame([(None, "Ida"), (None, "Per"), ("Guest", None)], "voice string, name string")
    assert [r[0] for r in reshape.assign_from_mapping(singers, "name", "voice", voices).collect()] == ["Alto", "Bass", "Guest"]
    with pytest.raises(RequestError):
        reshape.assign_from_mapping(singers, "name", "voice", {"Ida": "Alto"})
    assert [r[0] for r in reshape.unmapped_keys(singers, "name", {"Ida": "Alto"}).collect()] == ["Per"]
    fees = spark.createDataFrame([("Alto", 7.0, "may"), ("Bass", 5.5, "may"), ("All", 12.0, "may")], "voice string, fee double, Date string")
    got = reshape.reconcile(fees, "fee", "Date", F.col("voice") == "All", 0.4).first()
    assert (got["component_sum"], got["difference"], got["within_tolerance"], got["reported_rows"]) == (12.5, -0.5, False, 1)


def test_generic_tables(spark):
    df = spark.createDataFrame([("Alto", "1,200", "n"), ("Bass", "300", "2"), ("Alto", "50", "m")], "Voice string, Fee string, Mark string")
    numbers, lost = generic.infer_numbers(df)
    assert dict(numbers.dtypes) == {"Voice": "string", "Fee": "bigint", "Mark": "string"} and lost == {"Fee": 0}
    assert generic.correct_columns(df, ["Mark"], {"Fee": "Paid"}).columns == ["Voice", "Paid"]
    with pytest.raises(RequestError):
        generic.correct_columns(df, [], {"Fee": "Voice"})
    assert [tuple(r) for r in generic.chart_data(numbers, "Voice", "Fee").collect()] == [("Alto", 1250), ("Bass", 300)]
    edits = spark.createDataFrame([(7, "mark", "A")], "singer int, column string, value string")
    assert sorted(map(tuple, generic.apply_edits(spark.createDataFrame([(7, "C"), (8, "B")], "singer int, mark string"), edits, "singer").collect())) == [(7, "A"), (8, "B")]


def test_quality_reports(spark):
    df = spark.createDataFrame([(0, "Alto", "9"), (1, "Alto", "9"), (2, "", None), (3, "Bass", "2-5-2025")], "row_pos int, voice string, mark string")
    report = quality.quality_report(df)
    assert (report["total_missing"], report["empty_rows"], report["duplicate_rows"], report["date_cells"]) == (2, [2], [1], [(3, "mark", "2-5-2025")])
    assert quality.Contract(column_count=2, filled=("voice",), unique_key=("voice",)).violations(df) == ["1 missing cells in 'voice'", "2 rows share a key of voice"]


def test_pages(spark):
    p = spark.createDataFrame([("x", 1, "Concert programme, spring"), ("x", 2, "Spring fees"), ("y", 1, " \n\t " * 30)], pages.PAGES)
    assert pages.search(p, "SPRING").count() == 2 and pages.search_all(p, ["fees", "spring"]).count() == 1
    assert {r[0]: r[1] for r in pages.has_text(p, 20).collect()} == {"x": True, "y": False}
    assert {r[0]: r[1] for r in pages.matching_profiles(p, {"concert": ["programme", "fees"], "none": ["tuba"]}).collect()} == {"x": ["concert"], "y": []}
    with pytest.raises(RequestError):
        pages.search(p, "  ")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("Ida", 1), ("Per", 2)], "name string, n int")
    target = export_csv(df.orderBy("n"), str(tmp_path / "deep" / "singers.csv"))
    assert target.read_bytes().startswith(b"\xef\xbb\xbfname,n")
    with pytest.raises(FileExistsError):
        export_csv(df, str(target))
    assert download_zip({"singers.csv": csv_bytes(df)})[:2] == b"PK"
    assert batch_names([("my list.pdf", "t.csv"), ("my_list.pdf", "t.csv")]) == ["my_list__t.csv", "my_list__t_2.csv"]
