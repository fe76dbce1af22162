import datetime
import json

import pytest

from tabulon import cli
from tabulon.errors import RequestError
from tabulon.operators.grid import grid_of
from tabulon.plans import catalogs, reports

PAGES = [("o", 1, "Weekly Outbreak Report of the Integrated Disease Surveillance Program"), ("o", 2, "Cases Deaths Comments/ Action Taken"), ("o", 3, "going on"),
         ("o", 4, "Disease outbreaks of previous weeks reported late"), ("o", 5, "and COVID-19 status")]
FIRST = ["TN/CHE/2024/07/011", "Tamil Nad\nu", "Salem", "Chicken\npox", "14", "0", "05-02-2024", "9-2-2024", "Under\nwatch", None, "Team sent.", " "]
GOES_ON = [None] * 9 + ["Samples", None, "taken."]
SECOND = ["BR/PAT/2024/07/012", "Bihar", "Gaya\nTown", "Measles", "1,020", "3", "06-02-2024", "08-02-2024", "Over", "Camp held."]
SHIFTED = ["OR/KHO/2024/05/003", " ", "Odisha", "Puri", "Cholera", "21", "2", "21-01-2024", None, None, "Over", None, "Wells", "cleaned"]
STRAIGHT = ["GJ/SUR/2024/05/004", "Gujarat", "Surat", "Mumps", "8", "0", "22-01-2024", "Over", None, "Advice given"]


def document(spark, late=(SHIFTED, STRAIGHT), current=(FIRST, GOES_ON, SECOND)):
    pages = spark.createDataFrame(PAGES, "doc_id string, page int, text string")
    a, b, c = grid_of(spark, [["Unique ID", "Name"], *current[:2]], "o", 2), grid_of(spark, list(current[2:]), "o", 3), grid_of(spark, [["late"], late[0]], "o", 4)
    return pages, a.unionByName(b).unionByName(c).unionByName(grid_of(spark, list(late[1:]), "o", 5))


def test_both_tables_over_their_pages(spark):
    out = reports.process(*document(spark), "o")
    assert list(out) == ["current_outbreaks.clean", "current_outbreaks.analysis", "late_outbreaks.clean", "late_outbreaks.analysis"]
    rows = [tuple(r)[1:] for r in out["current_outbreaks.clean"].orderBy("row_pos").collect()]
    assert rows == [
        ("TN/CHE/2024/07/011", "Tamil Nadu", "Salem", "Chicken pox", 14, 0, "05-02-2024", "9-2-2024", "Under watch", "Team sent. Samples taken."),
        ("BR/PAT/2024/07/012", "Bihar", "Gaya Town", "Measles", 1020, 3, "06-02-2024", "08-02-2024", "Over", "Camp held."),
    ]
    assert out["current_outbreaks.analysis"].orderBy("row_pos").first()["Reporting_Date"] == datetime.date(2024, 2, 9)
    rows = [tuple(r)[1:] for r in out["late_outbreaks.analysis"].orderBy("row_pos").collect()]
    assert rows == [
        ("OR/KHO/2024/05/003", "Odisha", "Puri", "Cholera", 21, 2, datetime.date(2024, 1, 21), "Over", "Wells cleaned"),
        ("GJ/SUR/2024/05/004", "Gujarat", "Surat", "Mumps", 8, 0, datetime.date(2024, 1, 22), "Over", "Advice given"),
    ]


@pytest.mark.parametrize("place, cell", [(0, "TN/CHE/2024/07/011"), (4, "many"), (6, "31-02-2024"), (3, "  "), (9, None)])
def test_refused_records(spark, place, cell):
    """An identifier that stands twice, a count and a date that are none, a blank disease, no comment."""
    wrong = [*SECOND[:place], cell, *SECOND[place + 1 :]]
    with pytest.raises(RequestError):
        reports.process(*document(spark, current=(FIRST, GOES_ON, wrong)), "o")


def test_tables_without_records_or_columns(spark):
    with pytest.raises(RequestError):
        reports.current_outbreaks(grid_of(spark, [["tn/che/2024/07/011", *FIRST[1:]]]))
    with pytest.raises(RequestError):
        reports.current_outbreaks(grid_of(spark, [FIRST[:11]]))
    with pytest.raises(RequestError):
        reports.late_outbreaks(grid_of(spark, [STRAIGHT]))


def test_questions_about_a_known_report(spark):
    engine = catalogs.questions(*document(spark), "o")

    def answer(text):
        return [tuple(r) for r in engine.ask(text)[1].answer.collect()]

    assert answer("Which state had the highest cases?") == [("Bihar", 1020.0)]
    assert answer("Total late deaths") == [(2.0,)]
    assert answer("Average late reported cases by disease from 2024-01-22 to 2024-01-31") == [("Mumps", 8.0)]
    assert set(catalogs.CATALOGS) == {r.name for r in reports.REPORTS}


def test_command_line_on_a_known_report(spark, tmp_path, capsys):
    pages, grid = document(spark)
    pages.write.parquet(str(tmp_path / "pages"))
    grid.write.parquet(str(tmp_path / "grid"))
    given = ["--pages", str(tmp_path / "pages"), "--grid", str(tmp_path / "grid"), "--document", "o"]

    def run(*args):
        return cli.main(list(args)), capsys.readouterr()

    code, said = run("profiles")
    assert code == 0 and "weekly_outbreak_report" in said.out and "  Table: late_outbreaks" in said.out
    code, said = run("process", *given, "--out", str(tmp_path / "out"))
    assert code == 0 and "late_outbreaks.clean: 2 rows, 9 columns" in said.out
    assert (tmp_path / "out" / "current_outbreaks_analysis.csv").read_text("utf-8-sig").startswith("Unique_ID,State_UT")
    assert run("process", *given, "--out", str(tmp_path / "out"))[0] == 2  # the files are there
    code, said = run("tables", *given)
    assert code == 0 and set(json.loads(said.out)) == {"current_outbreaks", "late_outbreaks"}
    code, said = run("ask", *given, "--question", "Total late deaths")
    assert code == 0 and list(json.loads(said.out)["answer"][0].values()) == [2.0]
    assert run("ask", "--pages", "x")[0] == 2 and run("describe")[0] == 2
