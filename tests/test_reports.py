"""CSV that people hand in and get, the review page, and what a run is asked for."""

from __future__ import annotations

import csv
import glob
import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from framewise.functions.files import normal_path
from framewise.functions.scoring import PROFILES
from framewise.operators.options import RunOptions
from framewise.operators.replan import Session, Settings
from framewise.sinks.reports import review_page, write_csv, write_review
from framewise.sources.reports import read_feedback

from .test_replan import RULES, START, captures


def test_normal_paths(spark):
    paths = ["/a/b", "/a//b/", "/a/./b/../c", "/../a", "/a/..", "file:///a/../b", "s3a://bucket/a/./b", "hdfs://h:1/..", "/a/.b/..c/d.", "/...", "/", "/ä/é/../ü", None]
    want = ["/a/b", "/a/b", "/a/c", "/a", "/", "file:///b", "s3a://bucket/a/b", "hdfs://h:1/", "/a/.b/..c/d.", "/...", "/", "/ä/ü", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = {r["i"]: r["n"] for r in rows.select("i", normal_path(F.col("p")).alias("n")).collect()}
    assert [got[i] for i in range(len(paths))] == want
    plain = [p for p in paths if p and p.startswith("/")]
    assert [got[paths.index(p)] for p in plain] == [os.path.normpath(p) for p in plain]


def test_feedback_of_spreadsheets(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes('\ufefffile_path,note,decision\r\n"a ""1"", b.jpg",x,Keep\r\n\r\nd/../c.jpg,,\u00a0REJECT\t\r\n/r/c.jpg,,\r\n./e\\f.jpg,,keep\r\n/r//c.jpg,,keep\r\n'.encode())
    assert {tuple(r) for r in read_feedback(spark, str(path), "/r").collect()} == {('/r/a "1", b.jpg', "keep"), ("/r/c.jpg", "keep"), ("/r/e\\f.jpg", "keep")}


@pytest.mark.parametrize("text, told", [("a,keep\nb,\nc,maybe\nd,keep\n", "invalid decision in row 4 of .*f.csv"), ("a,keep\n,reject\n", "no path in row 3 of .*f.csv")])
def test_bad_feedback_rows_are_named(spark, tmp_path, text, told):
    (tmp_path / "f.csv").write_text("file_path,decision\n" + text)
    with pytest.raises(Exception, match=told):
        read_feedback(spark, str(tmp_path / "f.csv"), "/r").collect()


def test_rows_are_numbered_over_all_splits(spark, tmp_path):
    path, before = tmp_path / "f.csv", spark.conf.get("spark.sql.files.maxPartitionBytes")
    words = ["keep"] * 3000
    words[2345] = "perhaps"
    path.write_text("file_path,decision\n" + "".join(f"{i}.jpg,{w}\n" for i, w in enumerate(words)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        with pytest.raises(Exception, match="row 2347 of"):
            read_feedback(spark, str(path), "/r").collect()
        path.write_text("file_path,decision\n" + "".join(f"{i % 7}.jpg,{'keep' if i % 2 else 'reject'}\n" for i in range(3000)))
        want = {(f"/r/{i % 7}.jpg", "keep" if i % 2 else "reject") for i in range(2993, 3000)}
        assert {tuple(r) for r in read_feedback(spark, str(path), "/r").collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_feedback_without_its_column_or_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("path,decision\nx,keep\n")
    with pytest.raises(ValueError, match="file_path"):
        read_feedback(spark, str(tmp_path / "a.csv"), "/r")
    (tmp_path / "b.csv").write_text("file_path\nx\n")
    assert read_feedback(spark, str(tmp_path / "b.csv"), "/r").count() == 0
    (tmp_path / "c.csv").write_text('file_path,decision\n"a\nb.jpg",keep\nc.jpg,never\n')
    with pytest.raises(Exception, match="row 3 of"):
        read_feedback(spark, str(tmp_path / "c.csv"), "/r", multiline=True).collect()


def test_reports_keep_quotes_and_blanks(spark, tmp_path):
    names = ['a "b", c', " d ", "e\\f", 'g\\"h', ""]
    write_csv(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, file_path string"), str(tmp_path / "r"), "i")
    rows = [r for f in sorted(glob.glob(f"{tmp_path}/r/*.csv")) for r in csv.DictReader(open(f, newline=""))]
    assert [r["file_path"] for r in rows] == names


class Page(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.tags, self.open, self.text = [], [], {}
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, dict(attrs)))
        self.open.append(tag)

    def handle_data(self, data):
        if self.open:
            self.text.setdefault(self.open[-1], []).append(data.strip())

    def of(self, tag):
        return [a for t, a in self.tags if t == tag]


def frames(spark):
    shape = "group long, burst_rank long, burst_id long, file_path string, composite_score double, score_reason string, selection_rank long, burst_winner boolean, portfolio_selected boolean, thumbnail string, musiq_score double"
    return spark.createDataFrame([
        (1, 1, 7, '/r/a"<i>.jpg', 0.9, "sharp & <b>clear</b>", 1, True, True, None, 61.25), (1, 2, 7, "/r/b #1.jpg", 0.8, None, None, False, False, "t/b?.png", None),
        (2, 1, 8, "/r/c.jpg", 0.7, "", 2, True, False, None, None), (3, 2, 9, "/r/d.jpg", 0.6, "", None, False, True, None, None), (4, 1, 10, "/r/e.jpg", 0.5, "$$x ${y}", 3, True, False, None, None),
    ], shape)


def test_review_page_shows_bursts_and_decisions(spark):
    text = review_page(frames(spark), title='run "1" </script>')
    page = Page(text)
    assert [s["class"] for s in page.of("section")] == ["burst", "alone"]
    assert [f["data-path"] for f in page.of("figure")] == ['/r/a"<i>.jpg', "/r/b #1.jpg", "/r/c.jpg", "/r/d.jpg", "/r/e.jpg"]
    assert [i.get("src") for i in page.of("img")][:3] == ["/r/a%22%3Ci%3E.jpg", "t/b%3F.png", "/r/c.jpg"]
    assert page.text["mark"][0] == "Pick" and "Lost" in page.text["mark"] and page.text["mark"].count("Exported") == 2
    assert "5 photos, 1 bursts, 2 exported." in text and "Burst 7, 2 frames" in text and "MUSIQ 61.2" in text and "Feedback keep <mark>Exported</mark> d.jpg" in text
    assert "<b>clear" not in text and text.count("</script>") == 1 and "$$x ${y}" in text
    assert review_page(frames(spark).where("false"))


def test_review_page_is_written_whole_and_bounded(spark, tmp_path):
    write_review(frames(spark), f"{tmp_path}/run_7/review.html", limit=2)
    page = Page((tmp_path / "run_7" / "review.html").read_text())
    assert len(page.of("figure")) == 2 and page.text["title"][0] == "run_7"


def test_summary_of_a_session(spark):
    rows = captures(spark)
    session = Session(rows, START, RULES)
    one = session.summary().first()
    assert (one["requested"], one["capped"], one["lowest_score"]) == (0, False, None) and one["selected"] == one["keeps"] > 0
    assert one["notes"] == [f"{one['keeps']} pinned, more than the target; all are chosen"]
    session.change("1000000")
    one = session.summary().first()
    chosen = session.selection().where("feedback_decision <> 'keep'")
    assert one["capped"] and one["requested"] == one["base"] < one["photos"] and one["lowest_score"] == chosen.agg(F.min("composite_score")).first()[0]
    assert len(one["notes"]) == 1 + (one["selected"] < one["requested"])
    session.close()


def test_options_are_checked_before_a_run(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "f.csv").write_text("file_path\n")
    (tmp_path / "link").symlink_to(tmp_path)
    source = str(tmp_path / "in")
    assert RunOptions(source, f"{source}/out", files={"decisions": str(tmp_path / "f.csv")}).check(spark).batch == 8
    assert RunOptions(source, f"{source}-out").check(spark)
    for output in (source, f"{source}/", str(tmp_path), f"file:{tmp_path}/in/deep/..", f"{tmp_path}/link", "/"):
        with pytest.raises(ValueError, match="is the source or above it"):
            RunOptions(source, output).check(spark)
    with pytest.raises(ValueError, match="no folder .*; no file .*in for weights"):
        RunOptions(f"{source}/none", f"{source}/out", files={"weights": source}).check(spark)
    for bad in ({"batch": 0}, {"review": -1}, {"cache": "some"}):
        with pytest.raises(ValueError):
            RunOptions(source, source, **bad)
    with pytest.raises(ValueError):
        Settings(PROFILES["balanced"], diversity=1.5)
