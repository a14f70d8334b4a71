"""Licence files are compared whole whatever they say; texts of the same id and path, long ones and odd ones."""

from pyspark.sql import functions as F

from reachforge.llm import license_scan


def scan(spark, rows):
    return license_scan.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string").withColumn("dir", F.lit("own")))


def test_a_licence_file_needs_no_word_of_a_notice(spark):
    text = license_scan.TEXTS["MIT"]
    bare = "\n".join(x for x in text.split("\n\n") if x.startswith("THE SOFTWARE")) + "\nTHE SOFTWARE IS PROVIDED"
    df = spark.createDataFrame([("Terms of use: MIT", True), (bare, True), (bare, False), ("plain prose", True), ("plain prose", False), ("", True)], "t string, s boolean")
    got = [x[0] for x in df.select(license_scan.notices(F.col("t"), F.col("s"))).collect()]
    assert "Terms of use: MIT" in got[0] and bare in got[1] and got[3] == ["plain prose"] and got[4] == [] and got[5] == [""]


def test_short_headers_that_name_a_licence(spark):
    got = {r.id: r for r in scan(spark, [(1, "a/x.py", "# may be used under the terms of GPL version 3\nx = 1"), (2, "a/y.py", "# may be used under the terms of the GPL, version 2\n"), (3, "b/LICENSE", "plain words that are no licence at all"), (4, "b/z.py", "z")]).collect()}
    assert got[1].license == "GPL-3.0" and got[2].license == "GPL-2.0" and got[3].license is None and got[4].license is None


def test_long_and_odd_rows(spark):
    long = "word and word " * 40_000 + "\nReleased under the MIT License\n" + "tail " * 1000
    rows = [(1, "a/b.txt", long), (2, None, None), (None, "LICENSE", "Released under the MIT License"), (None, "LICENSE", "Released under the MIT License"), (3, "q/r", "x"), (3, "q/r", "x"), (4, "", "")]
    got = scan(spark, rows).collect()
    assert len(got) == len(rows) and next(r for r in got if r.id == 1).license == "MIT"
    assert [r.license for r in got if r.id == 3] == ["MIT", "MIT"] and next(r for r in got if r.id == 2).license is None
    assert scan(spark, []).count() == 0
