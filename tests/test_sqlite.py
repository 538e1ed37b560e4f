"""SQLite tables in ranges of rowids: whole, pruned, ordered, missing and odd ones."""

import sqlite3

import pytest

from tickloom.sources.sqlite import read_table, require_tables


@pytest.fixture
def journal(tmp_path):
    path = str(tmp_path / "jour nal.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE tenders (ts REAL, "the id" INTEGER, venue TEXT, payload BLOB, loose)')
        db.executemany("INSERT INTO tenders VALUES (?, ?, ?, ?, ?)", [(i / 2, i, f"v{i % 3}", bytes([i % 256]), i) for i in range(1000)])
        db.execute("DELETE FROM tenders WHERE \"the id\" BETWEEN 100 AND 899")
        db.execute("INSERT INTO tenders VALUES (NULL, 'no number', CAST(x'ff41' AS TEXT), 'text', NULL)")
        db.execute("CREATE TABLE vacant (a INTEGER)")
    return path


def test_all_rows_come_once_whatever_the_ranges(spark, journal):
    for partitions in (1, 2, 7, 100):
        t = read_table(spark, journal, "tenders", partitions=partitions)
        assert t.dtypes == [("ts", "double"), ("the id", "bigint"), ("venue", "string"), ("payload", "binary"), ("loose", "string")]
        assert partitions / 2 < t.rdd.getNumPartitions() <= partitions
        ids = sorted(r["the id"] for r in t.collect() if r["the id"] is not None)
        assert ids == [*range(100), *range(900, 1000)]
    odd = t.filter("ts IS NULL").first()
    assert odd["the id"] is None and odd.venue == "�A" and bytes(odd.payload) == b"text" and odd.loose is None


def test_projection_and_order(spark, journal):
    t = read_table(spark, journal, "tenders", "venue string, ts double").filter("venue = 'v1'").orderBy("ts")
    assert [r.ts for r in t.limit(3).collect()] == [0.5, 2.0, 3.5] and t.columns == ["venue", "ts"]


def test_missing_and_empty_tables(spark, journal):
    assert read_table(spark, journal, "tendres", "a long").count() == 0
    assert read_table(spark, journal, "vacant").count() == 0
    with pytest.raises(Exception, match="has no table tendres"):
        read_table(spark, journal, "tendres").count()


def test_the_file_is_never_written(spark, tmp_path):
    with pytest.raises(Exception, match="unable to open"):
        read_table(spark, str(tmp_path / "absent.db"), "t", "a long").count()
    assert not (tmp_path / "absent.db").exists()


def test_guards_name_what_is_missing(spark, journal):
    require_tables(journal, "tenders", "vacant")
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        require_tables(journal, "b", "tenders", "a")
    with pytest.raises(Exception, match=r"no columns \['nope'\]"):
        read_table(spark, journal, "tenders", "venue string, nope long").count()
