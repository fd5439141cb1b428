"""Text records with line breaks, in files read by several tasks."""

import random

import pytest
import snapledger as sl
from pyspark.errors import PySparkException
from snapledger.sources import records

AWKWARD = ['a"b', "c\td", "e\\f", "g\nh", "\n", '"', "\\", "\\\n", '\n"', '\t"\n"\t', "i\r\nj", "NA", "null", " lead ", "tail\\", "007", "ü/日", "", "k\n\n\nl"]


def shipped(spark):
    from snapledger.sources.ship import ship

    ship(spark)


@pytest.mark.parametrize("split", [64, 1000])
@pytest.mark.parametrize("quoted", [False, True])
def test_a_file_in_many_splits(spark, frame, rows, conf, tmp_path, split, quoted):
    """Splits begin at any line of any record; every path comes back, once."""
    shipped(spark)
    rng = random.Random(split)
    some = [("".join(rng.choice(AWKWARD) for _ in range(rng.randint(1, 4))) + str(i), rng.choice(["x", None, "12", ""]), rng.choice([None, i])) for i in range(400)]
    some += [(p, "h", 1) for p in AWKWARD] + [(None, None, None)]
    df = frame(*some).coalesce(1)
    sl.write_tsv(df, str(tmp_path / "s.tsv"), sl.FULL, quote_numbers=quoted)
    conf("spark.sql.files.maxPartitionBytes", str(split))
    conf("spark.sql.files.openCostInBytes", "1")
    found = sl.read_tsv(spark, str(tmp_path / "s.tsv"), sl.FULL)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "s.tsv"))
    assert lines.rdd.getNumPartitions() > 5
    want = [(p or None, h or None, n) for p, h, n in some] if quoted else some  # all quoted, null and empty look alike
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_paths_that_look_like_records(spark, frame, conf, tmp_path):
    """Where a split takes the inside of a path for records, the quotes before it tell, and the file is read otherwise."""
    shipped(spark)
    fake = "begin" + "\n\t\t5" * 40 + "\nend"
    some = [(fake + str(i), "h", i) for i in range(20)]
    sl.write_tsv(frame(*some).coalesce(1), str(tmp_path / "s.tsv"), sl.FULL)
    conf("spark.sql.files.maxPartitionBytes", "100")
    conf("spark.sql.files.openCostInBytes", "1")
    assert sorted(map(tuple, sl.read_tsv(spark, str(tmp_path / "s.tsv"), sl.FULL).collect())) == sorted(some)


def test_only_text_is_quoted(spark, frame, tmp_path):
    shipped(spark)
    sl.write_tsv(frame(('a"b\\', None, 12)), str(tmp_path / "s.tsv"), sl.FULL, quote_numbers=False)
    text = [r[0] for r in spark.read.text(str(tmp_path / "s.tsv")).collect()]
    assert set(text) == {'"relative_path"\t"full_hash"\t"file_size_bytes"', '"a\\"b\\\\"\t\t12'}


def test_spark_reads_what_is_written(spark, frame, rows, tmp_path):
    shipped(spark)
    some = [(p, "h", i) for i, p in enumerate(["a\nb", "c\td", "e\\", 'f"', "g"])]
    sl.write_tsv(frame(*some), str(tmp_path / "s.tsv"), sl.FULL, quote_numbers=False)
    plain = spark.read.options(sep="\t", header=True, escape="\\", multiLine=True).csv(str(tmp_path / "s.tsv"))
    assert {(r[0], r[1], r[2]) for r in plain.collect()} == {(p, h, str(n)) for p, h, n in some}


@pytest.mark.parametrize(
    "text, message",
    [
        ('"relative_path"\t"full_hash"\t"file_size_bytes"\n"a"\t"1"\n', "not a record"),
        ('"relative_path"\t"full_hash"\t"file_size_bytes"\n"a"\t"1"\tx\n', "not a record"),
        ('"relative_path"\t"full_hash"\t"file_size_bytes"\n"a\t"1"\t1\n', "not a record|not closed"),
        ('"relative_path"\t"full_hash"\t"file_size_bytes"\n"a\n', "not closed"),
    ],
)
def test_bad_files_fail(spark, tmp_path, text, message):
    shipped(spark)
    (tmp_path / "s.tsv").write_text(text)
    with pytest.raises((ValueError, PySparkException), match=message):
        sl.read_tsv(spark, str(tmp_path / "s.tsv"), sl.FULL).collect()


def test_parsing():
    d = records.Dialect(["relative_path", "full_hash", "file_size_bytes"])
    assert d.parse('"a\\"\\\\"\t\t') == ['a"\\', None, None]
    assert d.parse('""\t"x"\t7') == ["", "x", 7] and d.parse('""\t"x"\t"7"') == [None, "x", 7] and d.parse('"p"\t""\t""') == ["p", None, None]
    assert d.is_end('rest"\t"h"\t1') and d.is_end('h"\t1') and not d.is_end('"a"\t"h"\t1')
    assert records.odd_quotes('a"') and not records.odd_quotes('a\\"') and not records.odd_quotes('"a"')
