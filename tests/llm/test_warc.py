"""What the archive reader inflates, and how archives are cut into files."""

import pytest
from pyspark.sql.datasource import EqualTo
from snapledger.llm import queries, warc


@pytest.fixture
def archive(tmp_path):
    rows = [{"record_type": "revisit" if i % 4 == 0 else "response", "record_id": f"<urn:page:{i}>", "target_uri": "u", "refers_to": None,
             "payload_digest": "sha1:X", "payload_bytes": 5000, "payload": bytes([i]) * 5000} for i in range(40)]
    writer = warc._Writer(str(tmp_path / "a"))
    writer.commit([writer.write(iter(rows))])
    return str(tmp_path / "a")


def inflated(monkeypatch, archive, kind, wants):
    """Records read, and payloads inflated for them."""
    calls = []
    plain = warc.members

    def counting(data):
        for headers, payload in plain(data):
            yield headers, lambda payload=payload: calls.append(1) or payload()

    monkeypatch.setattr(warc, "members", counting)
    reader = warc._Reader({"path": archive, "payload": wants})
    assert list(reader.pushFilters([EqualTo(("record_type",), kind)])) == []
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return len(rows), len(calls)


def test_only_wanted_payloads_are_inflated(monkeypatch, archive):
    assert inflated(monkeypatch, archive, "revisit", "false") == (10, 0)
    assert inflated(monkeypatch, archive, "response", "true") == (30, 30)


def test_files_end_at_their_size(monkeypatch, tmp_path, archive):
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    rows = [{"record_type": "response", "record_id": str(i), "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"x"} for i in range(10)]
    writer = warc._Writer(str(tmp_path / "b"))
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))])
    reader = warc._Reader({"path": str(tmp_path / "b")})
    files = reader.partitions()
    assert 2 <= len(files) <= 10
    assert [r[1] for p in files for r in reader.read(p)] == [str(i) for i in range(10)]


def test_query_reads_apart(spark, testdata):
    """The predicate reaches the source, in both reads of the registered query."""
    found = queries.QUERIES["op4_warc"](spark, f"{testdata}/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 2 and "record_type#" in plan
    pages = spark.read.parquet(f"{testdata}/sf0.001/pages.parquet")
    assert found.count() == pages.count()
    kinds = {r.record_type for r in found.collect()}
    assert kinds <= {"response", "revisit"} and "response" in kinds
