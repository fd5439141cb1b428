"""Known row counts on two scales, for an old and a new state cut from the documents."""

import pytest
import snapledger as sl
from pyspark.sql import functions as F

N = 256
CASES = {
    "snapshot": (200, 1000),
    "duplicates": (21, 135),
    "duplicate_groups": (10, 62),
    "duplicates_partial": (27, 156),
    "duplicates_partial_groups": (13, 71),
    "duplicates_size": (33, 323),
    "prefixes_of_several_sizes": (3, 12),
    "nested_groups": (189, 927),
    "removed": (14, 69),
    "added": (18, 92),
    "modified": (24, 119),
    "modified_by_size": (24, 119),
    "keys_of_both": (198, 992),
    "collisions": (166, 831),
    "without_src1": (90, 450),
    "without_src1_boundary": (190, 950),
    "without_fr": (175, 855),
    "pages": (50, 250),
    "pages_without_html": (41, 215),
    "conversations": (87, 536),
    "bytes_total": (495_892, 2_472_458),
    "bytes_avoided": (446_583, 2_222_080),
}


@pytest.fixture(scope="module", params=[("sf0.001", 0), ("sf0.01", 1)], ids=["sf0.001", "sf0.01"])
def measured(spark, request, testdata):
    sf, column = request.param
    docs = spark.read.parquet(f"{testdata}/{sf}/documents.parquet")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    snap = sl.stored(sl.snapshot(docs, key, "text"))
    partial = sl.stored(sl.snapshot(docs, key, "text", sl.PARTIAL, N))

    def state(kept, text, mode):
        return sl.snapshot(docs.where(kept).withColumn("text", text), key, "text", mode)

    first = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v0"))).otherwise(F.col("text"))
    old, new, old_sizes, new_sizes = (
        side
        for mode in (sl.FULL, sl.SIZE_ONLY)
        for side in (
            sl.stored(state(F.col("doc_id") % 10 != 0, first, mode)),
            sl.stored(state(F.col("doc_id") % 13 != 0, F.col("text"), mode)),
        )
    )
    pages = sl.snapshot(spark.read.parquet(f"{testdata}/{sf}/pages.parquet"), "url", "html")
    turns = spark.read.parquet(f"{testdata}/{sf}/conversations.parquet")
    summary = sl.duplicate_summary(snap).first()
    read = sl.scan_counters(snap, sl.PARTIAL, N).first()
    assert summary["duplicate_rows"] == sl.duplicates(snap).count()
    return column, {
        "snapshot": snap.count(),
        "duplicates": summary["duplicate_rows"],
        "duplicate_groups": summary["duplicate_groups"],
        "duplicates_partial": sl.duplicates(partial).count(),
        "duplicates_partial_groups": sl.duplicate_summary(partial).first()["duplicate_groups"],
        "duplicates_size": sl.duplicates_by_mode(snap, sl.SIZE_ONLY).count(),
        "prefixes_of_several_sizes": partial.groupBy(sl.HASH)
        .agg(F.countDistinct(sl.SIZE).alias("n"))
        .where("n > 1")
        .count(),
        "nested_groups": sl.nested_groups(sl.fingerprint_levels(docs, key, "text", prefix_bytes=N)).count(),
        "removed": sl.removed(old, new).count(),
        "added": sl.added(old, new).count(),
        "modified": sl.modified(old, new).count(),
        "modified_by_size": sl.modified(old_sizes, new_sizes, sl.SIZE).count(),
        "keys_of_both": sl.diff_flags(old, new).count(),
        "collisions": sl.path_collisions(sl.concat(old, new)).select(sl.PATH).distinct().count(),
        "without_src1": sl.exclude(snap, paths=["src1"]).count(),
        "without_src1_boundary": sl.exclude(snap, paths=["src1"], boundary=True).count(),
        "without_fr": sl.exclude(snap, suffixes=[".fr"]).count(),
        "pages": pages.count(),
        "pages_without_html": sl.exclude(pages, suffixes=["*.html"]).count(),
        "conversations": sl.snapshot(
            turns, F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"
        ).count(),
        "bytes_total": read["bytes_total"],
        "bytes_avoided": read["bytes_avoided"],
    }


def test_counts(measured):
    column, got = measured
    assert got == {name: counts[column] for name, counts in CASES.items()}
