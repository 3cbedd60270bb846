"""Revisions of sheets as a stream that stops and starts again."""

import random
from datetime import datetime, timedelta

import pytest

pytest.importorskip("google.protobuf")

from planspark.streaming import revision_stream  # noqa: E402

PAGE = "sheet_number string, upload string, uploaded_at timestamp, rev_label string, content_hash string"


def plain(pages):
    """The events of pages by going through them."""
    sheets, out = {}, []
    for sheet, upload, _, label, content in pages:
        if not sheet:
            out.append((sheet, upload, "unnumbered", None, None, None))
            continue
        revs = sheets.setdefault(sheet, [])
        same = next((r for r in revs if content is not None and r[1] == content), None)
        if same:
            out.append((sheet, upload, "duplicate", None, None, same[0]))
            continue
        first = revs[0][0] if revs else None
        taken = revs and label and any(r[2] == label for r in revs)
        kind = "new_sheet" if not revs else "conflict" if taken else "new_revision"
        named = f"{label} (alt {upload})" if taken else label or ("Rev.0" if not revs else f"Unlabelled {upload}")
        revs.append((upload, content, named))
        out.append((sheet, upload, kind, named, "accepted" if first is None else "pending", first))
    return out


def test_a_stream_that_starts_again_goes_on_where_it_stopped(spark, tmp_path):
    rng = random.Random(3)
    begin = datetime(2024, 1, 1)
    pages = [(rng.choice(["T-101", "T-102", "T-103", None, "T-104"]), f"u{k:03d}", begin + timedelta(minutes=k), rng.choice([None, "A", "B", "C"]), rng.choice([None, *"pqrstuvw"])) for k in range(90)]
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    conf = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (pages[:40], pages[40:41], pages[41:]):  # three runs, each from the checkpoint of the one before
            spark.createDataFrame(part, PAGE).coalesce(1).write.mode("append").parquet(source)
            stream = revision_stream.revisions(spark.readStream.schema(PAGE).parquet(source))
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(conf, had) if had else spark.conf.unset(conf)
    got = [(r.sheet_number, r.upload, r.kind, r.rev_label, r.status, r.of_upload) for r in spark.read.parquet(out).orderBy("upload").collect()]
    assert got == plain(pages) and {"new_sheet", "duplicate", "conflict", "new_revision", "unnumbered"} == {r[2] for r in got}
