"""display_rows over every event."""

import json

from pagemill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_event_shows_its_values(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "props").collect()
    want = sorted((r.event_id, r.event_type, sum(v not in ("", None) for v in json.loads(r.props).values())) for r in events)
    assert sorted(map(tuple, catalog.QUERIES["display_rows"](spark, SF).collect())) == want
