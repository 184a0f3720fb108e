"""Dumps of features are compressed where a query writes and reads them."""

import os

from fnatlas.jobs import dumps

SF = "/root/testdata/sf0.001"


def test_compressed_dump(spark, monkeypatch):
    """The same features from an eighth of the plain dump's bytes, or fewer."""
    size = lambda path: sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(path) for f in fs if f.startswith("part-"))
    told = []
    monkeypatch.setattr(dumps, "feature_dump", lambda *a, f=dumps.feature_dump: told.append(f(*a)) or told[-1])
    rows = lambda d: sorted(map(str, d.collect()))
    kept = rows(dumps.features_read(spark, SF))
    plain = dumps.feature_dump(spark, SF)
    fields = kept and rows(dumps.readers.read_features(spark, plain, files="*.json").select("version", "function_id"))
    assert len(fields) == len(kept) and 8 * size(told[0]) < size(plain)
