"""What the tiles of the n-gram join send to their tasks."""

from tidewire.llm import ngram_join as ng


def test_signs_travel_once_per_task(spark, monkeypatch):
    """Rows of tiles hold no signs, and one that stands on both sides of its tile goes there once."""
    shingles = list(range(1, 13))
    tiled = spark.createDataFrame(
        [(t, band, band == 7, node, 12) for t in shingles[:4] for band in (7, 8) for node in (1, 2)],
        "token long, band int, upper boolean, node long, size long")
    roots = spark.createDataFrame([], "node long, root long")
    bits = bytearray([255, 15, 0, 0, 0, 0, 0, 0])
    signs = spark.createDataFrame([(n, bits, 9, shingles) for n in (1, 2)], "node long, bits binary, need int, known array<long>")
    real, seen = ng.store, []

    def store(df):
        out = real(df)
        seen.append((set(df.columns), out.count()))
        return out

    monkeypatch.setattr(ng, "store", store)
    for best, wanted in ((False, [(1, 2)]), (True, [(1, 2), (2, 1)])):
        seen.clear()
        found = ng.candidates(tiled, roots, signs, 75, best)
        columns, rows = seen[0]
        # Eight tiles of two sets: sixteen rows (before, twenty-four with signs in each).
        assert rows == 16 and not columns & {"bits", "known"}
        assert set(map(tuple, found.select("a", "b").collect())) <= set(wanted)
        assert found.count() >= 1
