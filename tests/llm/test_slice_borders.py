"""Repeats just behind the border of two slices of a long text."""

import numpy as np

import brute
from creditloom.llm import repeats


def test_repeats_at_slice_borders(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)  # borders every 924 bytes; anchors are taken here, workers only compare them
    chance = np.random.default_rng(7)
    long = chance.integers(97, 123, 8000, dtype=np.uint8).tobytes()
    docs = [(0, long), *[(1 + k, long[at:at + n]) for k, (at, n) in enumerate(
        (border + off, n) for border in range(924, 7000, 924) for off in (-90, -40, -3, 0, 1, 7, 30, 70) for n in (100, 120, 175))]]
    docs += [(len(docs), b"start " + long[900:5000] + b" end")]
    rows = []
    for doc, raw in docs:
        for _ in range(2 if doc % 5 == 0 else 1):  # some documents come twice
            for h, a, lo, hi in zip(*(x.tolist() for x in (lambda t: (t[0].view(np.int64), *t[1:]))(repeats.anchors(raw))), strict=True):
                rows.append((h, doc, doc, a, bytearray(raw[lo:a][::-1]), bytearray(raw[a:hi + repeats.LENGTH])))
    found = repeats._later_spans(spark.createDataFrame(rows, repeats.CONTEXT), repeats.LENGTH).collect()
    gone = {doc: set() for doc, _ in docs}
    for r in found:
        gone[r["_r_id"]].update(range(r["_r_start"], r["_r_end"]))
    want = brute.repeats([(doc, raw.decode()) for doc, raw in docs])
    assert {doc: len(x) for doc, x in gone.items()} == {doc: w[1] for doc, w in want.items()}
