"""Archives and nearest inner products against brute force (6, 9)."""

import base64
import gzip
import hashlib
import io
import math
import random

import pytest

from routeyard.llm import topk, warc

PAGES = "page_id long, url string, html string, payload string, size long"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_equal_brute_force(spark):
    bodies = [None, "", "<p>a</p>", "<p>a</p>", "é" * 1000, "big " * 500_000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\n", "<p>a</p>"]
    ids = [7, 3, 9, 4, 1, 2, 8, None]
    pages = spark.createDataFrame([(i, None if i == 9 else f"http://x/{i}\r\n", b, "clash", 1) for i, b in zip(ids, bodies)], PAGES)
    for min_bytes in (0, 5):
        rows = warc.archive(pages.repartition(3), min_bytes).collect()
        assert len(rows) == len(ids)
        for r in rows:
            body = bodies[ids.index(r["page_id"])] or ""
            same = [i for i, b in zip(ids, bodies) if (b or "") == body and i is not None]
            first = min(same) if same else None
            revisit = len(body.encode()) >= min_bytes and r["page_id"] is not None and r["page_id"] != first
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body.encode()), digest(body))
            assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
    assert warc.archive(pages.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "u", "x", "", 0), (1, "u", "x", "", 0)], PAGES)
    assert [r["record_type"] for r in warc.archive(again).collect()] == ["response"] * 2


def test_normaliser_reads_one_stream_or_many_members():
    rng = random.Random(4)
    records = [warc.record(i, "u", rng.randbytes(rng.randint(0, 3000)), None) for i in range(50)]
    for raw in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        assert list(warc.split_records(warc.inflated(io.BytesIO(raw)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"".join(records)[:-5]])))
    assert gzip.decompress(warc.member(records[0])) == records[0]


VECTORS = "vec_id long, embedding array<float>, label int, shard long, v string"


def brute_top(rows, k, every=100):
    whole = lambda v: [math.floor(1024 * x) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(4096, 256), (40, 2)])
def test_top_k_equals_brute_force(spark, shard_rows, block_rows):
    rng = random.Random(6)
    draw = lambda n: [rng.choice([rng.gauss(0, 1), 0.0, 0.5, -0.5]) for _ in range(n)]
    rows = [(i, draw(6)) for i in range(420)] + [(i, draw(3)) for i in range(500, 504)]
    rows += [(i, [0.25] * 6) for i in range(600, 640)]                         # ties
    rows += [(None, draw(6)), (700, None), (701, [None] * 6), (702, [float("nan")] * 6), (703, [float("inf")] * 6),
             (800, [1e30] * 6), (801, [-3e30, 1.0, 0.0, 0.0, 0.0, 0.0]), (900, []), (901, [])]
    small = [(i, v) for i, v in rows if i not in (800, 801)]
    frame = lambda data: spark.createDataFrame([(i, v, 0, 1, "x") for i, v in data], VECTORS).repartition(5)
    as_floats = [(r["vec_id"], r["embedding"]) for r in frame(small).collect()]
    got = topk.top_k(frame(small), shard_rows=shard_rows, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute_top(as_floats, 10)
    huge = topk.top_k(frame(rows), shard_rows=shard_rows, block_rows=block_rows).collect()
    assert {r["query_id"] for r in huge} == {i for i, *_ in brute_top(as_floats, 10)} | {800}
    assert all(-(1 << 63) <= r["score"] < 1 << 63 for r in huge)
    assert topk.top_k(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows,block_rows", [(4096, 256), (20, 1)])
def test_an_id_asks_once(spark, shard_rows, block_rows):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(4)]) for i in range(1, 60)]
    asks = [(100, [1.0, 0.5, 0.0, 0.0]), (100, [0.5, 9.0, 9.0, 9.0]), (100, [0.5, 9.0, 9.0, 9.0]), (200, [1.0] * 4), (200, [2.0]), (201, [3.0])]
    everything = rows + rows[:5] + asks                               # some candidates twice, each listed
    got = topk.top_k(spark.createDataFrame([(i, v, 0, 1, "x") for i, v in everything], VECTORS).repartition(4),
                     shard_rows=shard_rows, block_rows=block_rows).collect()
    whole = lambda v: [math.floor(1024 * x) for x in v]
    want = []
    for q, v in ((100, [0.5, 9.0, 9.0, 9.0]), (200, [2.0])):
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(c))), i) for i, c in everything if i != q and len(c) == len(v))
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
