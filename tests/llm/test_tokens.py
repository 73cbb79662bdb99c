"""Token operators against their libraries, and exact round trips (3, 4, 5, 7)."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from routeyard.llm import byte_bpe, library, packing, token_counts, token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TIKTOKEN, PIECE = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("path,rule", [(BYTE, library.BYTE_LEVEL), (WORD, library.WORDS)])
def test_encoder_equals_the_library(odd_texts, path, rule):
    encoder = library.Encoder(path, rule)
    assert library.same_merges(encoder.library, rule)
    got = encoder.encode(pa.array(odd_texts))
    for text, ids in zip(odd_texts, got):
        assert ids.tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids


def check_pieces(df, texts, window):
    """Pieces tile every document, sequences are gapless, and ids are those of the library; returns padding's share."""
    lib = library.open_tokenizer(BYTE)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = df.collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(want)
    for i, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            ids = np.array(want[i][at:at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(want[i]) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
            at += r["length"]
        assert at == len(want[i])
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    return padding / max(1, total)


def test_packing_tiles_every_document(make_docs, odd_texts):
    texts = dict(enumerate(odd_texts))
    docs = make_docs(odd_texts)
    check_pieces(packing.pack(docs, BYTE), texts, 2048)
    check_pieces(packing.pack(docs, BYTE, window=64, block=300), texts, 64)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_packing_wastes_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check_pieces(packing.pack(docs, BYTE), texts, 2048) < 0.02


def test_packing_keeps_order_and_repeated_ids(make_docs):
    docs = make_docs(["b. b", "a", "b. b", None], ids=[3, 3, 3, None])
    rows = packing.pack(docs, BYTE).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "3", "3", "None"]


def plain_cost(places, fees, window):
    cost = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= window:
                waste = 0 if n & (n - 1) == 0 else window - n
                cost[j] = min(cost[j], cost[i] + waste + fees[j])
    return cost[-1]


def test_monotone_queue_finds_the_cheapest_cuts():
    rng = np.random.default_rng(3)
    for window in (8, 37, 64):
        for _ in range(40):
            places = np.concatenate([[0], np.cumsum(rng.integers(1, window // 2, rng.integers(1, 40)))])
            fees = rng.choice([0.0, 2.0, 9.0], len(places))
            chain = packing.best_cuts(places, fees, window, final=True)
            cost = 0.0
            for i, j in zip(chain, chain[1:]):
                n = int(places[j] - places[i])
                assert 0 < n <= window
                cost += (0 if n & (n - 1) == 0 else window - n) + fees[j]
            assert chain[0] == 0 and chain[-1] == len(places) - 1
            assert cost == pytest.approx(plain_cost(places.tolist(), fees.tolist(), window))


def test_token_files_round_trip(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    got = by_id(token_files.token_digests(docs, WORD))
    lib, at = library.open_tokenizer(WORD), 0
    for i, text in enumerate(odd_texts):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_digests(docs.limit(0), WORD).count() == 0
    least = token_files.token_digests(make_docs(["a b", "c", "d"], ids=[None, -(1 << 63), (1 << 63) - 1]), WORD).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in least) == [(False, 0), (True, -(1 << 63)), (True, (1 << 63) - 1)]
    repeated = token_files.token_digests(make_docs(["a b", "a b", "c"], ids=[None, 4, 4]), WORD).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(repeated, key=lambda r: r["start"])] == [(None, 0), (4, 3), (4, 5)] or \
        [r["doc_id"] for r in sorted(repeated, key=lambda r: r["start"])] == [None, 4, 4]


def test_readers_decompress_only_what_they_need():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_ids=100)
    docs = [np.arange(n, dtype=np.uint32) + 7 * n for n in (30, 250, 0, 99, 1, 400)]
    for i, ids in enumerate(docs):
        writer.add(i if i else None, ids)
    writer.close()
    raw = out.getvalue()
    reader = token_files.FrameReader(io.BytesIO(raw), len(raw))
    opened = []
    whole = reader.frame
    reader.frame = lambda k: opened.append(k) or whole(k)
    assert np.concatenate([p for _, p in reader.parts([3])]).tolist() == docs[3].tolist()
    assert opened == [2, 3] and reader.doc_ids[0] == token_files.NULL_ID
    for d, ids in enumerate(docs):
        parts = [p for _, p in reader.parts([d])]
        assert (np.concatenate(parts).tolist() if parts else []) == ids.tolist()
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(stream, "<u4").tolist() == np.concatenate(docs).tolist()
    reader.sums = reader.sums.copy()
    reader.sums[2] ^= 1
    with pytest.raises(ValueError):
        list(reader.parts([3]))
    with pytest.raises(ValueError):
        token_files.FrameReader(io.BytesIO(raw[:-3]), len(raw) - 3)


def test_token_counts_equal_the_library(make_docs, odd_texts):
    model = token_counts.Counter(PIECE).model
    texts = [*odd_texts, "ab" * 300 + " c  d " * 20, " " * 200 + "a b", "no-blank-" * 4000]
    got = by_id(token_counts.count_tokens(make_docs(texts), PIECE, limit=100, chunk=24, overlap=4))
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(make_docs(["a"]).limit(0), PIECE).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key-{i}".encode() for i in range(3001)]
    table = byte_bpe.PerfectHash(keys)
    assert table.index(byte_bpe.hashes(keys)).tolist() == list(range(3001))
    assert sorted(table.order.tolist()) == list(range(3001))


def test_byte_bpe_equals_tiktoken(make_docs, odd_texts):
    import tiktoken

    bpe = byte_bpe.ByteBpe(TIKTOKEN, P.PATTERN)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [t for t in odd_texts if t is None or len(t) < 40_000]       # the library gives up on very long pieces
    got = by_id(byte_bpe.digests(make_docs(texts), TIKTOKEN, P.PATTERN))
    for i, t in enumerate(texts):
        ids = np.array(known.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    long = "x" * 50_000
    ids, counts = bpe.encode(pa.array([long]))
    assert bpe.decode(ids, counts)[0].decode() == long
    assert byte_bpe.digests(make_docs(["a"]).limit(0), TIKTOKEN, P.PATTERN).count() == 0
