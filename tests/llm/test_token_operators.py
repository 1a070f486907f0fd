import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import bpe_duckdb, packing, token_files
from docquarry.llm.chunk_encoder import encoder

from .cases import documents, texts

TOKENIZER, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


FRESH = Tokenizer.from_file(TOKENIZER)


def reference_ids(text):
    """As the library does it, special tokens' strings included."""
    return FRESH.encode(text or "", add_special_tokens=False).ids


ODD = st.text(alphabet=st.sampled_from(list(" \n\tab'sé😀1.,!")), max_size=30)
SPECIAL = st.lists(ODD | st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<", "|>", " ", "word"]), max_size=8).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD | SPECIAL, min_size=1, max_size=6))
def test_chunks_encode_as_whole_texts(batch):
    ids, counts = encoder(TOKENIZER).encode(batch)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [reference_ids(t) for t in batch]


def test_special_tokens():
    assert encoder(TOKENIZER).encode(["a <|endoftext|> b", "x<|endof", "text|>"])[0].tolist()[:4] == [64, 220, 50256, 275]
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    assert encoder(TOKENIZER, special=False).encode(["a <|endoftext|> b"])[0].tolist() == plain.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        encoder(P.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(6, 20))
def test_huffman_round_trip(ids, max_bits):
    ids = np.array(ids, np.uint32)
    counts = np.bincount(ids, minlength=1)
    lengths = token_files.code_lengths(counts, max_bits)
    assert lengths.max(initial=0) <= max_bits
    assert sum(2.0 ** -int(b) for b in lengths if b) <= 1
    _, codes = token_files.canonical_codes(lengths)
    assert token_files.BlockDecoder(lengths).decode(*token_files.encode_block(ids, codes, lengths), len(ids)).tolist() == ids.tolist()


def test_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.random.default_rng(5).integers(1, 1000, 300)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (counts * token_files.code_lengths(counts, 30)).sum() == cost


@pytest.mark.parametrize("rows", [None, []])
def test_token_files(spark, tmp_path, rows):
    docs = documents(spark, rows=rows)
    path = token_files.write_token_files(docs, f"file://{tmp_path}/files", TOKENIZER, block_ids=500)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = sorted(texts() if rows is None else rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(want)
    for g, (key, text, _) in zip(got, want):
        ids = np.array(reference_ids(text) + [2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], bytes(g["ids"])) == (key, start, len(ids), ids.tobytes())
        start += len(ids)


@pytest.mark.parametrize("rows", [None, []])
def test_packing(spark, rows):
    got = packing.pack(documents(spark, rows=rows), TOKENIZER, capacity=128, group_bytes=20_000).collect()
    by_sequence, ids_of = {}, {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        ids_of.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], bytes(p["ids"])))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 128
    every = sorted(zlib.crc32(np.array(reference_ids(t) + [1], "<u4").tobytes()) for _, t, _ in {(k, t, 0) for k, t, _ in (texts() if rows is None else rows)})
    joined = [zlib.crc32(b"".join(x for _, x in sorted(set(v)))) for v in ids_of.values()]
    assert sorted(joined) == every
    assert sum(p["length"] for p in got) == sum(len(reference_ids(t)) + 1 for _, t, _ in (texts() if rows is None else rows))


def test_first_fit_decreasing_against_a_plain_scan():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        sizes = rng.integers(1, 100, n).tolist()
        room, want = [], [0] * n
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            room[at] -= sizes[i]
            want[i] = at
        assert packing.first_fit_decreasing(sizes, 100) == want
        bins = {}
        for i, b in enumerate(want):
            bins.setdefault(b, []).append((i, 0, sizes[i]))
        filled = packing.fill_gaps(list(bins.values()), 100)
        assert sum(sum(x[2] for x in b) < 100 for b in filled) <= 1
        seen = sorted((i, k) for b in filled for i, s, length in b for k in range(s, s + length))
        assert seen == [(i, k) for i, s in enumerate(sizes) for k in range(s)]


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_duckdb.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("rows", [None, []])
def test_bpe(spark, rows):
    encoding = tiktoken_encoding()
    got = bpe_duckdb.encode_decode(documents(spark, rows=rows), RANKS, P.PATTERN).collect()
    want = [(k, encoding.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in (texts() if rows is None else rows)]
    key = lambda r: (r[0] or -1, r[2])
    assert sorted(((g["doc_id"], list(g["ids"]), bytes(g["decoded"])) for g in got), key=key) == sorted(want, key=key)


@settings(max_examples=40, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_duck_words_equal_tiktoken(batch):
    encoder_, encoding = _duck(), tiktoken_encoding()
    ids, counts, decoded = encoder_.encode_and_decode(batch)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [encoding.encode_ordinary(t) for t in batch]
    assert decoded == [t.encode() for t in batch]


def _duck(made=[]):  # noqa: B006
    if not made:
        made.append(bpe_duckdb.DuckEncoder(RANKS, P.PATTERN))
    return made[0]


SCRIPTS = st.text(alphabet=st.sampled_from(list(" \n\t\r'.,-!?sdtéÜß\u00a0\u2003\u3000\u180e\u0085\u0301日ก١²ªx1")), max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(SCRIPTS, min_size=1, max_size=5))
def test_chunks_of_a_crowded_table_encode_as_whole_texts(batch):
    """A table of 20 chunks forgets all the time."""
    small = encoder(TOKENIZER, 20)
    for _ in range(2):
        ids, counts = small.encode(batch)
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [reference_ids(t) for t in batch]


@pytest.mark.parametrize("word", ["o" * 3000, "ha" * 1500, "-" * 2000, "isaac" * 500, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3000)), "日本語" * 400, "ab" * 300 + "a" * 700])
def test_long_words_equal_tiktoken(word):
    ids, counts, decoded = _duck().encode_and_decode([word, f"x {word}!"])
    encoding = tiktoken_encoding()
    assert ids.tolist() == encoding.encode_ordinary(word) + encoding.encode_ordinary(f"x {word}!")
    assert decoded == [word.encode(), f"x {word}!".encode()]


def test_decoding_of_given_ids(spark):
    rows = [(1, [15496, 995]), (2, []), (3, None), (3, [220]), (None, [10185, 50000])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("decoded", F.lit("x"))
    got = sorted(((r["doc_id"] or 0), bytes(r["decoded"])) for r in bpe_duckdb.decode(frame, RANKS, P.PATTERN).collect())
    encoding = tiktoken_encoding()
    assert got == sorted((k or 0, encoding.decode_bytes(ids or [])) for k, ids in rows)
    with pytest.raises(Exception, match="vocabulary"):
        bpe_duckdb.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), RANKS, P.PATTERN).collect()
