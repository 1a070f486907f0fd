"""The pipeline's stages against a plain Python version, on odd tables."""

import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .cases import documents, texts
from .test_document_operators import SECRETS, brute_spans, family, jaccard_groups

NAMES = ("_dropped", "dropped", "place", "_clean", "clean", "_text_key", "text_key", "_spans", "spans", "_id", "id", "_hash", "hash", "_p", "p", "lang_pred", "pack_group", "row_key", "ids", "digest")


def table(spark, path, rows):
    frame = documents(spark, rows=rows)
    frame = frame.withColumns({c: F.lit(7) for c in NAMES if c not in frame.columns})
    frame.repartition(2).write.parquet(str(path))
    return spark.read.parquet(str(path))


def masked(text):
    spans = sorted((int(s), int(e)) for s, e in re.findall(r":(\d+):(\d+)", brute_spans(text)))
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def plain_version(rows):
    """doc_id, text after all filtering stages; the rows have no weak secrets and all letters are labelled."""
    kept = [(k, t, lang) for k, t, lang in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for k, t, _ in kept:
        last[t] = max(last.get(t, -1), -1 if k is None else k)
    once = [(None if k == -1 else k, t, "en") for t, k in last.items()]
    parts = jaccard_groups(once, 5, 80)
    gone = {k for k, _, component in parts if k != component and k != -1}
    return {k: masked(t) for k, t, _ in once if k not in gone}


def test_pipeline_against_plain_python(spark, tmp_path):
    known = [t for t in SECRETS if not t or not re.search("short12|user_id|https", t)]
    rows = texts() + [(100 + i, t, "en") for i, t in enumerate(family(1, 12, 120, 6))] + [(200 + i, t, None) for i, t in enumerate(known)] + [(3, texts()[0][1], "en")] * 2
    docs, work = table(spark, tmp_path / "in", rows), tmp_path
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{work}/{k}")
        docs = spark.read.parquet(f"{work}/{k}")
        if k == len(corpus_pipeline.STAGES) - 2:
            assert all(docs.agg(*[F.min(c).alias(c) for c in NAMES if dict(docs.dtypes)[c] == "int"]).first()[c] == 7 for c in NAMES if dict(docs.dtypes)[c] == "int")
            texts_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = plain_version(rows)
    assert texts_of == want
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(want)
    for key, found in pieces.items():
        ids = np.array(code.encode(want[key], add_special_tokens=False).ids + [1], "<u4")
        found.sort(key=lambda r: r["start"])
        assert [r["start"] for r in found] == [0, *np.cumsum([r["length"] for r in found])[:-1]] and sum(r["length"] for r in found) == len(ids) == found[0]["doc_tokens"]
        assert [r["ids_crc32"] for r in found] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in found]


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (2, "", None), (2, "", None), (None, "12", "en")]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    """An empty table, and one whose texts are all null, empty or without letters."""
    table(spark, tmp_path / "documents.parquet", rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_each_odd_table(spark, tmp_path):
    odd = table(spark, tmp_path / "odd", [(1, None, None), (1, None, None), (None, "", "en"), (5, "a " * 40_000, "en"), (5, "a " * 40_000, "en"), (6, "😀", None)])
    rest = {name: stage(spark, odd, "").select("doc_id").collect() for name, stage in corpus_pipeline.STAGES}
    assert rest["language_id"] == []  # nothing is labelled, so no language can be learned
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rest["exact_dedup"]) == [1, 5, 6]
    assert len(rest["ngram_join"]) == len(rest["secret_scan"]) == 6 and {r["doc_id"] for r in rest["packing"]} == {1, None, 5, 6}
