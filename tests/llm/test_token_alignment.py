import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import token_alignment as ta

from .cases import documents, texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Plain:
    """Whole texts with fresh tokenizers; groups from the positions where both end."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = {chr(i): i for i in shown} | {chr(0x100 + n): i for n, i in enumerate(i for i in range(256) if i not in shown)}
        self.a_bytes = lambda i: bytes(names[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        a, b, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        spelled = [self.a_bytes(i) for i in a], [self.b_bytes(i) for i in b]
        if any(b"".join(s) != whole for s in spelled):
            return None
        ends = [list(accumulate(map(len, s))) for s in spelled]
        out, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            stop = [e.index(end) + 1 for e in ends]
            out.append((a[at[0] : stop[0]], b[at[1] : stop[1]]))
            at = stop
        return out

    def rows(self, table):
        found = [self.groups(t) for _, t, *_ in table]
        links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in found]
        held = Counter(p for each in links for p in each)
        most = {}
        for (x, _), n in held.items():
            most[x] = max(n, most.get(x, 0))
        out = []
        for (key, *_), g, each in zip(table, found, links):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
            out.append((
                key, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(each.values()),
                sum(n for p, n in each.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in each.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
            ))
        return out


PLAIN = Plain()
ALIGNER = ta.AlignedChunks(A, B, max_chunks=40)
ODD = st.text(alphabet=st.sampled_from([*" \n\t\rabé😀1.,!'<>|▁_ 　\x00́語"]), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD | st.text(max_size=12) | st.sampled_from(["<|endoftext|>", "<s> a</s>", "<unk>", "<0x41>", "   ", "\r\n;\r\n"]), min_size=1, max_size=6))
def test_groups_are_those_of_whole_texts(batch):
    import pyarrow as pa

    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    got = [c.to_pylist() for c in ALIGNER.documents(pa.array(batch, pa.string()))]
    for i, text in enumerate(batch):
        groups = PLAIN.groups(text) or []
        links = Counter(x * 32000 + y for a, b in groups for x in a for y in b)
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert [c[i] for c in got[:5]] == [sum(len(g[k]) for g in groups) for k in (0, 1)] + [len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest() if groups else ""]
        assert dict(zip(got[5][i], got[6][i])) == links


LONG = ("".join(chr(97 + i * i % 26) for i in range(30_000)), "日本語" * 3000, "a" * 20_000)


@pytest.mark.parametrize("most", [ta.MOST_BROADCAST, 40, 0])
def test_equals_plain_python(spark, most):
    table = texts() + [(20 + i, t, "x") for i, t in enumerate(LONG)] + [(30, "▁ is no space", "x"), (31, "repeated row", "x"), (31, "repeated row", "x"), (None, "no identifier", "en")]
    docs = documents(spark, rows=table).withColumns({c: F.lit("x") for c in ("uid", "pairs", "links", "pair", "n", "best")})
    got = ta.align(docs, A, B, most_broadcast=most).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, PLAIN.rows(table)))


def test_no_documents(spark):
    assert ta.align(documents(spark, rows=[]), A, B).count() == 0
    assert [tuple(r) for r in ta.align(documents(spark, rows=[(1, None, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", b"aab"]), max_size=12), st.randoms())
def test_transducer(tokens, random):
    """Any two ways to cut the same bytes fall into groups at their common ends; other bytes are told."""
    whole = b"".join(tokens)
    cuts = sorted({0, len(whole)} | {random.randint(0, len(whole)) for _ in range(4)})
    other = [whole[x:y] for x, y in zip(cuts, cuts[1:]) if y > x]
    names = sorted({*tokens, *other, b"ab"})
    machine = ta.Transducer(names, names)
    ids = [[names.index(t) for t in side] for side in (tokens, other)]
    ends = [set(accumulate(map(len, side))) for side in (tokens, other)]
    groups = machine.groups(*ids)
    assert len(groups) == len(ends[0] & ends[1])
    assert all(b"".join(tokens[g[0] : g[1]]) == b"".join(other[g[2] : g[3]]) for g in groups)
    assert machine.groups(*ids) == groups and machine.groups(ids[0] + [0], ids[1]) is None
    assert machine.groups(ids[0] + [names.index(b"ab")], ids[1] + [names.index(b"ab")][:0]) is None
