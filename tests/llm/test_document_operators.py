import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import exact_dedup, language_id, ngram_join, secret_scan
from docquarry.llm.components import connected_components
from docquarry.llm.shingles import shingle_set

from .cases import documents, texts


def by_text(rows):
    groups = {}
    for key, text, _ in rows:
        groups.setdefault(text or "", []).append(-1 if key is None else key)
    return groups


@pytest.mark.parametrize("digest", ["sha256", "colliding"])
def test_exact_dedup(spark, tmp_path, digest):
    make = exact_dedup.sha256_hex if digest == "sha256" else (lambda text: F.substring(F.sha2(text, 256), 1, 1))
    docs = documents(spark, tmp_path / "docs")
    got = exact_dedup.exact_dedup(docs, digest=make, files_per_batch=1, salt_rows=2).collect()
    groups = by_text(texts())
    assert len(got) == len(texts())
    assert sorted((r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"]) for r in got) == sorted((max(v), len(v)) for v in groups.values() for _ in v)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_of_nothing_and_all_columns(spark, tmp_path):
    assert exact_dedup.exact_dedup(documents(spark, tmp_path / "none", rows=[])).count() == 0
    docs = documents(spark, tmp_path / "docs")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(by_text(texts()))


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: F.lit("same")])
def test_deliveries_meet_the_state_of_those_before(spark, tmp_path, digest):
    """Three deliveries, with a true digest and with one under which all texts collide."""
    rows = [(i, f"text {i % 4}" if i % 5 else None, "en") for i in range(24)]
    frames = [documents(spark, tmp_path / f"in{k}", rows=rows[8 * k : 8 * k + 8]) for k in range(3)]
    before, seen = None, []
    for k, frame in enumerate(frames):
        got = exact_dedup.exact_dedup(frame, state_dir=f"file://{tmp_path}/state", earlier=before, digest=digest).collect()
        seen += rows[8 * k : 8 * k + 8]
        for r in got:
            group = [i for i, t, _ in seen if (t or "") == (rows[r["doc_id"]][1] or "")]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        before = frame if before is None else spark.read.parquet(*[str(tmp_path / f"in{j}") for j in range(k + 1)])


def test_earlier_rows_are_asked_for(spark, tmp_path):
    for k in range(2):
        frame = documents(spark, tmp_path / f"d{k}", rows=[(1 - k, "the same", "en")])
        if k:
            with pytest.raises(Exception, match="earlier deliveries"):
                exact_dedup.exact_dedup(frame, state_dir=f"file://{tmp_path}/s").collect()
        else:
            assert exact_dedup.exact_dedup(frame, state_dir=f"file://{tmp_path}/s").count() == 1


def jaccard_groups(rows, n_words, percent):
    sets = []
    for key, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(n_words, len(words))
        sets.append((key, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted((-1 if key is None else key, len(s), least.get(find(i), -1)) for i, (key, s) in enumerate(sets))


def family(seed, n, size, edits):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(r.randint(0, edits)):
            words[r.randrange(size)] = f"e{r.randint(0, 99999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("n_words", "percent", "block"), [(4, 85, 512), (5, 80, 3)])
def test_ngram_join(spark, n_words, percent, block):
    rows = texts() + [(100 + i, t, "en") for i, t in enumerate(family(1, 25, 120, 6) + family(2, 10, 300, 14) + family(3, 12, 9, 1))]
    got = ngram_join.jaccard_components(documents(spark, rows=rows), n_words=n_words, percent=percent, block_classes=block).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert found == jaccard_groups(rows, n_words, percent)


def test_ngram_join_of_nothing_and_one_of_each(spark):
    assert ngram_join.jaccard_components(documents(spark, rows=[])).count() == 0
    docs = documents(spark)
    kept = ngram_join.one_of_each(docs, n_words=4, percent=85)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [0, 1, 2, 5, 6, 8, 9, 10, 10, 12, 13, 15]


def test_tree_links_connect_what_brute_force_connects():
    sets = [shingle_set(t, 4) for t in family(9, 60, 80, 5) + family(8, 40, 85, 9)]
    linked = lambda a, b: 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))
    for left, right in ((sets, None), (sets[::2], sets[1::2])):
        other = left if right is None else right
        n, shift = len(left) + (0 if right is None else len(right)), 0 if right is None else len(left)
        want = [(i, j) for i in range(len(left)) for j in range(len(other)) if (right is not None or i < j) and linked(left[i].tolist(), other[j].tolist())]
        got = ngram_join.tree_links(left, right, 85)
        assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, want))) if right is None else set(got) <= set(want)
        assert classes(n, [(i, j + shift) for i, j in got]) == classes(n, [(i, j + shift) for i, j in want])


def classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70), (80, 80)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(text):
    out = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for kind, pattern, fits in (("assign", assign, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)):
        out += [(m.start(), secret_scan.ORDER[kind], kind, m.end()) for m in pattern.finditer(text or "") if fits(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


SECRETS = [
    "", None, "é😀 Token = \"abcdefghijklmnop\" x", "token: secret: abcdefghijklmnop", "AKIA" + "A" * 14 + " AKIAAKIA" + "B" * 13, "x" + "0123456789abcdef" * 3 + "g", "apiKEY=0123456789abcdef01",
    "password=short12 user_id: someone", "password=short12", "user_id: someone", "see https://host.example/x and api_key='abcdef123456789'", "https://host.example only", "password=short12" + " " * 300 + "user_id: someone", "PASSWD:'aaaaaaaaaaaa' passwd:aaaaaaaaaaa",
]


def test_secret_spans(spark):
    docs = documents(spark, rows=[(i, t, "en") for i, t in enumerate(SECRETS)])
    got = {r["doc_id"]: r for r in secret_scan.secret_spans(docs).select("doc_id", secret_scan.span_text(F.col("base")).alias("base"), F.transform("linked", lambda s: s["kind"]).alias("linked")).collect()}
    assert [got[i]["base"] for i in range(len(SECRETS))] == [brute_spans(t) for t in SECRETS]
    linked = {i: sorted(r["linked"]) for i, r in got.items() if r["linked"]}
    assert linked == {7: ["weak_id", "weak_secret"], 10: ["endpoint"]}
    assert secret_scan.secret_spans(documents(spark, rows=[])).count() == 0


def test_secret_links_against_sql(spark):
    """Parts at all distances around the scope, in both orders, with and without quotes."""
    import duckdb

    from docquarry.llm import queries

    r = random.Random(4)
    parts = ["password=short12", '"client_id": "abcd"', "user_name: someone", "https://h.example:80", "AKIA" + "B" * 16, "token='" + "x" * 400 + "'", "0123456789abcdef01", "é"]
    rows = [(i, "".join(r.choice(parts) + " " * r.choice([1, 3, 255, 256, 257, 258, 300]) for _ in range(r.randint(0, 4))), "en") for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas()  # noqa: F841
    want = {r[0]: r[5] for r in duckdb.sql(queries.OP8_SQL).fetchall()}
    found = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["spans"] for r in found.select("doc_id", secret_scan.span_text(F.concat("base", "linked")).alias("spans")).collect()}
    assert got == want and sum("weak_secret" in s for s in got.values()) > 20


def test_redaction(spark):
    docs = documents(spark, rows=[(i, t, "en") for i, t in enumerate(SECRETS)])
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[0]["text"] == "" and got[1]["text"] is None and got[2]["text"] == "é😀 [SECRET]\" x" and got[2]["n_chars"] == len("é😀 [SECRET]\" x")
    assert got[7]["text"] == "[SECRET] [SECRET]" and got[8]["text"] == SECRETS[8]


def test_redaction_equals_brute_force(spark, monkeypatch):
    """Spans that overlap, touch and lie in several parts of a text."""
    monkeypatch.setattr(secret_scan, "PART", 16)
    r = random.Random(8)
    pieces = ["AKIA" + "Q7" * 9, "0123456789abcdef", "password=" + "a1" * 9, "token:0123456789abcdef01", "é😀", "\n", " ", "x" * 40, "user_id=someone", "https://h.example", "passwd=short1"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(120)]
    docs = documents(spark, rows=[(i, t, "en") for i, t in enumerate(texts)])
    spans = {s["doc_id"]: sorted((x["start"], x["end"]) for x in s["base"] + s["linked"]) for s in secret_scan.secret_spans(docs).collect()}
    for row in secret_scan.redact(docs).collect():
        text, at, out = texts[row["doc_id"]], 0, ""
        for start, end in spans[row["doc_id"]]:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert row["text"] == out + text[at:]


def test_redaction_of_very_many_hits(spark):
    """Time and memory grow with the text, not with hits times text."""
    text = "é 0123456789abcdef " * 100_000
    started = time.monotonic()
    assert secret_scan.redact(documents(spark, rows=[(0, text, "en")])).first()["text"] == "é [SECRET] " * 100_000
    assert time.monotonic() - started < 60


def linked_kinds(spark, cases):
    found = secret_scan.secret_spans(documents(spark, rows=[(i, t, "en") for i, t in enumerate(cases)])).collect()
    return [sorted(s["kind"] for s in r["linked"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def test_endpoint_and_password_complete_each_other(spark):
    cases = ["postgres://db.host:5432 password=hunter22", "password=hunter22 at postgres://db.host:5432", "password=hunter22" + " " * 300 + "postgres://db.host:5432", "postgres://db.host:5432 user_id: someone"]
    assert linked_kinds(spark, cases) == [["endpoint", "weak_secret"]] * 2 + [[], []]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(documents(spark, rows=[(i, t, "en") for i, t in enumerate(cases)])).collect()}
    assert [clean[i] for i in range(4)] == ["[SECRET] [SECRET]", "[SECRET] at [SECRET]", *cases[2:]]


def test_links_over_the_gap_and_in_json(spark):
    jwt = "token=" + "aB3." * 200
    cases = [f"{jwt} user_id=someone", f"user_id=someone {jwt}", f"{jwt}{' ' * 257}user_id=someone", '{"client_id": "abcd", "password": "hunter22"}', "user_name='bob_1' passwd: 'short1'"]
    assert linked_kinds(spark, cases) == [["weak_id"], ["weak_id"], [], ["weak_id", "weak_secret"], ["weak_id", "weak_secret"]]


@pytest.mark.parametrize("scope", [7, 256])
def test_links_equal_brute_force(spark, scope):
    """Parts of random lengths at random places, several to a cell."""
    r, kinds, cases = random.Random(scope), list(secret_scan.ORDER), []
    for _ in range(60):
        starts = [r.randrange(12 * scope) for _ in range(r.randrange(2, 7))]
        cases.append([(a, k, kinds[k], a + r.choice([1, scope // 2, scope, 4 * scope])) for a, k in ((a, r.randrange(6)) for a in starts)])
    frame = spark.createDataFrame([(str(i), c) for i, c in enumerate(cases)], "text_key string, parts array<struct<start:int,rank:int,kind:string,end:int>>")
    got = {(x["text_key"], tuple(x["part"])) for x in secret_scan._linked(frame, scope).collect()}
    secret = lambda p: secret_scan.ROLE[p[2]] == "secret"
    want = {(str(i), p) for i, c in enumerate(cases) for p in c if p[1] > 2 and any(secret(o) != secret(p) and max(o[0] - p[3], p[0] - o[3]) <= scope for o in c)}
    assert got == want and 0 < len(want) < sum(p[1] > 2 for c in cases for p in c)


def test_language_id(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    rows = duckdb.sql(f"SELECT doc_id, lang FROM '{path}'").fetchall()
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sorted(out) == sorted(k for k, r in got.items() if r["held_out"])
    truth = dict(rows)
    right = sum(got[k]["lang_pred"] == truth[k] for k in out)
    assert right / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_edge_cases(spark):
    model = language_id.CrossParser({"a": ["the cat sat on the mat " * 40], "b": ["le chat est sur la table " * 40]}, 2000, 32)
    out = model.predict([None, "", "12 !?", "the cat", "le chat", "x" * 5000, "日本"])
    assert out.lang.tolist()[:5] == ["und", "und", "und", "a", "b"] and out.score.between(0, 1).all()
    docs = documents(spark)
    assert language_id.identify(docs).count() == len(texts())
    assert language_id.identify(documents(spark, rows=[])).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {1, 2, 10, 15}.isdisjoint({r["doc_id"] for r in kept.collect()})


WORDS_OF = {"en": "the cat sat on that mat with his thing", "fr": "le chat est sur une table avec des choses", "de": "die katze liegt auf der matte und schläft"}


def worded(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS_OF[lang].split()) for _ in range(n))


@pytest.mark.parametrize("sizes", [{"en": 3, "fr": 3, "de": 3}, {"en": 100, "fr": 3, "de": 9000}])
def test_languages_of_short_and_of_long_texts_are_learned(spark, sizes):
    """Posts of three words, books of 9,000: each labelled language has a model; marks before a text take no room."""
    rows = [(100 * k + i, ("- " * 30_000 if lang == "de" else "") + worded(lang, sizes[lang], i), lang) for k, lang in enumerate(sizes) for i in range(12)]
    got = language_id.identify(documents(spark, rows=rows)).collect()
    truth = {k: lang for k, _, lang in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.9 * len(rows)
    assert "und" not in {r["lang_pred"] for r in got}
    assert language_id.keep_identified(documents(spark, rows=rows)).count() == len(rows)


def test_languages_of_many_scripts_are_told_apart(spark):
    """Words of the same lengths in every language: only letters differ, rare scripts and 3,000 ideographs among them."""
    first = {"en": (97, 26), "ru": (0x430, 32), "el": (0x3B1, 17), "ka": (0x10D0, 32), "th": (0x0E01, 30), "zh": (0x4E00, 3000), "yi": (0xA000, 1000)}

    def text(lang, i):
        r, (start, n) = random.Random(f"{lang}{i}"), first[lang]
        return " ".join("".join(chr(start + r.randrange(n)) for _ in range(2 + (i * j) % 4)) for j in range(150))

    rows = [(100 * k + i, text(lang, i), lang) for k, lang in enumerate(first) for i in range(60 if lang in ("en", "ru") else 12)]
    truth = {k: lang for k, _, lang in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(documents(spark, rows=rows)).collect()} == truth
    model = language_id.CrossParser({lang: [text(lang, i) for i in range(12)] for lang in first}, 20_000)
    assert model.steps.nbytes < 4_000_000


def test_sparse_transitions_equal_the_tables():
    r = random.Random(5)
    automata = [language_id.SuffixAutomaton([r.randrange(n) for _ in range(400)], 40) for n in (3, 40)]
    steps, roots = language_id.combed([a.follow for a in automata], 40)
    for a, root in zip(automata, roots, strict=True):
        place, table, todo = {1: root}, a.table, [1]
        while todo:
            state = todo.pop()
            for c in range(40):
                to, owner = steps[place[state] + c].tolist()
                assert (owner == place[state]) == bool(table[state, c])
                if table[state, c]:
                    if int(table[state, c]) not in place:
                        todo.append(int(table[state, c]))
                    assert place.setdefault(int(table[state, c]), to) == to
        assert len(set(place.values())) == len(place)


def test_cross_parsing_counts_phrases():
    model = language_id.CrossParser({"a": ["abracadabra"]}, 100, 32)
    bits, letters = model.entropies(["abra", "abraxabra", "zzz"])
    phrases = bits[0] * [4, 9, 3] / model.bits[0]
    assert letters.tolist() == [4, 9, 3] and phrases.round(6).tolist()[0] == 1.0
    sub = lambda t: [t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
    automaton = language_id.SuffixAutomaton([1, 2, 3, 1, 2, 1], 5).table
    for word in sub([1, 2, 3, 1, 2, 1]) + [[3, 2], [2, 2]]:
        state = 1
        for c in word:
            state = automaton[state, c] if state else 0
        assert bool(state) == (word in sub([1, 2, 3, 1, 2, 1]))


def test_hash_of_text_is_sha256(spark, tmp_path):
    docs = documents(spark, tmp_path / "docs")
    assert {r["digest"] for r in exact_dedup.exact_dedup(docs).collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in texts()}
