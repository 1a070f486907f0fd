"""Secret scans with multipart credential linking.

Base kinds stand alone.  Their spans are found with regular expressions, leftmost first and
without overlap; Spark's functions give matches but not positions, so the text is split by the
same expression and the lengths of pieces and matches are summed up.

Weak candidates say little alone: an identifier of an access (client, account or user), a secret
too short for the base kind, an endpoint.  They are reported only when a complementary part lies
within ``scope`` code points in the same text: a weak identifier or endpoint next to a secret, a weak
secret next to an identifier or endpoint.  The distance is the gap between the parts, from the end of
one to the start of the other.  This is an interval join: parts, widened by ``scope`` on the side that
completes, are keyed by text and by all cells of ``scope`` code points that they touch; per cell two
bounds of each side are enough, so no pairs are formed.

Defined results: null text counts as empty; repeated rows get a row each; overlapping spans of
different kinds all stay; no spans give empty strings (and the hash of the empty string); an empty
table gives no rows; very long texts are scanned whole.  Other columns of the input are not read;
``redact`` keeps them, whatever their names.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_name, stored, text_of


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind, expression and, where not all matches count, what a match must be like.  A run of
#: characters of one class matches at its start or, if it is too short, nowhere in it.
ASSIGN = rf"({_WORDS}){_GLUE}([A-Za-z0-9+/_.=-]+)"
BASE = (
    ("assign", ASSIGN, rf"^(?:{_WORDS}){_GLUE}[A-Za-z0-9+/_.=-]{{12,}}$"),
    ("access", r"AKIA[A-Z0-9]{14,}", None),
    ("hex", r"[0-9a-f]{16,}", None),
)
WEAK = (
    ("weak_id", rf"(?:ASIA|AIDA|AROA)[A-Z0-9]{{12,}}|(?:client|account|user)_(?:id|name){_GLUE}[A-Za-z0-9_.@-]{{4,}}", None),
    ("weak_secret", ASSIGN, rf"^(?:{_WORDS}){_GLUE}[A-Za-z0-9+/_.=-]{{6,11}}$"),
    ("endpoint", r"(?:https?|jdbc|postgres|mysql|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?", None),
)
ORDER = {k: i for i, k in enumerate(["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"])}
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
SCOPE = 256
HITS = 64
#: ``redact`` cuts texts into parts of so many code points.
PART = 4096


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans(text: Column, kind: str, pattern: str, keep: str | None = None) -> Column:
    """Array of (start, rank, kind, end) of the matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((at + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # Sums are carried on within parts of the hits, and from part to part: adding to one long array would
    # copy it for each hit.
    def of_parts(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        one = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), one))

    def of_steps(steps: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / HITS).cast("int")), lambda k: F.slice(steps, k * HITS + 1, F.lit(HITS))), of_parts)

    def of_hits(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit"), F.length(m).alias("size")))
        # No match, nothing to add up: most texts take this way.
        return F.when(F.size(found) > 0, _let(steps, of_steps)).otherwise(none)

    all_spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_hits)
    if keep:
        all_spans = F.filter(all_spans, lambda s: s["hit"].rlike(keep))
    return F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def span_text(array: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _linked(weak: DataFrame, scope: int) -> DataFrame:
    """(text_key, span) of the weak candidates with a complementary part within ``scope``."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("part.kind"))
    parts = weak.select("text_key", F.explode("parts").alias("part")).withColumn("is_secret", role == "secret")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope))).alias("cell")
    at, end = F.col("part.start"), F.col("part.end")
    # A widened part is longer than a cell, so it covers the first or the last place of each cell that it
    # touches: of those with the first place the one that reaches farthest stands for all, of those with
    # the last place the one that begins first.
    wide = parts.select("text_key", "is_secret", (at - scope).alias("from"), (end + scope).alias("to"), cells(at - scope, end + scope))
    sides = wide.groupBy("text_key", "cell", (~F.col("is_secret")).alias("is_secret")).agg(
        F.max(F.when(F.col("from") <= F.col("cell") * scope, F.col("to"))).alias("reach"),
        F.min(F.when(F.col("to") >= (F.col("cell") + 1) * scope - 1, F.col("from"))).alias("from"),
    )
    candidates = parts.filter(F.col("part.rank") >= ORDER["weak_id"]).select("text_key", "is_secret", "part", cells(at, end))
    in_scope = F.coalesce(at <= F.col("reach"), F.lit(False)) | F.coalesce(end >= F.col("from"), F.lit(False))
    return candidates.join(sides, ["text_key", "cell", "is_secret"]).filter(in_scope).select("text_key", "part").distinct()


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row: doc_id, base (array of spans), linked (array of weak spans that a part completes)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = rows.select(
        "doc_id",
        F.sha2("text", 256).alias("text_key"),
        F.concat(*[spans(F.col("text"), k, p, keep) for k, p, keep in BASE]).alias("base"),
        F.concat(*[spans(F.col("text"), k, p, keep) for k, p, keep in WEAK]).alias("weak"),
    )
    found = stored(found, "secret-spans")
    # Equal texts have equal spans: each text with two parts of which one is weak is linked once.  Rows
    # without such parts, nearly all, take no part in the joins.
    paired = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    weak = found.filter(paired).select("text_key", F.concat("base", "weak").alias("parts")).dropDuplicates(["text_key"])
    linked = _linked(weak, scope).groupBy("text_key").agg(F.collect_list("part").alias("linked"))
    none = F.filter("base", lambda s: F.lit(False))
    joined = found.filter(paired).join(linked, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("linked", none).alias("linked"))
    return joined.unionByName(found.filter(~paired).select("doc_id", "text_key", "base", none.alias("linked")))


def _gaps(found: DataFrame) -> DataFrame:
    """text_key, gaps (array of from, to) of what lies before, between and behind the spans; the last one has no end."""
    order = Window.partitionBy("text_key").orderBy("start", "end")
    rows = found.select("text_key", F.inline("spans")).select("text_key", "start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.struct(F.col("before").alias("from"), F.col("start").alias("to"))
    rest = F.struct(F.max("end").alias("from"), F.lit(None).cast("int").alias("to"))
    gaps = F.array_append(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("before"), gap))), rest)
    return rows.withColumn("before", before).groupBy("text_key").agg(gaps.alias("gaps"))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` (null: all) of a text that was cut into parts of ``PART``."""
    first = F.floor(start / PART).cast("int")
    head = lambda n: F.substring(F.get(parts, first), start - first * PART + 1, n)
    last = F.coalesce(F.floor(end / PART).cast("int"), F.size(parts))
    tail = F.coalesce(F.substring(F.get(parts, last), F.lit(1), end - last * PART), F.lit(""))
    far = F.concat(F.coalesce(head(F.lit(PART)), F.lit("")), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(first == last, F.coalesce(head(end - start), F.lit(""))).otherwise(far)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with the base and linked spans of the text replaced by ``mask``; all columns and rows stay.

    Overlapping spans become one mask.  A column ``n_chars`` follows the new text.
    """
    key, gaps, changed = (fresh_name(n, docs) for n in ("text_key", "gaps", "clean"))
    found = secret_spans(docs, id_col=id_col, text_col=text_col, scope=scope).select("text_key", F.concat("base", "linked").alias("spans"))
    found = _gaps(found.filter(F.size("spans") > 0).dropDuplicates(["text_key"])).toDF(key, gaps)
    text = text_of(text_col)
    joined = docs.withColumn(key, F.sha2(text, 256)).join(found, key, "left")
    # A part of a text is looked for from its beginning, so the text is cut into parts first.
    clean = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: F.array_join(F.transform(gaps, lambda g: _between(parts, g["from"], g["to"])), mask))
    new = F.when(F.col(gaps).isNull(), F.col(f"`{text_col}`")).otherwise(clean)
    out = joined.withColumn(changed, new)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(changed).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(gaps).isNull(), F.col("n_chars")).otherwise(F.length(changed).cast(docs.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
