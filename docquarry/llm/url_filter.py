"""URL filters: rules on hosts and path prefixes, and a path-template tree for the rest.

Rules decide where they fit (a host and its subdomains, a path's beginning; the longest rule wins).
For other URLs, each host's paths form a tree.  Segments that are numbers or long hexadecimal
words become wildcards at once.  A branch also becomes a wildcard if its share of blocked pages does
not differ from that of its siblings with labels (two-proportion z test; without any labels below the
parent nothing tells them apart).  A branch without labels beside labelled ones stands for itself, and
the number of branches decides nothing, so no verdict depends on how many siblings a branch has.
Branches that became the wildcard of a node are one branch from there on: what lies below them is
counted and judged together.  A path's template keeps the branches that stand for themselves.  A template is rejected when the
smoothed share of blocked among its labelled pages, (blocked + 1) / (labelled + 2), exceeds ``reject``.
Labelled pages are those that a rule decides.

Nodes whose labelled pages have one verdict are settled with all that lies below in one pass, whatever the depth; a
round a level is needed only below nodes with blocked and allowed pages.

Counting works on (host, generalised path) with partial sums per task, so a host with a third of
all pages is as small as its distinct paths.  Only rejected paths are joined back to pages.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed;
repeated rows get a row each; ties between rules of one length go to the one whose text sorts first.
An empty table gives no rows; very long URLs are read whole.  Other columns are not read; ``keep_allowed``
keeps them, whatever their names.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_name, shared_dir, stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER, HEX = r"^[0-9]+", r"^[0-9a-f]{8,}$"
Z, REJECT = 1.96, 0.8

Rule = tuple[str, str]  # verdict, host/path


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def by_length(rules: list[Rule]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), longest rule first."""
    return [(v, r, *_parts(r)) for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))]


def _parts(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, f"/{path}"


def match_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    def one(verdict: str, rule: str, rule_host: str, rule_path: str) -> Column:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        return F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.coalesce(*[one(*r) for r in by_length(rules)])


def generalised(path: Column) -> Column:
    """Non-empty segments with numbers as ``{n}`` (what follows the digits stays) and hexadecimal words as ``{h}``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(HEX) & ~s.rlike(r"^[0-9]+$"), F.lit("{h}")).otherwise(F.regexp_replace(s, NUMBER, "{n}")))


def _same_first(lo: Column, hi: Column) -> Column:
    """How many segments two paths have in common at their beginning."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, same: Column) -> Column:
        on = acc["on"] & same
        return F.struct((acc["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.aggregate(F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False))), start, step, lambda acc: acc["n"])


NODE, PURE, MIXED = ["host", "template"], "all_lab > 0 AND (all_bad = 0 OR all_bad = all_lab)", "all_bad > 0 AND all_bad < all_lab"


def rejections(pages: DataFrame, z: float, reject: float) -> DataFrame:
    """(host, raw) of the distinct (host, generalised path) for which the verdict is not ``_unknown(reject)``.

    The tree is built from the root, and only where it can matter: in hosts with pages with and without labels.
    Below a node without labels every template is unknown.  Below a node whose labelled pages are all blocked, or all
    allowed, branches with labels always become one, so ``_below_pure`` settles all levels at once.  Only
    nodes with blocked and allowed pages take a round a level.
    """
    work, step, found = shared_dir(pages.sparkSession, "templates"), 0, []
    counts = [F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict").isNull()).alias("open")]
    paths = stored(pages.groupBy("host", "raw").agg(*counts), "paths", f"{work}/paths")
    hosts = paths.groupBy("host").agg(F.sum("labelled").alias("all_lab"), F.sum("open").alias("all_open")).filter("all_lab > 0 AND all_open > 0")
    active = paths.join(stored(hosts.select("host"), "hosts", f"{work}/hosts"), "host", "left_semi")
    active = stored(active.select("host", "raw", "labelled", "blocked", F.lit("").alias("template"), F.col("raw").alias("rest")), "active", f"{work}/active-0")
    while not active.isEmpty():
        step += 1
        nodes = stored(active.groupBy(*NODE).agg(F.sum("labelled").alias("all_lab"), F.sum("blocked").alias("all_bad")), "nodes", f"{work}/nodes-{step}")
        below = lambda condition: active.join(nodes.filter(condition).select(*NODE), NODE, "left_semi")  # noqa: B023, E731
        if not nodes.filter(PURE).isEmpty():
            found.append(_below_pure(below(PURE), reject, f"{work}/pure-{step}"))
        if nodes.filter(MIXED).isEmpty():
            break
        ended, active = _one_level(below(MIXED), z, f"{work}/mixed-{step}")
        known = ended.groupBy(*NODE).agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("bad")).filter(_rejected(reject) != _unknown(reject))
        found.append(ended.join(known.select(*NODE), NODE, "left_semi").select("host", "raw"))
    return reduce(DataFrame.unionByName, found, active.limit(0).select("host", "raw"))


def _rejected(reject: float) -> Column:
    """Whether a template with ``lab`` labelled pages, ``bad`` of them blocked, is rejected."""
    return (F.col("bad") + 1) / (F.col("lab") + 2) > reject


def _unknown(reject: float) -> bool:
    """The same of a template without labelled pages."""
    return 1 / 2 > reject


def _below_pure(active: DataFrame, reject: float, path: str) -> DataFrame:
    """(host, raw) with another verdict than ``_unknown``, below nodes whose labelled pages have one verdict.

    Two branches with labels have equal shares and become the wildcard, so each level has one branch with
    labels.  A path stays on it as long as its segments are among those of labelled paths at their depth (or is the
    wildcard's own name, where there is one), and is judged with the labelled paths that end where it ends.
    """
    sized = active.withColumn("n_segments", F.size("rest"))
    labelled = sized.filter("labelled > 0")
    ends = labelled.groupBy(*NODE, "n_segments").agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("bad")).filter(_rejected(reject) != _unknown(reject))
    ends = stored(ends.select(*NODE, "n_segments"), "ends", f"{path}-ends")
    at = labelled.select(*NODE, F.posexplode("rest").alias("depth", "segment")).distinct()
    several = at.groupBy(*NODE, "depth").count().filter("count > 1").select(*NODE, "depth", F.lit("*").alias("segment"))
    known = stored(at.unionByName(several).distinct(), "known", f"{path}-known")
    wanted = sized.join(ends, [*NODE, "n_segments"], "left_semi")
    wanted = stored(wanted.withColumn("path_id", F.unhex(F.sha2(F.concat_ws("/", F.col("host"), "raw"), 256))), "wanted", f"{path}-wanted")
    each = wanted.filter("labelled = 0").select(*NODE, "path_id", F.posexplode("rest").alias("depth", "segment"))
    lost = stored(each.join(known, [*NODE, "depth", "segment"], "left_anti").select("path_id").distinct(), "lost", f"{path}-lost")
    return wanted.join(lost, "path_id", "left_anti").select("host", "raw")


def _one_level(active: DataFrame, z: float, path: str) -> tuple[DataFrame, DataFrame]:
    """Paths that end and paths that go on: each node's paths move on over the segments that they share, then its branches are judged."""
    ends = active.groupBy(*NODE).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    ends = stored(ends.select(*NODE, _same_first(F.col("lo"), F.col("hi")).alias("n")), "ends", f"{path}-ends")
    shared = F.concat(F.col("template"), F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("n")), lambda s: F.concat(F.lit("/"), s)), ""))
    rest = F.slice("rest", F.col("n") + 1, F.size("rest"))
    moved = active.join(ends, NODE).select("host", "raw", "labelled", "blocked", shared.alias("template"), rest.alias("rest"))
    moved = stored(moved.withColumn("segment", F.get("rest", F.lit(0))), "moved", f"{path}-moved")
    branch = moved.filter("segment IS NOT NULL").groupBy(*NODE, "segment").agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("bad"))
    branch = stored(branch, "branch", f"{path}-branch")
    node = branch.groupBy(*NODE).agg(F.count("*").alias("n_children"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    judged = branch.join(node, NODE).select(*NODE, "segment", F.when(_wild(z), F.lit("*")).otherwise(F.col("segment")).alias("shown"))
    judged = stored(judged, "judged", f"{path}-judged")
    further = moved.join(judged, [*NODE, "segment"]).select(
        "host", "raw", "labelled", "blocked", F.concat_ws("/", "template", "shown").alias("template"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")
    )
    return moved.filter("segment IS NULL").select("host", "raw", "template", "labelled", "blocked"), stored(further, "further", f"{path}-further")


def _wild(z: float) -> Column:
    """Whether a branch (lab, bad) of a node (n_children, all_lab, all_bad) becomes a wildcard."""
    lab, bad = F.col("lab"), F.col("bad")
    rest = F.col("all_lab") - lab
    pooled = F.col("all_bad") / F.col("all_lab")
    apart = F.abs(bad / lab - (F.col("all_bad") - bad) / rest) > z * F.sqrt(pooled * (1 - pooled) * (1 / lab + 1 / rest))
    return (
        F.when(F.col("n_children") == 1, F.lit(False))
        .when(F.col("all_lab") == 0, F.lit(True)).when((lab == 0) | (rest == 0), F.lit(False)).otherwise(~apart)
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url",
    z: float = Z, reject: float = REJECT,
) -> DataFrame:
    """One row per row: page_id, host, path, rule (null if none fits), verdict, template_rejected.

    ``template_rejected`` is told for hosts with pages that no rule decides; elsewhere it is as without labels.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    found = rows.withColumn("found", match_rule(rules, F.col("host"), F.col("path")))
    found = found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"), generalised(F.col("path")).alias("raw"))
    other = stored(rejections(found, z, reject).withColumn("rejected", F.lit(not _unknown(reject))), "url-rejected")
    judged = found.join(other, ["host", "raw"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(_unknown(reject))))
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.col("rejected").alias("template_rejected"))


def keep_allowed(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", id_col: str = "page_id", **options) -> DataFrame:
    """``pages`` without the URLs that are blocked; rows stay as they are (matched by identifier and URL)."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    blocked = judge_urls(pages, rules, id_col=id_col, url_col=url_col, **options).filter("verdict = 'block'")
    its_host, its_path = fresh_name("host", pages), fresh_name("path", pages)
    blocked = blocked.select(F.col("host").alias(its_host), F.col("path").alias(its_path)).distinct()
    return pages.join(blocked, (host == F.col(its_host)) & (path == F.col(its_path)), "left_anti")
