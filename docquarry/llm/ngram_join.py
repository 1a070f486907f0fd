"""Self-join of documents by the Jaccard similarity of their word shingles, with signature trees.

Candidates.  Documents with the same set form a class.  In any one order of all shingles, two sets
of similarity ``t`` or more share a shingle among the first ``n - ceil(t n) + 1`` of each.  The order
taken here: first the shingles of a zone of hash values (``1.7 (1 - t)`` of all), those of one class
only before the others, these by how often they occur; then the rest by hash.  So a shingle of a
common passage comes last, most classes have no shared shingle in their prefix and are done, and
only a zone of the shingles is ever shuffled.

Trees.  A class with shared keys lives in a block of about ``block_classes`` classes at most (and of
bounded bytes), all of one group: the most frequent key among its own and those of the classes it
shares a key with.  A block's sets hang in a signature tree whose nodes hold OR-combined token bitmaps
and size ranges.  The tree is traversed against itself, or two blocks' trees together; a pair of nodes
is dropped when ``|A and B| + excess`` (tokens that share a bit) or a size range rules out the overlap
the threshold asks for.  Leaves that remain are compared token by token, unless links found before
already connect them.

Rounds.  Classes are linked within their blocks first, which gives each a label; then one class of
each label meets those of the group's other blocks.  In a family of copies that leaves one label, and
the work grows with the family's size.  Only what is unsettled then meets between blocks: classes with
a common key and different labels.  Connected components of the links between labels give the groups.

Defined results: null text counts as empty; a document without words has no shingles, links with
nothing and is its own component; rows with equal sets are in one component, repeated rows too;
an empty table gives an empty result.  Very long texts are compared whole.  Other columns are not read;
``one_of_each`` keeps them, whatever their names.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import by_text
from .components import connected_components
from .shared import fresh_name, release_memory, shared_dir, stored, text_of
from .shingles import shingle_sets

SIGNATURES = "doc_id long, text_hash long, class_id long, n_shingles long, zone_size int, zone array<long>, extra array<long>"
FANOUT = 8
#: A task notes the classes of so many rows, to send their shingles once.
MAX_SEEN = 200_000
#: A block's sets take about so many bytes at most (a single larger set is a block of its own).
BLOCK_BYTES = 16_000_000


def prefix_length(n: int, percent: int) -> int:
    return n + (percent * n) // -100 + 1


def _signatures(n_words: int, percent: int):
    limit = np.uint64(min(2**64 - 1, int(2**64 * 1.7 * (100 - percent) / 100)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in by_text(whole, 2)):
            classes, sizes, in_zone, zones, extras = [], [], [], [], []
            for tokens in shingle_sets(batch.column(2), n_words):
                n = len(tokens)
                class_id = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if n else None
                split = int(np.searchsorted(tokens, limit))
                classes.append(class_id)
                sizes.append(n)
                in_zone.append(split)
                # Copies within a task carry their shingles once.
                fresh = n > 0 and class_id not in seen
                zones.append(tokens[:split].view(np.int64) if fresh else np.zeros(0, np.int64))
                lack = max(0, prefix_length(n, percent) - split) if fresh else 0
                extras.append(tokens[split : split + lack].view(np.int64))
                if fresh and len(seen) < MAX_SEEN:
                    seen.add(class_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(in_zone, pa.int32()), _lists(zones), _lists(extras)],
                ["doc_id", "text_hash", "class_id", "n_shingles", "zone_size", "zone", "extra"],
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_text(whole, 1)):
            data = [tokens.tobytes() for tokens in shingle_sets(batch.column(1), n_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["class_id", "tokens"])

    return run


class SignatureTree:
    """Leaves are sets; a node holds (OR of bitmaps, least size, greatest size, greatest excess, children)."""

    def __init__(self, sets: list[np.ndarray], n_bits: int) -> None:
        leaves = []
        for i, tokens in enumerate(sets):
            bits = np.zeros(n_bits, bool)
            bits[(tokens & np.uint64(n_bits - 1)).astype(np.int64)] = True
            bitmap = int.from_bytes(np.packbits(bits).tobytes(), "big")
            leaves.append((bitmap, len(tokens), len(tokens), len(tokens) - bitmap.bit_count(), None, i))
        level = sorted(leaves, key=lambda x: (x[1], x[0]))
        while len(level) > 1:
            level = [self._join(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
        self.root = level[0]

    @staticmethod
    def _join(nodes: list[tuple]) -> tuple:
        bitmap = 0
        for x in nodes:
            bitmap |= x[0]
        return bitmap, min(x[1] for x in nodes), max(x[2] for x in nodes), max(x[3] for x in nodes), nodes, -1


def may_link(a: tuple, b: tuple, percent: int) -> bool:
    """Whether a set under ``a`` and one under ``b`` can have the overlap that their sizes ask for."""
    if 100 * a[2] < percent * b[1] or 100 * b[2] < percent * a[1]:
        return False
    most = min(a[2], b[2], (a[0] & b[0]).bit_count() + min(a[3], b[3]))
    return (100 + percent) * most >= percent * (a[1] + b[1])


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i of left, j of right or, without right, of left) that connect all that is linked.

    Sets of equal ``labels`` (of left, then right) are known to be connected.
    """
    n = len(left)
    every = left + (right or [])
    mean = sum(map(len, every)) / len(every)
    n_bits = max(64, 1 << int(np.ceil(np.log2(max(1.0, 1.5 * mean)))))
    a = SignatureTree(left, n_bits)
    b = SignatureTree(right, n_bits) if right is not None else a
    members: list[set[int] | None] = [None] * len(every)
    first_of: dict[int, int] = {}
    parent = [first_of.setdefault(x, i) for i, x in enumerate(labels)] if labels else list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tokens(x: int) -> set[int]:
        if members[x] is None:
            members[x] = set(every[x].tolist())
        return members[x]

    out, stack = [], [(a.root, b.root)]
    shift = n if right is not None else 0
    while stack:
        x, y = stack.pop()
        if not may_link(x, y, percent):
            continue
        if x[4] is None and y[4] is None:
            i, j = x[5], y[5] + shift
            if i == j or find(i) == find(j):
                continue
            common = len(tokens(i) & tokens(j))
            if 100 * common >= percent * (len(every[i]) + len(every[j]) - common):
                parent[find(i)] = find(j)
                out.append((i, j - shift))
        elif x is y:
            kids = x[4]
            stack += [(kids[p], kids[q]) for p in range(len(kids)) for q in range(p, len(kids))]
        elif y[4] is None or (x[4] is not None and x[2] >= y[2]):
            stack += [(kid, y) for kid in x[4]]
        else:
            stack += [(x, kid) for kid in y[4]]
    return out


def _settle(percent: int):
    """class_id and label of all classes of one block; classes of one label are connected."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("class_id").to_pylist()
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
        label = list(range(len(ids)))

        def find(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for i, j in tree_links(sets, None, percent):
            i, j = find(i), find(j)
            label[max(i, j, key=ids.__getitem__)] = min(i, j, key=ids.__getitem__)
        release_memory()
        return pa.table([table.column("class_id"), pa.array([ids[find(i)] for i in range(len(ids))], pa.int64())], ["class_id", "label"])

    return run


def _meet(percent: int):
    """Links between the labels of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        labels, first = table.column("label").to_pylist(), table.column("first").to_pylist()
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
        sides = [[k for k in range(len(first)) if first[k] == side] for side in (True, False)]
        found = []
        if all(sides):
            found = tree_links(*([sets[k] for k in side] for side in sides), percent, [labels[k] for side in sides for k in side])
        release_memory()
        return pa.table([pa.array([labels[sides[0][i]] for i, _ in found], pa.int64()), pa.array([labels[sides[1][j]] for _, j in found], pa.int64())], ["a", "b"])

    return run


def _blocks(of_group: DataFrame, group: str, block_classes: int) -> DataFrame:
    """class_id and block: a part of its group, bounded in classes and in bytes of their sets."""
    size = F.greatest(F.count("*") / block_classes, F.sum("n_shingles") * 8 / BLOCK_BYTES)
    parts = of_group.groupBy(group).agg(F.ceil(size).cast("int").alias("parts"))
    # A group is a row for each of its classes here: the join may be split, and nothing else gathers a group.
    block = F.xxhash64(F.col(group), F.pmod(F.xxhash64("class_id"), F.col("parts")))
    return of_group.join(parts, group).select("class_id", group, "n_shingles", block.alias("block"))


def _labels(homes: DataFrame, sets: DataFrame, percent: int, block_classes: int, work: str) -> DataFrame:
    """class_id, label, block of all classes: linked within their blocks, then one class of each label with those
    of the other blocks of the group, until a group's labels fit into one block or no longer grow fewer."""
    settled = homes.join(sets, "class_id").groupBy("block").applyInArrow(_settle(percent), "class_id long, label long")
    labels = stored(settled.join(homes, "class_id").select("class_id", "label", "home", "n_shingles", "block"), "labels", f"{work}/labels-0")
    n, step = labels.filter("class_id = label").count(), 0
    while True:
        heads = labels.filter("class_id = label").select("class_id", "home", "n_shingles")
        wide = labels.groupBy("home").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x <> y").select("home")
        step += 1
        again = stored(_blocks(heads.join(stored(wide, "wide", f"{work}/wide-{step}"), "home"), "home", block_classes), "again", f"{work}/again-{step}")
        if again.isEmpty():
            return labels
        merged = again.join(sets, "class_id").groupBy("block").applyInArrow(_settle(percent), "class_id long, label long").filter("class_id <> label")
        merged = stored(merged.toDF("label", "new"), "merged", f"{work}/merged-{step}")
        labels = stored(
            labels.join(merged, "label", "left").select("class_id", F.coalesce("new", "label").alias("label"), "home", "n_shingles", "block"),
            "labels", f"{work}/labels-{step}",
        )
        before, n = n, labels.filter("class_id = label").count()
        if 2 * n > before or again.groupBy("home").agg(F.min("block").alias("x"), F.max("block").alias("y")).filter("x <> y").isEmpty():
            return labels


def shared_keys(signatures: DataFrame, percent: int) -> DataFrame:
    """(class_id, n_shingles, keys): the prefix's shingles that more than one class has, none left out."""
    tokens = signatures.select("class_id", F.explode("zone").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo <> hi").select("token", "df")
    live = tokens.join(counts, "token").groupBy("class_id").agg(F.collect_set(F.struct("df", "token")).alias("live"))
    extra = F.max(F.col("extra"))  # equal within a class but for copies that carry none
    classes = signatures.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("zone_size").alias("zone_size"), extra.alias("extra"))
    n = F.col("n_shingles")
    prefix = n - F.ceil(n * percent / F.lit(100)) + 1
    n_keys = F.greatest(F.lit(0), prefix - (F.col("zone_size") - F.size("live"))).cast("int")
    keys = F.concat(F.transform(F.slice(F.sort_array("live"), F.lit(1), n_keys), lambda s: s["token"]), "extra")
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    joined = classes.join(live, "class_id", "left").withColumn("live", F.coalesce("live", none))
    return joined.select("class_id", "n_shingles", keys.alias("keys")).filter(F.size("keys") > 0)


def _guests(at: DataFrame) -> DataFrame:
    """block_x, block_y, first, class_id, label: the classes that take part in the meeting of two blocks.

    ``at`` has key, block, class_id and label.  Of a key's most frequent label, classes meet only the blocks
    that have another label under the key; classes of other labels meet all of the key's blocks.
    """
    counts = at.groupBy("key", "label").agg(F.count("*").alias("n"))
    major = counts.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("major"))
    marked = at.join(major, "key").withColumn("odd", F.col("label") != F.col("major"))
    of_key = marked.groupBy("key").agg(F.collect_set("block").alias("every"), F.collect_set(F.when(F.col("odd"), F.col("block"))).alias("odd_ones"))
    places = marked.join(of_key, "key").select("class_id", "label", "block", F.when(F.col("odd"), F.col("every")).otherwise(F.col("odd_ones")).alias("others"))
    # A class has the same blocks under most of its keys: sets of them are joined before they become rows.
    visits = places.groupBy("class_id", "label", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    pairs = visits.select("class_id", "label", "block", F.explode("others").alias("other")).filter("block <> other")
    return pairs.select(F.least("block", "other").alias("block_x"), F.greatest("block", "other").alias("block_y"), (F.col("block") < F.col("other")).alias("first"), "class_id", "label")


def jaccard_components(
    docs: DataFrame, *, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_classes: int = 512,
) -> DataFrame:
    """One row per row: doc_id, text_hash, n_shingles, class_id, component_id (smallest doc_id reachable by links)."""
    work = shared_dir(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signatures = stored(rows.mapInArrow(_signatures(n_words, percent), SIGNATURES), "signatures", f"{work}/signatures")

    keyed = shared_keys(signatures, percent)
    postings = stored(keyed.select("class_id", "n_shingles", F.explode("keys").alias("key")), "postings", f"{work}/postings")
    sizes = postings.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    live = postings.join(sizes, "key")
    # A class belongs with its most frequent key, or with that of a class it shares a key with, if more
    # frequent: a large family gathers under one key.  Its block is a part of that group.
    own = live.groupBy("class_id").agg(F.max(F.struct("m", "key")).alias("own"))
    of_key = live.join(own, "class_id").groupBy("key").agg(F.max("own").alias("best"))
    home = live.join(of_key, "key").groupBy("class_id").agg(F.max("best").alias("best"), F.first("n_shingles").alias("n_shingles"))
    home = stored(home.select("class_id", F.col("best.key").alias("home"), "n_shingles"), "home", f"{work}/home")
    homes = stored(_blocks(home, "home", block_classes), "homes", f"{work}/homes")

    # Whole sets of the classes in question are computed again from one text of each.
    chosen = signatures.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    wanted = homes.join(chosen, "class_id").select("class_id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    texts = rows.alias("r").join(wanted.alias("w"), (F.col("r.text_hash") == F.col("w.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))).select("class_id", "text")
    sets = stored(texts.dropDuplicates(["class_id"]).mapInArrow(_sets(n_words), "class_id long, tokens binary"), "sets", f"{work}/sets")

    labels = _labels(homes, sets, percent, block_classes, work).select("class_id", "label", "block")
    # What may still be linked has another label, another block and a key in common.
    at = stored(postings.join(labels, "class_id").select("key", "class_id", "label", "block"), "at", f"{work}/at")
    mixed = at.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min("block").alias("x"), F.max("block").alias("y")).filter("l <> h AND x <> y")
    mixed = stored(mixed.select("key"), "mixed", f"{work}/mixed")
    open_at = stored(at.join(mixed, "key").select("key", "block", "class_id", "label"), "open", f"{work}/open")
    guests = stored(_guests(open_at), "guests", f"{work}/guests")
    met = guests.join(sets, "class_id").groupBy("block_x", "block_y").applyInArrow(_meet(percent), "a long, b long")
    links = stored(met, "links", f"{work}/links")

    components = connected_components(links).withColumnsRenamed({"node": "label"})
    of_label = labels.join(components, "label", "left").select("class_id", F.coalesce("component", "label").alias("component"))
    least = signatures.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.min("doc_id").alias("least"))
    grouped = stored(least.join(of_label, "class_id", "left").select("class_id", "least", F.coalesce("component", "class_id").alias("component")), "grouped", f"{work}/grouped")
    several = grouped.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first")
    several = stored(several, "several", f"{work}/several")
    of_class = grouped.join(several, "component", "left").select("class_id", F.coalesce("first", "least").alias("component_id"))
    return signatures.join(of_class, "class_id", "left").select("doc_id", "text_hash", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest identifier of each group only; all columns stay.

    Rows without an identifier stay, and so do repeated rows (same identifier and text).
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    key, text_hash = fresh_name("id", docs), fresh_name("hash", docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash))
    return docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (F.xxhash64(text_of(text_col)) == F.col(text_hash)), "left_anti")
