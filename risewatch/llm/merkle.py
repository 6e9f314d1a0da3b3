"""Merkle manifest of a data set: a tree of digests per group, and a proof for every row by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import stage
from risewatch.llm.runs import join_hot, placed

#: The tree of trees.
TOP = -1


def digest_of(*values: Column) -> Column:
    """SHA-256 over values: `-` for null, else the UTF-8 byte count, a colon and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def joined(kids: Column) -> Column:
    """The digests of an array of kids, one after the other, as bytes."""
    return F.unhex(F.concat_ws("", F.transform(kids, lambda kid: F.hex(kid["digest"]))))


def fold(leaf: Column, segments: Column) -> Column:
    """The digest that a leaf (hexadecimal text) leads to over its segments (texts before, after)."""
    return F.aggregate(segments, leaf, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]).cast("binary"), 256))


@dataclass(frozen=True)
class Tree:
    """Runs of leaves with their digest, every other node's segment towards its parent, and the root.

    `runs`: node, kids (array of pos, digest and the leaf's other columns), lone (a leaf that is its own subroot).
    `pointers`: node, up, path (array of before, after, subroot; digests as bytes).
    `root`, `root_key` are null for no rows; `height` is the number of levels above the lowest runs.
    """

    runs: DataFrame
    pointers: DataFrame
    root: str | None
    root_key: tuple | None
    height: int


NODE = "struct<t: bigint, k: int, p: bigint>"


def _node(t: Column, k: int | Column, p: Column) -> Column:
    level = k if isinstance(k, Column) else F.lit(k)
    return F.struct(t.cast("long").alias("t"), level.cast("int").alias("k"), p.cast("long").alias("p"))


def build(leaves: DataFrame, group: str, order: Sequence[str], fan: int = 16, name: str = "merkle") -> Tree:
    """The tree over rows with a `leaf` digest (hexadecimal text) and any other columns.

    Within a group, leaves ascend by `order`, missing values first; every `fan` consecutive nodes become one,
    level by level, until one is left, the group's subroot.  Subroots in the order of groups, a missing group
    first, become the root likewise.  Rows equal in group and order are put in the order of their digests.
    """
    rows = stage(leaves.withColumn("leaf", F.unhex("leaf")), f"{name}-leaves")
    sort = [*(F.col(c).asc_nulls_first() for c in order), F.col("leaf").asc()]
    found = placed(rows, group, F.col(group).asc_nulls_first(), sort, None, f"{name}-order")
    payload = [c for c in leaves.columns if c not in ("leaf", group)]
    kid = F.struct((F.col("_i") % fan).cast("int").alias("pos"), F.col("leaf").alias("digest"), *payload)
    runs = (
        found.rows.groupBy(F.col("_t").alias("t"), F.expr(f"_i DIV {fan}").alias("p"))
        .agg(_in_order(kid), F.bool_or("_last").alias("last"))
        .withColumn("lone", (F.col("p") == 0) & F.col("last") & (F.size("kids") == 1))
    )
    digest = F.when(F.col("lone"), F.col("kids")[0]["digest"]).otherwise(_combined("kids"))
    runs = stage(runs.select(_node(F.col("t"), 1, F.col("p")).alias("node"), "kids", "lone", "last", digest.alias("digest")), f"{name}-runs")

    # Nodes to be combined: node (their key), t and p (their place), last, digest.
    level, tables, subroots = 1, [], []
    nodes = runs.select("node", F.col("node.t").alias("t"), F.col("node.p").alias("p"), "last", "digest")
    while True:
        alone = (F.col("p") == 0) & F.col("last")
        subroots.append(nodes.where(alone).select("node", F.lit(TOP).cast("long").alias("t"), F.col("t").alias("p"), (F.col("t") == found.groups - 1).alias("last"), "digest"))
        upper = _level(nodes.where(~alone), fan, level + 1, f"{name}-level")
        if upper.isEmpty():
            break
        tables.append((upper, False))
        level += 1
        nodes = _of(upper)
    height = level - 1
    nodes, above, first = subroots[0], 0, True
    for more in subroots[1:]:
        nodes = nodes.unionByName(more)
    while found.groups > 1:
        above += 1
        upper = _level(nodes, fan, above, f"{name}-top")
        tables.append((upper, first))
        nodes, first = _of(upper), False
        if nodes.where("p = 0 AND last").count():
            break
    top = nodes.select("node.*", as_hex(F.col("digest")).alias("digest")).first()
    pointers = None
    for upper, of_subroots in tables:
        each = upper.select(F.col("node").alias("up"), "kids", F.explode("kids").alias("kid")).select(
            "kid.node", "up", F.array(_segment("kids", F.col("kid.pos"), F.col("kid.digest") if of_subroots else None)).alias("path")
        )
        pointers = each if pointers is None else pointers.unionByName(each)
    if pointers is None:
        empty = f"node {NODE}, up {NODE}, path array<struct<before: binary, after: binary, subroot: binary>>"
        pointers = leaves.sparkSession.createDataFrame([], empty)
    key = None if top is None else (top["t"], top["k"], top["p"])
    return Tree(runs, pointers, None if top is None else top["digest"], key, height + above)


def _in_order(kid: Column) -> Column:
    """Kids by place; their payload may be of kinds that cannot be compared, so it takes no part."""
    return F.array_sort(F.collect_list(kid), lambda a, b: a["pos"] - b["pos"]).alias("kids")


def _combined(kids: str) -> Column:
    return F.unhex(F.sha2(as_hex(joined(F.col(kids))).cast("binary"), 256))


def _level(nodes: DataFrame, fan: int, level: int, name: str) -> DataFrame:
    """The runs of `fan` consecutive nodes: node, kids (pos, digest, node), last, digest."""
    kid = F.struct((F.col("p") % fan).cast("int").alias("pos"), "digest", "node")
    runs = nodes.groupBy("t", F.expr(f"p DIV {fan}").alias("p")).agg(_in_order(kid), F.bool_or("last").alias("last"))
    return stage(runs.select(_node(F.col("t"), level, F.col("p")).alias("node"), "kids", "last", _combined("kids").alias("digest")), name)


def _of(upper: DataFrame) -> DataFrame:
    return upper.select("node", F.col("node.t").alias("t"), F.col("node.p").alias("p"), "last", "digest")


def _segment(kids: str, pos: Column, subroot: Column | None = None) -> Column:
    kids = F.col(kids)
    return F.struct(
        joined(F.slice(kids, F.lit(1), pos)).alias("before"), joined(F.slice(kids, pos + 2, F.size(kids))).alias("after"),
        (F.lit(None) if subroot is None else subroot).cast("binary").alias("subroot"),
    )


def paths(tree: Tree, name: str = "merkle") -> DataFrame:
    """(node, path): the segments from every inner node but the root to the root, by pointer jumping.

    A node points at an ancestor and holds the segments up to it.  A round looks up where that ancestor
    points, appends its segments and so doubles the distance; rounds grow with the logarithm of the height.
    Of the ancestors, few are pointed at by very many nodes: those are broadcast, see `join_hot`.
    """
    now, far = tree.pointers, 1
    if tree.root_key is None:
        return now.select("node", "path")
    root = F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(tree.root_key, ("long", "int", "long"), "tkp")))
    now = stage(now, f"{name}-paths")
    while far < tree.height:
        # What lies `far` above a lowest run is at least so high, or a node of the tree of trees.
        ahead = now.where((F.col("node.t") == TOP) | (F.col("node.k") > far)).select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("more")
        )
        going = join_hot(now.where(F.col("up") != root), ahead, "up")
        gone = going.select("node", F.col("next").alias("up"), F.concat("path", "more").alias("path"))
        now = stage(now.where(F.col("up") == root).unionByName(gone), f"{name}-paths")
        far *= 2
    return now.select("node", "path")


def proofs(tree: Tree, name: str = "merkle") -> DataFrame:
    """Per leaf: its other columns, leaf, subroot, root, segments (array of before, after).

    All digests are hexadecimal text; a segment holds the siblings before and after the node, level by level
    from the leaf to the root.  A leaf that is its own subroot has no segment within its group.  The leaves
    of a run share their ancestors' segments, which are joined to the run, once.
    """
    found = paths(tree, name).where((F.col("node.t") != TOP) & (F.col("node.k") == 1))
    # Runs of leaves and their paths are one to one.
    rows = tree.runs.select("node", "kids", "lone").join(found, "node", "left").select(
        "kids", "lone",
        F.coalesce(F.transform("path", lambda s: F.struct(as_hex(s["before"]).alias("before"), as_hex(s["after"]).alias("after"))), F.array()).alias("upper"),
        as_hex(F.get(F.array_compact(F.transform(F.col("path"), lambda s: s["subroot"])), F.lit(0))).alias("subroot"),
    )
    own = F.struct(as_hex(F.col("own.before")).alias("before"), as_hex(F.col("own.after")).alias("after"))
    root = F.lit(tree.root).cast("string")
    payload = [c for c in tree.runs.schema["kids"].dataType.elementType.names if c not in ("pos", "digest")]
    return rows.select("*", F.explode("kids").alias("kid")).withColumn("own", _segment("kids", F.col("kid.pos"))).select(
        *(F.col("kid")[c].alias(c) for c in payload), as_hex(F.col("kid.digest")).alias("leaf"),
        F.coalesce("subroot", root).alias("subroot"), root.alias("root"),
        F.when(F.col("lone"), F.col("upper")).otherwise(F.concat(F.array(own), F.col("upper"))).alias("segments"),
    )


def manifest(docs: DataFrame, claims: Column, group: str = "source", order: str = "doc_id",
             columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = 16) -> DataFrame:
    """Per row: doc_id, claimed (the digest of what is now claimed to be the row), leaf, subroot, root, segments.

    `claims` gives the text that someone holds and wants checked against the manifest.  A missing group, id or
    text is a value of its own; repeated rows are leaves of their own; other columns are left out; an empty
    table has no root and no rows.
    """
    fields = [F.col(c) for c in columns]
    claimed = digest_of(*(claims if c == "text" else F.col(c) for c in columns))
    leaf = digest_of(*fields)
    differs = ~claims.eqNullSafe(F.col("text"))
    leaves = docs.select(order, F.col(group).alias("_group"), leaf.alias("leaf"), F.when(differs, F.unhex(claimed)).alias("claimed"))
    found = proofs(build(leaves, "_group", [order], fan))
    return found.withColumn("claimed", F.coalesce(as_hex(F.col("claimed")), F.col("leaf")))


def checked(found: DataFrame) -> DataFrame:
    """Add proof_sha256 (all siblings in order), folded_root (of what is claimed) and verified."""
    siblings = F.concat_ws("", F.transform("segments", lambda s: F.concat(s["before"], s["after"])))
    return found.withColumns({
        "proof_sha256": F.sha2(siblings.cast("binary"), 256), "folded_root": fold(F.col("claimed"), F.col("segments")),
    }).withColumn("verified", F.col("folded_root") == F.col("root"))
