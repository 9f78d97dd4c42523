"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each by pointer jumping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.sources.shared import saved

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of a tree that one shuffle builds: a row then holds FAN ** LEVELS_AT_ONCE digests.
LEVELS_AT_ONCE = 5
# Rows that are numbered together.
ROWS_TOGETHER = 50_000
# The tree over the trees of the sources; their keys start with 0 or 1.
TOP = ""


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of a row: each field as its number of UTF-8 bytes, a colon and its text, or ``-``."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, pos, n, leaf and the columns kept) with a row for each of the data, ``runs``
    (id, children, whole) with each inner node's digests, ``subroots`` (tree, id, digest), and the ``root``.

    A node's ``id`` is its tree, level and place there; ``whole`` marks the top of a tree.
    ``height`` is the number of levels from the lowest leaf to the root, ``size`` the number of leaves and
    ``trees`` that of sources.
    """

    leaves: DataFrame
    runs: DataFrame
    subroots: DataFrame
    root: str | None
    root_id: Column
    height: int
    size: int
    trees: int


def _stored(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, stored in no more files than they need: far up a tree few rows are left."""
    return saved(df.coalesce(max(1, -(-rows // ROWS_TOGETHER))))


def _ranked(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, with ``pos``, from 0, in the order of each ``tree``, and ``n``, the rows of that tree.

    Rows are dealt by ranges of tree and order, so that a tree with most of the rows is numbered by
    many tasks; what each range holds of each tree is added up.
    """
    ranges = df.repartitionByRange(max(1, -(-rows // ROWS_TOGETHER)), "tree", *order)
    placed = _stored(ranges.withColumn("_part", F.spark_partition_id()), rows)
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_here"))
    starts = counts.select(
        "tree", "_part", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_start"), F.sum("_here").over(tree).alias("n")
    )
    own = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order)) - 1
    numbered = placed.withColumn("_own", own).join(starts, ["tree", "_part"])
    return numbered.withColumn("pos", F.col("_start") + F.col("_own")).drop("_part", "_start", "_own")


def _id(tree, level, pos) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _built(nodes: DataFrame, base: int) -> DataFrame:
    """``id, children, of`` of the inner nodes in the next levels above ``nodes(tree, pos, n, digest)``.

    ``n`` counts the tree's nodes on the level ``base`` of ``nodes``, and ``of`` those on the level of ``id``.
    """
    wide = FAN**LEVELS_AT_ONCE
    group = F.floor(F.col("pos") / wide).alias("group")
    lists = nodes.where("n > 1").groupBy("tree", "n", group).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("at"))
    lists = lists.withColumn("digests_0", F.col("at.digest"))
    made = []
    for j in range(LEVELS_AT_ONCE):
        digests = F.col(f"digests_{j}")
        # A tree ends on the level where it has one node.
        goes_on = (F.ceil(F.col("n") / FAN**j) > 1) & (F.size(digests) > 0)
        runs = F.when(goes_on, _in_runs(digests)).otherwise(F.array().cast("array<array<string>>"))
        lists = lists.withColumn(f"runs_{j}", runs).withColumn(f"digests_{j + 1}", F.transform(f"runs_{j}", _joined))
        made.append(_as_nodes(F.col(f"runs_{j}"), base, j))
    return lists.select(F.inline(F.concat(*made)))


def _in_runs(digests: Column) -> Column:
    last = F.floor((F.size(digests) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(digests, i * FAN + 1, FAN))


def _as_nodes(runs: Column, base: int, j: int) -> Column:
    first = F.col("group") * FAN ** (LEVELS_AT_ONCE - j - 1)
    of = F.ceil(F.col("n") / FAN ** (j + 1)).cast("long").alias("of")
    level = F.lit(base + j + 1)

    def node(run: Column, i: Column) -> Column:
        return F.struct(_id(F.col("tree"), level, first + i).alias("id"), run.alias("children"), of)

    return F.transform(runs, node)


def _grown(nodes: DataFrame, most: int, rows: int) -> DataFrame:
    """``id, children, of`` of all inner nodes over the ``rows`` leaves ``nodes(tree, pos, n, digest)``; ``most`` is the largest n."""
    runs = None
    for base in range(0, max(1, height(most)), LEVELS_AT_ONCE):
        made = _stored(_built(nodes, base), rows // FAN**base)
        runs = made if runs is None else runs.unionByName(made)
        upper = made.where(F.col("id.level") == base + LEVELS_AT_ONCE)
        nodes = upper.select("id.tree", "id.pos", F.col("of").alias("n"), _joined(F.col("children")).alias("digest"))
    return runs


def manifest(docs: DataFrame, keep: list[str] | None = None) -> Manifest:
    """The tree of ``docs(doc_id, source, lang, n_chars, text)``, with the columns ``keep`` on its leaves.

    The rows of a source are leaves in the order of doc_id (null first, ties by digest, so that equal
    rows may stand in either order). Three consecutive nodes, the last run fewer, become the digest of
    their hex digests until one is left, the source's subroot; the subroots, in the order of the
    sources' bytes (null first), become the root in the same way. An empty table has no root.
    """
    keep = [f"_kept_{c}" for c in keep or []]
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    leaves = docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(*map(F.col, FIELDS)).alias("leaf"),
        *[F.col(c.removeprefix("_kept_")).alias(c) for c in keep],
    )
    size = docs.count()
    leaves = _ranked(leaves, ["doc_id", "leaf"], size)
    most = leaves.agg(F.max("n")).first()[0] or 0
    runs = _grown(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")), most, size)
    alone = leaves.where("n = 1").select("tree", _id(F.col("tree"), F.lit(0), F.lit(0)).alias("id"), F.col("leaf").alias("digest"))
    tops = runs.where("of = 1").select("id.tree", "id", _joined(F.col("children")).alias("digest"))
    sources = tops.unionByName(alone).withColumnRenamed("tree", "key").withColumn("tree", F.lit(TOP))
    trees = sources.count()
    subroots = _ranked(sources, ["key"], trees)
    above = _grown(subroots.select("tree", "pos", "n", "digest"), trees, trees)
    # Trees of one source end with its top, which no tree stands above.
    ends = above.where("of = 1").select("id", _joined(F.col("children")).alias("digest")) if trees > 1 else subroots.select("id", "digest")
    end = ends.first()
    root, root_id = (end.digest, _id(F.lit(end.id.tree), F.lit(end.id.level), F.lit(end.id.pos))) if end else (None, F.lit(None))
    runs = runs.unionByName(above).select("id", "children", (F.col("of") == 1).alias("whole"))
    return Manifest(leaves, runs, subroots, root, root_id, height(most) + height(trees), size, trees)


def _siblings(children: Column, i: Column) -> Column:
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), i), "").alias("left"),
        F.array_join(F.slice(children, i + 2, F.lit(FAN)), "").alias("right"),
    )


def paths(tree: Manifest) -> DataFrame:
    """``id, up, path, subroot`` of every inner node below the root: its siblings on each level up to the root.

    A node starts with its own siblings and points to its parent. In each round it appends the path
    of the node it points to and then points where that one does, so the distance doubles. Nodes
    that point to the root are done. Only nodes far enough up can be pointed to in a round; they are
    stored apart, as many fewer as the round is later.
    """
    up = F.col("id.level") > 1
    one = F.transform("children", lambda child, i: F.struct(i.alias("i"), child.alias("digest")))
    inner = tree.runs.where(up | (F.col("id.tree") == TOP)).select("id", "children", F.inline(one))
    place = F.col("id.pos") * FAN + F.col("i")
    links = inner.select(
        _id(F.col("id.tree"), F.col("id.level") - 1, place).alias("id"),
        F.col("id").alias("up"),
        F.array(_siblings(F.col("children"), F.col("i"))).alias("path"),
        F.col("digest"),
    )
    # The leaves of the tree over the trees are the tops of these.
    is_top = (F.col("id.tree") == TOP) & (F.col("id.level") == 0)
    tops = links.where(is_top).withColumn("pos", F.col("id.pos")).drop("id")
    tops = tops.join(tree.subroots.select("pos", "id"), "pos").withColumn("subroot", F.col("digest"))
    others = links.where(~is_top).withColumn("subroot", F.lit(None).cast("string"))
    columns = ["id", "up", "path", "subroot"]
    rows = tree.size // 2 + tree.trees
    climbing = _stored(others.select(columns).unionByName(tops.select(columns)), rows)
    done = climbing.limit(0)
    distance = 1
    while distance < tree.height:
        far = climbing.unionByName(done).where((F.col("id.level") > distance) | (F.col("id.tree") == TOP))
        names = {"id": "up", "up": "next", "path": "more", "subroot": "top"}
        far = _stored(far.select(*[F.col(c).alias(new) for c, new in names.items()]), tree.size // FAN**distance + tree.trees)
        there = F.col("up") == tree.root_id
        done = done.unionByName(climbing.where(there))
        jumped = climbing.where(~there).join(far, "up")
        path, subroot = F.concat("path", "more").alias("path"), F.coalesce("subroot", "top").alias("subroot")
        climbing = _stored(jumped.select("id", F.col("next").alias("up"), path, subroot), rows)
        distance *= 2
    return done.unionByName(climbing)


def proofs(tree: Manifest) -> DataFrame:
    """The leaves with ``leaf``, ``subroot``, ``root`` and ``path``, the siblings (left, right) on each level.

    The run of a leaf takes the path of its node, and each leaf its siblings of the run.
    """
    found = paths(tree).select("id", F.col("path").alias("rest"), "subroot")
    runs = tree.runs.where((F.col("id.level") == 1) & (F.col("id.tree") != TOP)).select("id", "children")
    # The node that holds a leaf: its run, or the leaf itself where the source has no other.
    own = F.when(F.col("n") > 1, _id(F.col("tree"), F.lit(1), F.floor(F.col("pos") / FAN))).otherwise(_id(F.col("tree"), F.lit(0), F.lit(0)))
    held = runs.join(found, "id", "full")
    held = held.where(F.col("id.level") <= 1).where(F.col("id.tree") != TOP)
    rest = F.coalesce("rest", F.array().cast("array<struct<left:string,right:string>>"))
    path = F.when(F.col("n") > 1, F.concat(F.array(_siblings(F.col("children"), (F.col("pos") % FAN).cast("int"))), rest)).otherwise(rest)
    root = F.lit(tree.root).cast("string")
    joined = tree.leaves.withColumn("id", own).join(held, "id", "left")
    kept = [F.col(c).alias(c.removeprefix("_kept_")) for c in tree.leaves.columns if c.startswith("_kept_")]
    return joined.select(
        "doc_id", "leaf", F.coalesce("subroot", root).alias("subroot"), root.alias("root"), path.alias("path"), *kept
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, at: F.sha2(F.concat(at["left"], digest, at["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the decimal doc_id; without an id, as it is."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def audited(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    The manifest is made of the rows as they are; each row is then held against it as :func:`tampered`
    leaves it, by its leaf and the siblings of its proof alone. Nulls are fields without a value;
    repeated rows are leaves of their own; an empty table gives no rows; other columns are ignored.
    """
    names = [F.col(c) for c in FIELDS]
    names[FIELDS.index("text")] = tampered(F.col("text"), F.col("doc_id"))
    rows = docs.select(*FIELDS, leaf_digest(*names).alias("_found"))
    shown = proofs(manifest(rows, keep=["_found"]))
    return shown.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("_found"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
