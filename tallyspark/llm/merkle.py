"""Operator 13: a Merkle manifest of a dataset, whose nodes lie in an external store.

Every row is a leaf, and every lang has a binary tree over its leaves in order of doc_id; the trees' subroots are the
leaves of one more tree. Leaves are written once, dealt by range and sorted into runs; a run's place follows from the
sizes of the runs before it. The sorted leaves stream into the node store, Parquet with a folder a level: a task reads
4096 consecutive nodes and makes the levels above them, each from the one below in order, and the next pass reads the
highest of these again, so n leaves take log(n) / 12 passes. Proofs come from a merge-scan in the other direction: the
nodes of a run of 4096, sorted by level and place, meet the path of the run's own top node, which the pass above has
given, and each leaf takes its siblings by coordinate. No task holds more than one run's nodes, and nothing is
collected but the size of the largest tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from tallyspark.llm.common import delete_folder, partitions, shared_folder

#: Levels that one pass makes: a task holds 2 ** BITS nodes of the level it reads.
BITS = 12
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())])


def digest(*parts: Column | str) -> Column:
    """Lower-case hex SHA-256 of texts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*(encoded(c) for c in (doc_id, source, lang, n_chars, text)))


def parent(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(tree, bucket) and the rows of each, in order, from batches sorted by both."""
    key, rows = None, []
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "bucket", *columns)]
        for tree, bucket, *row in zip(*lists, strict=True):
            if (tree, bucket) != key:
                if rows:
                    yield key, rows
                key, rows = (tree, bucket), []
            rows.append(tuple(row))
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _climb(base: int, bits: int):
    """The nodes of the levels base + 1 to base + bits from runs of 2 ** bits nodes of level base."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, bucket), rows in _runs(batches, ["height", "digest"]):
            height, below = rows[0][0], [d for _, d in rows]
            for level in range(1, min(bits, height - base) + 1):
                below = [parent(*below[i : i + 2]) for i in range(0, len(below), 2)]
                first = bucket << (bits - level)
                yield from ((tree, base + level, first + i, d) for i, d in enumerate(below))

    return lambda batches: _batches(nodes(batches), _NODE)


def _descend(base: int, bits: int, carried: list[str], schema: pa.Schema):
    """The path of every node of level base, from its run's nodes below level base + bits and the path of what is above.

    Rows come sorted by level, highest first: the path from above (level null) leads, then each level by place. A
    step is L or R and the sibling that stands there, or empty where a node was alone; a root (digest null) has none.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, bucket), rows in _runs(batches, ["level", "sibling", "path", *carried]):
            above: list[str] = []
            levels: dict[int, list[str | None]] = {}
            kept: list[tuple] = []
            for level, node, path, *rest in rows:
                if level is None:
                    above = path
                    continue
                levels.setdefault(level, []).append(node)
                if level == base:
                    kept.append(tuple(rest))
            order = sorted(levels)
            steps = [[d and ("" if (i ^ 1) >= len(levels[k]) else ("L" if i & 1 else "R") + levels[k][i ^ 1]) for i, d in enumerate(levels[k])] for k in order]
            first = bucket << bits
            for i, rest in enumerate(kept):
                own = [here[i >> up] for up, here in enumerate(steps)]
                yield (tree, first + i, *rest, [x for x in own if x is not None] + above)

    return lambda batches: _batches(paths(batches), schema, 1024)


def _dealt(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Runs of one tree together, in order."""
    return rows.repartition(partitions(rows), "tree", "bucket").sortWithinPartitions("tree", "bucket", *order)


def number(leaves: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """`leaves` (tree, digest, ...), written in sorted runs, with pos, their place in their tree by `order`, and
    height, its levels above the leaves. Rows that tie in `order` stand in any order, but each has its own place."""
    tree = F.col("tree").asc_nulls_first()
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions(leaves), tree, *order, "tie").sortWithinPartitions(tree, *order, "tie")
    # ids rise from run to run and within each
    ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/runs")
    spark = leaves.sparkSession
    runs = spark.read.parquet(f"{folder}/runs").withColumn("run", F.shiftright("at", 33))
    sizes = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("run")) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("tree"))
    # the levels above n leaves: the bits of n - 1
    height = F.when(total == 1, 0).otherwise(F.length(F.bin(total - 1))).cast("int")
    offsets = sizes.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), (before - F.col("first")).alias("shift"), height.alias("height"))
    joined = runs.join(offsets, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("run") == F.col("_run")))
    joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "run", "shift", "_tree", "_run").write.parquet(f"{folder}/leaves")
    delete_folder(spark, f"{folder}/runs")
    return spark.read.parquet(f"{folder}/leaves")


def grow(leaves: DataFrame, folder: str, bits: int = BITS) -> tuple[DataFrame, int]:
    """The node store of `leaves` (tree, pos, height, digest): (tree, level, pos, digest), a folder a level under
    `folder`, and the height of the highest tree."""
    spark, store = leaves.sparkSession, f"{folder}/nodes"
    highest = leaves.agg(F.max("height")).first()[0] or 0
    leaves.select("tree", "pos", "digest").write.parquet(f"{store}/level=0")
    heights = leaves.where("pos = 0").select(F.col("tree").alias("_tree"), "height")
    for base in range(0, highest, bits):
        if base:
            # what the last pass made lies in this folder: one level, read in order
            below = spark.read.parquet(f"{store}/level={base}").select("tree", "pos", "digest")
            below = below.join(heights, F.col("tree").eqNullSafe(F.col("_tree"))).where(F.col("height") > base).drop("_tree")
        else:
            below = leaves.select("tree", "pos", "height", "digest")
        runs = _dealt(below.withColumn("bucket", F.shiftright("pos", bits)), "pos").select("tree", "bucket", "height", "digest")
        runs.mapInArrow(_climb(base, bits), "tree string, level int, pos long, digest string").write.partitionBy("level").mode("append").parquet(store)
    nodes = spark.read.schema("tree string, pos long, digest string, level int").parquet(store).select("tree", "level", "pos", "digest")
    return nodes, highest


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, height, digest) of each tree's root: its node at place 0 of its highest level."""
    return nodes.where("pos = 0").groupBy("tree").agg(F.max("level").alias("height"), F.max_by("digest", "level").alias("digest"))


def prove(nodes: DataFrame, leaves: DataFrame, above: DataFrame, highest: int, folder: str, bits: int = BITS) -> DataFrame:
    """`leaves` (tree, pos, digest, ...) with path: from the leaf's own level to the root's and on along `above` (tree,
    height, path), which leads on from each tree's root."""
    spark = nodes.sparkSession
    heights = above.select(F.col("tree").alias("_tree"), "height")
    others = [(c, t) for c, t in leaves.dtypes if c not in ("tree", "pos", "digest", "height")]
    paths: DataFrame | None = None
    for base in reversed(range(0, max(highest, 1), bits)):
        carried = [("digest", "string"), *others] if base == 0 else []
        # trees whose root lies in this pass begin with what is above them
        low = F.col("height") > base if base else F.lit(True)
        heads = above.where(low & (F.col("height") <= base + bits)).select("tree", F.lit(0).cast("long").alias("bucket"), "path")
        if paths is not None:
            heads = heads.unionByName(paths.select("tree", F.col("pos").alias("bucket"), "path"))
        here = nodes.where((F.col("level") >= base) & (F.col("level") < base + bits))
        if base == 0:
            here = here.where("level > 0").unionByName(leaves.drop("height").withColumn("level", F.lit(0)), allowMissingColumns=True)
        rooted = here.join(heights, F.col("tree").eqNullSafe(F.col("_tree"))).where((F.col("level") < F.col("height")) | (F.col("level") == 0))
        bucket = F.expr(f"shiftright(pos, {bits} - (level - {base}))")
        # a root is nobody's sibling
        rows = rooted.select("tree", bucket.alias("bucket"), "level", "pos", F.when(F.col("level") < F.col("height"), F.col("digest")).alias("sibling"), *[c for c, _ in carried])
        runs = _dealt(heads.unionByName(rows, allowMissingColumns=True), F.col("level").desc_nulls_first(), "pos")
        ddl = ", ".join(f"{c} {t}" for c, t in [("tree", "string"), ("pos", "long"), *carried, ("path", "array<string>")])
        given = to_arrow_schema(_parse_datatype_string(ddl))
        paths = runs.mapInArrow(_descend(base, bits, [c for c, _ in carried], given), ddl)
        if base:
            paths.write.parquet(f"{folder}/paths-{base}")
            paths = spark.read.parquet(f"{folder}/paths-{base}")
    return paths


def climbed(start: Column | str, path: Column | str) -> Column:
    """The root that a leaf's digest gives along its path."""

    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.when(sibling == "", digest(node)).when(sibling.startswith("L"), digest(other, node)).otherwise(digest(node, other))

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row of `docs` (doc_id, source, lang, n_chars, text): doc_id, lang, pos, leaf, subroot, root, path and tampered.

    pos is the row's place among its lang's, by doc_id (null first), then by leaf: rows that repeat an id, or all of
    a row, are leaves of their own. path holds the siblings from the leaf to root, each L or R and a digest, or an
    empty text where a node was alone. tampered is the leaf with n_chars one higher, where unsigned crc32(doc_id) can
    be divided by 7 and n_chars is not null; else null. A null lang has its own tree; empty texts are values of no
    bytes; other columns are ignored; an empty table gives no rows. Folders of the store lie under the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    touched = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False)) & n_chars.isNotNull()
    more = n_chars.cast("decimal(20,0)") + 1
    leaves = docs.select(
        lang.cast("string").alias("tree"), doc_id.cast("long").alias("doc_id"),
        leaf_digest(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(touched, leaf_digest(doc_id, source, lang, more, text)).alias("tampered"),
    )
    # the texts are read once, sorting deals digests only
    leaves.write.parquet(f"{folder}/digests")
    placed = number(spark.read.parquet(f"{folder}/digests"), [F.col("doc_id").asc_nulls_first(), F.col("digest")], f"{folder}/langs")
    delete_folder(spark, f"{folder}/digests")
    nodes, highest = grow(placed, f"{folder}/langs", bits)

    subroots = tops(nodes)
    top_leaves = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest", F.col("height").alias("below"))
    top_placed = number(top_leaves, [F.col("lang").asc_nulls_first()], f"{folder}/tops")
    top_nodes, top_highest = grow(top_placed, f"{folder}/tops", bits)
    root = tops(top_nodes)
    top_paths = prove(top_nodes, top_placed, root.withColumn("path", F.array().cast("array<string>")), top_highest, f"{folder}/tops", bits)
    named = top_paths.join(root.select("tree", F.col("digest").alias("root")), "tree")
    named.select(F.col("lang").alias("tree"), F.col("below").alias("height"), "path", F.col("digest").alias("subroot"), "root").write.parquet(f"{folder}/subroots")
    above = spark.read.parquet(f"{folder}/subroots")

    paths = prove(nodes, placed, above.select("tree", "height", "path"), highest, f"{folder}/langs", bits)
    found = paths.join(above.select(F.col("tree").alias("_tree"), "subroot", "root"), F.col("tree").eqNullSafe(F.col("_tree")))
    return found.select("doc_id", F.col("tree").alias("lang"), "pos", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered")
