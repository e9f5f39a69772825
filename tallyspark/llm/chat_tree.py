r"""Operator 7: chat formatting over a prefix tree of conversations.

A turn is written `<|role|>text</s>`. Inside roles and texts a backslash is doubled, and one is put into every
control string (`<|` becomes `<\|`), so that none is left and the reading back is exact. Conversations that
share initial turns share nodes. A node's id is the digest of its parent's id and its own piece, of one width
at any depth; equal conversations end in one leaf. The steps:

1. each leaf's ids, root first, are sorted over the cluster by range: that is the depth-first order, and a node
   belongs to the first leaf that passes through it, which emits its text once;
2. offsets of the layout are a distributed prefix sum of what each leaf adds;
3. every node gets its place, its position id and the intervals of the layout that it attends to: those of its
   ancestors, adjoining ones merged, so that a long conversation's are few;
4. a conversation is read back from the layout by the starts of its nodes.

Turns that very many conversations share make frequent keys; those are joined apart (`join_uneven`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, join_uneven, partitions

#: Places inside control strings, after their first character.
_INSIDE = r"(?<=<)(?=\||/s>|s>)|(?<=\|)(?=>)|(?<=\[)(?=/?INST\])"
#: Shared pieces up to this many bytes are broadcast where very many conversations hold them.
BROADCAST_PIECE = 16_384
_INTERVALS = "array<struct<start:bigint,stop:bigint>>"


def escape(text: Column) -> Column:
    """Double backslashes, then break control strings with one."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _INSIDE, r"\\")


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, piece, id, lead, tail, pos)): each turn formatted, with its node's id, where
    its text lies in the piece, and its position id, the length of all turns before it.

    Turns are ordered by turn, then role and text; null roles and texts are empty; repeated rows stay; rows with a
    null conv_id form one conversation.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    listed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def piece(x: Column) -> Column:
        lead = F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>"))
        body = escape(x["text"])
        return F.struct(x["role"].alias("role"), F.concat(lead, body, F.lit("</s>")).alias("piece"), F.length(lead).alias("lead"), (F.length(lead) + F.length(body)).alias("tail"))

    pieces = listed.select("conv_id", F.transform("rows", piece).alias("pieces"))
    kind = "array<struct<role:string,piece:string,id:binary,lead:int,tail:int,pos:bigint>>"

    def chain(state: Column, x: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        pos = F.coalesce(last["pos"] + F.length(last["piece"]), F.lit(0)).cast("bigint")
        node = F.unhex(F.md5(F.concat(F.coalesce(last["id"], F.lit("").cast("binary")), x["piece"].cast("binary"))))
        return F.concat(state, F.array(F.struct(x["role"].alias("role"), x["piece"].alias("piece"), node.alias("id"), x["lead"].alias("lead"), x["tail"].alias("tail"), pos.alias("pos"))))

    return pieces.select("conv_id", F.aggregate("pieces", F.array().cast(kind), chain).alias("turns"))


def _leaves(paths: DataFrame) -> DataFrame:
    """(leaf, rank, ids, sizes, poss, owner, n): the distinct conversations in depth-first order.

    owner is one conversation that ends in the leaf, and n how many do.
    """
    one = paths.select(
        F.element_at("turns", -1)["id"].alias("leaf"), F.struct(F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: F.length(t["piece"]).cast("long")).alias("sizes"), F.transform("turns", lambda t: t["pos"]).alias("poss")).alias("path"), _key().alias("key"),
    )
    distinct = one.groupBy("leaf").agg(F.first("path").alias("path"), F.min("key").alias("owner"), F.count(F.lit(1)).alias("n")).select("leaf", "path.*", "owner", "n")
    ordered = distinct.repartitionByRange(partitions(paths), "ids").sortWithinPartitions("ids")
    # ids of sorted ranges rise with the order, whatever the ranges' sizes
    return cut(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))


def build_tree(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of `conversation_paths`: its nodes, and the starts of each leaf's nodes.

    Nodes: id, start, stop, pos, depth, role, piece, loss_from, loss_to, ancestors, conversations. [start, stop) is
    the node's place in the depth-first layout, in characters; a node attends to itself up to each character and to
    its ancestors' intervals, in which adjoining ones are merged. pos is the position id of its first character.
    [loss_from, loss_to) is the trained part of the piece: an assistant's text, else empty.
    Leaves: leaf (the id of a conversation's last turn), starts (of its nodes, root first), n (conversations).
    """
    leaves = _leaves(paths)
    steps = leaves.select("rank", "n", F.posexplode(F.arrays_zip("ids", "sizes", "poss")).alias("step", "x")).select("rank", "n", "step", F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"), F.col("x.poss").alias("pos"))
    nodes = cut(
        steps.groupBy("id").agg(F.min("rank").alias("by"), F.first("step").alias("step"), F.first("size").alias("size"), F.first("pos").alias("pos"), F.sum("n").alias("conversations"), F.count(F.lit(1)).alias("leaves"))
    )
    # what each leaf adds to the layout, and where that begins: sums by range, then inside each
    added = nodes.groupBy(F.col("by").alias("rank")).agg(F.sum("size").alias("size"), F.min("step").alias("first"), F.min("pos").alias("first_pos")).withColumn("part", F.shiftright("rank", 33))
    parts = added.groupBy("part").agg(F.sum("size").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    based = added.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(shifts), "part").select("rank", "first", "first_pos", (F.col("before") + F.col("shift")).alias("base"))
    starts = nodes.join(based.withColumnRenamed("rank", "by"), "by").select("id", "leaves", "conversations", (F.col("base") + F.col("pos") - F.col("first_pos")).alias("start"))

    # every leaf's own nodes, with their places
    placed = join_uneven(steps.select("rank", "step", "id", "size"), starts, ["id"], "leaves", F.struct("rank", "step"))
    place = F.struct("step", "start", (F.col("start") + F.col("size")).alias("stop"), "conversations")
    lists = placed.groupBy("rank").agg(F.sort_array(F.collect_list(place)).alias("places"))
    known = cut(leaves.select("leaf", "rank", "owner", "n").join(lists, "rank").join(based, "rank", "left").select("leaf", "rank", "owner", "n", "places", "first", "first_pos", "base"))

    # a leaf emits the nodes from its first new one on; those adjoin each other in the layout
    def merge(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), p["stop"].alias("stop"))))
        return F.when(last["stop"] == p["start"], grown).otherwise(F.concat(out, F.array(F.struct(p["start"].alias("start"), p["stop"].alias("stop")))))

    above = F.aggregate(F.slice("places", F.lit(1), F.col("first")), F.array().cast(_INTERVALS), merge)
    emitting = known.where("base is not null").select(F.col("owner").alias("key"), "first", "first_pos", "base", "places", above.alias("above"))
    last = F.try_element_at("above", F.lit(-1))
    adjoins = F.coalesce(last["stop"] == F.col("base"), F.lit(False))
    emitting = emitting.withColumn("from", F.when(adjoins, last["start"]).otherwise(F.col("base"))).withColumn("above", F.when(adjoins, F.slice("above", F.lit(1), F.size("above") - 1)).otherwise(F.col("above")))
    texts = paths.select(_key().alias("key"), "turns").join(emitting, "key")
    rows = texts.select("first_pos", "base", "first", "places", "above", "from", F.posexplode(F.slice("turns", F.col("first") + 1, F.size("turns"))).alias("i", "t"))
    start = F.col("base") + F.col("t.pos") - F.col("first_pos")
    trained = F.col("t.role") == "assistant"
    own = F.when(start > F.col("from"), F.array(F.struct(F.col("from").alias("start"), start.alias("stop")))).otherwise(F.array().cast(_INTERVALS))
    out = rows.select(
        F.col("t.id").alias("id"), start.alias("start"), (start + F.length("t.piece")).alias("stop"), F.col("t.pos").alias("pos"), (F.col("first") + F.col("i") + 1).alias("depth"), F.col("t.role").alias("role"), F.col("t.piece").alias("piece"),
        F.when(trained, F.col("t.lead")).otherwise(0).alias("loss_from"), F.when(trained, F.col("t.tail")).otherwise(0).alias("loss_to"), F.concat("above", own).alias("ancestors"),
        F.element_at("places", F.col("first") + F.col("i") + 1)["conversations"].alias("conversations"),
    )
    return out, known.select("leaf", F.transform("places", lambda p: p["start"]).alias("starts"), "n")


def read_back(paths: DataFrame, tree: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per conversation, from the tree: conv_id, formatted, turns (role, text), trained (the text under the mask), and
    over its turns positions (the sum of position ids), attended (the sum of the attended intervals' lengths) and
    layout_sha256 (the digest of start:stop:pos:conversations:attended intervals of each).

    Each leaf is read once, from the nodes that stand at its starts, and its conversations share what is read.
    """
    nodes, leaves = tree
    steps = leaves.select("leaf", F.posexplode("starts").alias("step", "start"))
    seen = F.array_join(F.transform("ancestors", lambda a: F.concat_ws("-", a["start"].cast("string"), a["stop"].cast("string"))), ",")
    place = F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("start", "stop", "pos", "conversations")), seen), 256)
    attended = F.aggregate("ancestors", F.lit(0).cast("long"), lambda total, a: total + a["stop"] - a["start"])
    layout = nodes.select("start", "piece", "loss_from", "loss_to", "pos", attended.alias("attended"), place.alias("place"), "conversations")
    laid = cut(layout)
    found = join_uneven(steps, laid, ["start"], "conversations", F.struct("leaf", "step"), F.octet_length("piece") <= BROADCAST_PIECE)
    piece = F.struct("step", "piece", "loss_from", "loss_to", "pos", "attended", "place")
    lists = found.groupBy("leaf").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    trained = F.array_join(F.transform("pieces", lambda p: unescape(F.substring(p["piece"], p["loss_from"] + 1, p["loss_to"] - p["loss_from"]))), "")
    layout_digest = F.sha2(F.array_join(F.transform("pieces", lambda p: p["place"]), "\n"), 256)

    def total(field: str) -> Column:
        return F.aggregate(F.transform("pieces", lambda p: p[field]), F.lit(0).cast("long"), lambda before, x: before + x)

    whole = lists.select("leaf", formatted.alias("formatted"), trained.alias("trained"), total("pos").alias("positions"), total("attended").alias("attended"), layout_digest.alias("layout_sha256"))
    pattern = F.lit(r"(?s)<\|(.*?)\|>(.*?)</s>")
    turns = F.arrays_zip(F.transform(F.regexp_extract_all("formatted", pattern, F.lit(1)), unescape).alias("role"), F.transform(F.regexp_extract_all("formatted", pattern, F.lit(2)), unescape).alias("text"))
    read = whole.select("leaf", "formatted", turns.alias("turns"), "trained", "positions", "attended", "layout_sha256")
    return read.join(leaves.select("leaf", "n"), "leaf")


def conversations_of(paths: DataFrame, per_leaf: DataFrame) -> DataFrame:
    """conv_id and the columns of `per_leaf` (leaf, n, …) for every conversation; very many may share a leaf."""
    ends = paths.select("conv_id", F.element_at("turns", -1)["id"].alias("leaf"))
    return join_uneven(ends, per_leaf, ["leaf"], "n", F.col("conv_id")).drop("leaf", "n")
