"""Prefix trie of conversations: ternary search trees per range shard, merged at their borders.

A turn is reduced to a 128-bit digest of role and text next to the text's bytes,
so texts never move. Conversations, as sequences of digests, are sorted into
range shards by (sequence, conversation id); equal sequences in great number
therefore spread over shards. A shard numbers its digests in their order and
builds a ternary search tree over these numbers, the median conversation first,
which keeps it balanced. One traversal with an explicit stack gives members,
leaves and savings of every node.

Only nodes on the path of a shard's first or last conversation can have members
in other shards. These boundary nodes, at most two per level and shard, are
merged by the digest of their path: members first, then the sums over subtrees,
to which each shard adds the boundary nodes that it is the first to hold. All
other nodes are final where they are found.

The hash over the ids of conversations that end at a node is taken in the shard;
for boundary nodes the shards write the ids as text in order, in blocks, and the
blocks of a node are hashed one after the other with bounded memory.

Defined results: a null role or text is empty; turns of one conversation with
equal numbers follow each other by their digests; repeated rows are turns each;
rows without a conversation id take no part; a conversation may be rebuilt from
no turns and then ends at the root; an empty table has no nodes. Of the input
only the four named columns are read. A conversation is one row of 24 bytes per
turn, which bounds it at about 80 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import broadcast_if_few, ship, written

DIGEST = 16
SHARD_TURNS = 400_000        # turns of a shard's conversations, about
BLOCK_IDS = 50_000           # ids in a block of text
BOUNDARY_BROADCAST = 200_000
ROWS_A_BATCH = 20_000


# ---- conversations as sequences of digests --------------------------------------


def slim_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """``conv_id, turn, digest, n_bytes``; the digest covers role and text apart from each other."""
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    return conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST).alias("digest"),
        F.octet_length(said).cast("long").alias("n_bytes"),
    ).filter("conv_id IS NOT NULL")


def head_length(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % 9).cast("int")


def rebuilt(turns: DataFrame, family: int = 5) -> DataFrame:
    """``conv_id, turns``: turns of the family's first conversation, then own ones.

    A family's conversations lie in one partition, so one shuffle of slim rows
    serves both the grouping and the look at the first of the family.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    own = turns.withColumn("family", first).repartition("family").groupBy("family", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("turn").isNotNull().alias("known"), "turn", "digest", "n_bytes"))).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, 8)), ignorenulls=True).over(
        Window.partitionBy("family").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    h = head_length(F.col("conv_id"))
    return own.withColumn("head", head).withColumn("h", h).select("conv_id", F.concat(
        F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(own, 1, 0)")),
        F.expr("slice(own, h + 1, greatest(size(own) - h, 0))")).alias("turns"))


# ---- one shard -----------------------------------------------------------------


class TernaryTree:
    """Ternary search tree over sequences of whole numbers; a node is a prefix.

    ``low`` and ``high`` lead to siblings, ``down`` to the next position. Node 0
    is the empty prefix, and ``parent`` always has a smaller number.
    """

    def __init__(self) -> None:
        self.symbol, self.parent, self.depth = [-1], [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]

    def insert(self, sequence: list[int]) -> int:
        """The node of ``sequence``, made with its prefixes where missing."""
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        node = 0
        for value in sequence:
            at, links, key = down[node], down, node
            while at >= 0 and symbol[at] != value:
                links, key = (low, at) if value < symbol[at] else (high, at)
                at = links[key]
            if at < 0:
                at = len(symbol)
                links[key] = at
                symbol.append(value)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                low.append(-1)
                high.append(-1)
                down.append(-1)
            node = at
        return node

    def in_order(self) -> list[int]:
        """All nodes, a prefix before its extensions and siblings in order of their symbols."""
        out = [0]
        stack = [(self.down[0], False)]
        while stack:
            node, seen = stack.pop()
            if node < 0:
                continue
            if seen:
                out.append(node)
                stack.append((self.high[node], False))
                stack.append((self.down[node], False))
            else:
                stack.append((node, True))
                stack.append((self.low[node], False))
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle of every range before the rest of it."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


NODE_SCHEMA = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("slot", pa.int32()), ("parent_slot", pa.int32()),
    ("path", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("n_bytes", pa.int64()), ("ends_sha256", pa.string()), ("block", pa.int32()), ("ids", pa.string())])
NODE_DDL = ("kind string, shard int, slot int, parent_slot int, path binary, conv_id long, depth long, "
            "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, "
            "ends_sha256 string, block int, ids string")


def dictionary(digests: bytes) -> tuple[np.ndarray, int]:
    """Numbers of the digests of a shard, in the order of their bytes, and how many there are."""
    halves = np.array(memoryview(digests), np.uint8).reshape(-1, DIGEST).view(">u8").astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(halves[order], axis=0) != 0).any(axis=1)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    return codes, int(new.sum())


def shard_nodes(keys: list[bytes], ids: list[int], weights: np.ndarray, shard: int) -> Iterator[dict[str, list]]:
    """Rows of one shard, given its conversations in order of (sequence, id).

    ``node`` rows are final but for ``parent_conv_id`` below a boundary node,
    which ``parent_slot`` names. ``boundary`` rows hold the numbers of nodes that
    lie wholly in the shard and below them, and their own members. ``ends`` rows
    are blocks of ids.
    """
    sizes = np.array([len(k) // DIGEST for k in keys], np.int64)
    codes, n_codes = dictionary(b"".join(keys))
    size_of = np.zeros(n_codes, np.int64)
    size_of[codes] = weights
    codes = codes.tolist()
    ends = np.cumsum(sizes).tolist()
    starts = [e - s for e, s in zip(ends, sizes.tolist())]
    tree = TernaryTree()
    end_of = [0] * len(keys)
    for k in medians(len(keys)):
        end_of[k] = tree.insert(codes[starts[k]:ends[k]])
    n = len(tree.symbol)
    order = tree.in_order()
    members, smallest, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    finish: dict[int, list[int]] = {}
    for k, node in enumerate(end_of):           # ids of equal sequences ascend
        finish.setdefault(node, []).append(ids[k])
    boundary = {}
    for node in (end_of[0], end_of[-1]):
        while node >= 0:
            boundary[node] = 0
            node = tree.parent[node]
    for slot, node in enumerate(sorted(boundary)):
        boundary[node] = slot
    weight = [0, *(int(size_of[s]) for s in tree.symbol[1:])]
    for node in reversed(order):                # extensions before their prefix
        own = finish.get(node)
        if own:
            members[node] += len(own)
            if smallest[node] is None or own[0] < smallest[node]:
                smallest[node] = own[0]
        if node not in boundary:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * weight[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            if smallest[up] is None or smallest[node] < smallest[up]:
                smallest[up] = smallest[node]
            if node not in boundary:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    nothing = hashlib.sha256(b"").hexdigest()

    def rows(kind: str, **columns: list) -> dict[str, list]:
        length = len(next(iter(columns.values())))
        return {name: columns.get(name, [None] * length) for name in NODE_SCHEMA.names} | {"kind": [kind] * length}

    inner = [node for node in order if node not in boundary]
    for at in range(0, len(inner), ROWS_A_BATCH):
        own = inner[at:at + ROWS_A_BATCH]
        above = [tree.parent[x] for x in own]
        yield rows(
            "node", shard=[shard] * len(own), parent_slot=[boundary.get(p) for p in above],
            conv_id=[smallest[x] for x in own], depth=[tree.depth[x] for x in own],
            parent_conv_id=[None if p in boundary else smallest[p] for p in above],
            n_convs=[members[x] for x in own], n_children=[children[x] for x in own],
            n_leaves=[leaves[x] for x in own], saved_tokens=[saved[x] for x in own],
            ends_sha256=[hashlib.sha256(",".join(map(str, finish[x])).encode()).hexdigest() if x in finish else nothing
                         for x in own])
    edge = sorted(boundary)
    first, last = keys[0], keys[-1]
    path_of = {}
    for node, key in ((end_of[0], first), (end_of[-1], last)):
        while node >= 0:
            path_of[node] = hashlib.sha256(key[:DIGEST * tree.depth[node]]).digest()[:DIGEST]
            node = tree.parent[node]
    yield rows(
        "boundary", shard=[shard] * len(edge), slot=[boundary[x] for x in edge],
        parent_slot=[boundary.get(tree.parent[x]) for x in edge], path=[path_of[x] for x in edge],
        conv_id=[smallest[x] for x in edge], depth=[tree.depth[x] for x in edge], n_convs=[members[x] for x in edge],
        n_children=[children[x] for x in edge], n_leaves=[leaves[x] for x in edge],
        saved_tokens=[saved[x] for x in edge], n_bytes=[weight[x] for x in edge])
    for node in edge:
        own = finish.get(node, [])
        for block, at in enumerate(range(0, len(own), BLOCK_IDS)):
            yield rows("ends", shard=[shard], path=[path_of[node]], depth=[tree.depth[node]], block=[block],
                       ids=[",".join(map(str, own[at:at + BLOCK_IDS]))])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, ids, weights = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
        weights.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
    if keys:
        for columns in shard_nodes(keys, ids, np.concatenate(weights), TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in NODE_SCHEMA], schema=NODE_SCHEMA)


def shards(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Rows of all shards; ``sequences`` is a written table of ``conv_id, turns``."""
    spark = sequences.sparkSession
    total, n = sequences.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)), F.count("*")).first()
    count = min(max(spark.sparkContext.defaultParallelism, -(-(total + n) // shard_turns)), max(n, 1))
    keyed = sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), "")).alias("key"),
        F.transform("turns", lambda t: t.n_bytes).alias("weights"))
    ship(spark)
    return keyed.repartitionByRange(count, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _shard, NODE_DDL)


# ---- boundary nodes -------------------------------------------------------------


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of every node, which come in order, one node after the other."""
    node, digest = None, None
    for batch in batches:
        out = []
        for path, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (path, depth) == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = (path, depth), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "depth", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], ["path", "depth", "sha"])


def _subtree_sums(frame):
    """Adds to every boundary row of a shard what its shard adds for boundary nodes below it."""
    frame = frame.sort_values("slot", ascending=False, ignore_index=True)
    at = {slot: k for k, slot in enumerate(frame["slot"].tolist())}
    held = {name: frame[name].tolist() for name in ("n_leaves", "saved_tokens", "n_children")}
    owner, leaf, saving = frame["owner"].tolist(), frame["leaf"].tolist(), frame["saving"].tolist()
    has_parent = frame["parent_slot"].notna().tolist()
    for k, parent in enumerate(frame["parent_slot"].tolist()):         # a node's slot is above its parent's
        if owner[k]:
            held["n_leaves"][k] += leaf[k]
            held["saved_tokens"][k] += saving[k]
        if has_parent[k]:
            above = at[int(parent)]
            held["n_leaves"][above] += held["n_leaves"][k]
            held["saved_tokens"][above] += held["saved_tokens"][k]
            held["n_children"][above] += owner[k]
    return frame[["path", "depth"]].assign(**held)


def merged_boundaries(found: DataFrame) -> DataFrame:
    """``path, depth`` and the final numbers of boundary nodes; ``found`` is the written table of :func:`shards`."""
    rows = found.filter("kind = 'boundary'").select(
        "shard", "slot", "parent_slot", "path", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "n_bytes")
    below = rows.filter("parent_slot IS NOT NULL").select("shard", F.col("parent_slot").alias("slot")).distinct()
    rows = rows.join(below.withColumn("edge_below", F.lit(True)), ["shard", "slot"], "left")
    whole = rows.groupBy("path", "depth").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("shard").alias("first_shard"),
        F.max((F.col("n_children") > 0) | F.coalesce("edge_below", F.lit(False))).alias("inner"),
        F.max("n_bytes").alias("n_bytes"))
    placed = rows.select("shard", "slot", "parent_slot", "path", "depth", "n_children", "n_leaves", "saved_tokens").join(
        whole.select("path", "depth", "first_shard", (~F.col("inner")).cast("long").alias("leaf"),
                     ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving")), ["path", "depth"])
    placed = placed.withColumn("owner", (F.col("shard") == F.col("first_shard")).cast("long")).drop("first_shard")
    sums = placed.groupBy("shard").applyInPandas(      # two rows per level of the shard's first and last conversation
        _subtree_sums, "path binary, depth long, n_leaves long, saved_tokens long, n_children long").groupBy("path", "depth").agg(*[F.sum(n).alias(n) for n in ("n_leaves", "saved_tokens", "n_children")])
    blocks = found.filter("kind = 'ends'").select("path", "depth", "ids", "shard", "block")
    ends = blocks.repartition("path", "depth").sortWithinPartitions("path", "depth", "shard", "block").select(
        "path", "depth", "ids").mapInArrow(_hash_blocks, "path binary, depth long, sha string")
    keys = ["path", "depth"]
    return whole.select(*keys, "conv_id", "n_convs").join(sums, keys).join(ends, keys, "left").select(
        *keys, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``sequences`` (``conv_id, turns``).

    Runs jobs while it is called: sequences, shards and merged boundary nodes are
    written to the shared folder.
    """
    found = written(shards(written(sequences, "sequences"), shard_turns), "trie-shards")
    merged = written(merged_boundaries(found), "trie-boundaries")
    places = found.filter("kind = 'boundary'").select("shard", "slot", "parent_slot", "path", "depth")
    named = places.join(merged.select("path", "depth", "conv_id"), ["path", "depth"])
    edge = written(named.select("shard", "slot", "parent_slot", "path", "depth", "conv_id"), "trie-edges")
    parent = broadcast_if_few(edge.select(
        "shard", F.col("slot").alias("parent_slot"), F.col("conv_id").alias("above")), BOUNDARY_BROADCAST)
    inner = found.filter("kind = 'node'").join(parent, ["shard", "parent_slot"], "left").withColumn(
        "parent_conv_id", F.coalesce("above", "parent_conv_id"))
    # every shard that holds a boundary node names the same parent
    above = edge.join(parent, ["shard", "parent_slot"]).groupBy("path", "depth").agg(
        F.min("above").alias("parent_conv_id"))
    border = merged.join(above, ["path", "depth"], "left")
    return inner.select(*COLUMNS).unionByName(border.select(*COLUMNS))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over all rebuilt conversations."""
    return trie_nodes(rebuilt(slim_turns(conversations)), shard_turns)
