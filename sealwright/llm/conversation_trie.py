"""The prefix trie of conversations: nodes by prefix keys, subtree totals by time-forward processing.

A turn's key is a 128-bit value of its place, role and text, and a prefix's key is the exclusive or of its turns' keys, so
that prefixes are running aggregates which a long conversation's parts compute apart and join by one carry a part. Nodes
are the distinct keys. Totals then go up the trie as messages: nodes stand in reverse level order, each takes what its
children sent it out of a priority queue and sends its own totals to its parent. That runs in shards, whole subtrees each,
and then once more over the few nodes above the shards' roots, with what the roots sent.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import attempt_name, filesystem, shared_folder, written

#: A node stands above the shards while more turns than this are below it, counted a conversation each.
SHARD_TURNS = 250_000
#: And more than one in so many of all turns; so no shard of several conversations is a large part of the table.
SHARD_SHARE = 256
#: Nodes above the shards at most, the ones with the most turns below them; this many rows are broadcast and go to one task.
TOPS = 100_000
#: Conversation ids whose text is put together at a time.
ENDS = 4096
#: Messages that a task's queue holds before it writes a sorted run.
QUEUE = 500_000

FAMILY, SHARED_TURNS = 100, 6


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, what (MD5 of role and text), points (code points of the text); rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    what = F.unhex(F.md5(F.concat(F.encode(F.octet_length(role).cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), F.encode(role, "UTF-8"), F.encode(text, "UTF-8"))))
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), what.alias("what"), F.length(text).cast("long").alias("points"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per turn of the rebuilt conversations, with its part; a row per conversation: conv_id, len).

    The turns are sorted by ranges, of which a long conversation takes several; a turn's place is its place in its
    conversation's part of one range, and the turns of the parts before.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("what")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id())
    t = written(ordered.withColumn("part", F.shiftright("spot", 33)), "trie-turns")
    parts = t.groupBy("conv_id", "part").agg(F.min("spot").alias("lo"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part")
    parts = written(parts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "trie-parts")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % SHARED_TURNS)
    bases = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    placed = t.join(parts.join(convs, "conv_id"), ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("spot") - F.col("lo"))
    own = placed.filter(F.col("place") >= F.col("h")).select("conv_id", "part", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "what", "points", "len")
    # at most SHARED_TURNS - 1 turns of a conversation, for the conversations of its family
    firsts = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED_TURNS - 1)).select(F.col("conv_id").alias("base"), "place", "what", "points")
    lent = convs.filter("taken > 0").join(firsts, "base").filter("place < taken").select("conv_id", F.lit(-1).cast("long").alias("part"), (F.col("place") + 1).alias("depth"), "what", "points", "len")
    return own.unionByName(lent), convs.select("conv_id", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, points, len with the key (a, b) of the prefix that ends with the turn, and its parent's (up_a, up_b)."""
    z = lambda seed: F.xxhash64(F.lit(seed), F.col("depth"), F.col("what"))
    rows = written(rows.select("conv_id", "part", "depth", "points", "len", z(1).alias("za"), z(2).alias("zb")), "trie-rebuilt")
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("za").alias("za"), F.bit_xor("zb").alias("zb"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"carry_{c}") for c in ("za", "zb")])
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = rows.join(carry, ["conv_id", "part"])
    for key, c in (("a", "za"), ("b", "zb")):
        keyed = keyed.withColumn(key, F.bit_xor(c).over(within).bitwiseXOR(F.col(f"carry_{c}"))).withColumn(f"up_{key}", F.col(key).bitwiseXOR(F.col(c)))
    return written(keyed.select("conv_id", "depth", "points", "len", "a", "b", "up_a", "up_b"), "trie-prefixes")


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the prefixes that are whole conversations.

    Ids are put together in blocks by value; the blocks of a prefix, however many, pass its hash in order.
    """
    whole = rows.filter("depth = len").select("depth", "a", "b", "conv_id").unionByName(convs.filter("len = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b")], "conv_id"))
    blocks = whole.groupBy("depth", "a", "b", F.floor(F.col("conv_id") / ENDS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    keys = ("depth", "a", "b")

    def hashed(batches):
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if key != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*keys, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*keys, "ends_sha256"])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


class SpillingQueue:
    """A priority queue of (key, message): the smallest lie in a heap, and sorted runs in files of the shared folder."""

    def __init__(self, folder: str, most: int = QUEUE):
        self.folder, self.most, self.heap, self.runs, self.spilled, self.n = folder, most, [], [], 0, 0

    def push(self, key: tuple, message: tuple) -> None:
        if len(self.heap) >= self.most:
            self.spill()
        self.n += 1  # messages are never compared
        heapq.heappush(self.heap, (key, self.n, message))

    def spill(self) -> None:
        fs, base = filesystem(self.folder)
        path = f"{base}/{attempt_name('queue', f'-{self.spilled}.run')}"
        self.spilled += 1
        with fs.open_output_stream(path) as out:
            rows = sorted(self.heap)
            for i in range(0, len(rows), 10_000):
                pickle.dump(rows[i : i + 10_000], out)
        self.heap = []
        run = self._read(fs, path)
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _read(fs, path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path) as source:
            while True:
                try:
                    rows = pickle.load(source)
                except EOFError:
                    break
                yield from rows
        fs.delete_file(path)

    def first(self) -> tuple | None:
        """The smallest key, or None."""
        keys = ([self.heap[0][:2]] if self.heap else []) + ([self.runs[0][0][:2]] if self.runs else [])
        return min(keys)[0] if keys else None

    def pop(self) -> tuple[tuple, tuple]:
        if self.runs and (not self.heap or self.runs[0][0][:2] < self.heap[0][:2]):
            (key, _, message), n, run = heapq.heappop(self.runs)
            if (following := next(run, None)) is not None:
                heapq.heappush(self.runs, (following, n, run))
            return key, message
        key, _, message = heapq.heappop(self.heap)
        return key, message


def time_forward(nodes: Iterator[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Nodes with their totals and their parent's conv_id, from nodes in reverse level order: -depth, then key, ascending.

    A node is (depth, a, b, up_a, up_b, conv_id, ends_sha256, n_convs, own, children, leaves, saved), the last three being
    sums of what children elsewhere sent. A node comes out once its parent is at hand; those whose parent isn't among the
    nodes come out last, with None for its conv_id.
    """
    for depth, a, b, up_a, up_b, conv, shown, n_convs, own, children, leaves, saved in nodes:
        at = (-depth, a, b)
        saved += (n_convs - 1) * own
        while queue.first() == at:
            child = queue.pop()[1]
            children, leaves, saved = children + 1, leaves + child[-2], saved + child[-1]
            yield (conv, *child)
        queue.push((1 - depth, up_a, up_b), (depth, up_a, up_b, conv, shown, n_convs, children, leaves or 1, saved))
    while queue.first() is not None:
        yield (None, *queue.pop()[1])


NODE = ("depth", "a", "b", "up_a", "up_b", "conv_id", "ends_sha256", "n_convs", "own", "sent_children", "sent_leaves", "sent_saved")
TOTALS = "parent_conv_id long, depth long, up_a long, up_b long, conv_id long, ends_sha256 string, n_convs long, n_children long, n_leaves long, saved_tokens long"


def totals(nodes: DataFrame, folder: str, most: int = QUEUE) -> DataFrame:
    """time_forward() over each shard; a partition's nodes are sorted by (shard, reverse level order), by Spark and with its spilling."""
    names = [x.split()[0] for x in TOTALS.split(", ")]

    def run(batches):
        import itertools

        import pyarrow as pa

        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in TOTALS.split(", ")]
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", *NODE))))
        done = (out for _, shard in itertools.groupby(rows, lambda r: r[0]) for out in time_forward((r[1:] for r in shard), SpillingQueue(folder, most)))
        while out := list(itertools.islice(done, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return nodes.select("shard", *NODE).mapInArrow(run, TOTALS)


def trie(conversations: DataFrame, queue: int = QUEUE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node, root included.

    Turns are ordered by turn (null first), equal ones by the MD5 of role and text; repeated rows are turns of their own.
    Rows without conv_id are in no conversation and left out; null roles and texts are empty. Without conversations there
    are no nodes. What is below a node is counted before shards are dealt, so a beginning that a third of all conversations
    have divides into its continuations; only a single conversation's own turns can make a shard larger, and pass one by one.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(turns_of(conversations))
    rows = prefixes(turns)
    key = ["depth", "a", "b"]
    nodes = rows.groupBy(*key).agg(F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("points").alias("own"), F.sum(F.col("len") - F.col("depth") + 1).alias("below"))
    zero = F.lit(0).cast("long")
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), (F.sum("len") + F.count(F.lit(1))).alias("below")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*key, "up_a", "up_b")], "conv_id", "n_convs", zero.alias("own"), "below")
    none = hashlib.sha256().hexdigest()
    nodes = nodes.unionByName(root).join(ends(rows, convs), key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    nodes = written(nodes, "trie-nodes")

    all_turns = convs.agg(F.coalesce(F.sum("len"), zero)).first()[0]
    limit = max(1, min(SHARD_TURNS, all_turns // SHARD_SHARE))
    # more turns are below a node than below any one of its children, so the largest nodes include all that are above them
    tops = written(nodes.filter((F.col("below") > limit) | (F.col("depth") == 0)).orderBy(F.col("below").desc(), "depth").limit(TOPS), "trie-tops")
    above = F.broadcast(tops.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("top_conv_id")))
    is_top = F.broadcast(tops.select(*key))
    entry = rows.join(above, ["depth", "up_a", "up_b"]).join(is_top, key, "left_anti").select("conv_id", F.col("a").alias("shard"), "len")
    entry = written(entry, "trie-shards")
    # at most 1000 conversations have more than a thousandth of all turns
    long = entry.filter(F.col("len") * 1000 > all_turns).drop("len")
    below = nodes.join(is_top, key, "left_anti").withColumns({c: zero for c in NODE[-3:]})
    others = below.join(F.broadcast(long.select("conv_id")), "conv_id", "left_anti").join(entry.filter(F.col("len") * 1000 <= all_turns).drop("len"), "conv_id")
    sharded = below.join(F.broadcast(long), "conv_id").unionByName(others)
    order = [F.col("shard"), F.col("depth").desc(), F.col("a"), F.col("b")]
    folder = shared_folder(spark, "trie-queues")
    inside = written(totals(sharded.repartition("shard").sortWithinPartitions(*order), folder, queue), "trie-totals")

    roots = inside.filter("parent_conv_id is null")
    sent = roots.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("sent_children"), F.sum("n_leaves").alias("sent_leaves"), F.sum("saved_tokens").alias("sent_saved"))
    upper = tops.join(sent, key, "left").withColumns({c: F.coalesce(c, zero) for c in NODE[-3:]}).withColumn("shard", zero)
    over = totals(upper.repartition(1).sortWithinPartitions(*order), folder, queue)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    joined = roots.drop("parent_conv_id").join(above.withColumnRenamed("top_conv_id", "parent_conv_id"), ["depth", "up_a", "up_b"])
    return inside.filter("parent_conv_id is not null").select(*out).unionByName(joined.select(*out)).unionByName(over.select(*out))
