"""Near duplicates by Order MinHash: sampled k-mers of words in text order, candidates verified by banded alignment.

A document's K-word shingles are labelled by their occurrence number, so all of its labelled shingles differ. For
each of TABLES seeds the SAMPLE shingles with the smallest hashes, kept in the order of the text, are hashed to one
sketch: equal sketches are likely only if the texts share shingles in the same order. Documents with an equal sketch
are neighbours in a range-sorted table. A document's first pairs are those with its longest run's first member and
with the member before it. A pair is verified by aligning its words inside the band that the similarity allows
(insertions, deletions, substitutions); links are closed to classes by star contraction. Runs that then hold several
classes go on, with more hubs in each turn, until all pairs of theirs in different classes have been tried.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import hashes_of, word_hashes
from .shared import words, written

#: Similarity is 1 - edits / words of the longer text. Of two texts with scattered edits (share of equal words s), each
#: K-word shingle survives with s ** K, so K is short: the chance of an equal sketch is 0.999 at s = 0.93, 0.98 at 0.9
#: and 0.76 at 0.85 for substitutions that lie apart; edits that lie together cost fewer shingles. A larger SAMPLE keeps
#: texts apart that share only a passage: where it is a third of each, one such pair in 100 has an equal sketch.
K, SIMILARITY = 2, 0.8
TABLES, SAMPLE = 24, 5
#: Pairs are verified in groups of about so many that share a member, a few times as many at most.
GROUP = 32
#: Hubs of a run in turn t: HUBS ** t; if no more than 4 * HUBS ** t pairs a member are left, all of them are tried.
HUBS = 8
#: A run's members meet its hubs in tiles of about so many of each.
TILE = 1024
#: A task contracts about so many links at a time, in some 50 MB.
LINKS = 1 << 17
#: 64-bit words of a signature: for shorter texts, and for the longest.
WORDS, MOST_WORDS = 32, 1024


def shingles(hashes, k: int = K):
    """Occurrence-labelled hashes of the k-word shingles, in text order; a shorter text is one shingle. All differ."""
    import numpy as np

    h = np.asarray(hashes, np.int64).view(np.uint64)
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out += h[i : i + len(out)]
    order = np.argsort(out, kind="stable")
    s = out[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        number = np.empty(len(s), np.uint64)
        number[order] = (np.arange(len(s)) - first).astype(np.uint64)
        out = out + number * np.uint64(0xD1B54A32D192ED03)
    return out


def sketches(labelled, tables: int = TABLES, sample: int = SAMPLE):
    """One 64-bit hash a table, of the sample smallest shingles in text order (of all, where there are fewer)."""
    import numpy as np

    seeds = (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
    best = None
    for at in range(0, len(labelled), 1 << 16):  # bounds the memory for a very long text
        part = labelled[None, at : at + (1 << 16)]
        h = (part ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        place = np.broadcast_to(np.arange(at, at + part.shape[1]), h.shape)
        if best is not None:
            h, place = np.concatenate([best[0], h], axis=1), np.concatenate([best[1], place], axis=1)
        if h.shape[1] > sample:
            least = np.argpartition(h, sample - 1, axis=1)[:, :sample]
            h, place = np.take_along_axis(h, least, 1), np.take_along_axis(place, least, 1)
        best = h, place
    place = np.sort(best[1], axis=1)
    out = np.zeros(tables, np.uint64)
    for i in range(place.shape[1]):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += labelled[place[:, i]]
    return out


def edit_distance(a: list, b: list, most: int) -> int:
    """Insertions, deletions and substitutions from a to b; exact up to ``most``, above it some larger number.

    The alignment's matrix is walked along its diagonals, no farther than ``most`` from the main one. A column's part
    of the band is two numbers, whose bits say where a cell is one above and one below its upper neighbour, so that a
    column is a few operations on whole numbers.
    """
    begin, end = 0, min(len(a), len(b))
    while begin < end and a[begin] == b[begin]:
        begin += 1
    behind = 0
    while behind < end - begin and a[-1 - behind] == b[-1 - behind]:
        behind += 1
    a, b = a[begin : len(a) - behind], b[begin : len(b) - behind]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most or not m:
        return n
    most = min(most, n)
    # bit k of column j's numbers is row j - most + k; rows above the first count up away from it
    mask, new_row = (1 << 2 * most + 1) - 1, 1 << 2 * most
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i + most
    down = (1 << most) - 1
    up, watched, distance = mask ^ down, 1 << n - m + most, n - m
    for j, x in enumerate(b):
        same = where.get(x, 0) >> j & mask
        level = ((same & up) + up ^ up | same | down) & mask  # where the diagonal step is free
        right = down | ~(level | up) & mask
        left = level & up
        if not level & watched and (distance := distance + 1) > most:
            return distance
        right = right << 1 | 1
        up, down = ((left << 1 | ~(level | right)) & mask) >> 1 | new_row, (level & right & mask) >> 1
    return distance


def similarity(a: list, b: list, least: float = SIMILARITY) -> float:
    """1 - edits / words of the longer text for two lists of words; exact if it is at least ``least``, else something smaller."""
    longer = max(len(a), len(b))
    if not longer or not a or not b:
        return 0.0
    most = int((1 - least) * longer + 1e-9)
    return 1 - edit_distance(a, b, most) / longer


def labelled_words(hashes):
    """Hashes of the words and their occurrence numbers, sorted. All differ."""
    import numpy as np

    return np.sort(shingles(hashes, 1))


def may_be_similar(a, b, least: float = SIMILARITY) -> bool:
    """Whether the words that two labelled_words() have in common are enough; never false for similar texts.

    An edit is of one word at most, so the longer text has no more words that the other lacks than there are edits.
    """
    import numpy as np

    longer = max(len(a), len(b))
    if min(len(a), len(b)) < longer * least - 1e-9:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return longer - np.count_nonzero(both[1:] == both[:-1]) <= int((1 - least) * longer + 1e-9)


def signature(hashes, size: int = WORDS):
    """The number of words, and ``size`` 64-bit words with a bit for each word's hash and occurrence, flipped by each.

    A substitution changes two words, an insertion or deletion one, so that two signatures differ in no more than two
    bits an edit, less the difference in size; what they rule out is never similar.
    """
    import numpy as np

    labelled = shingles(hashes, 1)
    bits = np.bincount((labelled * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) % (64 * size), minlength=64 * size) & 1
    return np.concatenate([[len(labelled)], np.packbits(bits.astype(np.uint8)).view(np.int64)])


def signature_words(n: int) -> int:
    """How many 64-bit words a text's signature has: a power of two, some 16 bits a word, so that few flips meet in a bit."""
    return min(max(WORDS, 1 << max(n - 1, 0).bit_length() - 2 if n > 4 * WORDS else WORDS), MOST_WORDS)


def folded(signatures, size: int):
    """Signatures (rows) as they would be with fewer words: halves are laid over each other."""
    while signatures.shape[1] > size:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def may_pair(tile, least: float):
    """Of a tile's rows (see untried()), the places of hubs and members that signatures don't rule out.

    A pair counts in the first table in which its sketches are equal: that run tries it, or has done so.
    """
    import numpy as np
    import pyarrow.compute as pc

    asks, every, hub = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "all", "hub"))
    table, diagonal = tile.column("table")[0].as_py(), tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
    mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(mine) or not len(others):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    node, root = (np.array(tile.column(c).to_pylist(), "S16") for c in ("node", "root"))
    earlier = pc.list_flatten(tile.column("sketches")).to_numpy().reshape(len(node), -1)[:, :table]
    lengths = pc.list_value_length(tile.column("sign")).to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = pc.list_flatten(tile.column("sign")).to_numpy(), np.cumsum(lengths) - lengths
    n, levels = values[starts], lengths - 1
    values = values.view(np.uint64)  # of signed numbers, bitwise_count() counts the magnitude's bits
    # the members' signatures, by their size
    by_level = {int(x): values[starts[at := others[levels[others] == x], None] + 1 + np.arange(x)] for x in np.unique(levels[others])}
    place = np.zeros(len(node), np.int64)
    for x in by_level:
        at = others[levels[others] == x]
        place[at] = np.arange(len(at))
    short: dict = {}
    ordered = diagonal or not every[0]  # else a pair is in one tile once
    found = []
    for h in mine.tolist():
        longer = np.maximum(n[others], n[h])
        ok = (root[others] != root[h]) & (np.minimum(n[others], n[h]) >= longer * least - 1e-9)
        if ordered:
            ok &= ~hub[others] | (node[others] > node[h])
        at = others[ok]
        at = at[~(earlier[at] == earlier[h]).any(axis=1)]
        own = values[None, starts[h] + 1 : starts[h] + lengths[h]]
        for x, rows in by_level.items():
            if not len(b := at[levels[at] == x]):
                continue
            size = min(x, own.shape[1])
            if (x, size) not in short:
                short[x, size] = folded(rows, size)
            differ = np.bitwise_count(short[x, size][place[b]] ^ folded(own, size)).sum(axis=1, dtype=np.int64)
            # insertions and deletions, which a difference in size asks for, change one word and not two
            b = b[differ + np.abs(n[b] - n[h]) <= np.maximum(n[b], n[h]) * (2 * (1 - least)) + 1e-9]
            if len(b):
                found.append((np.full(len(b), h), b))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), node (16 bytes; equal for texts with the same words), sketch.

    Texts without words have no node. The words are found once for both columns, in a projection of their own.
    """

    @F.pandas_udf("array<long>")
    def sketch(hashes: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if h is None else sketches(shingles(h)).view(np.int64) for h in hashes])

    has_words = F.coalesce(F.col("text").rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(False))
    clean = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.when(has_words, words(F.col("text"))).alias("clean"))
    return clean.select("doc_id", "copy", F.unhex(F.md5("clean")).alias("node"), sketch(hashes_of(F.col("clean"))).alias("sketch"))


def neighbours(batches):
    """Of a sorted partition's rows (table, sketch, node): for each node (b) its run's head, the node before, and how many came before.

    The first and the last run of the partition are reported too, as (part, table, sketch, head, b: tail, place: rows),
    since they may go on in the next partition.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, first, held = TaskContext.get().partitionId(), None, None  # the first run and the open one: table, sketch, head, tail, rows

    def out(parts, table, sketch, head, before, b, place):
        columns = [pa.array(parts, pa.int32()), pa.array(table, pa.int32()), pa.array(sketch, pa.int64()), pa.array(head, pa.binary()), pa.array(before, pa.binary()), pa.array(b, pa.binary()), pa.array(place, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["part", "table", "sketch", "head", "before", "b", "place"])

    for rows in batches:
        if not rows.num_rows:
            continue
        table, sketch, node = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("table", "sketch", "node"))
        new = np.concatenate([[True], (table[1:] != table[:-1]) | (sketch[1:] != sketch[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        place, head, before = np.arange(len(new)) - start, node[start], np.concatenate([node[:1], node[:-1]])
        if held and held[:2] == (table[0], sketch[0]):
            mine = np.cumsum(new) == 1
            head[mine], before[0], new[0] = held[2], held[3], False
            place[mine] += held[4]
        starts = np.flatnonzero(new)
        if first is None and held and len(starts):
            first = (*held[:3], node[starts[0] - 1] if starts[0] else held[3], held[4] + starts[0])
        elif first is None and len(starts) > 1:
            first = (table[0], sketch[0], node[0], node[starts[1] - 1], starts[1])
        at = np.flatnonzero(~new)
        if len(at):
            yield out(np.full(len(at), -1), table[at], sketch[at], head[at], before[at], node[at], place[at])
            at = at[place[at] == 1]  # the head has a run, too
            yield out(np.full(len(at), -1), table[at], sketch[at], head[at], head[at], head[at], np.zeros(len(at), np.int64))
        held = (table[-1], sketch[-1], head[-1], node[-1], place[-1] + 1)
    if held:
        runs = [first, held] if first else [held]
        table, sketch, head, tail, rows = zip(*runs)
        yield out([part] * len(runs), table, sketch, head, head, tail, rows)


def candidates(by_node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (a < b, part) with an equal sketch in some table, two for each node at most; and all nodes that have any.

    A node's pairs are of its longest run; what its other runs may link besides, linked() tries.
    """
    rows = by_node.select("node", F.posexplode("sketch").alias("table", "sketch"))
    # by range, so that a run of any length is dealt to many tasks; the runs' ends meet below
    rows = rows.repartitionByRange("table", "sketch", "node").sortWithinPartitions("table", "sketch", "node")
    found = rows.mapInArrow(neighbours, "part int, table int, sketch long, head binary, before binary, b binary, place long")
    best = F.max(F.struct("place", "head", "before")).alias("best")
    # the ends and, aggregated before the shuffle, each node's place in its longest run
    found = written(found.groupBy("part", F.when(F.col("part") >= 0, F.col("table")).alias("table"), F.when(F.col("part") >= 0, F.col("sketch")).alias("sketch"), "b").agg(best).select("part", "table", "sketch", "b", "best.*"), "neighbours")
    # a run that several partitions hold: a row or two for each of them
    chain = Window.partitionBy("table", "sketch").orderBy("part", "head")
    ends = found.filter("part >= 0").select(F.col("head").alias("b"), F.lag("b").over(chain).alias("before"), F.first("head").over(chain).alias("head")).filter("before is not null and before <> b")
    mine = found.filter("part < 0")
    # a head's pairs are cut into parts by their places in the run, so that no part is large
    both = F.explode(F.array(F.struct(F.col("head").alias("a"), F.floor(F.col("place") / GROUP).alias("part")), F.struct(F.col("before").alias("a"), F.lit(0).cast("long").alias("part")))).alias("p")
    pairs = mine.select("b", both).unionByName(ends.withColumn("place", F.lit(-1)).select("b", both))
    # nodes are in order in a run, so that a < b
    pairs = written(pairs.select("p.a", "b", "p.part").filter("a <> b").distinct(), "pairs")
    return pairs, mine.select(F.col("b").alias("node")).union(pairs.select("a")).union(pairs.select("b")).distinct()


def verified(pairs: DataFrame, words_of: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs whose texts (node, hashes of the words) are at least so similar.

    pairs (a, b, part): the parts of a's pairs, which are small, are groups; a group has a's words once.
    """
    left = pairs.select("a", "part").distinct().join(words_of, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("binary").alias("b"), "hashes")
    right = pairs.join(words_of, F.col("b") == F.col("node")).select("a", "part", "b", "hashes")

    def compare(table):
        import pyarrow as pa

        names, rows = table.column("b").to_pylist(), table.column("hashes")
        hub = rows[names.index(None)].values.to_numpy()
        mine, hub, found = labelled_words(hub), hub.tolist(), []
        for b, x in zip(names, rows):
            # the alignment is the dear part, and few of the pairs that aren't similar get to it
            if b is not None and may_be_similar(mine, labelled_words(x.values.to_numpy()), least) and (s := similarity(hub, x.as_py(), least)) >= least:
                found.append((table.column("a")[0].as_py(), b, s))
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema) if found else schema.empty_table()

    return left.unionByName(right).groupBy("a", "part").applyInArrow(compare, "a binary, b binary, similarity double")


def forests(batches):
    """Links (a, b) that join the same nodes as these, LINKS at a time: from each node to the smallest that it leads to."""
    import pyarrow as pa

    root: dict = {}
    held = 0

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def stars():
        found = [(x, top) for x in root if (top := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    for rows in batches:
        for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        held += rows.num_rows
        if held >= LINKS:
            yield stars()
            root.clear()
            held = 0
    if root:
        yield stars()


def classes(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (a, b) lead to; for nodes with links only.

    Tasks contract the links they read first, a bounded number at a time, which leaves no more than one a node of
    each. What these have in common is contracted by alternating the two star contractions (each links a node's
    neighbours to the smallest of them) until only stars are left; a round is two joins on aggregated minima, and no
    component is ever in one place.
    """

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()

    edges = written(links.select("a", "b"), "links")
    edges = edges.coalesce(edges.count() // LINKS + 1).mapInArrow(forests, "a binary, b binary")
    edges = written(edges.distinct(), "forests")  # a > b
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # from tables, as a join fed by the aggregate itself couldn't be split where a class is large
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large-stars")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def untried(members: DataFrame, turn: int, least: float) -> DataFrame:
    """Of runs with several classes (table, sketch, node, root, popular, sign, sketches, all: whether all pairs are tried in
    this turn; the run's size and its largest class): pairs (a: hub, b) of different classes to verify in this turn.

    The first hub is a run's member whose sketches are the most frequent (in a star of copies, the original); later,
    one outside of the run's largest class, and members chosen by hash. Hubs and members are dealt to tiles of bounded
    size, whose tasks compare signatures: no pair is a row unless these leave it open.
    """
    run, tile = ["table", "sketch"], ["table", "sketch", "i", "j"]
    best = members.filter(F.lit(turn == 0) | (F.col("root") != F.col("largest"))).groupBy(*run).agg(F.max(F.struct("popular", "node"))["node"].alias("best"))
    m = members.join(written(best, "hubs"), run)
    hub = F.col("all") | (F.col("node") == F.col("best"))
    if turn:
        hub |= F.pmod(F.xxhash64("node"), F.col("size")) < HUBS**turn
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    m = m.withColumns({"hub": hub, "blocks": blocks, "rows": F.when(F.col("all"), blocks).otherwise(F.ceil(F.least(F.col("size"), F.lit(HUBS**turn + 1)) / TILE).cast("int"))})
    m = m.withColumns({"row": F.pmod(F.xxhash64("node", F.lit(3)), "rows").cast("int"), "block": F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int")})
    # where all meet all, the tiles on one side of the diagonal are enough
    of_members = F.transform(F.sequence(F.lit(0), F.when(F.col("all"), F.col("block")).otherwise(F.col("rows") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks")))
    of_hubs = F.transform(F.sequence(F.when(F.col("all"), F.col("row")).otherwise(F.lit(0)), F.col("blocks") - 1), lambda j: F.struct(F.col("row").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    m = m.withColumn("tile", F.explode(F.when(F.col("hub"), F.concat(of_members, of_hubs)).otherwise(of_members)))
    m = m.select(*run, "tile.*", "all", "hub", "size", "node", "root", "sketches", "sign").repartition(*tile).sortWithinPartitions(*tile)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def out(rows):
            rows = rows.combine_chunks()
            a, b = may_pair(rows, least)
            nodes = rows.column("node")
            return pa.RecordBatch.from_arrays([pa.array(nodes.take(pa.array(x)).to_pylist(), pa.binary()) for x in (a, b)] + [pa.array(rows.column("size").take(pa.array(a)).to_pylist(), pa.int64())], ["a", "b", "size"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in tile], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, stop in zip(starts, starts[1:]):
                if held and key != keys[start].tolist():
                    yield out(pa.Table.from_batches(held))
                    held = []
                key = keys[start].tolist()
                held.append(batch.slice(start, stop - start))
        if held:
            yield out(pa.Table.from_batches(held))

    pairs = m.mapInArrow(compare, "a binary, b binary, size long")
    # a hub has no more pairs than its runs have members
    return written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / GROUP).cast("long")).alias("part")), "more-pairs")


def linked(nodes: DataFrame, pairs: DataFrame, words_of: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node, root of the nodes (node, sketch) with links: any two similar texts with an equal sketch are in one class.

    After the pairs, only runs that aren't one class yet go on, so that a large group of copies, which is one class by
    then, has no rows here. In the last turn of a run all its pairs in different classes are tried, so nothing of it is
    left out; turns grow, so their number is a logarithm.
    """

    @F.pandas_udf("array<long>")
    def sign(hashes: pd.Series) -> pd.Series:
        return pd.Series([signature(h, signature_words(len(h))) for h in hashes])

    roots, run = classes(verified(pairs, words_of, least)), ["table", "sketch"]
    members, signs, turn = None, None, 0
    while True:
        if members is None:
            rooted = nodes.select("node", "sketch").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.posexplode("sketch").alias("table", "sketch"))
        else:
            rooted = members.join(roots, "node", "left").select(*run, "node", F.coalesce("root", "node").alias("root"))
        rooted = written(rooted, "runs")
        counts = rooted.groupBy(*run, "root").agg(F.count(F.lit(1)).alias("c"))
        runs = counts.groupBy(*run).agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max(F.struct("c", "root"))["root"].alias("largest"))
        runs = written(runs.filter("within < size * size"), "open-runs")
        rooted = written(rooted.join(runs, run), "open-members")
        if rooted.isEmpty():
            return roots
        popular = written(rooted.groupBy("node").agg(F.sum("size").alias("popular")), "popular")
        if signs is None:
            signs = words_of.join(popular.select("node"), "node").select("node", sign("hashes").alias("sign"))
            signs = written(signs.join(nodes.select("node", F.col("sketch").alias("sketches")), "node"), "signatures")
        rooted = rooted.withColumn("all", (F.col("size") * F.col("size") - F.col("within")) / 2 <= F.col("size") * (4 * HUBS**turn))
        more = untried(rooted.join(popular.join(signs, "node"), "node"), turn, least)
        members = rooted.filter("not all").select(*run, "node")
        if turn == 0:
            first = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
            more = more.join(first, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
        # only classes are linked from now on, so what contracts is small
        found = verified(more, words_of, least).select("a", "b")
        for end in "a", "b":
            found = found.join(roots.toDF(end, "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        merged = classes(found.filter("a <> b"))
        moved = roots.join(merged.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(moved.unionByName(merged), "roots")  # a root is no class's node besides, so these are apart
        turn += 1


def rows_with_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, copy, class_id; see near_duplicates()."""
    table = written(sketched(docs), "sketches")
    by_node = written(table.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("row"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "nodes")
    pairs, ends = candidates(by_node)
    nodes = written(ends.join(by_node.select("node", "row.*", "sketch"), "node"), "candidate-nodes")
    ends = nodes.drop("sketch").withColumnRenamed("doc_id", "id").hint("merge")
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    # a merge join at every size: the candidates grow with the documents
    texts = texts.join(ends, F.col("doc_id").eqNullSafe(F.col("id")) & (texts["copy"] == ends["copy"])).select("node", word_hashes(F.col("text")).alias("hashes"))
    words_of = written(texts.dropDuplicates(["node"]), "candidate-words")
    roots = linked(nodes, pairs, words_of, least)
    # by nodes first, and from tables: neither many copies of a text nor a large class is one task's rows
    rooted = written(by_node.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted-nodes")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")
    named = written(rooted.join(ids, "root").select("node", "class_id"), "node-classes")
    out = table.select("doc_id", "copy", "node").join(named, "node", "left")
    return out.select("doc_id", "copy", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of those that near-duplicate links connect; a row for each row of docs.

    Case and punctuation don't count. Texts of fewer than five words are alike only if their words are equal, since one
    edit is more than a fifth of them; texts of up to some ten words are found less surely than longer ones, as an edit
    costs them most of their shingles. Null texts and texts without words are classes of their own, as class_id their
    doc_id. A class without any doc_id has none. Repeated rows have equal classes.
    """
    return rows_with_class(docs, least).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that have their class's smallest doc_id, with the columns of docs; of repeated rows one stays.

    Rows without doc_id stay if no row of their class has one, but exact copies of one another are repeated rows.
    """
    first = rows_with_class(docs, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("__n"))
    first = first.withColumnsRenamed({"doc_id": "__id", "copy": "__c"})
    kept = docs.withColumn("__copy", F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__c")))
    return kept.filter("__n = 1").unionByName(kept.filter("__n > 1").dropDuplicates(["doc_id", "__copy"])).select(*docs.columns)
