"""Removal of bytes that repeat an earlier document's, by sorting suffixes in range-partitioned buckets.

Two equal strings of LENGTH bytes have the same smallest hash among their GRAM-byte strings, so only suffixes that
begin at such smallest strings (about one in 16) are compared, each with as much text about it as its windows of
LENGTH bytes reach, and MOST_WINDOWS windows at most. Sampled splitters deal these suffixes to buckets by their leading
bytes, then by the hash of the first GRAM bytes: a frequent beginning can be cut, but suffixes of equal beginnings
never part, so that no match lies across a bucket's boundary. A first pass drops suffixes whose first GRAM bytes are in
one document only. Then each bucket sorts what is left in suffix order, by multikey quicksort on eight-byte words, and
gives each window the smallest document that has it.

Documents are worked on in groups of about GROUP_BYTES, and a group's suffixes travel as one compressed block per
bucket. Copies of a whole document are settled first, by digest; in a group equal suffixes are settled at once and
only the smallest document's goes on. A beginning that HOT suffixes or more have still (the edge of a passage that a
third of all documents repeat, each with text of its own beside it) isn't compared in one place: its windows are
dealt by their own digests, after each group has kept the smallest document of each.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
GROUP_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: A suffix has at most so many windows; longer repetitions are cut.
MOST_WINDOWS = 4 * SPAN
#: Beginnings with more suffixes than this are compared window by window, wherever the windows' digests lead.
HOT = 1 << 15
#: Windows are sorted in turns of about so many, and hashes are computed for so many bytes at once.
TURN, STRETCH = 1 << 18, 1 << 20
#: Segments of the quicksort up to this size are finished together, word by word.
SMALL_SEGMENT = 1 << 12
#: Splitters come from a sample of about so many bytes of text, or of so many suffixes a bucket.
SAMPLE_BYTES, SAMPLE_PER_BUCKET = 8 << 20, 64
NO_ID = (1 << 63) - 1
BLOCK = "dest long, bucket long, kind string, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def pack(**arrays) -> bytes:
    """Named numpy arrays as one compressed block; unpack() gives them back."""
    import zstandard

    parts, head = [], b""
    for name, a in arrays.items():
        kind = a.dtype.str.encode()
        head += struct.pack("<BBQ", len(name), len(kind), len(a)) + name.encode() + kind
        parts.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(head)) + head + b"".join(parts))


def unpack(data: bytes) -> dict:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, end, out = 4, 4 + struct.unpack_from("<I", raw)[0], {}
    data_at = end
    while at < end:
        a, b, n = struct.unpack_from("<BBQ", raw, at)
        name, kind = raw[at + 10 : at + 10 + a].decode(), np.dtype(raw[at + 10 + a : at + 10 + a + b].decode())
        out[name] = np.frombuffer(raw, kind, n, data_at)
        data_at += n * kind.itemsize
        at += 10 + a + b
    return out


def suffix_blocks(ords, bucket, h, doc, at, n, off, multi, weight):
    """(bucket, block) of the suffixes that a group sends, by document; a block has only those documents that it has suffixes of.

    There is a block for each group and bucket, so it has no names and grows with its suffixes alone. Numbers lie byte
    by byte, the lowest of all first, since their high bytes compress to nothing. unpack_suffixes() reads a block.
    """
    import numpy as np
    import zstandard

    if not len(h):
        return
    order = np.lexsort((at, doc, bucket))
    bucket, h, doc, at, n, off, multi, weight = (x[order] for x in (bucket, h, doc, at, n, off, multi, weight))
    begins = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new = begins.copy()
    new[1:] |= doc[1:] != doc[:-1]
    starts, docs = np.flatnonzero(begins), doc[new]
    doc_starts = np.cumsum(new)[starts] - 1

    def steps(x):
        """Differences, but of each block's first document the number itself."""
        out = np.diff(x, prepend=0)
        out[doc_starts] = x[doc_starts]
        return out

    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    of_docs = [planes(steps(ords[docs]), "<i8"), planes(steps(docs), "<i4")]
    first, *others = planes(h, "<u8"), planes(at, "<i4"), planes(weight, "<i4"), planes(new & ~begins, "i1"), planes(n, "i1"), planes(off, "i1"), planes(multi, "i1")
    compress = zstandard.ZstdCompressor(level=1).compress
    ends, doc_ends = np.append(starts[1:], len(h)).tolist(), np.append(doc_starts[1:], len(docs)).tolist()
    for k, i, j, di, dj in zip(bucket[starts].tolist(), starts.tolist(), ends, doc_starts.tolist(), doc_ends):
        parts = [first[:, i:j].tobytes(), *(x[:, di:dj].tobytes() for x in of_docs), *(x[:, i:j].tobytes() for x in others)]
        yield k, compress(struct.pack("<II", j - i, dj - di) + b"".join(parts))


def unpack_suffixes(data: bytes):
    """h, ord, doc, at, n, off, multi and weight of a block of suffix_blocks(), decompressed."""
    import numpy as np

    suffixes, docs = struct.unpack_from("<II", data)
    place, parts = 8, []
    for width, count in ((8, suffixes), (8, docs), (4, docs), (4, suffixes), (4, suffixes), *[(1, suffixes)] * 4):
        planes = np.frombuffer(data, np.uint8, width * count, place).reshape(width, count)
        parts.append(np.ascontiguousarray(planes.T).view(f"<i{width}").ravel())
        place += width * count
    h, ords, doc, at, weight, k, n, off, multi = parts
    k = np.cumsum(k, dtype=np.int64)
    return h.view(np.uint64), np.cumsum(ords)[k], np.cumsum(doc, dtype=np.int32)[k], at, n, off, multi.astype(bool), weight


class Group:
    """The documents of a group in a fixed order (ord, tag), rows with both equal once, and their bytes in one buffer."""

    def __init__(self, table):
        import numpy as np

        rows = sorted(set(zip(table.column("ord").to_pylist(), table.column("tag").to_pylist(), table.column("text").to_pylist())))
        self.ids = {(o, t): i for i, (o, t, _) in enumerate(rows)}
        texts = [t.encode() for _, _, t in rows]
        self.ord = np.array([r[0] for r in rows], np.int64)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts) + bytes(96), np.uint8)

    def suffixes(self, skip):
        """hash, doc, at (first window), n (windows), off (from the first window to the suffix), lead, of documents not in skip."""
        import numpy as np

        parts = [self._stretch(at, min(at + STRETCH, len(self.data) - 96), skip) for at in range(0, len(self.data) - 96, STRETCH)]
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.int16, np.uint64)
        return tuple(np.concatenate([np.empty(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))

    def _stretch(self, begin: int, end: int, skip):
        """suffixes() of the windows that start in begin..end."""
        import numpy as np

        n = min(end - begin + SPAN, len(self.data) - 64 - begin)  # the grams of these windows
        words = np.ndarray((n + GRAM,), "<u8", self.data, begin, (1,))
        grams = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        for at in (*range(8, GRAM - 7, 8), GRAM - 8):
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
            grams += words[at : at + n]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        least, span = grams.copy(), 1
        while span * 2 <= SPAN:
            np.minimum(least[:-span], least[span:], out=least[:-span])
            span *= 2
        if SPAN > span:
            np.minimum(least[: -(SPAN - span)], least[SPAN - span :], out=least[: -(SPAN - span)])
        # windows that lie in one document; the smallest hash of a run of windows, and where it comes first
        n = end - begin
        least = least[:n]
        windows = np.where(np.isin(np.arange(len(self.size)), skip), 0, np.maximum(self.size - LENGTH + 1, 0))
        opens, closes = (np.clip(x[windows > 0] - begin, 0, n) for x in (self.start, self.start + windows))
        valid = np.zeros(n + 1, np.int32)
        np.add.at(valid, opens, 1)
        np.add.at(valid, closes, -1)
        valid = np.cumsum(valid[:n]) > 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        first[opens[opens < closes]] = True
        place = np.flatnonzero(first)
        doc = np.searchsorted(self.start, place + begin, "right") - 1
        ends = np.minimum(np.append(place[1:], n), (self.start + windows)[doc] - begin)
        pieces = -(-(ends - place) // MOST_WINDOWS)
        if (pieces > 1).any():
            turn = np.repeat(np.arange(len(place)), pieces)
            place = place[turn] + MOST_WINDOWS * (np.arange(len(turn)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            doc, ends = doc[turn], np.minimum(ends[turn], place + MOST_WINDOWS)
        hashes, off = least[place], np.full(len(place), -1, np.int16)
        for o in range(SPAN):
            off[(off < 0) & (grams[place + o] == hashes)] = o
        return hashes, doc, place + begin - self.start[doc], ends - place, off, words[place + off].byteswap()


def bucket_of(lead, hashes, splitters):
    """The bucket of each suffix, by its leading bytes and then by the hash; splitters: two arrays in the order of both."""
    import numpy as np

    leads, ties = splitters
    lo, hi = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
    # of those whose lead is a splitter's, too: how many splitters come before each in the order of both
    tied = np.flatnonzero(lo < hi)
    if len(tied):
        behind = np.concatenate([np.zeros(len(leads), np.int8), np.ones(len(tied), np.int8)])
        order = np.lexsort((behind, np.concatenate([ties, hashes[tied]]), np.concatenate([leads, lead[tied]])))
        before = np.cumsum(behind[order] == 0)
        mine = order >= len(leads)
        lo[tied[order[mine] - len(leads)]] = before[mine]
    return lo


def blocks_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dest", "bucket", "kind", "data"])


def extract(splitters, n_buckets: int):
    """Of a group: a block of suffixes for each bucket; those of strings that two of its documents have are known already."""

    def run(texts, copies):
        import numpy as np

        if not texts.num_rows:
            return blocks_table([])
        dest, group = texts.column("dest")[0].as_py(), Group(texts)
        skip = np.array(sorted({group.ids[k] for k in zip(copies.column("ord").to_pylist(), copies.column("tag").to_pylist())}), np.int64)
        h, doc, at, n, off, lead = group.suffixes(skip)
        order = np.lexsort((group.ord[doc], h))
        h, doc, at, n, off, lead = (x[order] for x in (h, doc, at, n, off, lead))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(h)) - 1 if len(h) else starts
        shared = group.ord[doc[starts]] != group.ord[doc[ends]] if len(h) else np.empty(0, bool)
        known = np.repeat(shared, ends - starts + 1)
        rows = [(dest, dest % n_buckets, "copies", pack(doc=skip.astype("<i4")))]
        if known.any():
            rows.append((dest, dest % n_buckets, "known", pack(h=h[known], doc=doc[known].astype("<i4"), at=at[known].astype("<i4"), n=n[known].astype("<i4"), off=off[known].astype("<i1"))))
        # of a string that is known here, one entry tells the others
        multi = np.zeros(len(h), bool)
        multi[starts[shared]] = True
        send = np.flatnonzero(~known | multi)
        weight = np.ones(len(h), np.int64)
        weight[starts] = np.where(shared, ends - starts + 1, 1)
        b = bucket_of(lead[send], h[send], splitters.value)
        rows += [(dest, k, "suffixes", block) for k, block in suffix_blocks(group.ord, b, *(x[send] for x in (h, doc, at, n, off, multi, weight)))]
        return blocks_table(rows)

    return run


def find_shared(most: int):
    """Of a bucket: per group a block of the suffixes whose first bytes two or more documents have, and of the hot ones. Other kinds pass."""

    def run(table):
        import numpy as np
        import zstandard

        rows, parts, decompress = [], [], zstandard.ZstdDecompressor().decompress
        for dest, bucket, kind, data in zip(*(table.column(c).to_pylist() for c in ("dest", "bucket", "kind", "data"))):
            if kind != "suffixes":
                rows.append((dest, bucket, kind, data))
                continue
            x = unpack_suffixes(decompress(data))
            parts.append((np.full(len(x[0]), dest, np.int32), *x))
        if parts:
            dest, h, ords, doc, at, n, off, multi, weight = (np.concatenate(p) for p in zip(*parts))
            del parts
            order = np.argsort(h)
            s = h[order]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sizes = np.diff(np.append(starts, len(s)))
            o = ords[order]
            shared = (np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)) | np.logical_or.reduceat(multi[order], starts)
            crowd = shared & (np.add.reduceat(weight[order].astype(np.int64), starts) > most)
            keep, hot = np.zeros((2, len(h)), bool)
            keep[order], hot[order] = np.repeat(shared, sizes), np.repeat(crowd, sizes)
            for mine, kind in ((keep & ~multi, "known"), (hot, "hot")):
                kept = np.flatnonzero(mine)
                kept = kept[np.argsort(dest[kept], kind="stable")]
                for part in np.split(kept, np.flatnonzero(np.diff(dest[kept])) + 1) if len(kept) else []:
                    data = pack(h=np.unique(h[part])) if kind == "hot" else pack(h=h[part], doc=doc[part], at=at[part], n=n[part], off=off[part])
                    rows.append((int(dest[part[0]]), 0, kind, data))
        return blocks_table(rows)

    return run


def word_at(data, place, left):
    """The eight bytes of data from each place as a big-endian number; of those, only the next ``left`` count, others are 0."""
    import numpy as np

    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = words[np.minimum(place, len(data) - 8)].byteswap()
    short = left < 8
    if short.any():
        keep = np.clip(left[short], 0, 8).astype(np.uint64) * np.uint64(8)
        out[short] = np.where(keep > 0, out[short] >> (np.uint64(64) - np.maximum(keep, np.uint64(1))) << (np.uint64(64) - np.maximum(keep, np.uint64(1))), np.uint64(0))
    return out


def multikey_quicksort(n: int, depths: int, word):
    """Order of n strings of ``depths`` words, and whether each in that order begins a new value; word(rows, depth) gives words.

    Each turn splits all open segments in three by a pivot: what is smaller and what is larger stay at their depth,
    what is equal goes on to the next word. Small segments are finished together, by the same words within their ties.
    """
    import numpy as np

    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    start, end, depth = np.array([0]), np.array([n]), np.array([0])
    small: list[tuple] = []
    while len(start):
        size = end - start
        few = size <= SMALL_SEGMENT
        small += zip(start[few & (size > 1)].tolist(), end[few & (size > 1)].tolist(), depth[few & (size > 1)].tolist())
        start, end, depth, size = start[~few], end[~few], depth[~few], size[~few]
        if not len(start):
            break
        at = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(segment)) + np.repeat(start - at, size)
        rows = order[place]
        key = word(rows, depth[segment])
        pivot = np.sort(key[at + np.stack([size // 4, size // 2, 3 * size // 4])], axis=0)[1][segment]
        part = 3 * segment + (key >= pivot) + (key > pivot)
        order[place] = rows[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(size))
        ends = np.cumsum(counts) + np.repeat(start - at, 3)
        starts = ends - counts
        new[starts[counts > 0]] = True
        depths_now = np.repeat(depth, 3) + np.tile([0, 1, 0], len(size))
        open_ = (counts > 1) & (depths_now < depths)
        start, end, depth = starts[open_], ends[open_], depths_now[open_]
    if small:
        start, end, depth = (np.array(x) for x in zip(*small))
        size = end - start
        place = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist())])
        depth = np.repeat(depth, size)
        segment = np.repeat(np.arange(len(size)), size)
        while len(place):
            rows = order[place]
            key = word(rows, depth)
            turn = np.lexsort((key, segment))
            order[place], key = rows[turn], key[turn]
            differ = (segment[1:] == segment[:-1]) & (key[1:] != key[:-1])
            new[place[1:][differ]] = True
            # what ties with a neighbour goes on to its next word
            segment = np.cumsum(np.concatenate([[True], differ | (segment[1:] != segment[:-1])]))
            tied = (np.bincount(segment)[segment] > 1) & (depth + 1 < depths)
            place, depth, segment = place[tied], depth[tied] + 1, segment[tied]
    return order, new


def sorted_windows(data, place):
    """multikey_quicksort() of the LENGTH-byte strings of data that begin at the places."""
    return multikey_quicksort(len(place), -(-LENGTH // 8), lambda rows, depth: word_at(data, place[rows] + 8 * depth, LENGTH - 8 * depth))


def window_digests(data, place):
    """Two 64-bit hashes of each LENGTH-byte string."""
    import numpy as np

    out = np.full((2, len(place)), LENGTH, np.uint64)
    for i in range(0, LENGTH, 8):
        w = word_at(data, place + i, np.full(len(place), LENGTH - i))
        for k, m in enumerate((0x9E3779B97F4A7C15, 0xA0761D6478BD642F)):
            out[k] = (out[k] ^ w) * np.uint64(m)
            out[k] ^= out[k] >> np.uint64(31 - 2 * k)
    return out


def ranges(context, window):
    """(context, first window, windows) of the runs in lists of windows, which are in order."""
    import numpy as np

    if not len(context):
        return np.empty((3, 0), np.int64)
    begins = np.concatenate([[True], (np.diff(window) != 1) | (context[1:] != context[:-1])])
    at = np.flatnonzero(begins)
    return np.stack([context[at], window[at], np.diff(np.append(at, len(context)))])


def contexts(splitters, n_buckets: int):
    """Of a group: its suffixes that may be shared, with the text about them, in a block for each bucket.

    Equal ones are one context, which the smallest document has; those of other documents are covered. A context's
    members (uid, doc, at) pass on to remove(). Of hot beginnings the windows go on, by their digests, instead.
    """

    def run(texts, blocks):
        import numpy as np

        if not texts.num_rows:
            return blocks_table([])
        dest, group, known, hot, rows = texts.column("dest")[0].as_py(), Group(texts), [], [], []
        for kind, data in zip(blocks.column("kind").to_pylist(), blocks.column("data").to_pylist()):
            if kind == "copies":
                rows.append((dest, dest % n_buckets, kind, data))
            elif kind == "hot":
                hot.append(unpack(data)["h"])
            else:
                known.append(unpack(data))
        if not known:
            return blocks_table(rows)
        h, doc, at, n, off = (np.concatenate([k[c] for k in known]) for c in ("h", "doc", "at", "n", "off"))
        del known
        n, start = n.astype(np.int64), group.start[doc] + at
        order = np.lexsort((at, group.ord[doc]))
        h, doc, at, n, off, start = (x[order] for x in (h, doc, at, n, off, start))
        first: dict = {}
        data = group.data
        uid = np.array([first.setdefault((a, o, data[b:e].tobytes()), len(first)) for a, o, b, e in zip(h.tolist(), off.tolist(), start.tolist(), (start + n + LENGTH - 1).tolist())])
        del first
        rep = np.unique(uid, return_index=True)[1]
        ords = group.ord[doc]
        whole = ords > ords[rep][uid]
        if whole.any():
            rows.append((dest, dest % n_buckets, "covered", pack(doc=doc[whole].astype("<i4"), at=at[whole].astype("<i4"), end=(at + n + LENGTH - 1)[whole].astype("<i4"))))
        by_uid = np.flatnonzero(~whole)
        by_uid = by_uid[np.argsort(uid[by_uid], kind="stable")]
        rows.append((dest, dest % n_buckets, "members", pack(uid=np.diff(uid[by_uid], prepend=0).astype("<i4"), doc=doc[by_uid].astype("<i4"), at=at[by_uid].astype("<i4"))))
        h, doc, n, off, start, ords = (x[rep] for x in (h, doc, n, off, start, ords))
        crowded = np.isin(h, np.concatenate(hot)) if hot else np.zeros(len(h), bool)
        calm = np.flatnonzero(~crowded)
        b = bucket_of(word_at(data, start[calm] + off[calm], np.full(len(calm), 8)), h[calm], splitters.value)
        turn = np.argsort(b, kind="stable")
        calm, cuts = calm[turn], np.flatnonzero(np.diff(b[turn], prepend=-1, append=n_buckets))
        for k, i, j in zip(b[turn][cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            s = calm[i:j]
            text = np.concatenate([data[x:y] for x, y in zip(start[s].tolist(), (start[s] + n[s] + LENGTH - 1).tolist())])
            rows.append((dest, k, "contexts", pack(h=h[s], ord=ords[s], uid=s.astype("<i4"), n=n[s].astype("<i4"), off=off[s].astype("<i1"), text=text)))
        c = np.flatnonzero(crowded)
        if len(c):
            context = np.repeat(c, n[c])
            window = np.arange(len(context)) - np.repeat(np.cumsum(n[c]) - n[c], n[c])
            place = start[context] + window
            order, new = sorted_windows(data, place)
            wid = np.empty(len(order), np.int64)
            wid[order] = np.cumsum(new) - 1
            least = np.minimum.reduceat(ords[context][order], np.flatnonzero(new))
            gone = least[wid] < ords[context]
            if gone.any():
                u, w, count = ranges(context[gone], window[gone])
                rows.append((dest, dest % n_buckets, "found", pack(uid=u.astype("<i4"), first=w.astype("<i4"), count=count.astype("<i4"))))
            stay = np.flatnonzero(~gone)
            stay = stay[np.argsort(wid[stay], kind="stable")]
            rows.append((dest, dest % n_buckets, "places", pack(wid=wid[stay].astype("<i4"), uid=context[stay].astype("<i4"), window=window[stay].astype("<i4"))))
            one, two = window_digests(data, place[order[new]])
            b = (one % np.uint64(n_buckets)).astype(np.int64)
            turn = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[turn], np.arange(n_buckets + 1))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                s = turn[cuts[k] : cuts[k + 1]]
                rows.append((dest, k, "windows", pack(one=one[s], two=two[s], ord=least[s], wid=s.astype("<i4"))))
        return blocks_table(rows)

    return run


def smaller_elsewhere(h, ords, n, off, start, data):
    """For the contexts of a bucket, the windows that a smaller document has: arrays (context, first window, windows)."""
    import numpy as np

    # in suffix order: the text from the beginning on, then the text before it, then how the windows lie in it
    right, left = n + LENGTH - 1 - off, off.astype(np.int64)
    a, b = -(-int(right.max()) // 8), -(-int(left.max()) // 8)

    def word(rows, depth):
        out = np.empty(len(rows), np.uint64)
        for mine, place, size in ((depth < a, start + off, right), ((depth >= a) & (depth < a + b), start, left)):
            if mine.any():
                r, d = rows[mine], (depth[mine] if place is not start else depth[mine] - a) * 8
                out[mine] = word_at(data, place[r] + d, size[r] - d)
        last = depth == a + b
        if last.any():
            out[last] = (n[rows[last]] * 64 + off[rows[last]]).astype(np.uint64)
        return out

    order, new = multikey_quicksort(len(h), a + b + 1, word)
    number = np.cumsum(new) - 1
    least = np.minimum.reduceat(ords[order], np.flatnonzero(new))
    whole = ords[order] > least[number]
    gone = order[whole]
    found = [np.stack([gone, np.zeros(len(gone), np.int64), n[gone]])]
    # then the windows of what is left, where a beginning has different contexts; equal beginnings are neighbours
    left_over = order[~whole]
    begins = np.concatenate([[True], h[left_over[1:]] != h[left_over[:-1]]])
    run = np.cumsum(begins) - 1
    several = np.bincount(run)[run] > 1
    left_over, run = left_over[several], run[several]
    total = np.cumsum(n[left_over])
    cuts = np.append(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), len(run))
    at = 0
    while len(left_over) and at < len(cuts) - 1:  # beginnings by turns of about TURN windows; none has more than HOT contexts
        base = total[cuts[at] - 1] if cuts[at] else 0
        end = max(at + 1, int(np.searchsorted(total[cuts[at + 1 :] - 1], base + TURN, "right")) + at)
        mine = left_over[cuts[at] : cuts[end]]
        context = np.repeat(mine, n[mine])
        window = np.arange(len(context)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
        order, new = sorted_windows(data, start[context] + window)
        least = np.empty(len(context), np.int64)
        least[order] = np.minimum.reduceat(ords[context[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = least < ords[context]
        found.append(ranges(context[hit], window[hit]))
        at = end
    return np.concatenate(found, axis=1)


def compare(table):
    """Of a bucket: sorts its suffixes and gives each group the ranges that smaller documents have too."""
    import numpy as np

    rows, parts, data, windows = [], [], [], []
    for dest, bucket, kind, block in zip(*(table.column(c).to_pylist() for c in ("dest", "bucket", "kind", "data"))):
        if kind not in ("contexts", "windows"):
            rows.append((dest, bucket, kind, block))
            continue
        x = unpack(block)
        if kind == "windows":
            windows.append((np.full(len(x["one"]), dest, np.int32), x["one"], x["two"], x["ord"], x["wid"]))
        else:
            parts.append((np.full(len(x["h"]), dest, np.int32), x["h"], x["ord"], x["uid"], x["n"], x["off"]))
            data.append(x["text"])

    def reply(kind, dest, **arrays):
        turn = np.argsort(dest, kind="stable")
        for part in np.split(turn, np.flatnonzero(np.diff(dest[turn])) + 1) if len(turn) else []:
            rows.append((int(dest[part[0]]), 0, kind, pack(**{k: x[part].astype("<i4") for k, x in arrays.items()})))

    if parts:
        dest, h, ords, uid, n, off = (np.concatenate(p) for p in zip(*parts))
        n, text = n.astype(np.int64), np.concatenate([*data, np.zeros(8, np.uint8)])
        start = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        del data, parts
        i, first, count = smaller_elsewhere(h, ords, n, off, start, text)
        reply("found", dest[i], uid=uid[i], first=first, count=count)
    if windows:
        dest, one, two, ords, wid = (np.concatenate(p) for p in zip(*windows))
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])
        least = np.minimum.reduceat(ords[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = order[least < ords[order]]
        reply("gone", dest[gone], wid=wid[gone])
    return blocks_table(rows)


def joined(keys, others):
    """(i, j): all places with keys[i] == others[j]; others are in order."""
    import numpy as np

    lo, hi = np.searchsorted(others, keys, "left"), np.searchsorted(others, keys, "right")
    i = np.repeat(np.arange(len(keys)), hi - lo)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)


def remove(with_bytes: bool):
    """Of a group: the result rows; ranges merge, as a byte goes once however many ranges cover it."""

    def run(texts, blocks):
        import hashlib

        import numpy as np
        import pyarrow as pa

        group, found = Group(texts), {k: [] for k in ("copies", "covered", "members", "places", "found", "gone")}
        for kind, data in zip(blocks.column("kind").to_pylist(), blocks.column("data").to_pylist()):
            found[kind].append(unpack(data))
        marks = np.zeros(len(group.data) + 1, np.int32)

        def mark(begin, end):
            np.add.at(marks, begin, 1)
            np.add.at(marks, end, -1)

        for x in found["copies"]:
            gone = x["doc"][group.size[x["doc"]] >= LENGTH]
            mark(group.start[gone], group.start[gone] + group.size[gone])
        for x in found["covered"]:
            mark(group.start[x["doc"]] + x["at"], group.start[x["doc"]] + x["end"])
        for m in found["members"]:  # one block a group
            uids, at = np.cumsum(m["uid"]), group.start[m["doc"]] + m["at"]
            hits = [(x["uid"], x["first"], x["count"]) for x in found["found"]]
            for x in found["places"]:
                i, j = joined(np.concatenate([np.empty(0, np.int32), *(g["wid"] for g in found["gone"])]), x["wid"])
                hits.append((x["uid"][j], x["window"][j], np.ones(len(j), np.int32)))
            for uid, first, count in hits:
                i, j = joined(uid, uids)
                mark(at[j] + first[i], at[j] + first[i] + count[i] + LENGTH - 1)
        covered = np.cumsum(marks[:-1]) > 0
        out = {}
        for key, i in group.ids.items():
            a, b = int(group.start[i]), int(group.start[i] + group.size[i])
            c = covered[a:b]
            kept = group.data[a:b][~c].tobytes()
            spans = int(c[0]) + int(np.count_nonzero(c[1:] & ~c[:-1])) if b > a else 0
            out[key] = (b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)
        rows = [out[k] for k in zip(texts.column("ord").to_pylist(), texts.column("tag").to_pylist())]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.Table.from_arrays([texts.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [x.split()[0] for x in RESULT.split(", ")])

    return run


def sampled_splitters(texts: DataFrame, total: int, n_buckets: int):
    """n_buckets - 1 splitters from a sample of documents, whose size is SAMPLE_BYTES or SAMPLE_PER_BUCKET suffixes a bucket."""
    import numpy as np

    wanted = max(SAMPLE_BYTES, 16 * SAMPLE_PER_BUCKET * n_buckets)
    every = max(1, total // wanted)
    step = max(1, wanted // 16 // (SAMPLE_PER_BUCKET * n_buckets))

    def leads(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                h, _, _, _, _, lead = Group(pa.Table.from_batches([batch])).suffixes(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(lead[::step].view(np.int64)), pa.array(h[::step].view(np.int64))], ["lead", "h"])

    rows = texts.filter(F.pmod(F.xxhash64("ord", F.lit(7)), F.lit(every)) == 0).select("ord", "tag", "text").mapInArrow(leads, "lead long, h long").collect() if n_buckets > 1 else []
    lead, h = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in (0, 1))
    order = np.lexsort((h, lead))
    at = (np.arange(1, n_buckets) * len(order)) // n_buckets if len(order) else np.empty(0, np.int64)
    return lead[order][at], h[order][at]


def dedup(docs: DataFrame, with_bytes: bool = True, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per row of docs: RESULT, where kept is the text's remaining bytes (null without with_bytes).

    A byte goes if a string of LENGTH bytes that covers it also begins in a document with a smaller doc_id. Strings
    are judged on the input and lie in one document. Null text is empty. Rows without doc_id come after all others and
    not before each other; rows that share a doc_id aren't smaller than each other, and repeated rows get equal results.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups, n_buckets = max(1, math.ceil(total / group_bytes)), max(1, math.ceil(total / bucket_bytes))
    text = F.coalesce("text", F.lit(""))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.unhex(F.md5(text)).alias("tag"), text.alias("text"))
    t = t.select(F.pmod(F.xxhash64("ord", "tag"), F.lit(n_groups)).alias("dest"), "doc_id", "ord", "tag", "text")
    splitters = docs.sparkSession.sparkContext.broadcast(sampled_splitters(t, total, n_buckets))  # 16 bytes a bucket
    digests = t.select("dest", "ord", "tag")
    # from a table: a join fed by the aggregate itself couldn't be split where a third of all rows have one digest
    firsts = written(digests.groupBy("tag").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").select("tag", "first"), "first-copies")
    copies = digests.join(firsts, "tag").filter("ord > first").select("dest", "ord", "tag").toDF("dest", "ord", "tag")
    by_dest = lambda df: df.groupBy("dest")
    found = by_dest(t).cogroup(by_dest(copies)).applyInArrow(extract(splitters, n_buckets), BLOCK)
    found = found.groupBy("bucket").applyInArrow(find_shared(hot), BLOCK)
    found = by_dest(t).cogroup(by_dest(found)).applyInArrow(contexts(splitters, n_buckets), BLOCK)
    found = found.groupBy("bucket").applyInArrow(compare, BLOCK)
    return by_dest(t).cogroup(by_dest(found)).applyInArrow(remove(with_bytes), RESULT)
