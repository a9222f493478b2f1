"""Edit-aware token counts: a segment tree of pre-token counts per document, kept up to date as the text is edited.

A byte-level BPE encodes each pre-token on its own, so a document's count is the sum over its pre-tokens. The tree's
leaves are pre-tokens (characters, tokens); inner nodes hold sums, so the leaf of a character and the document's count
are found, and a leaf is changed, in as many steps as the tree is high. An edit re-encodes only the characters from
two leaves before it (a pre-token may look ahead over white space) to the first old leaf boundary behind it at which
the new pre-tokens end as well. trees() gives the documents' leaves as columns, which can be kept as a table;
updated() edits such rows, and encodes nothing of the others or of what an edit leaves alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What the query redacts: addresses, keys and card or account numbers. Text that tokenizers count as new words. An
#: address starts where its run of characters does, or where the last match ended, so that each run is read once.
REDACTED = r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.]+|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[0-9a-f]{32,64}\b|\b\d{12,19}\b"
PLACEHOLDER = "<redacted>"
EDITS = "array<struct<start:int,length:int,replacement:string>>"
#: A tree as columns: its leaves as compressed 32-bit integers, their number, and their tokens in all.
TREE = "leaf_chars binary, leaf_tokens binary, leaves int, tokens long"
RESULT = "tokens_before long, tokens_after long, n_edits int, leaves int, chars_reencoded long"
EDITED = f"text string, leaf_chars binary, leaf_tokens binary, tokens long, {RESULT}"


class PreTokens:
    """Splits text at the tokenizer's fixed pattern, and counts the tokens of pre-tokens; counts of common ones are kept."""

    def __init__(self, path: str, most: int = 400_000):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.most = regex.compile(public_tokenizers.PATTERN).findall, most
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            n = self.known[word] = len(self.encoding.encode_ordinary(word))
        return n


class SegmentTree:
    """Sums of characters and of tokens over a document's pre-tokens.

    Places k >= size are the leaves, and place k is the sum of 2 k and 2 k + 1 for the others. The leaves that an edit
    replaces take its new pre-tokens, the last one all that are left over; so the tree keeps its shape, and leaf
    boundaries stay pre-token boundaries.
    """

    def __init__(self, chars, tokens):
        from array import array

        import numpy as np

        self.leaves = len(chars)
        self.size = size = 1 << max(0, self.leaves - 1).bit_length()
        sums = []
        for values in (chars, tokens):
            node = np.zeros(2 * size, np.int64)
            node[size : size + self.leaves] = values
            level = size
            while level > 1:
                node[level // 2 : level] = node[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
            sums.append(array("q", node.tobytes()))
        self.chars, self.counts = sums

    @property
    def tokens(self) -> int:
        return self.counts[1]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character; the last leaf for the text's end."""
        k, at, chars = 1, 0, self.chars
        while k < self.size:
            k *= 2
            if char >= at + chars[k] and chars[k + 1]:
                at += chars[k]
                k += 1
        return k - self.size, at

    def before(self, leaf: int) -> int:
        """The last leaf with characters before this one; -1 if there is none."""
        k, chars = leaf + self.size, self.chars
        while k > 1:
            if k & 1 and chars[k - 1]:
                k -= 1
                while k < self.size:
                    k = 2 * k + 1 if chars[2 * k + 1] else 2 * k
                return k - self.size
            k //= 2
        return -1

    def after(self, leaf: int) -> int:
        """The first leaf with characters after this one; -1 if there is none."""
        k, chars = leaf + self.size, self.chars
        while k > 1:
            if not k & 1 and chars[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if chars[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return -1

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        more, most = chars - self.chars[k], tokens - self.counts[k]
        while k and (more or most):
            self.chars[k] += more
            self.counts[k] += most
            k //= 2


class EditedText:
    """A text, cut into its tree's leaves; replace() applies an edit and re-encodes what it touches."""

    def __init__(self, words: list[str], counts, pre: PreTokens):
        self.words, self.pre, self.reencoded = words or [""], pre, 0
        self.several: dict[int, list[str]] = {}  # the pre-tokens of leaves that took more than one
        self.tree = SegmentTree(list(map(len, self.words)), counts if words else [0])

    @classmethod
    def of(cls, text: str, pre: PreTokens) -> EditedText:
        words = pre.split(text)
        return cls(words, [pre.count(w) for w in words], pre)

    @classmethod
    def of_leaves(cls, text: str, chars, counts, pre: PreTokens) -> EditedText:
        """From kept leaves; nothing is encoded."""
        words, at = [], 0
        for n in chars:
            words.append(text[at : at + n])
            at += n
        return cls(words, counts, pre)

    @property
    def text(self) -> str:
        return "".join(self.words)

    def leaves(self) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the pre-tokens: a leaf that an edit left with several is one for each of them again."""
        chars, tokens = [], []
        for k in range(self.tree.leaves):
            for w in self.several.get(k, ()) or [self.words[k]]:
                if w:
                    chars.append(len(w))
                    tokens.append(self.pre.count(w) if k in self.several else self.tree.counts[self.tree.size + k])
        return chars, tokens

    def replace(self, start: int, length: int, replacement: str) -> None:
        tree = self.tree
        start = min(max(start, 0), tree.chars[1])
        end = min(start + max(length, 0), tree.chars[1])
        first, at = tree.find(start)
        for _ in range(2):
            if (k := tree.before(first)) >= 0:
                first = k
                at -= tree.chars[tree.size + k]
        last, more = tree.find(end)[0], 1
        old = "".join(self.words[first : last + 1])
        piece = old[: start - at] + replacement + old[end - at :]
        while True:
            # pre-tokens look ahead, so the piece's last one counts only if it ends the same with what follows in sight
            words = self.pre.split(piece)
            if tree.after(last) < 0 or words and self._ends(words[-1], last):
                break
            for _ in range(more):
                if (k := tree.after(last)) >= 0:
                    piece, last = piece + self.words[k], k
            more *= 2
        slots = last - first
        for i in range(slots):
            self._put(first + i, words[i : i + 1])
        self._put(last, words[slots:])
        self.reencoded += len(piece)

    def _put(self, leaf: int, words: list[str]) -> None:
        self.words[leaf] = "".join(words)
        self.several.pop(leaf, None)
        if len(words) > 1:
            self.several[leaf] = words
        self.tree.set(leaf, len(self.words[leaf]), sum(map(self.pre.count, words)))

    def _ends(self, word: str, last: int) -> bool:
        """Whether the pre-token that ends with the leaf ``last`` ends there when the text goes on."""
        ahead, wanted = "", 64
        while True:
            while len(ahead) < wanted and (last := self.tree.after(last)) >= 0:
                ahead += self.words[last]
            found = len(self.pre.split(word + ahead[:wanted])[0])
            if found < len(word) + min(wanted, len(ahead)) or len(ahead) <= wanted and last < 0:
                return found == len(word)
            wanted *= 2


def redactions(text: Column, pattern: str = REDACTED, replacement: str = PLACEHOLDER) -> Column:
    """EDITS that replace each match of the pattern; characters count from 0. None for null.

    The JVM finds the matches; where they begin is a running sum, which takes as many steps as there are matches.
    """

    @F.pandas_udf(EDITS)
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([None if n is None else edits_at(s, n, replacement) for s, n in zip(found["skips"], found["lengths"])], dtype=object)

    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one column, so that a text without matches is read once
    found = F.when(text.rlike(pattern), F.struct(F.transform(parts, F.char_length).alias("skips"), F.transform(found, F.char_length).alias("lengths")))
    return F.coalesce(placed(found), F.array().cast(EDITS))


def edits_at(skips, lengths, replacement: str) -> list[dict]:
    """Edits of so many characters each, behind so many that stay (after the last edit there may be more)."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    starts = np.cumsum(np.asarray(skips, np.int64)[: len(lengths)] + lengths) - lengths
    return [{"start": s, "length": n, "replacement": replacement} for s, n in zip(starts.tolist(), lengths.tolist())]


def packed(values: list[int]) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.array(values, "<i4").tobytes())


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def trees(text: Column, tokenizer_path: str) -> Column:
    """A struct (TREE) of the text's leaves, pre-token by pre-token; none for null and empty text."""

    @F.pandas_udf(TREE)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pre = PreTokens(tokenizer_path)
        for texts in batches:
            rows = []
            for text in texts:
                words = pre.split(text or "")
                counts = list(map(pre.count, words))
                rows.append((packed(list(map(len, words))), packed(counts), len(words), sum(counts)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TREE.split(", ")])

    return build(text)


def updated(text: Column, tree: Column, edits: Column, tokenizer_path: str) -> Column:
    """A struct (EDITED) of a kept tree after the edits. Of rows without edits nothing goes through Python.

    Edits are of characters of the text as it was, in any order; they are applied from the last to the first. Edits that
    overlap are refused with a ValueError. Null text is empty; null edits are none; edits that reach beyond the text are
    cut.
    """

    @F.pandas_udf(EDITED)
    def update(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pre = PreTokens(tokenizer_path)
        for columns in batches:
            rows = []
            for text, chars, tokens, changes in zip(*columns):
                if changes is None or not len(changes):
                    rows.append((None,) * 9)
                    continue
                chars = unpacked(chars).tolist()
                doc = EditedText.of_leaves(text or "", chars, unpacked(tokens), pre)
                before, leaves = doc.tree.tokens, len(chars)
                changes = sorted(changes, key=lambda e: (e["start"], e["length"]), reverse=True)
                for later, e in zip(changes, changes[1:]):
                    if max(e["start"], 0) + max(e["length"], 0) > max(later["start"], 0):
                        raise ValueError(f"edits overlap: {e} and {later}")
                for e in changes:
                    doc.replace(e["start"], e["length"], e["replacement"] or "")
                rows.append((doc.text, *map(packed, doc.leaves()), doc.tree.tokens, before, doc.tree.tokens, len(changes), leaves, doc.reencoded))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EDITED.split(", ")])

    touched = F.coalesce(F.size(edits), F.lit(0)) > 0
    new = update(*[F.when(touched, c) for c in (text, tree["leaf_chars"], tree["leaf_tokens"], edits)])
    n = tree["tokens"]
    same = F.struct(text.alias("text"), tree["leaf_chars"].alias("leaf_chars"), tree["leaf_tokens"].alias("leaf_tokens"), n.alias("tokens"), n.alias("tokens_before"), n.alias("tokens_after"), F.lit(0).alias("n_edits"), tree["leaves"].alias("leaves"), F.lit(0).cast("long").alias("chars_reencoded"))
    return F.when(touched, new).otherwise(same)


def count_tokens(docs: DataFrame, edits: Column, tokenizer_path: str, keep_text: bool = True) -> DataFrame:
    """docs with the columns of RESULT (columns so named are replaced): counts before and after the edits.

    The documents' trees, and the edits, an expression over docs' columns, are kept as a table, written once; then the
    edits are applied to its rows. No row moves, so a hot source doesn't matter. Without keep_text the table has the
    texts that edits touch only, and the result has none.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept, trees(F.col("text"), tokenizer_path).alias("__tree"), edits.alias("__edits"))
    if not keep_text:
        kept = [c for c in kept if c != "text"]
        rows = rows.select(*kept, F.when(F.size("__edits") > 0, F.col("text")).alias("text"), "__tree", "__edits")
    rows = written(rows, "token-trees")
    new = updated(F.col("text"), F.col("__tree"), F.col("__edits"), tokenizer_path)
    return rows.select(*kept, new.alias("__c")).select(*kept, *[F.col(f"__c.{n}").alias(n) for n in names])
