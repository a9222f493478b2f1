"""BPE encoding by speculation, and decoding: longest matches are proposed, adjacent pairs verified, few words merged.

A sequence of tokens is what merging gives if and only if each token comes out of merging its own characters and each
adjacent pair stays two tokens when merged together: until the first merge across a border, both sides of it develop as
they would alone. So a word's longest matches are proposed, all pairs of a batch's words are tested at once in numpy,
and only words with a pair that fails are merged one step at a time.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lists

NEVER = np.iinfo(np.int64).max
#: Texts are divided into words so many characters at a time, which bounds a worker's memory to this or one text.
PIECE_CHARS = 1 << 20
BOTH = "ids binary, decoded string"


class Merges:
    """A BPE model's tokens and rules. Ranks are the order of the rules; single characters have none (-1)."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.size = max(vocab.values()) + 1
        self.rules: dict[tuple[int, int], int] = {}
        self.makes: list[int] = []
        self.left, self.right, self.rank = (np.full(self.size, -1, np.int64) for _ in range(3))
        made: dict[int, int] = {}
        for rank, rule in enumerate(merges):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rules[x, y] = rank
            self.makes.append(z)
            made[z] = made.get(z, 0) + 1
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.fromiter((x * self.size + y for x, y in self.rules), np.int64, len(self.rules))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rules.values(), np.int64, len(keys))[order]
        self.trusted = self._trusted(made)
        tokens = {t: i for t, i in vocab.items() if self.trusted[i]}
        self.inner = {t: i for t, i in tokens.items() if not end or not t.endswith(end)}
        self.last = {t[: len(t) - len(end)]: i for t, i in tokens.items() if t.endswith(end)}
        self.longest = max(map(len, tokens))
        # by a token's first three characters: the lengths that a longest match there can have, longest first
        sizes: dict[str, set[int]] = {}
        for t in self.inner:
            if len(t) > 2:
                sizes.setdefault(t[:3], {1, 2}).add(len(t))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}

    def _trusted(self, made: dict[int, int]) -> np.ndarray:
        """Tokens that come out of merging their own characters by the one rule that makes them; only these are proposed."""
        parts = self.left >= 0
        t = np.flatnonzero(parts)
        good = ~parts
        once = np.fromiter((made[x] == 1 for x in t.tolist()), bool, len(t))
        later = (self.rank[t] > self.rank[self.left[t]]) & (self.rank[t] > self.rank[self.right[t]])
        good[t] = once & later
        good[t] &= self.apart(self.left[t], self.right[t], whole=False)
        for x in t[np.argsort(self.rank[t])].tolist():  # parts before what they make
            good[x] &= good[self.left[x]] and good[self.right[x]]
        return good

    def rule_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the rules for pairs; NEVER where there is none."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether each pair of trusted tokens stays apart when merged together.

        Merging is run backwards: of the two tokens at the border the one made later is taken apart, and at each state
        a rule for the two must not come before what made the one or the other. Of equal ranks the leftmost is first.
        With ``whole`` false a rule for the two whole tokens doesn't count.
        """
        fine = np.ones(len(a), bool)
        live, until_a, until_b = np.arange(len(a)), np.full(len(a), NEVER), np.full(len(a), NEVER)
        first = not whole
        while len(live):
            rule = self.rule_ranks(a, b)
            bad = (rule < until_a) & (rule <= until_b) & (rule != NEVER)
            if first:
                bad[:] = False
                first = False
            fine[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, until_a, until_b = (x[go] for x in (live, a, b, ra, rb, until_a, until_b))
            take_a = ra > rb
            until_a, until_b = np.where(take_a, ra, until_a), np.where(take_a, until_b, rb)
            a, b = np.where(take_a, self.right[a], a), np.where(take_a, b, self.left[b])
        return fine

    def propose(self, piece: str) -> list[int]:
        """Longest matches from left to right; the last one carries the word's end."""
        out, at, n = [], 0, len(piece)
        inner, sizes, most = self.inner.get, self.sizes.get, n - 1 if self.end else n
        while at < n:
            if n - at <= self.longest and (found := self.last.get(piece[at:] if at else piece)) is not None:
                out.append(found)
                break
            for size in sizes(piece[at : at + 3], (2, 1)):
                stop = at + size
                if stop <= most and (found := inner(piece[at:stop])) is not None:
                    break
            out.append(found)
            at = stop
        return out

    def merge(self, piece: str) -> list[int]:
        """The exact way: the rule with the lowest rank first, of equal ones the leftmost."""
        ids = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.end]]
        return self._merge_short(ids) if len(ids) <= 100 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rules, makes = self.rules.get, self.makes
        none = len(makes)
        ranks = [rules(p, none) for p in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [makes[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rules((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rules((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rules[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rules]
        heapq.heapify(heap)
        while heap:
            rank, i, (x, y) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = self.makes[rank], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (ids[p], ids[q]) in self.rules:
                    heapq.heappush(heap, (self.rules[ids[p], ids[q]], p, (ids[p], ids[q])))
        return [x for x in ids if x >= 0]

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], int]:
        """(ids of each piece, how many pieces had to be merged)."""
        proposed = [self.propose(p) for p in pieces]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((x for p in proposed for x in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposed)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        failing = np.unique(owner[inside[~self.apart(pairs // self.size, pairs % self.size)[which]]])
        for i in failing.tolist():
            proposed[i] = self.merge(pieces[i])
        return proposed, len(failing)


class Codec:
    """Texts to ids and back, as the tokenizers library does with the same file and without added special tokens.

    For files like word_bpe_49k.json only: NFC, white space made one space, lower case, a splitting pattern that keeps no
    white space, bytes as characters, BPE with a word end; special tokens in a text are tokens. Others are refused. White
    space divides a text into words that are encoded alone, and kept: some ``most`` of the latest and of those before.
    """

    #: The parts of a file that this class carries out itself.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = {"behavior": "Removed", "invert": True}
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

    def __init__(self, path: str, most: int = 200_000):
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps, added = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}]), spec["added_tokens"]
        split, as_bytes = steps[0], {k: v for k, v in steps[1].items() if k != "trim_offsets"}
        known = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known &= (spec["normalizer"] or {}).get("normalizers") == self.NORMALIZER and as_bytes == self.BYTES and len(steps) == 2
        known &= {k: split.get(k) for k in self.SPLIT} == self.SPLIT and spec["decoder"] is None and spec["post_processor"] is None
        known &= all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        if not known:
            raise ValueError(f"{path} isn't a tokenizer of the kind this codec carries out")
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokens = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # visible ASCII, and Latin-1 letters: NFC keeps them, and lower case is a character's own
        self.plain, self.pattern = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch, regex.compile(split["pattern"]["Regex"])
        self.as_bytes = {c: self.pre_tokens(chr(c))[0][0] for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
        # U+001C to U+001F are white space to Python, but not to the library
        self.words = re.compile(r"[\S\x1c-\x1f]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        names = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.most, self.known, self.old, self.pieces_known = most, {}, {}, {}
        self.merged = self.seen = 0

    def pieces(self, word: str) -> list[str | int]:
        """A word's pre-tokens with bytes as characters, and ids of special tokens."""
        if not self.by_special or not self.by_special.search(word):
            return self._pre_tokens(word)
        out: list[str | int] = []
        for part in self.by_special.split(word):
            out += [self.special[part]] if part in self.special else self._pre_tokens(part)
        return out

    def _pre_tokens(self, part: str) -> list[str]:
        if not self.plain(part):
            return [p for p, _ in self.pre_tokens(self.normalize(part))] if part else []
        found = self.pattern.findall(part.lower())
        return found if part.isascii() else [p.translate(self.as_bytes) for p in found]

    def learn(self, words: Iterable[str]) -> None:
        """Adds ids of words to the kept ones, all in one go."""
        cut, new = {}, {}
        for w in words:
            if (ids := self.old.get(w)) is not None:
                self.known[w] = ids
                continue
            cut[w] = parts = self.pieces(w)
            for p in parts:
                if p not in self.pieces_known and isinstance(p, str):
                    new[p] = None
        ids, merged = self.merges.encode(list(new))
        self.merged, self.seen = self.merged + merged, self.seen + len(new)
        self.pieces_known.update((p, struct.pack(f"<{len(x)}I", *x)) for p, x in zip(new, ids))
        for w, parts in cut.items():
            self.known[w] = b"".join([self.pieces_known[p] if isinstance(p, str) else struct.pack("<I", p) for p in parts])
        if len(self.pieces_known) > 3 * self.most:
            self.pieces_known = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; null is an empty text. Takes some PIECE_CHARS at a time."""
        held, size = [], 0
        for t in texts:
            held.append((self.words(t) if self.odd(t) else t.split()) if t else ())
            size += len(t or "")
            if size >= PIECE_CHARS:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def _ids(self, divided: list[Iterable[str]]) -> Iterator[bytes]:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        self.learn({w for words in divided for w in words if w not in self.known})
        for words in divided:
            yield b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The names of the ids with spaces between, as the library decodes where a file has no decoder; unknown ids go."""
        n = len(self.names)
        return " ".join([t for i in np.frombuffer(ids, "<u4").tolist() if i < n and (t := self.names[i]) is not None])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per file and Python worker; its words stay known from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(text: Column, tokenizer_path: str) -> Column:
    """The ids of each whole text as little-endian 32-bit integers in binary. Null and white space give no ids."""

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in lists(texts):
            yield pa.array(codec(tokenizer_path).encode(part), pa.binary())

    return encode(text)


def decoded(ids: Column, tokenizer_path: str) -> Column:
    """The text of encoded() as the library decodes it with skip_special_tokens=False. Null stays null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in lists(batches):
            yield pa.array([codec(tokenizer_path).decode(x) if x is not None else None for x in part], pa.string())

    return decode(ids)


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs with __bpe: the struct of ids, and of the text that these decode to. One Python worker a task does both.

    All columns stay, and repeated rows are encoded each. No row moves, so no key is hot.
    """

    @F.arrow_udf(BOTH)
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return ids_and_texts(texts, tokenizer_path)

    return docs.withColumn("__bpe", both(F.col("text")))


def ids_and_texts(arrays: Iterable[pa.Array], tokenizer_path: str) -> Iterator[pa.Array]:
    """Structs BOTH of the texts. A batch is a task's whole share, so its parts are worked off and handed on one by one."""
    own = codec(tokenizer_path)
    for part in lists(arrays):
        ids = list(own.encode(part))
        yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], ["ids", "decoded"])
