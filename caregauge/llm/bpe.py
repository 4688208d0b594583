"""Byte-pair encoding by a segment tree over the ranks of neighbouring pairs, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from caregauge.llm.common import slices, texts
from caregauge.llm.tokens import CACHED_WORDS, WordIds, batches_of, id_lists, lowers, marks_apart

NONE = np.iinfo(np.int64).max
#: Words, as the pattern cuts them, whose ids a worker remembers.
CACHED_PIECES = 200_000
#: Words of up to so many symbols are merged many at a time.
SHORT = 64
# Fixed value: white space as the tokenizer's pattern engine has it.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def unassigned() -> str:
    """A class of the code points without a category in Python's tables."""
    free = [a for a in range(0x110000) if unicodedata.category(chr(a)) == "Cn"]
    first = [a for a, b in zip(free, [-2, *free]) if a != b + 1]
    last = [a for a, b in zip(free, [*free[1:], -2]) if a + 1 != b]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last)) + "]"


@lru_cache(maxsize=1)
def unassigned_letter() -> re.Pattern[str]:
    return re.compile(unassigned())


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others by code
    points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else more))
        more += b not in shown
    return letters


class Bpe(WordIds):
    """Vocabulary and merges of a tokenizer file whose steps are: canonical composition, white
    space to one space, lower case, a pattern whose matches are the words, bytes as letters,
    merges with a suffix at the word's end."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        super().__init__(cached_words)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = [n["type"] for n in file["normalizer"]["normalizers"]]
        split = file["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or file["decoder"] is not None:
            raise ValueError(f"{path}: not the kind of tokenizer that this encoder knows")
        vocab: dict[str, int] = model["vocab"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # Letters that Python's tables don't have yet are cut by the library's.
        self.newer = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.normalizer = normalizers.Sequence(
            [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
        )
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.hints = frozenset(t[:2] for t in self.special)
        self.lowers, self.marks_apart = lowers(file), marks_apart(file)
        most = max([*vocab.values(), *self.special.values()]) + 1
        self.base = most
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * most + vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks = {int(k): r for r, k in enumerate(keys.tolist())}
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], order
        self.pieces: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE if there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(ok & (self.keys[at] == key), self.key_ranks[at], NONE)

    def merge_many(self, symbols: list[np.ndarray], width: int) -> list[np.ndarray]:
        """Merges words of up to ``width`` symbols, a power of two, side by side.

        Leaf p of a word's tree has the rank of the pair that begins at p, with p in the low
        bits, so that the root is the leftmost pair of lowest rank. Each turn merges the root's
        pair in every word that has one and renews the paths above the three leaves it touches.
        """
        n = len(symbols)
        ids = np.zeros((n, width + 1), dtype=np.int64)
        length = np.array([len(s) for s in symbols])
        inside = np.arange(width + 1)[None, :] < length[:, None]
        ids[inside] = np.concatenate(symbols)
        follow = np.where(inside, np.arange(1, width + 2)[None, :], width)
        follow[np.arange(n), length - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        place = np.arange(width)

        def leaf(rank: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, rank * width + p)

        tree[:, width:] = leaf(self.rank(ids[:, :-1], ids[:, 1:], inside[:, 1:]), place[None, :])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        alive = inside.copy()
        w = np.flatnonzero(tree[:, 1] != NONE)
        while len(w):
            root = tree[w, 1]
            p, r = root % width, root // width
            gone = follow[w, p]
            after = follow[w, gone]
            ids[w, p] = self.merged[r]
            follow[w, p] = after
            alive[w, gone] = False
            before[w, after] = p  # column ``width`` takes those without a successor
            prior = before[w, p]
            tree[w, width + gone] = NONE
            tree[w, width + p] = leaf(self.rank(ids[w, p], ids[w, after], after < width), p)
            held = prior >= 0
            wl, pl = w[held], prior[held]
            tree[wl, width + pl] = leaf(self.rank(ids[wl, pl], ids[wl, p[held]], np.ones(len(wl), bool)), pl)
            for words, node in ((w, width + gone), (w, width + p), (wl, width + pl)):
                node = node // 2
                while len(node) and node[0]:
                    tree[words, node] = np.minimum(tree[words, 2 * node], tree[words, 2 * node + 1])
                    node = node // 2
            w = w[tree[w, 1] != NONE]
        return [ids[i][alive[i]] for i in range(n)]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same tree for one long word."""
        n = len(symbols)
        width = 1 << max(1, (n - 1).bit_length())
        ids, ranks, base = list(symbols), self.ranks, self.base
        follow, before = list(range(1, n + 1)), list(range(-1, n))
        tree: list[int] = [NONE] * (2 * width)

        def leaf(p: int) -> int:
            if follow[p] >= n:
                return NONE
            rank = ranks.get(ids[p] * base + ids[follow[p]])
            return NONE if rank is None else rank * width + p

        for p in range(n - 1):
            tree[width + p] = leaf(p)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != NONE:
            p, r = tree[1] % width, tree[1] // width
            gone = follow[p]
            ids[p] = int(self.merged[r])
            follow[p] = follow[gone]
            before[follow[p]] = p
            ids[gone] = -1
            touched = [(gone, NONE), (p, leaf(p))]
            if before[p] >= 0:
                touched.append((before[p], leaf(before[p])))
            for at, value in touched:
                node = width + at
                tree[node] = value
                node //= 2
                while node:
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
                    node //= 2
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as the pattern cuts them (not empty)."""
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, np.ndarray]]] = {}
        for word in words:
            raw = np.frombuffer(word.encode(), dtype=np.uint8)
            symbols = self.inner[raw]
            symbols[-1] = self.last[raw[-1]]
            if len(symbols) > SHORT:
                out[word] = np.array(self.merge_long(symbols.tolist()), dtype="<i4").tobytes()
            else:
                groups.setdefault(1 << max(1, (len(symbols) - 1).bit_length()), []).append((word, symbols))
        for width, group in groups.items():
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                for (word, _), ids in zip(some, self.merge_many([s for _, s in some], width)):
                    out[word] = ids.astype("<i4").tobytes()
        return out

    def cut(self, chunk: str) -> list[str | int]:
        """Words of a text without spaces and line ends; a special token as its id."""
        if any(h in chunk for h in self.hints):
            found: list[str | int] = []
            for k, part in enumerate(self.specials.split(chunk)):
                found += [self.special[part]] if k % 2 else self.cut_plain(part)
            return found
        return self.cut_plain(chunk)

    def cut_plain(self, part: str) -> list[str]:
        if not part.isascii() and unassigned_letter().search(part):
            return [w for w, _ in self.newer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        part = SPACES.sub(" ", unicodedata.normalize("NFC", part))
        # Each letter by itself: the final form of a sigma is not chosen.
        part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
        return self.pattern.findall(part)

    def ids_of(self, words: list[str]) -> list[bytes]:
        cut = list(map(self.cut, words))
        new = {w for ws in cut for w in ws if isinstance(w, str) and w not in self.pieces}
        fresh = self.encode_words(sorted(new))
        if len(self.pieces) + len(fresh) <= CACHED_PIECES:
            self.pieces.update(fresh)

        def raw(w: str | int) -> bytes:
            if isinstance(w, int):
                return w.to_bytes(4, "little")
            return fresh[w] if w in fresh else self.pieces[w]

        return [b"".join(map(raw, ws)) for ws in cut]


class Tokens:
    """Texts of ids: tokens joined by spaces, special ones included, as the file names no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["decoder"] is not None:
            raise ValueError(f"{path}: not the kind of tokenizer that this decoder knows")
        names = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids array<int>) of every text. A null or empty text has no ids; special
    tokens in a text are taken as the library takes them; a word of any length is merged whole;
    repeated rows give repeated results; extra columns are left out."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches_of(batches):
            ids = id_lists(*coder.encode(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    docs = texts(docs)
    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows (doc_id, ids); a null list decodes to an empty text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        for batch in slices(batches, 256):
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False)
            ends = ids.offsets.to_numpy()
            decoded = [coder.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"]
            )

    frame = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return frame.mapInArrow(rows, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
