"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; later ones are encoded in each batch they occur in.
CACHED_WORDS = 400_000
#: Text that is encoded at once, unless a single text has more.
BATCH_BYTES = 4 << 20

def batches_of(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_BYTES of text at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
            pa.default_memory_pool().release_unused()  # a worker stays; what it freed need not


class WordIds:
    """Ids of texts from the ids of the parts between their spaces and line ends.

    Each different part of a batch is looked up once, and encoded if it is not known. Known
    parts are one Arrow array, and their ids another one, so that many take little memory.
    """

    #: Whether the tokenizer lowers letters itself, and whether marks after letters begin a token
    #: of their own; how its special tokens begin. Set by the subclasses.
    lowers = marks_apart = False
    hints: frozenset[str] = frozenset()

    def __init__(self, cached_words: int = CACHED_WORDS) -> None:
        self.limit = cached_words
        self.known = pa.array([], pa.string())
        self.sizes = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        raise NotImplementedError

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts, and where each text's begin. Parts with the same ids are made alike:
        a full stop or comma is parted from the letter before it, ASCII letters are lowered
        (not where a special token may stand, which the tokenizer cuts out before)."""
        texts = pc.replace_substring(texts, "\n", " ")
        if self.marks_apart:
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,]) ", r"\1 \2 ")
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        if self.lowers and not any(pc.any(pc.match_substring(texts, h)).as_py() for h in self.hints):
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return words, offsets - offsets[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and end)."""
        words, offsets = self.parts(texts)
        coded = words.dictionary_encode()
        different = coded.dictionary
        place = pc.index_in(different, value_set=self.known)
        new = different.filter(pc.is_null(place))
        found = self.ids_of(new.to_pylist()) if len(new) else []
        sizes = np.concatenate((self.sizes, np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4))
        flat = np.concatenate((self.flat, np.frombuffer(b"".join(found), dtype="<u4")))
        at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.sizes) + np.arange(len(new))
        if len(sizes) <= self.limit:
            self.known = pa.concat_arrays([self.known, new])
            self.sizes, self.flat = sizes, flat
        starts = np.cumsum(sizes) - sizes
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        many = sizes[at]
        ends = np.concatenate(([0], np.cumsum(many)))
        values = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], many)]
        return ends[offsets], values

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        ends, values = self.encode(pa.array(texts, pa.string()))
        return [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def with_end(ends: np.ndarray, values: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text's."""
    out_ends = ends + np.arange(len(ends))
    out = np.empty(out_ends[-1], dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    own[out_ends[1:] - 1] = False
    out[own] = values
    out[~own] = end_id
    return out_ends, out


def id_lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view("<i4")))


def lowers(file: dict) -> bool:
    """Whether a tokenizer (as its file has it) lowers all letters."""
    steps = str(file["normalizer"])
    return "'Lowercase'" in steps and "'Prepend'" not in steps


def marks_apart(file: dict) -> bool:
    """Whether letters and other marks are tokens of their own, whatever stands beside them."""
    splits = (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    choices = {*splits[0].get("pattern", {}).get("Regex", "").split("|")}
    return {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= choices and splits[0].get("invert") is True


class TextEncoder(WordIds):
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` for many texts.

    The tokenizer drops white space before it looks for tokens, so that a text's ids are those of
    its parts. New parts are encoded in one call, with a control letter between spaces after
    each, which is a token of its own. Parts that hold this letter or may hold a special token
    go alone.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        super().__init__(cached_words)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parting = "\x01"
        first, second = self._one("a1,"), self._one("(b")
        parting = self._one(self.parting)
        if len(parting) != 1 or self._one(f"a1, {self.parting}\n(b") != first + parting + second:
            raise ValueError(f"{path} does not drop white space between words")
        self.parting_id = parting[0]
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", c) for c in contents):
            raise ValueError(f"{path} has tokens with white space")
        self.hints = frozenset(c[:2] for c in contents)
        self.alone = re.compile("|".join(map(re.escape, {*self.hints, self.parting})))
        file = json.loads(self.tokenizer.to_str())
        self.lowers = lowers(file)
        self.marks_apart = marks_apart(file)

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids_of(self, words: list[str]) -> list[bytes]:
        search = self.alone.search
        plain = [w for w in words if not search(w)]
        # Strings of a thousand words cost the library least for each word.
        after = f" {self.parting} "
        joined = [after.join([*plain[at : at + 1_000], ""]) for at in range(0, len(plain), 1_000)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, dtype="<u4") for e in encoded)])
        cuts = np.flatnonzero(ids == self.parting_id)
        if len(cuts) != len(plain):
            raise RuntimeError("words and ids differ in number")
        starts = (np.concatenate(([0], cuts[:-1] + 1)) * 4).tolist()
        ends = (cuts * 4).tolist()
        raw = ids.tobytes()
        if len(plain) == len(words):
            return [raw[a:b] for a, b in zip(starts, ends)]
        found = {w: raw[a:b] for w, a, b in zip(plain, starts, ends)}
        return [found[w] if w in found else np.array(self._one(w), dtype="<u4").tobytes() for w in words]


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One per worker and file, kept from task to task."""
    return TextEncoder(path)
