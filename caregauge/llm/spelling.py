"""Spelling variants: words one edit apart, by search schemes over bidirectional FM-indexes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregauge.llm.common import written

#: Words of one index, about, and words that one task looks for, about.
INDEX_WORDS = 40_000
QUERY_WORDS = 40_000
#: Words that are looked for side by side.
BLOCK = 4_096
END = 0


class RankIndex:
    """Wavelet matrix over the symbols before sorted suffixes: ranks of each symbol, and counts of smaller ones."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.starts = np.zeros(alphabet + 1, np.int32)
        np.cumsum(np.bincount(symbols, minlength=alphabet), out=self.starts[1:])
        every, base = np.arange(alphabet), np.zeros(alphabet, np.int32)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            zero = (symbols >> bit & 1) == 0
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(zero, out=zeros[1:])
            one = (every >> bit & 1) == 1
            base = np.where(one, zeros[-1] + base - zeros[base], zeros[base])
            self.levels.append((one, zeros, zeros[-1]))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])
        #: Where a symbol's occurrences end up, less where they are to begin.
        self.shift = self.starts[:-1] - base

    def extend(self, symbol: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rank and number of the suffixes of [low, low + size) with ``symbol`` put before
        them; and how many symbols before those suffixes are smaller."""
        high = low + size
        smaller = np.zeros(len(symbol), np.int32)
        for ones, zeros, all_zeros in self.levels:
            one = ones[symbol]
            z_low, z_high = zeros[low], zeros[high]
            smaller += (z_high - z_low) * one
            low = np.where(one, all_zeros + low - z_low, z_low)
            high = np.where(one, all_zeros + high - z_high, z_high)
        return low + self.shift[symbol], high - low, smaller


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the cyclic suffixes, by doubling the compared length."""
    n, rank, width = len(symbols), symbols.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == n - 1 or width >= n:
            return order
        rank, width = new, width * 2


class BidirectionalIndex:
    """FM-indexes of a delimited vocabulary and of its reverse, with intervals kept in step.

    An interval (low, back, size) stands for a pattern: its suffix ranks in the text, and those of the reversed
    pattern in the reversed text.
    """

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.letters = np.unique(np.concatenate(points)) if points else np.empty(0, np.uint32)
        # one delimiter before each word and a last one, so that |word| occurs once for each word,
        # and a symbol that no word has, since suffixes go round
        self.alphabet = len(self.letters) + 2
        lengths = np.array([len(p) for p in points], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.full(self.begins[-1] + 2, END, np.int64)
        text[-1] = self.alphabet - 1
        inside = np.ones(len(text), bool)
        inside[[*self.begins, -1]] = False
        text[inside] = self.coded(np.concatenate(points)) if points else 0
        self.size = len(text)
        self.order = suffix_array(text)
        reverse = text[::-1]
        self.beside = {True: text[self.order - 1], False: reverse[suffix_array(reverse) - 1]}
        self.ranks = {side: RankIndex(symbols, self.alphabet) for side, symbols in self.beside.items()}

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        known = self.letters[at] == points if len(self.letters) else np.zeros(len(points), bool)
        return np.where(known, at + 1, -1).astype(np.int64)

    def all(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, self.size, np.int32)

    def extend(self, interval, symbol: np.ndarray, to_left: bool):
        """Intervals of the patterns with ``symbol`` put before (or after) them."""
        low, back, size = interval
        near, far = (low, back) if to_left else (back, low)
        near, found, smaller = self.ranks[to_left].extend(np.maximum(symbol, END), near, size)
        far, size = far + smaller, np.where(symbol >= 0, found, 0)
        return (near, far, size) if to_left else (far, near, size)

    def letters_beside(self, interval, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the intervals, and letters that stand before (or after) their patterns; each once.

        Short intervals are looked through, long ones get every letter.
        """
        near, size = interval[0] if to_left else interval[1], interval[2]
        short = np.flatnonzero(size < self.alphabet)
        row = np.repeat(short, size[short])
        step = np.arange(len(row)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
        seen = np.unique(row * self.alphabet + self.beside[to_left][near[row] + step])
        letters = np.arange(1, self.alphabet - 1)
        wide = np.flatnonzero(size >= self.alphabet)
        row = np.concatenate([seen // self.alphabet, np.repeat(wide, len(letters))])
        letter = np.concatenate([seen % self.alphabet, np.tile(letters, len(wide))])
        real = (letter != END) & (letter < self.alphabet - 1)
        return row[real], letter[real]

    def words_at(self, interval) -> np.ndarray:
        """Numbers of the words that patterns with both delimiters stand for."""
        return np.searchsorted(self.begins, self.order[interval[0]])


State = tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]


def _where(state: State, keep: np.ndarray) -> State:
    interval, at, place = state
    return tuple(x[keep] for x in interval), at[keep], place[keep]


def _together(*states: State) -> State:
    return tuple(np.concatenate([s[0][k] for s in states]) for k in range(3)), *(
        np.concatenate([s[k] for s in states]) for k in (1, 2)
    )


def one_edit(index: BidirectionalIndex, words: list[str], exact_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``words``, number in the index) of words exactly one inserted, deleted or
    replaced code point apart, each once.

    ``exact_first``: the first half (half the length, rounded down) is the other word's beginning
    and the edit is behind it. Otherwise the rest is the other word's end and the edit before it.
    The exact half is matched from the middle of the word outwards to its delimiter; then the
    interval turns round and is extended across the other half with an error at any place.
    """
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    lengths = np.array([len(p) for p in points], np.int64)
    begins = np.cumsum(lengths) - lengths
    coded = np.append(index.coded(np.concatenate([*points, np.empty(0, np.uint32)])), END)
    half = lengths // 2
    # of the first half, places count from the middle to the left; of the second, to the right
    sizes = {True: half, False: lengths - half}

    def symbol(at: np.ndarray, place: np.ndarray, first: bool) -> np.ndarray:
        """Symbol at a place of a half; the delimiter behind its last."""
        inner = half[at] - 1 - place if first else half[at] + place
        last = np.maximum(begins[at] + lengths[at] - 1, 0)
        return np.where(place >= sizes[first][at], END, coded[np.clip(begins[at] + inner, 0, last)])

    def exactly(state: State, first: bool) -> tuple[State, State]:
        """One more symbol: the states that reached the delimiter, and those that go on."""
        interval, at, place = state
        interval = index.extend(interval, symbol(at, place, first), first)
        ended = place >= sizes[first][at]
        state = interval, at, place + 1
        return _where(state, ended & (interval[2] > 0)), _where(state, ~ended & (interval[2] > 0))

    found: list[State] = []
    state: State = (index.all(len(words)), np.arange(len(words)), np.zeros(len(words), np.int64))
    halves = [_where(state, np.zeros(len(words), bool))]
    while len(state[1]):
        matched, state = exactly(state, exact_first)
        halves.append(matched)
    interval, at, _ = _together(*halves)

    other = not exact_first
    strict: State = (interval, at, np.zeros(len(at), np.int64))
    spent = _where(strict, np.zeros(len(at), bool))
    while len(strict[1]) or len(spent[1]):
        interval, at, place = strict
        row, letter = index.letters_beside(interval, other)
        wide = index.extend(tuple(x[row] for x in interval), letter, other)
        inside, after = place < sizes[other][at], symbol(at, place, other)
        # A letter put before its equal gives the same word as one put behind it, and of a run of
        # equal letters any may go: taken once, at the end of the run.
        unlike = letter != after[row]
        dropped = inside & (after != symbol(at, place + 1, other))
        spent = _together(
            spent,
            _where((wide, at[row], place[row] + 1), unlike & inside[row]),
            _where((wide, at[row], place[row]), unlike),
            _where((interval, at, place + 1), dropped),
        )
        _, strict = exactly(strict, other)
        ended, spent = exactly(spent, other)
        found.append(ended)
    interval, at, _ = _together(spent, *found)
    return at, index.words_at(interval)


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3, cut: int = 97) -> DataFrame:
    """Rows (word, n): words of at least ``least_letters`` letters that occur ``least_count`` times.

    Words are the maximal runs of letters (up to U+00FF) of whole texts, A-Z in lower case. Where the
    unsigned crc32 h of ``<doc_id>:<run>`` is a multiple of ``cut``, the run loses its letter at h
    modulo its length. A null text has no words, a null doc_id counts as an empty one.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col("text"), upper, upper.lower())
    # runs that are shorter cannot become words
    runs = F.regexp_extract_all(lowered, F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least_letters},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % cut == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


_NEAR = "word string, n_near long, form string, form_n long"


def _near_words(exact_first: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def near(indexed: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """For each wanted word, its near words within the index: how many, and the most frequent."""
        out: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
        asked = wanted["word"].tolist()
        if not len(indexed) or not asked:
            return pd.DataFrame(out, dtype=object)
        indexed = indexed.sort_values("word")
        known, counts = indexed["word"].tolist(), indexed["n"].to_numpy(np.int64)
        index = BidirectionalIndex(known)
        for begin in range(0, len(asked), BLOCK):
            block = asked[begin : begin + BLOCK]
            at, other = one_edit(index, block, exact_first)
            if not exact_first:  # what begins with the first half, too, is found from there
                again = [known[o].startswith(block[a][: len(block[a]) // 2]) for a, o in zip(at.tolist(), other.tolist())]
                at, other = at[~np.array(again, bool)], other[~np.array(again, bool)]
            order = np.lexsort((other, -counts[other], at))  # words are sorted, so that ties go to the least
            at, other = at[order], other[order]
            which, first, many = np.unique(at, return_index=True, return_counts=True)
            out["word"] += [block[w] for w in which]
            out["n_near"] += many.tolist()
            out["form"] += [known[o] for o in other[first]]
            out["form_n"] += counts[other[first]].tolist()
        return pd.DataFrame(out, dtype=object)

    return near


def _ranges(low: list[str], high: list[str], first: bool) -> Callable:
    """Adds to words the ranges that hold words with their first half (or the end of which is their rest)."""
    import bisect

    def routed(frames):
        for frame in frames:
            rows, shards = [], []
            for row, word in enumerate(frame["word"].tolist()):
                part = word[: len(word) // 2] if first else word[len(word) // 2 :][::-1]
                begin = bisect.bisect_left(high, part)
                end = bisect.bisect_left(low, part + "􏿿")
                rows += [row] * (end - begin)
                shards += range(begin, end)
            yield frame.iloc[rows].assign(range=np.array(shards, np.int32))[["word", "range"]]

    return routed


def _found(words: DataFrame, total: int, exact_first: bool) -> DataFrame:
    """Near words by one half: indexes over ranges of words sorted by their beginning (or end), and
    each word sent to the ranges that hold its half."""
    spark = words.sparkSession
    sort_key = F.col("word") if exact_first else F.reverse("word")
    ranges = written(
        words.withColumn("sort_key", sort_key)
        .repartitionByRange(total // INDEX_WORDS + 1, "sort_key")
        .withColumn("part", F.spark_partition_id())
    )
    # one row for each range
    bounds = ranges.groupBy("part").agg(F.min("sort_key").alias("low"), F.max("sort_key").alias("high")).orderBy("low").collect()
    numbered = spark.createDataFrame([(b.part, k) for k, b in enumerate(bounds)], "part int, range int")
    route = _ranges([b.low for b in bounds], [b.high for b in bounds], exact_first)
    wanted = written(words.select("word").mapInPandas(route, "word string, range int"))
    parts = {r.range: r["count"] // QUERY_WORDS + 1 for r in wanted.groupBy("range").count().collect()}
    split = spark.createDataFrame(sorted(parts.items()), "range int, blocks int")
    split = F.broadcast(numbered.join(split, "range"))  # a row for each range, again
    left = ranges.join(split, "part").select("range", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n")
    right = wanted.join(split, "range").select("range", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), "word")
    by = ("range", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_near_words(exact_first), _NEAR)


def variants(words: DataFrame) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) for a vocabulary (word, n) of different words.

    Two words are near if exactly one inserted, deleted or replaced code point makes one the
    other. ``form`` is the near word of largest n (ties: the least), if its n is at least twice
    that of the word; ``root`` is where forms lead from the word, itself if it has none.

    Any words will do, the empty one and single letters too (half of them is empty and matches
    everywhere). Indexes cover about ``INDEX_WORDS`` words each; a word is sent to those whose
    range can hold its half. An empty vocabulary gives no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    total = words.count()
    if not total:
        return words.selectExpr("word", "n", "0L AS n_near", "'' AS form", "0L AS form_n", "'' AS root")
    parts = _found(words, total, True).unionByName(_found(words, total, False))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    enough = -F.col("best.less") >= 2 * F.col("n")
    known = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    # A form's n is twice the word's, so that a path has at most as many words as n has bits.
    steps = written(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps_on = written(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = steps_on.select("word", "root")
        if steps_on.where("moved").isEmpty():
            break
    return known.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
