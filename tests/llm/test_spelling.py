import random
import re
import zlib

import pytest

from caregauge.llm import queries, spelling


def counted(docs):
    """The vocabulary by its definition."""
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    forms, out = {}, []
    for word, n in words.items():
        near = [w for w in words if one_apart(word, w)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
        out.append((word, n, len(near)))
    rows = []
    for word, n, n_near in out:
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        rows.append((word, form, root, n, n_near, words.get(form)))
    return sorted(rows, key=str)


def prose(seed, words, pieces=("an", "the", "ou", "ing", "é", "sch", "Re", "aa", "ÿ")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(pieces) for _ in range(r.randint(1, 4))) for _ in range(words))


DOCS = [
    *[(k, prose(k % 9, 120)) for k in range(60)],
    *[(k, prose(k, 60, ("a", "b"))) for k in range(100, 110)],
    *[(7, "Colour color colours")] * 5,
    *[(None, "colour×colour÷ Ångström")] * 4,
    (8, None),
    (9, ""),
    *[(200 + k, "q" * 3000 + " " + "q" * 2999 + "r") for k in range(4)],
]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n long, word string, form string")


@pytest.mark.parametrize("size", [40_000, 60])
def test_query_against_all_pairs(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(spelling, "INDEX_WORDS", size)
    monkeypatch.setattr(spelling, "QUERY_WORDS", size // 2)
    frame(spark, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_spelling_variants(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(counted(DOCS))
    assert len(expected) > 100 and any(r[1] and r[1] != r[2] for r in expected)
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_no_words(spark, tmp_path):
    frame(spark, [(1, None), (2, "few")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op13_spelling_variants(spark, str(tmp_path)).count() == 0


def test_short_words_and_any_letters(spark):
    words = {"": 9, "a": 1, "b": 4, "ab": 2, "😀": 2, "a😀": 1, "ba": 5}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = found.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, rows), key=str) == brute(words)


def test_index_against_plain_search():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(300)})
    index = spelling.BidirectionalIndex(words[::2])
    for first in (True, False):
        at, other = spelling.one_edit(index, words, first)
        pairs = sorted(zip(at.tolist(), other.tolist()))

        def same_half(a, b):
            half = len(a) // 2
            return b.startswith(a[:half]) if first else b.endswith(a[half:])

        expected = [
            (a, o)
            for a, word in enumerate(words)
            for o, b in enumerate(words[::2])
            if one_apart(word, b) and same_half(word, b) and one_apart(*(x[len(word) // 2 :] if first else x[: len(x) - len(word) + len(word) // 2] for x in (word, b)))
        ]
        assert pairs == expected
