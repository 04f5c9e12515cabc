"""Operators 11 to 13 against a plain tree, the public library and plain period search, over awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import merkle, periodic_runs, sentence_piece

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, idx long, path string, start long"
#: Nulls, empty and very long texts, ties, repeats, characters outside ASCII; extra columns clash with names that operators make.
AWKWARD = [
    (i, t, lang, source, n, "x", 1, "/", 7)
    for i, t, lang, source, n in [
        (1, "a b\nc", "en", "s1", 5), (1, "a b\nc", "en", "s1", 5), (1, "another text", None, "s1", None), (None, "no\nid", "en", "s1", 5), (None, None, None, None, None),
        (2, None, "en", None, 0), (3, "", "en", None, 0), (4, " \t\n ", "de", "", 4), (5, "x y " * 20_000, "en", "s2", None), (6, "é日本🙂▁ ▁\r\n\x00  a", "ja", "ünï", 9),
        (10, "one two three " * 40, "en", "s2", 1), (14, "same " * 30, "en", "s2", 1), (22, "a b c d e f g h i j k l m " * 2 + "n", "en", "s2", 1), (35, "w" * 5_000, "en", "s2", 1),
    ]
] + [(100 + k, f"row {k}\n" * (k % 5), "en", "many", k, "x", 1, "/", 7) for k in range(90)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 11: manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_tree(nodes):
    """The root of nodes and each one's siblings left and right, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rows in sources.values():
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = [plain_tree([leaf_of(r, r.text) for r in sources[s]]) for s in order]
    root, ups = plain_tree([top for top, _ in trees])
    out = Counter()
    for s, (top, paths), up in zip(order, trees, ups, strict=True):
        for r, path in zip(sources[s], paths, strict=True):
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf_of(r, r.text.replace("\n", "") if tampered else r.text)
            for left, right in path + up:
                node = H(left, node, right)
            out[(r.doc_id, leaf_of(r, r.text), top, root, H(*(a + b for a, b in path + up)), node, node == root)] += 1
    return out


def test_manifest_against_a_plain_tree(documents, awkward):
    for docs in (documents, awkward, awkward.limit(1), documents.withColumn("source", F.col("doc_id").cast("string"))):
        got = Counter(tuple(r) for r in merkle.manifest(docs).collect())
        assert got == plain_manifest(docs.collect())


def test_manifest_of_trees_of_several_arrays(spark, monkeypatch):
    """More leaves than an array holds, sources of many sizes about the runs' and arrays' bounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SIZE", 9)
    sizes = (1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 82, 100)
    rows = [(k, f"t{k}\n", "en", f"s{n}", k) for n in sizes for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs).collect()
    assert Counter(map(tuple, got)) == plain_manifest(docs.collect())
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing(awkward):
    assert merkle.manifest(awkward.where("false")).collect() == []


# --- 12: pieces


def plain_coded(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = Counter()
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        out[(r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    return out


def test_pieces_as_the_library(documents, awkward):
    for docs in (documents, awkward):
        assert Counter(tuple(r) for r in sentence_piece.coded(docs, MODEL).collect()) == plain_coded(docs.collect())
    assert sentence_piece.coded(awkward.where("false"), MODEL).count() == 0


def test_pieces_of_drawn_texts(spark):
    draw = random.Random(7)
    alphabets = ["abcdefghij", "aeiou st", "▁ \n\t\r\x00", "ééñüßa ", "日本語テストのは ", "🙂🏽x", "the ing er", "!!..,,--==  __**##;\r", "    a", "0123456789 "]
    rows = []
    for k in range(3000):
        letters = "".join(draw.sample(alphabets, draw.randint(1, 3)))
        rows.append((k, "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))))
    rows += [(9001, " " * 4000), (9002, "=" * 4097), (9003, "".join(draw.choice("abcdefgh") for _ in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in sentence_piece.coded(docs, MODEL).collect()) == plain_coded(docs.collect())


def test_backtracking_and_small_tables(monkeypatch):
    """A longest piece that must be given back; tables that are cleared on the way change nothing."""
    monkeypatch.setattr(sentence_piece, "MOST_PAIRS", 3)
    model = sentence_piece.PieceModel(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw, given_back = random.Random(5), 0
    for _ in range(400):
        word = "".join(draw.choice("etaoinshrdlu") for _ in range(12))
        ids = model.encoded(["▁" + word])[0]
        assert ids == library.encode(word)
        longest, at = model.longest("▁" + word), 0
        for k in ids:
            given_back += k != longest[at]
            at += len(model.pieces[k])
    assert given_back > 100


# --- 13: runs


def plain_runs(words, least=12):
    """All runs by trying each period."""
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p) and not any(words[i : j + p - q] == words[i + q : j + p] for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_described(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_against_plain_search(documents, awkward):
    short = documents.where(F.size(F.split("text", " ")) < 700)
    assert short.count() > 150
    for docs in (short, awkward.where("doc_id is null or doc_id <> 5")):
        got = Counter(tuple(r) for r in periodic_runs.detected(docs, loop=True).collect())
        assert got == Counter(plain_described(r.doc_id, r.text) for r in docs.collect())
    row = periodic_runs.detected(awkward.where("doc_id = 5")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 40_000, 2, 20_000_000)
    assert periodic_runs.detected(awkward.where("false")).count() == 0


def test_runs_of_drawn_words():
    draw = random.Random(3)
    for k in range(1500):
        n, letters = draw.randint(0, 60), draw.choice([1, 2, 2, 3, 4, 8])
        words = [draw.randrange(letters) for _ in range(n)]
        if k % 2 and n > 4:
            p, s = draw.randint(1, n // 2), draw.randrange(n)
            words = words[:s] + [words[min(s + (i - s) % p, n - 1)] for i in range(s, n)]
        numbers = np.array(words, np.int32)
        assert [(r.start, r.end - r.start, r.period) for r in periodic_runs.runs_of(numbers)] == plain_runs(words), words
        if n:  # without the windows, and short runs as well
            got = periodic_runs._Stretch(numbers).runs(2)
            assert sorted((r.start, r.end - r.start, r.period) for r in got) == sorted(plain_runs(words, 2)), words


def test_runs_where_hashes_mislead(monkeypatch):
    """Extensions are right even if all hashes are equal, as words are compared."""
    monkeypatch.setattr(periodic_runs._Stretch, "same", lambda self, i, j, n: True)
    for words in ([bin(i).count("1") & 1 for i in range(300)], [0, 1, 2] * 30 + [0, 2] * 30, [0] * 100):
        numbers = np.array(words, np.int32)
        assert [(r.start, r.end - r.start, r.period) for r in periodic_runs.runs_of(numbers)] == plain_runs(words)
