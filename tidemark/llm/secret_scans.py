"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of the characters that keys are made of, and values that
follow a name such as token or password. The forest judges each by its length, the
transitions between its characters, how much of it dictionary words cover, the path
or address around it and the words beside it. It is trained from labelled findings
(text, start, end, secret); trees are grown in parallel, one task each, on a bounded
sample of findings, and the forest (of bounded size) is broadcast. Scanning is one
pass over whole texts without a shuffle.

Nulls: a null text has no findings; a null doc_id is carried; repeated rows are
scanned each; null labels are no findings. Without findings of both kinds every
candidate is a secret. A text without candidates gives no rows and is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import each, texts

TREES, DEPTH, MAX_FINDINGS, CUT = 24, 10, 8000, 0.5
_RUN = re.compile(r"[A-Za-z0-9_\-+/=.~@:%]{16,}")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api_?-?key|access_?-?key|private_?-?key|credentials?|auth|bearer)\W{0,4}[=:]\s{0,3}[\"'`]?([^\s\"'`,;<>]{8,})")
_LEFT, _RIGHT = ".,:;=-/+~@%", ".,:;-/+~@%"
#: Words that name a secret, and words that say a value is none.
NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "credentials", "private", "access")
DENIALS = ("example", "sample", "dummy", "test", "placeholder", "changeme", "commit", "sha", "sha256", "md5", "checksum", "digest", "integrity", "uuid", "id", "version", "etag", "mail", "path", "file", "image")
#: Frequent pieces of words in several languages, for dictionary coverage.
PIECES = ("tion", "ing", "the", "and", "ment", "able", "ous", "ent", "ion", "ung", "keit", "heit", "lich", "isch", "sch", "eur", "que", "elle", "aire", "mente", "idad", "ado", "ous", "ver", "pre", "con", "pro", "com", "res", "ter", "user", "name", "data", "file", "page", "index", "image", "mail", "www", "http", "html", "test", "example", "your", "here", "config", "value", "path", "node", "main")
_PIECE = re.compile("|".join(sorted(PIECES, key=lambda x: (-len(x), x))))


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate, in order and apart. Of a run that holds named values the pieces beside them are candidates of their own."""
    named = [(m.start(), *m.span(1)) for m in _NAMED.finditer(text)]
    found = [(a, b) for _, a, b in named]
    first = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while first < len(named) and named[first][2] <= start:
            first += 1
        k = first
        while start < end:
            inside = k < len(named) and named[k][0] < end
            a, b = start, named[k][0] if inside else end
            start = named[k][2] if inside else end
            k += 1
            a += len(text[a:b]) - len(text[a:b].lstrip(_LEFT))
            b -= len(text[a:b]) - len(text[a:b].rstrip(_RIGHT))
            if b - a >= 16 and any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b]):
                found.append((a, b))
    out, end = [], -1
    for a, b in sorted(found):
        b = a + len(text[a:b].rstrip(_RIGHT + "!#*$&)]}|"))
        if a >= end and b - a >= 8:
            out.append((a, b))
            end = b
    return out


FEATURES = ("length", "digits", "upper", "hex", "entropy", "changes", "vowel_pairs", "covered", "symbols", "repeats", "address", "path", "assigned", "quoted", "named", "denied", "prefix", "near_words")


def described(text: str, a: int, b: int) -> list[float]:
    """The features of a candidate."""
    value = text[a:b]
    n = len(value)
    kind = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value])
    _, shown = np.unique(list(value), return_counts=True)
    share = shown / n
    low = value.lower()
    before, after = text[max(0, a - 48) : a], text[b : b + 32]
    words = re.findall(r"[A-Za-z]+", before.lower().replace("_", " "))[-3:]
    later = re.findall(r"[A-Za-z]+", after.lower())[:2]
    vowels = sum((x in "aeiou") != (y in "aeiou") for x, y in zip(low, low[1:], strict=False) if x.isalpha() and y.isalpha())
    left = re.search(r"\S*$", before)[0]
    return [
        min(n, 512), (kind == 0).mean(), (kind == 2).mean(), sum(c in "0123456789abcdefABCDEF" for c in value) / n, float(-(share * np.log2(share)).sum()),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, vowels / max(1, n - 1), sum(len(m) for m in _PIECE.findall(low)) / n, (kind == 3).mean(), float(share.max()),
        float("@" in value or "://" in value or "@" in left or "://" in left), float(value.count("/") + value.count(".") + left.count("/")), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), float(before[-1:] in ("'", '"', "`")),
        float(any(w in NAMES for w in words)), float(any(w in DENIALS for w in [*words, *later]) or any(d in low for d in ("example", "changeme", "your", "xxxx"))),
        float(bool(re.match(r"AKIA|gh[pousr]_|xox[abprs]-|eyJ|sk[-_]|AIza|glpat-", value))), float(np.mean([len(w) for w in words]) if words else 0.0),
    ]


class Tree(NamedTuple):
    """Nodes as arrays: the feature asked (-1 in leaves), its threshold, the children and the share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.value[at]


def grown(x: np.ndarray, y: np.ndarray, seed: int) -> Tree:
    """A tree on a bootstrap sample, asking the best of a random few features at each node."""
    rng = np.random.default_rng(seed)
    drawn = rng.integers(0, len(x), len(x))
    x, y = x[drawn], y[drawn]
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        p = y[rows].mean()
        nodes.append([-1, 0.0, 0, 0, p])
        if depth == DEPTH or len(rows) < 4 or p in (0.0, 1.0):
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            n1, n = cut + 1, len(rows)
            p1, p2 = c[cut] / n1, (c[-1] - c[cut]) / (n - n1)
            gini = n1 * p1 * (1 - p1) + (n - n1) * p2 * (1 - p2)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (gini[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] < 0:
            return me
        under = x[rows, best[1]] <= best[2]
        nodes[me][0], nodes[me][1] = best[1], best[2]
        nodes[me][2], nodes[me][3] = grow(rows[under], depth + 1), grow(rows[~under], depth + 1)
        return me

    grow(np.arange(len(x)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def fit(findings: DataFrame, trees: int = TREES, most: int = MAX_FINDINGS) -> list[Tree]:
    """A forest from labelled findings: text, start, end, secret (0 or 1)."""
    spark = findings.sparkSession
    some = findings.where("text IS NOT NULL AND secret IS NOT NULL").orderBy(F.xxhash64("text", "start"), "text", "start").limit(most)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [described(t, a, b) for t, a, b in zip(batch["text"], batch["start"], batch["end"], strict=True)]
            yield pd.DataFrame({"x": rows, "y": batch["secret"].astype(float)})

    rows = some.select("text", "start", "end", "secret").mapInPandas(describe, "x array<double>, y double").toPandas()
    if rows["y"].nunique() < 2:
        return []
    sent = spark.sparkContext.broadcast((np.array(rows["x"].tolist()), rows["y"].to_numpy()))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = sent.value
        for batch in batches:
            for seed in batch["id"]:
                yield pd.DataFrame({"seed": [seed], "tree": [np.column_stack(grown(x, y, int(seed))).ravel().tolist()]})

    forest = spark.range(0, trees, 1, trees).mapInPandas(grow, "seed long, tree array<double>").toPandas().sort_values("seed")
    parts = [np.array(t).reshape(-1, 5) for t in forest["tree"]]
    return [Tree(t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]) for t in parts]


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings whose labels are known because they are made: keys, tokens and passwords in several settings,
    and what is taken for them: digests of files, ids, addresses, paths, words, numbers and placeholders.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_made(int(k)) for k in batch["id"]], columns=["text", "start", "end", "secret"])

    return spark.range(0, n, 1, 4).mapInPandas(make, "text string, start int, end int, secret int")


def _made(k: int) -> tuple[str, int, int, int]:
    rng = np.random.default_rng(k)
    pick = lambda letters, size: "".join(rng.choice(list(letters), size))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed_ = lower + lower.upper() + digits
    vowel, other = "aeiou", "bcdfghlmnprst"
    word = lambda: "".join(pick(other, 1) + pick(vowel, 1) + (pick("nrst", 1) if rng.random() < 0.4 else "") for _ in range(rng.integers(1, 5)))
    some = lambda: " ".join(word() for _ in range(rng.integers(2, 7)))
    hexes = lambda: pick("0123456789abcdef", rng.choice([32, 40, 48, 64]))
    site = lambda: f"{word()}.example.{rng.choice(['com', 'net', 'org'])}"
    secret = int(k % 2)
    if secret:
        value = [hexes, lambda: pick(mixed_, rng.integers(20, 44)), lambda: "AKIA" + pick(lower.upper() + digits, 16), lambda: "ghp_" + pick(mixed_, 36), lambda: pick(mixed_ + "+/", 40) + "==", lambda: pick(mixed_ + "!$%&", rng.integers(10, 20))][rng.integers(6)]()
        name = str(rng.choice(["token", "secret", "api_key", "password", "access_key", "auth_token", "API_KEY", "private_key"]))
        sign = str(rng.choice([" = ", ": ", "=", ' = "', "='", ': "']))
        strong = value.startswith(("AKIA", "ghp_"))
        head = some() + " " + ("" if strong and rng.random() < 0.5 else name + sign)
        closing = '"' if sign.endswith('"') else "'" if sign.endswith("'") else ""
    else:
        kind = rng.integers(10)
        head, closing = some() + " ", ""
        if kind == 0:
            value = f"{word()}.{pick(digits, 2)}@{word()}{pick(digits, 1)}.example.com"
        elif kind == 1:
            head, value = head + "https://", f"{site()}/{word()}/{pick(digits, 5)}.html"
        elif kind == 2:
            head, value = head + str(rng.choice(["commit ", "sha256 ", "md5: ", "checksum ", "etag: "])), hexes()
        elif kind == 3:
            value = "-".join(pick("0123456789abcdef", m) for m in (8, 4, 4, 4, 12))
        elif kind == 4:
            value = f"/{word()}/{word()}/{word()}{pick(digits, 3)}/{word()}.png"
        elif kind == 5:
            head, value = head + str(rng.choice(["token = ", "password: ", "api_key = "])), str(rng.choice(["YOUR_API_KEY_HERE_1", "changeme12345678", "xxxxxxxxxxxxxxxx1", "example-token-0001", "placeholder_value_1"]))
        elif kind == 6:
            value = "".join(word() for _ in range(5)) + pick(digits, 1)
        elif kind == 7:
            value = ".".join(pick(digits, 3) for _ in range(4)) + "/v" + pick(digits, 6) + "-" + word()
        elif kind == 8:
            value = f"{word()}_{word()}_{word()}_{pick(digits, 2)}"
        else:
            value = f"20{pick(digits, 2)}-0{pick('123456789', 1)}-{pick('12', 2)}T{pick('012', 2)}:{pick('12345', 2)}:00Z"
    if rng.random() < 0.25:
        head, value = head.upper(), value.upper()
    text = f"{head}{value}{closing} {some()}"
    return text, len(head), len(head) + len(value), secret


def _judge(forest: list[Tree]):
    def judge(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        if not forest:
            return np.ones(len(spans))
        x = np.array([described(text, a, b) for a, b in spans])
        return np.mean([t.of(x) for t in forest], axis=0)

    return judge


def scanned(docs: DataFrame, forest: list[Tree]) -> DataFrame:
    """doc_id, start_at, end_at (code points), score and secret of every candidate of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(sent.value)
        for batch in each(batches):
            row, spans, scores = [], [], []
            for k, value in enumerate(texts(batch.column("text"))):
                text = value.as_py()
                if found := candidates(text):
                    row += [k] * len(found)
                    spans += found
                    scores += judge(text, found).tolist()
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            ends = [pa.array([s[j] for s in spans], pa.int32()) for j in (0, 1)]
            yield pa.record_batch([ids, *ends, pa.array(scores, pa.float64()), pa.array([s >= CUT for s in scores], pa.bool_())], ["doc_id", "start_at", "end_at", "score", "secret"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start_at int, end_at int, score double, secret boolean")


def redacted(docs: DataFrame, forest: list[Tree], mark: str = "<SECRET>") -> DataFrame:
    """``docs``, all columns, with the secrets of each text replaced by ``mark`` and n_chars, if there, counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(sent.value)
        for batch in each(batches):
            changed: list[str | None] = [None] * batch.num_rows  # only texts with secrets are made anew
            for k, value in enumerate(batch.column("text")):
                if (text := value.as_py()) and (found := candidates(text)):
                    gone = [s for s, p in zip(found, judge(text, found), strict=True) if p >= CUT]
                    for a, b in reversed(gone):
                        text = text[:a] + mark + text[b:]
                    changed[k] = text if gone else None
            for name, make in (("text", lambda x: x), ("n_chars", lambda x: None if x is None else len(x))):
                if name in batch.schema.names and any(x is not None for x in changed):
                    at = batch.schema.get_field_index(name)
                    new = pa.array([make(x) for x in changed], batch.schema.field(at).type)
                    batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(new, batch.column(at)))
            yield batch

    return docs.mapInArrow(run, docs.schema)
