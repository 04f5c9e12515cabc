"""SentencePiece encoding of merge-type vocabularies by backtracking, and decoding.

An Aho-Corasick automaton over the pieces finds, in one pass, the longest piece
that starts at each character. A segment is then read from the left: the longest
piece is tried first, then ever shorter ones that are its prefixes. A piece may
follow another only if the two are compatible, that is, if merging the characters
of both anew, best score first and leftmost of equals, ends in just these two. A
position that no piece leads on from is marked in a bitfield and never entered
again, since only one sequence of compatible pieces reaches any position. A
sequence whose neighbours are all compatible is the merge's own result: the first
merge across a boundary would happen in the two neighbours alone as well.

Pieces that merging never makes are left out. Characters outside the vocabulary
become their bytes' pieces. No piece holds letters beside other characters
or a space mark behind its first letters, so a text's segments (space marks with
letters or with other characters) are encoded by themselves, each distinct one
once a worker, in tables of bounded size. There is no shuffle.

Nulls: a null text is empty: the begin and end ids and an empty decoded text. Ids
may be null or repeat; rows are encoded one by one. Other columns are never read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.bpe import Numbers
from tidemark.llm.words import each, slices, texts

SPACE = "▁"
#: No piece holds it: it parts segments in the automaton's pass.
APART = "\n"
NONE = -1
#: Where texts are cut: between two characters that no piece holds side by side, as is checked for each vocabulary.
SEGMENT = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^{SPACE}\p{{L}}\p{{M}}\x00-\x0c\x0e-\x1f]+|{SPACE}+|[\x00-\x0c\x0e-\x1f]"
#: Distinct segments and pairs a worker keeps before it starts its tables anew, and bytes of text between passes.
MOST_KEPT = 400_000
MOST_PAIRS = 1_000_000
BLOCK = 8 << 20


def merged(text: str, cost: dict[str, float]) -> list[str]:
    """What the characters of ``text`` merge to: the cheapest pair first, of equals the leftmost."""
    parts = list(text)
    while len(parts) > 1:
        found = [(c, k) for k in range(len(parts) - 1) if (c := cost.get(parts[k] + parts[k + 1])) is not None]
        if not found:
            break
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


class PieceModel:
    """A merge-type vocabulary: ``pieces`` by id, ``cost`` and ``ids`` of those that merging makes, ``shorter`` from a piece to its longest prefix among them."""

    def __init__(self, path: str) -> None:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(library.get_piece_size())
        self.pieces = [library.id_to_piece(k) for k in size]
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.byte = {int(self.pieces[k][3:5], 16): k for k in size if library.is_byte(k)}
        plain = [k for k in size if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k) or library.is_unused(k))]
        self.cost = {self.pieces[k]: -library.get_score(k) for k in plain}
        inner = [p for p in self.cost if regex.findall(SEGMENT, p) != [p] or APART in p or any(c not in self.cost for c in p)]
        if len(self.byte) != 256 or inner or library.encode(f" a{SPACE}\tb", out_type=str)[0][0] != SPACE:
            raise ValueError(f"not a merge-type model with byte pieces, leading space marks and texts as they are: {path}")
        self.ids = {self.pieces[k]: k for k in plain if merged(self.pieces[k], self.cost) == [self.pieces[k]]}
        self.shorter = [NONE] * len(self.pieces)
        for p, k in self.ids.items():
            self.shorter[k] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), NONE)
        self.size = [len(p) for p in self.pieces]
        self.value = {k: b for b, k in self.byte.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.searcher: ahocorasick.Automaton | None = None
        self.coder: _Coder | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"fits": {}, "searcher": None, "coder": None}

    def longest(self, text: str) -> list[int]:
        """The id of the longest piece that starts at each character, or NONE."""
        if self.searcher is None:
            self.searcher = ahocorasick.Automaton()
            for p, k in self.ids.items():
                self.searcher.add_word(p, k)
            self.searcher.make_automaton()
        out, size = [NONE] * len(text), self.size
        for last, k in self.searcher.iter(text):  # by last character: a longer piece from the same start comes later
            out[last + 1 - size[k]] = k
        return out

    def compatible(self, one: int, other: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged anew."""
        held = self.fits.get((one, other))
        if held is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            a, b = self.pieces[one], self.pieces[other]
            held = self.fits[one, other] = merged(a + b, self.cost) == [a, b]
        return held

    def path(self, longest: list[int], at: int, end: int) -> list[int]:
        """The ids of characters ``at`` to ``end``, all of them known, by backtracking."""
        size, shorter, known, fits = self.size, self.shorter, self.fits.get, self.compatible
        failed = bytearray((end - at >> 3) + 1)
        out: list[int] = []
        pos, piece, last = at, longest[at], NONE
        while pos < end:
            while piece != NONE:
                to = pos + size[piece]
                if to <= end and not failed[to - at >> 3] >> (to - at & 7) & 1 and (last == NONE or known((last, piece)) or fits(last, piece)):
                    break
                piece = shorter[piece]
            if piece != NONE:
                out.append(piece)
                pos, last = to, piece
                piece = longest[pos] if pos < end else NONE
            else:  # nothing leads on from here: never come back, and try a shorter piece before
                failed[pos - at >> 3] |= 1 << (pos - at & 7)
                out.pop()
                pos -= size[last]
                piece = shorter[last]
                last = out[-1] if out else NONE
        return out

    def encoded(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment."""
        strung = APART.join(segments)
        longest, out, at = self.longest(strung), [], 0
        for segment in segments:
            end = at + len(segment)
            ids: list[int] = []
            while at < end:
                if longest[at] == NONE:
                    ids += map(self.byte.__getitem__, strung[at].encode())
                    at += 1
                    continue
                try:
                    stop = longest.index(NONE, at, end)  # a character outside the vocabulary
                except ValueError:
                    stop = end
                ids += self.path(longest, at, stop)
                at = stop
            out.append(ids)
            at = end + len(APART)
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids that begin at a character: runs of byte pieces as UTF-8, space marks as spaces."""
        out, held, value = [], bytearray(), self.value
        for k in [*ids, self.end]:
            if k in value:
                held.append(value[k])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if k not in (self.begin, self.end):
                out.append(self.pieces[k].replace(SPACE, " "))
        return "".join(out)


class _Coder:
    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.find = regex.compile(SEGMENT).findall
        self.first, self.last = (array("I", [k]).tobytes() for k in (model.begin, model.end))
        self.clear()

    def clear(self) -> None:
        self.number, self.told, self.text = Numbers(), [], []

    def code(self, column: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Ids counted, their digest and the decoded text's digest, for each text."""
        if len(self.number) > MOST_KEPT:
            self.clear()
        ask = self.number.__getitem__
        rows = [array("l", map(ask, self.find(SPACE + text.replace(" ", SPACE)))) if text else array("l") for text in column]
        if self.number.new:
            for ids in self.model.encoded(self.number.new):
                self.told.append(array("I", ids).tobytes())
                self.text.append(self.model.decoded(ids).encode())
            self.number.new.clear()
        sizes, ids, back = [], [], []
        for row in rows:
            told = b"".join((self.first, *map(self.told.__getitem__, row), self.last))
            sizes.append(len(told) // 4)
            ids.append(sha256(told).hexdigest())
            back.append(sha256(b"".join(map(self.text.__getitem__, row))[1:]).hexdigest())  # without the space put before the text
        return sizes, ids, back


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``, begin and end ids included.

    The vocabulary, of a size fixed by its file, is read here and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(PieceModel(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value  # a worker keeps it, and its tables, from task to task
        coder = model.coder = model.coder or _Coder(model)
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text")), BLOCK):
                sizes, ids, back = coder.code(part.to_pylist())
                yield pa.record_batch([batch.column("doc_id").slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
