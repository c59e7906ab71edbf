"""SentencePiece encoding and decoding by streaming Viterbi search.

A text is encoded into the piece sequence with the highest sum of piece
scores.  The search walks the text once and keeps scores and
backpointers only for a window: the positions that a piece of maximum
length can still reach, and what leads to them.  Whenever the paths of
all live positions run through one boundary, everything before it is
committed and forgotten, so a text of any length takes bounded memory.
Where no piece of the vocabulary crosses a place (before a space mark
after another character, or beside a character that no piece holds) all
paths converge at once; texts are cut there, and the ids of the cuts are
remembered in a bounded cache.

Scores are log-probabilities.  A model of merges (BPE) has none, only
ranks; its scores are whole numbers, minus the rank.  Frequencies of words
and pieces fall with their rank by the law of Zipf and Mandelbrot, so that
minus log(rank + RANK_SHIFT) stands for a piece's log-probability.
Nothing is trained.

A space is the mark U+2581 and a text begins with a dummy space, as the
vocabulary has it.  Characters without a piece, and the mark itself in a
text, become byte pieces, so that decoding gives the exact text back.

The vocabulary file is read on the driver, from a path that is a
parameter, and broadcast (its size is the vocabulary's).

Edge cases: null and empty texts have no ids and decode to the empty
text; ties keep the path whose last piece begins first; repeated rows and
null ids keep their rows; an empty table gives an empty result; other
columns are ignored except `carry`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import tidy

#: The vocabulary that queries take, by its name among the installed public tokenizers.
VOCABULARY = "piece_bpe_32k.model"
#: Zipf-Mandelbrot shift of a piece's rank.
RANK_SHIFT = 100.0
MARK = "▁"
#: Stands for a mark in a text while spaces are marks; a lone surrogate is in no piece.
NO_PIECE = "\ud800"
#: Scores this much below the worst piece's make byte pieces the last resort.
BYTE_PENALTY = 10.0
#: Remembered cuts in a worker, in two generations of this size, and the longest one that is remembered.
CACHE_CUTS, CACHE_CHARS = 40_000, 40
WORST = -1e300


class _Cuts(dict):
    """Ids of cuts, remembered in two generations; a cut that is not there is searched."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, cut: str) -> tuple[int, ...]:
        if len(cut) > CACHE_CHARS:
            return tuple(self.vocabulary.stream(cut))
        found = self.older.get(cut) or self.vocabulary._short(cut)
        if len(self) >= CACHE_CUTS:
            self.older = dict(self)
            self.clear()
        self[cut] = found
        return found


@dataclass
class Vocabulary:
    """pieces: surface -> (id, score); byte_ids: the id of each byte; surfaces: id -> surface, or None for a byte piece over 0x7F."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surfaces: list[str | None]
    trie: dict = field(init=False, repr=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        # A node by character: the nodes after it (None at a leaf), and the score and id of the piece that ends there (None without one).
        grown: dict = {}
        for piece, (i, score) in self.pieces.items():
            children, node = grown, None
            for c in piece:
                node = children.setdefault(c, [{}, None, None])
                children = node[0]
            if node is not None:
                node[1:] = score, i

        def settled(children: dict) -> dict | None:
            return {c: (settled(below), score, i) for c, (below, score, i) in children.items()} or None

        self.trie = settled(grown) or {}
        self.longest = max(map(len, self.pieces), default=1)
        self.fallback = min((s for _, s in self.pieces.values()), default=0.0) - BYTE_PENALTY
        self.of_byte = {b: i for i, b in enumerate(self.byte_ids)}
        held = {c for p in self.pieces for c in p}
        crossed = any(MARK in p.lstrip(MARK) for p in self.pieces)
        alone = "\n" not in held
        # Cuts at which every path converges; none are safe if a piece crosses a space.
        self.cuts = None if crossed else re.compile(r" +[^ \n]*|[^ \n]+|\n" if alone else r" +[^ ]*|[^ ]+")
        self.cache = _Cuts(self)

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.byte_ids, self.surfaces)

    @staticmethod
    def load(path: str | None = None) -> Vocabulary:
        """A model file's vocabulary; without a path, that of VOCABULARY."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, surfaces = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[3:5], 16)
                byte_ids[byte] = i
                surfaces.append(chr(byte) if byte < 128 else None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append("")
            else:
                pieces[piece] = i, model.get_score(i)
                surfaces.append(piece.replace(MARK, " "))
        if all(score <= 0 and score == int(score) for _, score in pieces.values()):
            pieces = {p: (i, -log(RANK_SHIFT - score)) for p, (i, score) in pieces.items()}
        return Vocabulary(pieces, byte_ids, surfaces)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = " " + text
        if self.cuts is None:
            return list(self.stream(text))
        return list(chain.from_iterable(map(self.cache.__getitem__, self.cuts.findall(text))))

    def forget(self) -> None:
        """Drops the remembered cuts."""
        self.cache = _Cuts(self)

    def _short(self, text: str) -> tuple[int, ...]:
        """Ids of a text that fits into one window."""
        n = len(text)
        score, back, held = [0.0] + [WORST] * n, [0] * (n + 1), [None] * (n + 1)
        self._relax(text.replace(MARK, NO_PIECE).replace(" ", MARK), 0, n, score, back, held)
        return tuple(self._ids(text, back, held, n))

    def _relax(self, marked: str, first: int, last: int, score: list[float], back: list[int], held: list[int | None]) -> None:
        """Extends the paths at positions first .. last - 1 of `marked` by one piece; held: the id of a position's last piece, None for bytes."""
        trie, fallback, n = self.trie, self.fallback, len(marked)
        for start in range(first, last):
            at, end = score[start], start
            node = trie.get(marked[start])
            if (node is None or node[1] is None) and at + fallback > score[start + 1]:
                score[start + 1], back[start + 1], held[start + 1] = at + fallback, start, None
            while node is not None:
                end += 1
                children, gain, piece = node
                if gain is not None and at + gain > score[end]:
                    score[end] = at + gain
                    back[end] = start
                    held[end] = piece
                if children is None or end == n:
                    break
                node = children.get(marked[end])

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text whose spaces are still spaces; each step reads one maximum piece length, then commits what all paths share."""
        longest, n = self.longest, len(text)
        # For position base + k: best score so far, the start of its last piece and that piece's id.
        base, score, back, held = 0, [0.0], [0], [None]
        done = 0
        while done < n:
            step = min(n, done + longest)
            missing = min(n, step + longest) + 1 - base - len(score)
            score.extend([WORST] * missing)
            back.extend([0] * missing)
            held.extend([None] * missing)
            marked = text[base : step + longest].replace(MARK, NO_PIECE).replace(" ", MARK)
            self._relax(marked, done - base, step - base, score, back, held)
            done = step
            live = {p for p in range(done - base, len(score)) if score[p] > WORST}
            boundary = self._converged(back, live) if done < n else 0
            if boundary > 0:
                yield from self._ids(text[base : base + boundary], back, held, boundary)
                del score[:boundary], back[:boundary], held[:boundary]
                back = [b - boundary for b in back]
                base += boundary
        yield from self._ids(text[base:], back, held, n - base)

    @staticmethod
    def _converged(back: list[int], live: set[int]) -> int:
        """The last boundary that the paths of all live positions share."""
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            live.add(back[p])
        return live.pop()

    def _ids(self, text: str, back: list[int], held: list[int | None], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            start, piece = back[end], held[end]
            if piece is None:
                out.extend(self.byte_ids[b] for b in reversed(text[start:end].encode()))
            else:
                out.append(piece)
            end = start
        out.reverse()
        return out

    def decode(self, ids: Sequence[int]) -> str:
        surfaces = self.surfaces
        parts = [surfaces[i] for i in ids]
        if None not in parts:
            return "".join(parts)[1:]
        out, run = [], bytearray()
        for i, part in zip(ids, parts, strict=True):
            if part is None:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(part)
        return ("".join(out) + run.decode("utf-8", "replace"))[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Returns the `carry` columns, ids array<int>, n_tokens long and exact (decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    part = batch.slice(at, 100)
                    texts = part.column("__text").to_pylist()
                    ids = [v.encode(t) for t in texts]
                    exact = [v.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                    columns = [part.column(k) for k in kept] + [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(exact, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "n_tokens", "exact"])
        finally:
            v.forget()  # the worker lives on

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())]
    out = rows.mapInArrow(tidy(run), T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), *added]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "ids", "n_tokens", "exact")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Returns the `carry` columns and text, for every row; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = encoded.select(F.col(f"`{ids_col}`").alias("__ids"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(i or ()) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(texts, pa.string())], names=[*kept, "text"])

    out = rows.mapInArrow(tidy(run), T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), T.StructField("text", T.StringType())]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "text")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load())
