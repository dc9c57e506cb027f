"""SentencePiece encoding and decoding (9): Aho-Corasick automaton and one-pass Viterbi.

Method: an Aho-Corasick automaton over all pieces runs once over the text; at each
position its output links name every piece that ends there, and the best score up to the
position is relaxed from those of the pieces' starts.  For unigram models that gives the
greatest sum of scores.  For BPE models (the installed vocabulary) the greatest sum of merge ranks
would not give the ids that the model means; there a link is relaxed only if it is
admissible: merging the characters of the piece and of the one before it yields exactly those two.
That holds for one link at each position, so the constraint decides, and gives the model's own ids.

No piece crosses the start of a new word, so texts are split into words column by column, as Arrow
arrays of a few megabytes; the automaton runs over each distinct word of such a part, and short words are remembered
from part to part; the memory for words and for admissible neighbours is bounded.
Characters outside the vocabulary become byte pieces, or the unknown piece in models
without bytes.  Decoding is the exact inverse except that the word mark U+2581 in a
text reads as a space, as it does in SentencePiece itself.

The vocabulary is read by the driver from a path (a parameter) and broadcast: its size
is that of the file, about a megabyte, whatever the corpus.

Defined cases: null and empty text have no ids; null ids and repeated rows are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm._shared import giving_back, load, small_batches, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Remembered words and their greatest length, and remembered pairs of pieces.
_REMEMBER, _LENGTH, _PAIRS = 200_000, 64, 500_000
#: Bytes of texts that are split and encoded at once.
_PART = 1 << 20
#: Score of neighbours that don't merge.
_NEVER = float("-inf")


class PieceTable:
    """What encoding needs of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, prefix: bool, unk: int):
        self.pieces, self.scores, self.kinds, self.bpe, self.prefix, self.unk = pieces, scores, kinds, bpe, prefix, unk

    @classmethod
    def read(cls, path: str = MODEL) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        kinds = [p.type for p in model.pieces]
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], kinds, model.trainer_spec.model_type == 2,
                   model.normalizer_spec.add_dummy_prefix, kinds.index(2))


class _Words(dict):
    """Ids (int32, as bytes) of words in UTF-8, remembered for the first ones met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = array("i", self.encode(word.decode("utf-8", "surrogatepass").replace(" ", MARK))).tobytes()
        if len(self) < _REMEMBER and len(word) <= _LENGTH:
            self[word] = ids
        return ids


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _parts(texts: pa.BinaryArray) -> Iterator[pa.BinaryArray]:
    """Runs of rows of at most _PART bytes, or of one row."""
    ends, at = _flat(texts)[0][1:], 0
    while at < len(texts):
        below = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, below + _PART, "right")))
        yield texts.slice(at, to - at)
        at = to


class PieceCodec:
    """Encoder and decoder over a PieceTable; built once in each task."""

    NORMAL, BYTE = (1, 4), 6

    def __init__(self, table: PieceTable):
        self.t = table
        self.ids = {p: i for i, (p, k) in enumerate(zip(table.pieces, table.kinds)) if k in self.NORMAL}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.sizes = list(map(len, table.pieces))
        self.score = {p: table.scores[i] for p, i in self.ids.items()}
        self.chars = set("".join(self.ids))
        byte = {p: i for i, (p, k) in enumerate(zip(table.pieces, table.kinds)) if k == self.BYTE}
        self.byte_ids = [byte.get(f"<0x{b:02X}>") for b in range(256)] if byte else None
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # pieces cross words
        self.lines = "\n" not in self.chars
        self.known = _Words(self.word)
        self.follows: dict[int, bool] = {}
        self.orders: dict[int, tuple | None] = {}
        as_bytes = {i: bytes([b]) for b, i in enumerate(self.byte_ids or []) if i is not None}
        self.bytes = [as_bytes.get(i, p.replace(MARK, " ").encode() if k in self.NORMAL else b"") for i, (p, k) in enumerate(zip(table.pieces, table.kinds))]
        self.bytes[table.unk] = " ⁇ ".encode()
        self.raw = pa.array(self.bytes, pa.binary())

    def merges(self, chars: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The characters merged by the model's rule: the best-scored neighbours first, leftmost on ties.

        The parts that are left, the score of each merge, and the first and the last part before each merge and after the last.
        """
        parts, score = list(chars), self.score.get
        both = [score(a + b, _NEVER) for a, b in pairwise(parts)]  # of neighbours; only those of a merged part change
        scores, first, last = [], parts[:1], parts[-1:]
        while both:
            best = max(both)
            if best == _NEVER:
                break
            at = both.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del both[at]
            if at:
                both[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(both):
                both[at] = score(parts[at] + parts[at + 1], _NEVER)
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        scores.append(_NEVER)
        return parts, scores, first, last

    def merged(self, chars: str) -> list[str]:
        return self.merges(chars)[0]

    def _apart(self, before: int, piece: int) -> bool:
        """Whether no merge crosses from one piece to the next: each is merged in its own order, the better-scored step of both first."""
        for i in (before, piece):
            if i not in self.orders:
                parts, scores, *ends = self.merges(self.t.pieces[i])
                ends = (tuple(self.t.pieces[self.ids[c]] if c in self.ids else c for c in e) for e in ends)  # no copies of strings
                self.orders[i] = (tuple(scores), *ends) if len(parts) == 1 else None
        left, right = self.orders[before], self.orders[piece]
        if left is None or right is None:
            return False
        (x, _, last), (y, first, _) = left, right
        score, i, j = self.score.get, 0, 0
        cross = score(last[0] + first[0], _NEVER)
        while True:
            if cross > x[i] and cross >= y[j]:
                return False
            if x[i] >= y[j]:
                if x[i] == _NEVER:
                    return True
                i += 1
                changed = last[i] is not last[i - 1]
            else:
                j += 1
                changed = first[j] is not first[j - 1]
            if changed:
                cross = score(last[i] + first[j], _NEVER)

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether merging the characters of both pieces (of one, at the start) leaves them."""
        p = self.t.pieces
        if len(self.follows) >= _PAIRS:
            self.follows.clear()
        fits = self.merged(p[piece]) == [p[piece]] if before < 0 else self._apart(before, piece)
        self.follows[(before + 1) * len(p) + piece] = fits
        return fits

    def _segment(self, s: str) -> list[int]:
        """Ids of a string of known characters."""
        last = (self._admissible if self.t.bpe else self._greatest)(s)
        out, at, sizes = [], len(s), self.sizes
        while at:
            i = last[at]
            if i is None:  # a gap of a unigram vocabulary
                return [i for c in s for i in ([self.ids[c]] if c in self.ids else self._unknown(c))]
            out.append(i)
            at -= sizes[i]
        out.reverse()
        return out

    def _admissible(self, s: str) -> list[int | None]:
        """The piece that ends at each position by the merge rule; links after the admissible one are passed over."""
        pieces, follows, done = len(self.sizes), self.follows.get, -1
        last: list[int | None] = [None] * (len(s) + 1)
        last[0] = -1
        for end, (i, size) in self.automaton.iter(s):
            if end == done:
                continue
            before = last[end + 1 - size]
            if before is None:
                continue
            fits = follows((before + 1) * pieces + i)
            if self.may_follow(before, i) if fits is None else fits:
                last[end + 1] = i
                done = end
        return last

    def _greatest(self, s: str) -> list[int | None]:
        """The last piece of the greatest sum of scores up to each position."""
        scores = self.t.scores
        best: list[float | None] = [0.0] + [None] * len(s)
        last: list[int | None] = [None] * (len(s) + 1)
        for end, (i, size) in self.automaton.iter(s):
            score = best[end + 1 - size]
            if score is not None and (best[end + 1] is None or score + scores[i] > best[end + 1]):
                best[end + 1], last[end + 1] = score + scores[i], i
        return last

    def _unknown(self, c: str) -> list[int]:
        return [self.t.unk] if self.byte_ids is None else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def word(self, w: str) -> list[int]:
        if self.chars.issuperset(w):
            return self._segment(w)
        ids: list[int] = []
        start = 0
        for k, c in enumerate(w):
            if c not in self.chars:
                if start < k:
                    ids += self._segment(w[start:k])
                ids += self._unknown(c)
                start = k + 1
        if start < len(w):
            ids += self._segment(w[start:])
        return ids

    def close(self) -> None:
        """Forget everything: the remembered words refer to the codec, so it would outlive its task."""
        self.known.clear()
        self.known.encode = None
        self.follows.clear()
        self.orders.clear()

    def encode_all(self, texts: pa.BinaryArray) -> pa.ListArray:
        """Ids of each text of a column (UTF-8, without nulls)."""
        texts = pc.replace_substring(texts, pattern=MARK.encode(), replacement=b" ")
        if self.t.prefix:
            texts = pc.if_else(pc.equal(texts, b""), texts, pc.binary_join_element_wise(b" ", texts, b""))
        offsets, data = _flat(texts)
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        if not self.whole:  # a word: spaces and what follows up to the next space
            space = data == ord(" ")
            starts[:-1] |= space
            starts[1:-1] &= ~(space[1:] & space[:-1])
            starts[offsets] = True
            if self.lines:
                line = data == ord("\n")
                starts[:-1] |= line
                starts[1:] |= line
        starts[-1] = False
        at = np.flatnonzero(starts).astype(np.int32)
        ends = pa.py_buffer(np.append(at, np.int32(len(data))))
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        ids = [self.known[w] for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(ids))])
        of_word = pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), flat).take(words.indices)
        rows = of_word.offsets.to_numpy()[np.searchsorted(at, offsets)]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), of_word.values)

    def exact_all(self, ids: pa.ListArray, texts: pa.BinaryArray) -> list[bool]:
        """Whether decoding each row's ids gives its text back."""
        offsets = ids.offsets.to_numpy()
        at, data = _flat(self.raw.take(ids.values))
        data, out = data.tobytes(), []
        for k, text in enumerate(texts.to_pylist()):
            raw = data[at[offsets[k]] : at[offsets[k + 1]]]
            same = (raw[1:] if self.t.prefix and raw.startswith(b" ") else raw) == text
            out.append(same or self.decode(ids[k].as_py()) == text.decode("utf-8", "surrogatepass"))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary())).values.to_numpy()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.t.prefix and text.startswith(" ") else text


_ENCODED = "doc_id long, n_tokens long, ids array<int>, exact boolean"


def encode_documents(docs: DataFrame, *, model: str = MODEL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    table = docs.sparkSession.sparkContext.broadcast(vars(PieceTable.read(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(PieceTable(**table.value))
        try:
            for batch in batches:
                at = 0
                for texts in _parts(pc.fill_null(batch.column(1), "").cast(pa.binary())):
                    ids = codec.encode_all(texts)
                    columns = [batch.column(0).slice(at, len(texts)), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(codec.exact_all(ids, texts), pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "exact"])
                    at += len(texts)
        finally:
            codec.close()
            del codec

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):  # whole texts, and ids that outgrow them, in bounded batches
        return stored(rows.mapInArrow(giving_back(run), _ENCODED), "encoded")


def decode_documents(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    table = encoded.sparkSession.sparkContext.broadcast(vars(PieceTable.read(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(PieceTable(**table.value))
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"))


QUERIES = {"op9_piece_codec": op9_piece_codec}
SQL: dict[str, str] = {}
