"""SentencePiece encoding and decoding by a streaming Viterbi over the piece lattice.

Every boundary of the text keeps one backpointer: the last piece of the best
segmentation of the text before it. Only the boundaries of the last
``longest piece`` characters can still be reached by a later piece, so only
their paths survive; whenever these paths meet in one boundary, the ids up to it
are committed and forgotten. Memory is bounded by the stretch since the last
meeting point, not by the text.

What "best" means depends on the model's kind:

* ``unigram``: the path with the largest sum of piece scores.
* ``bpe``: a sum of scores does not give the public library's ids, since a merge
  model picks merges in order of rank. A sequence of pieces is what the merges
  give if and only if every two neighbours, merged on their own, stay as they
  are; so the lattice admits only such neighbours, exactly one path survives for
  each boundary, and the same window and commit rule apply. The ids equal those
  of the public library.

Where no piece of the vocabulary can span a boundary (a word end before a space
mark), all paths meet: the ids up to it are committed there. A stretch between two
such boundaries that is no longer than the longest piece lies whole in the window
and needs no search for an earlier meeting point; longer ones are streamed. What a
stretch gave is kept in a bounded memo.

Results for odd input: a null text has null ids and a null text back; an empty
text has no ids; characters outside the vocabulary become byte pieces; very long
texts and texts without any space are streamed; repeated rows give repeated
results; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import texts

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Stretches in a generation of the memo, and piece pairs that are remembered: about 150 MB a worker at most.
MEMO = 200_000
PAIRS = 400_000
HEADS = 50_000

#: Characters of a head.
HEAD = 5

#: Rows encoded before they are handed back.
ROWS = 256

#: Stretches longer than this are not kept.
MEMO_CHARS = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"unknown wire type {kind}")


class _Memo(dict):
    """Ids (as packed 32-bit numbers) of stretches after ``mark``, in two generations.

    When the young generation is full it becomes the old one, so frequent
    stretches stay known and memory stays bounded.
    """

    def __init__(self, model: Model, mark: str):
        super().__init__()
        self.model, self.mark, self.old = model, mark, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stretch = self.mark + word
            if 1 < len(word) <= MEMO_CHARS and word[-2:] not in self.model.adjacent:
                # no piece has these two characters side by side, so all paths meet between them
                ids = self[word[:-1]] + self.model.bare[word[-1]]
            elif len(stretch) > self.model.longest:
                ids = self.model.pack(stretch)
            else:
                ids = self.model.pack_short(stretch)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Model:
    """Pieces, scores and settings of a model file. Pickles as its bytes, so executors need no file."""

    def __init__(self, data: bytes):
        self.data = data
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.bytes_of: dict[int, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.control: set[int] = set()
        self.unk = 0
        self.bpe = False
        self.dummy_prefix = True
        self.squeeze = True
        self.charsmap = b""
        for number, value in _fields(data):
            if number == 1:
                self._piece(value)
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.charsmap:
            raise ValueError("models with a normalisation table are not supported")
        self.longest = max(map(len, self.ids), default=1)
        #: Pairs of characters that are side by side in some piece.
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Longest piece by its last three characters.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 2))
        #: Score of a character outside the vocabulary.
        self.unknown = min(self.scores, default=0.0) - 10.0
        #: Whether a piece has a space mark after another character: then no boundary is forced.
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: Whether a line break is no part of any piece: then it is a forced boundary too.
        self.breaks = not any("\n" in p for p in self.ids)
        self.memo, self.bare = _Memo(self, MARK), _Memo(self, "")
        self.pairs: dict[int, bool] = {}
        self.heads: dict[str, tuple[list[str], list[int]]] = {}
        mark = MARK.encode()
        self.raw = [p.encode().replace(mark, b" ") for p in self.pieces]
        for at in self.control:
            self.raw[at] = b""
        for at, byte in self.bytes_of.items():
            self.raw[at] = bytes([byte])

    def __reduce__(self):
        return _model_of, (self.data,)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def _piece(self, data: bytes) -> None:
        own = dict(_fields(data))
        text, kind, at = own.get(1, b"").decode("utf-8"), own.get(3, 1), len(self.pieces)
        self.pieces.append(text)
        self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
        if kind in (1, 4):
            self.ids[text] = at
        elif kind == 6:
            self.byte_ids[int(text[3:5], 16)] = at
            self.bytes_of[at] = int(text[3:5], 16)
        elif kind == 2:
            self.unk = at
        elif kind == 3:
            self.control.add(at)

    # -- the lattice -----------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The merges of one short string, in order of score, leftmost first."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                at = ids.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or scores[at] > best):
                    best, where = scores[at], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def code(self, piece: str) -> int:
        """The id of a piece; characters outside the vocabulary get codes above it."""
        at = self.ids.get(piece)
        return len(self.pieces) + ord(piece) if at is None else at

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the two pieces, merged on their own, stay as they are. No left: whether the right one does."""
        key = (self.code(left) << 24 | self.code(right)) if left else -1 - self.code(right)
        known = self.pairs.get(key)
        return self.judged(key, left, right) if known is None else known

    def judged(self, key: int, left: str, right: str) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def stream(self, chunks: Iterable[str]) -> Iterator[str]:
        """Pieces (or single characters outside the vocabulary) of the text in ``chunks``, as soon as they are certain.

        ``text``, ``last`` (each boundary's last piece) and ``total`` cover only
        the stretch since the last boundary in which all surviving paths met.
        """
        ids, scores, longest = self.ids, self.scores, self.longest
        text, last, total = "", [""], [0.0]
        before = ""  # the piece committed last
        unknown = self.unknown
        for chunk in chunks:
            for at in range(0, len(chunk), longest):
                text += chunk[at : at + longest]
                for end in range(len(last), len(text) + 1):
                    found, best = "", 0.0
                    for start in range(max(0, end - longest), end):
                        piece = text[start:end]
                        if piece not in ids and end - start > 1:
                            continue
                        if self.bpe:
                            if self.neighbours(last[start] or before, piece):
                                found = piece
                                break
                        else:
                            value = total[start] + (scores[ids[piece]] if piece in ids else unknown)
                            if not found or value > best:
                                found, best = piece, value
                    last.append(found)
                    total.append(best)
                if len(text) >= 4 * longest and (meet := self._meet(last)):
                    out = _path(last, meet)
                    yield from out
                    before = out[-1]
                    text, last, total = text[meet:], ["", *last[meet + 1 :]], [x - total[meet] for x in total[meet:]]
        yield from _path(last, len(text))

    def _meet(self, last: list[str]) -> int:
        """The boundary in which the paths of all boundaries that a later piece can reach meet; 0 if none."""
        alive = set(range(max(1, len(last) - self.longest), len(last)))
        while len(alive) > 1:
            most = max(alive)
            alive.remove(most)
            alive.add(most - len(last[most]))
        return alive.pop()

    def _extend(self, stretch: str, last: list[str], codes: list[int]) -> tuple[list[str], list[int]]:
        """Adds the backpointers (last pieces and their codes) of the boundaries that ``last`` does not have yet."""
        get, find, reach = self.ids.get, self.pairs.get, self.reach.get
        for end in range(len(last), len(stretch) + 1):
            start = end - reach(stretch[end - 3 : end], 2) if end > 2 else 0
            start = start if start > 0 else 0
            while True:
                piece = stretch[start:end]
                at = get(piece)
                if at is None and start == end - 1:
                    at = self.code(piece)
                if at is not None:
                    key = codes[start] << 24 | at if start else -1 - at
                    known = find(key)
                    if self.judged(key, last[start], piece) if known is None else known:
                        last.append(piece)
                        codes.append(at)
                        break
                start += 1
        return last, codes

    def pack_short(self, stretch: str) -> bytes:
        """``pack`` for a stretch no longer than the longest piece, the window: the same backpointers, kept to its end.

        The backpointers of a head are the same whatever follows it, so they are remembered for heads.
        """
        if not self.bpe:
            return self.pack(stretch)
        size = len(stretch)
        if size <= HEAD:
            last, codes = self._extend(stretch, [""], [-1])
        else:
            head = stretch[:HEAD]
            state = self.heads.get(head)
            if state is None:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                state = self.heads[head] = self._extend(head, [""], [-1])
            last, codes = self._extend(stretch, state[0][:], state[1][:])
        path = []
        while size:
            path.append(size)
            size -= len(last[size])
        limit, out = len(self.pieces), array("i")
        for end in reversed(path):
            if codes[end] < limit:
                out.append(codes[end])
            else:
                out.extend(self.ids_of(last[end]))
        return out.tobytes()

    def ids_of(self, piece: str) -> list[int]:
        at = self.ids.get(piece)
        if at is not None:
            return [at]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def pack(self, stretch: str) -> bytes:
        out = array("i")
        chunks = (stretch[i : i + 4096] for i in range(0, len(stretch), 4096))
        for piece in self.stream(chunks):
            out.extend(self.ids_of(piece))
        return out.tobytes()

    # -- texts -----------------------------------------------------------------------

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if self.crosses:
            return self.pack((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))
        out: list[bytes] = []
        marked = self.dummy_prefix
        for at, line in enumerate(text.split("\n") if self.breaks else [text]):
            if at:
                out.append(self.bare["\n"])
                marked = False
            words = line.split(" ")
            if "" not in words:
                out.append((self.memo if marked else self.bare)[words[0]])
                out.extend(map(self.memo.__getitem__, words[1:]))
                continue
            line = (MARK if marked else "") + line.replace(" ", MARK)
            for stretch in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line):
                out.append(self.memo[stretch[1:]] if stretch[0] == MARK else self.bare[stretch])
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; byte pieces are joined to characters, control pieces give nothing."""
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


_models: dict[bytes, Model] = {}


def _model_of(data: bytes) -> Model:
    """One model (and memo) a worker process, whatever tasks it runs."""
    if data not in _models:
        _models[data] = Model(data)
    return _models[data]


def _path(last: list[str], end: int) -> list[str]:
    out = []
    while end > 0:
        out.append(last[end])
        end -= len(last[end])
    return out[::-1]


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_ids, ids, round_trip). ``round_trip``: decoding gives the text back."""
    model = Model.load(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                packed, same = [], []
                for text in texts(batch.column(1)):
                    part = None if text is None else model.encode_packed(text)
                    packed.append(part)
                    same.append(None if part is None else model.decode(np.frombuffer(part, np.int32).tolist()) == text)
                sizes = np.array([0 if x is None else len(x) // 4 for x in packed], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                gone = pa.array([x is None for x in packed], pa.bool_())
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in packed), np.int32)), mask=gone
                )
                count = pa.array(sizes.astype(np.int64), mask=np.array([x is None for x in packed], bool))
                yield pa.RecordBatch.from_arrays([batch.column(0), count, ids, pa.array(same, pa.bool_())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: (doc_id, text). A null list gives a null text; null ids and ids beyond the vocabulary stand for no piece."""
    model = Model.load(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                back = [None if x is None else model.decode([i for i in x if i is not None and 0 <= i < len(model.pieces)]) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], schema=schema)

    chosen = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")
