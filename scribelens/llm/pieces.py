"""SentencePiece encoding by suffix-array matching, and decoding.

The pre-tokens of a batch that are new to the worker are joined into one text. Its suffixes are
sorted by as many characters as the longest piece has, and every piece of the vocabulary is
looked up by binary search: the suffixes that start with it are one range, its occurrences. Each
occurrence is an edge from its first to its last character. Edges are sorted by where they end
and relaxed in that order.

The vocabulary is a byte-pair one, where the path is not that of least cost but that of the
merges. That path is found by the same relaxation: every prefix of a pre-token has one encoding,
and an edge reaches its end exactly if its piece may follow the last piece of the encoding at its
start, which is so if encoding both pieces together gives both back. Whether two pieces may
follow each other depends on them only and is remembered. Characters without a piece are edges
of their own, later replaced by their bytes.
"""

from __future__ import annotations

import re
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.llm.tables import map_batches, read
from scribelens.llm.token_counts import MARK, load, read_model, splits_at_marks

REMEMBERED = 400_000  # pre-tokens a worker keeps
AT_ONCE = 30_000  # new pre-tokens whose text is indexed at once
LONGEST = 64  # longer ones are not kept
PUNCTUATION = ",.;:!?\"'-|*#%&$()"
_LETTER = re.compile(r"[^\W\d_]")
FEW = 48  # edges that are relaxed one by one


class Vocabulary:
    """Pieces of a model, their merge order and which of them may follow each other."""

    def __init__(self, model: bytes):
        p = load(model)
        n = self.size = p.get_piece_size()
        self.unknown = n  # stands for a character without a piece
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.text = {i: p.id_to_piece(i) for i in normal}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: p.get_score(i) for t, i in self.id.items()}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = p.unk_id()
        self.has_bytes = self.unk not in self.bytes
        self.marked = splits_at_marks(p)
        self.longest = max(map(len, self.id))
        self.spines: dict[tuple[str, int], list[str]] = {}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.asked, self.answers = np.array([np.iinfo(np.int64).min]), np.array([False])
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Merge characters, best score first, then leftmost; also the merges in their order."""
        symbols, done = list(text), []
        while True:
            best = max(
                ((s, -i) for i in range(len(symbols) - 1) if (s := self.score.get(symbols[i] + symbols[i + 1])) is not None),
                default=None,
            )
            if best is None:
                return symbols, done
            at = -best[1]
            done.append((symbols[at], symbols[at + 1]))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _spine(self, piece: str, side: int) -> list[str]:
        """The symbols that stand at the left (0) or right (1) end while a piece is merged."""
        if (found := self.spines.get((piece, side))) is None:
            ends = lambda t: piece.endswith(t) if side else piece.startswith(t)
            found = list({piece, piece[-1] if side else piece[0]} | {a + b for a, b in self.merge(piece)[1] if ends(a + b)})
            self.spines[piece, side] = found
        return found

    def alone(self, i: int) -> bool:
        """Whether a piece encodes as itself."""
        if i == self.unknown:
            return True
        if (found := self.whole.get(i)) is None:
            found = self.whole[i] = self.merge(self.text[i])[0] == [self.text[i]]
        return found

    def may_follow(self, pair: int) -> bool:
        """``pair`` is the first piece times (size + 1) plus the second."""
        if (found := self.follows.get(pair)) is None:
            a, b = divmod(pair, self.size + 1)
            if self.unknown in (a, b):
                found = self.alone(a) and self.alone(b)
            elif not (self.alone(a) and self.alone(b)):
                found = False
            else:
                left, right = self.text[a], self.text[b]
                # Only symbols at the seam can merge across it.
                touch = any(x + y in self.score for x in self._spine(left, 1) for y in self._spine(right, 0))
                found = not touch or self.merge(left + right)[0] == [left, right]
            self.follows[pair] = found
        return found


    def allowed(self, pairs: np.ndarray) -> np.ndarray:
        """`may_follow` of many pairs; -1 minus a piece asks whether it encodes as itself.

        Answers are kept in sorted order besides; those still missing there are few.
        """
        kinds, which = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.asked, kinds), len(self.asked) - 1)
        answer = self.answers[at]
        missing = np.flatnonzero(self.asked[at] != kinds)
        if len(missing):
            found = [self.alone(-1 - k) if k < 0 else self.may_follow(k) for k in kinds[missing].tolist()]
            answer[missing] = found
            self.fresh.append((kinds[missing], np.array(found, bool)))
            if sum(len(f[0]) for f in self.fresh) > max(2000, len(self.asked) // 8):
                asked = np.concatenate([self.asked, *(f[0] for f in self.fresh)])
                answers = np.concatenate([self.answers, *(f[1] for f in self.fresh)])
                self.asked, first = np.unique(asked, return_index=True)
                self.answers, self.fresh = answers[first], []
        return answer[which]


class SuffixArray:
    """Suffixes of a text of small integers, sorted by their first ``depth`` entries."""

    def __init__(self, codes: np.ndarray, depth: int):
        bits = 8 if codes.max(initial=0) < 255 else 16
        self.bits, per = bits, 64 // bits
        self.n = len(codes)
        padded = np.concatenate([codes, np.zeros(depth + per, codes.dtype)]).astype(np.uint64)
        packed = np.zeros(self.n + depth, np.uint64)
        for i in range(per):
            packed = (packed << np.uint64(bits)) | padded[i : i + len(packed)]
        words = [packed[at : at + self.n] for at in range(0, depth, per)]
        self.order = np.lexsort(words[::-1]).astype(np.int32)
        self.words = [w[self.order] for w in words]

    def _keys(self, rows: np.ndarray, fill: int) -> list[np.ndarray]:
        per = 64 // self.bits
        out = []
        for at in range(0, len(self.words) * per, per):
            word = np.zeros(len(rows), np.uint64)
            for i in range(at, at + per):
                column = rows[:, i] if i < rows.shape[1] else np.full(len(rows), -1)
                word = (word << np.uint64(self.bits)) | np.where(column < 0, fill, column).astype(np.uint64)
            out.append(word)
        return out

    def _search(self, keys: list[np.ndarray], after: bool) -> np.ndarray:
        """Number of suffixes before (or up to and with) each key."""
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), self.n)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, self.n - 1)
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for word, key in zip(self.words, keys):
                here = word[mid]
                less |= equal & (here < key)
                equal &= here == key
            right = (less | equal if after else less) & (low < high)
            low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
        return low

    def ranges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) place in ``order`` of each row's occurrences; -1 pads rows."""
        return self._search(self._keys(rows, 0), False), self._search(self._keys(rows, (1 << self.bits) - 1), True)


class _Memory(dict):
    """Entries in two generations: when the younger is full the older is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most // 2, {}

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.older[word]
        return found

    def missing(self, words: set[str]) -> set[str]:
        """Those in neither generation."""
        return words.difference(self).difference(self.older)

    def make_room(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.memory = _Memory(REMEMBERED)
        self.pieces = sorted(self.v.id)
        self.ids = np.array([self.v.id[p] for p in self.pieces], np.int32)
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)
        points = np.full((len(self.pieces), self.v.longest), -1, np.int32)
        for i, p in enumerate(self.pieces):
            points[i, : len(p)] = [ord(c) for c in p]
        self.points = points
        self.alphabet = np.unique(points[points >= 0])
        # A character that no piece holds is never merged, so the line break may end a pre-token.
        breaks = "" if any("\n" in t for t in self.pieces) else "\n"
        self.part = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+|{breaks or MARK}")

        # Neither is a mark of punctuation merged with a letter before it, unless a piece does so.
        joined = {b for p in self.pieces for a, b in zip(p, p[1:]) if _LETTER.match(a)}
        free = "".join(re.escape(c) for c in PUNCTUATION if c not in joined)
        self.seam = re.compile(f"(?<={_LETTER.pattern})(?=[{free}])") if free else None

    def _parts(self, word: str) -> list[str]:
        return self.seam.split(word) if self.seam else [word]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.part.findall(marked) if self.v.marked else [marked]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        self.memory.make_room()
        parts = [self.split(t) for t in texts]
        new = {w: self._parts(w) for w in self.memory.missing(set().union(*parts))}
        unknown = list(self.memory.missing(set().union(*new.values())))
        for at in range(0, len(unknown), AT_ONCE):
            some = unknown[at : at + AT_ONCE]
            self.memory.update(zip(some, self._encode_words(some)))
        get = self.memory.__getitem__
        self.memory.update([(w, b"".join(map(get, xs))) for w, xs in new.items() if len(xs) > 1])
        packed = [b"".join(map(get, p)) for p in parts]
        for w in [w for w in (*unknown, *new) if len(w) > LONGEST]:
            self.memory.pop(w, None)
        return packed

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character, last character (excluded) and piece of every occurrence."""
        points = np.frombuffer(text.encode("utf-32-le"), np.int32)
        # Characters that no piece holds match none: they share code 1, and 0 ends the text, so
        # the number of codes is bounded by the vocabulary.
        known = np.isin(points, self.alphabet)
        seen, found = np.unique(points[known], return_inverse=True)
        if not len(seen):
            return (np.zeros(0, np.int32),) * 3
        codes = np.ones(len(points), np.int64)
        codes[known] = found + 2
        at = np.minimum(np.searchsorted(seen, self.points), len(seen) - 1)
        rows = np.where(seen[at] == self.points, at + 2, 0)
        rows[self.points < 0] = -1
        usable = (rows != 0).all(axis=1)
        array = SuffixArray(codes, self.v.longest)
        first, last = array.ranges(rows[usable])
        n = last - first
        start = array.order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return start, start + np.repeat(self.sizes[usable], n), np.repeat(self.ids[usable], n)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        v = self.v
        text = "\0".join(words)  # no piece holds the separator, see `_single`
        lengths = np.array([len(w) for w in words])
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int32)
        start, end, piece = self._edges(text)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths + 1)[: len(text)]
        # Edges of characters without a piece.
        single = np.zeros(len(text), bool)
        single[start[end - start == 1]] = True
        lone = np.flatnonzero(~single).astype(np.int32)
        lone = lone[lone < (begin + lengths)[word_of[lone]]]
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), v.unknown, np.int32)])
        depth = end - begin[word_of[start]]
        # Sorting short integers takes linear time.
        by = np.argsort(depth.astype(np.uint16) if lengths.max() < 1 << 16 else depth, kind="stable")
        start, end, piece, depth = start[by], end[by], piece[by], depth[by]
        last = np.full(len(text) + 1, -1, np.int64)  # last piece of the encoding up to a place
        size = np.zeros(len(text) + 1, np.int64)
        at_start = np.zeros(len(text) + 1, bool)
        at_start[begin] = True
        cuts = np.searchsorted(depth, np.arange(1, lengths.max() + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo <= FEW:
                for s, e, p in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), piece[lo:hi].tolist()):
                    if v.alone(p) if at_start[s] else v.may_follow(int(last[s]) * (v.size + 1) + p):
                        last[e], size[e] = p, e - s
                continue
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            good = v.allowed(np.where(at_start[s], -1 - p, last[s] * (v.size + 1) + p))
            last[e[good]] = p[good]
            size[e[good]] = (e - s)[good]
        return self._trace(text, begin, begin + lengths, last, size)

    def _trace(self, text, begin, end, last, size) -> list[bytes]:
        """Follow the last pieces back from the end of each pre-token."""
        place, active, steps = end.copy(), np.flatnonzero(end > begin), []
        while len(active):
            steps.append((active, place[active]))
            place[active] = place[active] - size[place[active]]
            active = active[place[active] > begin[active]]
        if not steps:
            return [b""] * len(begin)
        word, at = (np.concatenate(c) for c in zip(*steps))
        by = np.lexsort((at, word))
        word, at = word[by], at[by]
        ids = last[at]
        bounds = np.searchsorted(word, np.arange(len(begin) + 1))
        raw = ids.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        for w in np.unique(word[ids == self.v.unknown]).tolist():
            part = slice(bounds[w], bounds[w + 1])
            out[w] = self._with_bytes(text, ids[part], at[part])
        return out

    def _with_bytes(self, text: str, ids: np.ndarray, at: np.ndarray) -> bytes:
        out: list[int] = []
        for i, e in zip(ids.tolist(), at.tolist()):
            if i != self.v.unknown:
                out.append(i)
            elif self.v.has_bytes:
                out += [self.v.bytes[b] for b in text[e - 1].encode()]
            elif not out or out[-1] != self.v.unk:
                out.append(self.v.unk)
        return np.array(out, "<i4").tobytes()


_WORKER: dict[bytes, tuple[Encoder, Decoder]] = {}


def of_worker(model: bytes) -> tuple[Encoder, Decoder]:
    """The encoder and decoder that all tasks of a Python worker share; only those of one model are kept."""
    name = blake2b(model).digest()
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Encoder(model), Decoder(model)
    return _WORKER[name]


class Decoder:
    """Texts of ids: the bytes of each piece, without the first blank."""

    def __init__(self, model: bytes):
        p = load(model)
        n = p.get_piece_size()
        shown = lambda i: b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(MARK, " ").encode()
        self.raw = [shown(i) for i in range(n)]
        for b in range(256):
            if (i := p.piece_to_id(f"<0x{b:02X}>")) != p.unk_id():
                self.raw[i] = bytes([b])

        self.column = pa.array(self.raw, pa.binary())

    @staticmethod
    def _text(raw: bytes) -> str:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join(map(self.raw.__getitem__, ids)))

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        """The text of each list; a null list is an empty text."""
        ids = ids.cast(pa.list_(pa.int32()))
        ids = pc.if_else(ids.is_null(), pa.scalar([], ids.type), ids) if ids.null_count else ids
        offsets = ids.offsets.to_numpy()
        pieces = self.column.take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces)
        joined = pc.binary_join(lists, pa.scalar(b"", pa.binary())).to_pylist()
        return [self._text(raw) for raw in joined]


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode_pieces(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_path: str | None = None, decoded: bool = False
) -> DataFrame:
    """doc_id and ids (array<int>), equal to the library's without begin and end ids.

    With ``decoded`` also decoded_sha256, that of the text the ids stand for. Null and empty texts
    have no ids. Rows are independent: repeated rows and null doc_ids are encoded like others, and
    other columns are ignored. Nothing is exchanged.
    """
    model = read_model(model_path)
    names = ["doc_id", "ids", "decoded_sha256"][: 2 + decoded]

    def make():
        encoder, decoder = of_worker(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), _lists(packed)]
            if decoded:
                columns.append(pa.array([sha256(t.encode()).hexdigest() for t in decoder.decode_all(columns[1])], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, make, "doc_id long, ids array<int>" + ", decoded_sha256 string" * decoded, rows=1000)


def decode_pieces(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids and text, the text that the ids stand for; null ids are an empty text."""
    model = read_model(model_path)

    def make():
        _, decoder = of_worker(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = decoder.decode_all(batch.column(1))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

        return step

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, text string", rows=500)


def op10_sentencepiece(spark, folder: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    encoded = encode_pieces(read(spark, folder, "documents"), decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256")
