"""Token counts per document with a whole-token shortcut.

The normalised text of a piece model has a blank mark in place of every blank and one at its
start. Where no piece holds a mark after another character, no merge crosses such a place, and
the text falls apart into pre-tokens that are encoded independently: marks followed by other
characters. `whole_tokens` proves once, outside any task, which vocabulary strings of that shape
encode alone as exactly one token. In a text, pre-tokens among those count one; only the rest is
merged, each distinct one once per task while it is remembered.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.llm.tables import map_batches, read

MARK = "▁"
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*")
REMEMBERED = 400_000  # pre-tokens kept per task besides the vocabulary
LONGEST = 64  # longer pre-tokens are not remembered


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str | None = None) -> bytes:
    """The bytes of a piece model; the tasks get them with their code, not the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def pre_token_ids(processor, pre_token: str) -> list[int]:
    """Encode one pre-token; the library puts its first mark back.

    A single mark cannot be passed that way: it is one character, so one piece or its bytes.
    """
    if pre_token != MARK:
        return processor.encode(pre_token[1:])
    piece = processor.piece_to_id(MARK)
    if piece != processor.unk_id():
        return [piece]
    return [processor.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]


def splits_at_marks(processor) -> bool:
    """Whether no piece crosses the start of a pre-token, and texts are not changed otherwise."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = " a  b "
    return not any(_CROSSING.search(p) for p in pieces) and (
        processor.decode(processor.encode(probe)) == probe and len(processor.encode(" ")) == len(processor.encode(MARK))
    )


def whole_tokens(processor) -> frozenset[str]:
    """Vocabulary strings shaped like a pre-token that encode alone as their own single token."""
    n = processor.get_piece_size()
    shaped = [(i, p) for i in range(n) if _PRE_TOKEN.fullmatch(p := processor.id_to_piece(i))]
    return frozenset(p for i, p in shaped if pre_token_ids(processor, p) == [i])


class TokenCounter:
    """Counts tokens of texts; keeps the counts of pre-tokens it has merged."""

    def __init__(self, model: bytes, whole: frozenset[str] | None):
        self.processor = load(model)
        # Keyed by pre-token without its first mark; without a proof, texts are merged whole.
        self.whole = None if whole is None else {p[1:]: 1 for p in whole}
        self.merged: dict[str, int] = {}

    def _merge(self, rest: str) -> int:
        n = len(pre_token_ids(self.processor, MARK + rest))
        if len(rest) <= LONGEST:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            self.merged[rest] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole is None:
            return len(self.processor.encode(text))
        if MARK in text or "  " in text or text[-1] == " " or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            words = [p[1:] for p in _PRE_TOKEN.findall(marked)]
        else:
            words = text.split(" ")
        whole, merged, total = self.whole.get, self.merged.get, 0
        for w in words:
            total += whole(w) or merged(w) or self._merge(w)
        return total


def count_tokens(
    docs: DataFrame, limit: int = 4096, text: str = "text", doc_id: str = "doc_id", model_path: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal those of the library without begin or end tokens. Null and empty texts count 0.
    Rows with a null or repeated doc_id are counted like others; other columns are ignored.
    Tasks keep the vocabulary and a bounded number of pre-tokens; nothing is exchanged.
    """
    model = read_model(model_path)
    processor = load(model)
    whole = whole_tokens(processor) if splits_at_marks(processor) else None

    def make():
        counter = TokenCounter(model, whole)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), size.alias("n_bytes"))
    counted = map_batches(given, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, folder: str) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"))
