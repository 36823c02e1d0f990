"""SentencePiece encoding and decoding through a table of distinct chunks.

The model marks blanks and joins no piece across a mark that follows another character, so a text is a
sequence of marked words (runs of marks, then a word) whose pieces are independent. Each distinct marked
word is segmented once and its ids are joined back by position. A worker keeps a bounded table; a word it
has dropped is segmented again, with the same result. ``table_is_exact`` checks once for each model that this
holds: for the whole vocabulary, and for PROBES that show what the model does to blanks and letters. Texts go to
a model that fails as they are, each as a whole.

Edge cases: a null or empty text has the end id alone and decodes to nothing; a text of one long word is
segmented whole; the mark itself (U+2581) in a text is a blank, as for the library; rows of a null or repeated
doc_id are encoded each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, utf8_texts

MARK = "▁"
#: Entries of a worker's table, and the longest chunk (bytes) that it keeps.
TABLE_ENTRIES, TABLE_CHUNK = 400_000, 64

#: Texts that tell models apart: blanks kept or not, prefixes, letters that are changed.
PROBES = ["a", " a", "a ", "a  b", "  ", "A b", "\n", "a\nb c\t d", "ﬁ ½ Å İ", "é e\u0301 漢字 😀", "▁x▁ y", "1 22 333", "it's a-b."]

_codecs: dict[str, Codec] = {}


class Codec:
    """A model with its table. ids() and decoded() equal the library's encode() and decode()."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark_id = self.model.piece_to_id(MARK)
        self.ids: dict[bytes, bytes] = {}
        self.changed: dict[bytes, bytes] = {}  # chunks that decode to something else
        self.exact = True
        self.exact = self.table_is_exact()

    def table_is_exact(self) -> bool:
        """No piece has a mark after another character, and probes are the same by chunks and as a whole."""
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(self.model.vocab_size())):
            return False
        texts = [t.encode() for t in PROBES]
        return self.encode(texts) == [self.whole(t) for t in texts]

    def whole(self, text: bytes) -> tuple[bytes, bytes]:
        ids = self.model.encode(text.decode("utf-8", "replace"))
        return " ".join(map(str, ids)).encode(), self.model.decode(ids).encode()

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """The marked words, each without its first mark."""
        if b"  " not in text and not text.startswith(b" "):
            return text.split(b" ")
        return [c[1:] for c in re.findall(rb" +[^ ]*", b" " + text)]

    def learn(self, chunks: list[bytes]) -> None:
        for lo in range(0, len(chunks), 20_000):
            part = chunks[lo : lo + 20_000]
            encoded = self.model.encode([c.decode("utf-8", "replace") for c in part], num_threads=1)
            encoded = [ids or [self.mark_id] for ids in encoded]
            for c, ids, text in zip(part, encoded, self.model.decode(encoded, num_threads=1)):
                self.ids[c] = " ".join(map(str, ids)).encode()
                if (text := text.encode()) != c:
                    self.changed[c] = text

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as decimal text, decoded text) of each text, without the end id."""
        if not self.exact:
            return [self.whole(t) for t in texts]
        texts = [t.replace(MARK.encode(), b" ") if b"\xe2\x96\x81" in t else t for t in texts]
        split = [self.chunks(t) if t else [] for t in texts]
        missing = [c for c in dict.fromkeys(c for w in split for c in w) if c not in self.ids]
        if len(self.ids) + len(missing) > TABLE_ENTRIES:
            self.ids.clear()
            self.changed.clear()
            missing = list(dict.fromkeys(c for w in split for c in w))
        self.learn(missing)
        out = []
        for text, own in zip(texts, split):
            if self.changed and not self.changed.keys().isdisjoint(own):
                text = b" ".join([self.changed.get(c, c) for c in own])
            out.append((b" ".join(map(self.ids.__getitem__, own)), text))
        for c in missing:
            if len(c) > TABLE_CHUNK:
                del self.ids[c]
                self.changed.pop(c, None)
        return out


def codec(path: str) -> Codec:
    hold("piece_codec", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns doc_id, ids (array, end id last) and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        end = c.model.eos_id()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                own = c.encode(list(utf8_texts(part.column(1))))
                ids = pa.array([[*map(int, i.split()), end] for i, _ in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([t.decode("utf-8", "replace") for _, t in own], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256 and decoded_sha256, made where the ids are, so that they don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        end = str(c.model.eos_id()).encode()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, ids_sha, text_sha = [], [], []
                for ids, text in c.encode(list(utf8_texts(part.column(1)))):
                    ids = ids + b" " + end if ids else end
                    n.append(ids.count(b" ") + 1)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
