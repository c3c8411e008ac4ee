"""Byte-level BPE by a distinct-word table.

Spark splits each text into pre-tokens ("words"), a worker keeps a table with one row for each distinct word it meets, encodes that
word once, and joins the ids back by position. Decoding joins ids to the pieces of the vocabulary. The table is a worker's own:
no word ever crosses the network, so nothing is shuffled and no frequent word can overload a task.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows give repeated results; an empty table
gives an empty table; columns besides the id and the text are left out; a text with the special token's string yields its id.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyloom.llm import common

# The pre-token pattern of the byte-level vocabulary, white space as Unicode has it.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Texts that are worked at once, and distinct words after which a worker's table begins anew (some 200 bytes each).
TEXTS_AT_ONCE, MOST_WORDS = 250, 250_000


def piece_bytes(vocabulary: dict[str, int], added: dict[str, int]) -> list[bytes]:
    """The bytes of every id. Byte-level vocabularies write a byte as a printable character: bytes that print stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in plain}
    chars |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    for piece, i in added.items():
        out[i] = piece.encode()
    return out


class Codec:
    """Encodes and decodes batches of split texts."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        pieces = piece_bytes(read["model"]["vocab"], added)
        self.pieces = pa.array(pieces, pa.large_binary())
        self.decimal = pa.array([str(i) for i in range(len(pieces))], pa.large_string())
        self.forget()

    def forget(self) -> None:
        """The distinct-word table: word to row, and of each row the first id, their number, and all ids."""
        self.known: dict[str, int] = {}
        self.first, self.count, self.table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of distinct words in the table, and its columns; words that it lacks are encoded and added."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in new]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate([self.first, len(self.table) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.table = np.concatenate([self.table, np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words)), self.first, self.count, self.table

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a list column of words, and for each row where its ids start (one more than rows)."""
        flat = words.flatten()
        coded = flat.dictionary_encode()
        place, first, count, table = self.rows_of(coded.dictionary.to_pylist())
        code = place[coded.indices.to_numpy()]
        n = count[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(first[code], n)
        starts = np.concatenate([[0], ends])
        rows = np.asarray(words.offsets) - np.asarray(words.offsets)[0]
        return table[at], starts[rows]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """The decoded bytes of each row, ids joined to their pieces."""
        pieces = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), self.pieces.take(pa.array(ids)))
        return pc.binary_join(pieces, pa.scalar(b"", pa.large_binary())).to_pylist()

    def written(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """The ids of each row in decimal, with commas."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), self.decimal.take(pa.array(ids))), pa.scalar(",", pa.large_string())).to_pylist()


def split_words(text: F.Column, special: list[str]) -> F.Column:
    """The pre-tokens of a text in order, the strings of special tokens whole."""
    words = lambda s: F.regexp_extract_all(s, F.lit(PATTERN), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not special:
        return words(text)
    if len(special) == 1:
        parts = F.transform(F.split(text, "\\Q" + special[0] + "\\E", -1), lambda s, i: F.when(i == 0, words(s)).otherwise(F.concat(F.array(F.lit(special[0])), words(s))))
        return F.when(text.contains(special[0]), F.flatten(parts)).otherwise(words(text))
    raise ValueError("at most one special token")


def read_spec(path: str) -> tuple[str, list[str]]:
    """The tokenizer's file, read on the driver, and the strings of its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spec, [x["content"] for x in json.loads(spec).get("added_tokens", [])]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """id, ids (array of ints) and decoded text (each only if asked for), n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    spec, special = read_spec(path)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kinds = {"id": None, "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
        pa.set_memory_pool(pa.system_memory_pool())
        codec = Codec(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [part(batch.slice(a, TEXTS_AT_ONCE)) for a in range(0, batch.num_rows, TEXTS_AT_ONCE)]
            return pa.Table.from_batches(made).combine_chunks().to_batches()[0] if len(made) > 1 else made[0] if made else part(batch)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = common.column(batch, "words")
            if len(words) == 0:
                flat, rows = np.zeros(0, np.int32), np.zeros(1, np.int64)
            else:
                flat, rows = codec.encode(words)
            back = codec.decode(flat, rows)
            out = {
                "n_tokens": pa.array(np.diff(rows), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256((x or "").encode()).hexdigest() for x in codec.written(flat, rows)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(whole(x)).hexdigest() for x in back], pa.string()),
            }
            if ids:
                out["ids"] = common.lists(flat, rows, pa.int32())
            if decoded:
                out["decoded"] = pa.array([whole(x).decode() for x in back], pa.string())
            first = common.column(batch, "id")
            return pa.RecordBatch.from_arrays([first, *out.values()], schema=pa.schema([pa.field("id", first.type), *(pa.field(c, kinds[c]) for c in out)]))

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    words = docs.select(F.col(id_col).alias("id"), split_words(F.col(text_col), special).alias("words"))
    return common.map_arrow(words, make, schema, by=None).withColumnRenamed("id", id_col)


def whole(x: bytes | None) -> bytes:
    """As the library decodes: bytes that aren't UTF-8 become U+FFFD."""
    return (x or b"").decode("utf-8", "replace").encode()
