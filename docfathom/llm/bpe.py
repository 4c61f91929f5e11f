"""Byte-level BPE that encodes every distinct word once.

Texts are packed to blocks. A block explodes its texts into pre-tokens (each match of
the pattern) and sends its distinct ones to a global shuffle by word. There each
word is encoded once, whatever the number of blocks that asked, and its ids go back
to those blocks. A block puts the ids in place of its pre-tokens, by position. Words
and ids travel in compressed lists, a row for each block and slice of the vocabulary,
not a row a word. Decoding looks each id up in the table of token bytes.

Null text is empty and has no ids. Rows are handled one by one, so ids may be null
or repeated. Ids without an entry in the table decode to nothing. A text longer than
a block ends the block it is in.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docfathom.llm.text import raw_texts

#: Planned bytes of text in a block, and for each slice of the vocabulary.
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 16 << 20
#: Words that a task remembers the ids of; with more it starts anew.
KNOWN_WORDS = 2_000_000
#: A space after which white space goes on, or the text ends: only elsewhere is a
#: single space sure to begin a pre-token.
IRREGULAR = re.compile(
    rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)"
)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@functools.cache
def _matches(pattern: str):
    import regex

    return regex.compile(pattern).findall


def parts(raw: bytes, pattern: str) -> tuple[list[bytes], list[bytes]]:
    """A text as pre-tokens at its start, then what follows each single space."""
    if IRREGULAR.search(raw):
        return [w.encode() for w in _matches(pattern)(raw.decode(errors="replace"))], []
    first, *rest = raw.split(b" ")
    return ([w.encode() for w in _matches(pattern)(first.decode(errors="replace"))] if first else []), rest


def spaced(rest: bytes, pattern: str) -> list[bytes]:
    """The pre-tokens of a space and what follows it."""
    if pattern == public_tokenizers.PATTERN:
        # What that pattern does with ASCII letters, and a point or comma after them.
        if rest.isalpha():
            return [b" " + rest]
        if rest[-1:] in b".," and rest[:-1].isalpha():
            return [b" " + rest[:-1], rest[-1:]]
    return [w.encode() for w in _matches(pattern)(" " + rest.decode(errors="replace"))]


def _squeeze(lengths: list[int], data: bytes) -> bytes:
    import zstandard

    head = np.array([len(lengths), *lengths], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=9).compress(head + data)


def _unsqueeze(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Where each item ends, and the items one after another."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data[:4], "<u4")[0])
    return np.cumsum(np.frombuffer(data[4 : 4 + 4 * n], "<u4"), dtype=np.int64), data[4 + 4 * n :]


def _items(packed: bytes) -> list[bytes]:
    ends, data = _unsqueeze(packed)
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _as_block(doc_ids: list, raws: list[bytes]) -> bytes:
    """Documents of a block, compressed."""
    rows = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(raws, pa.binary())})
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _of_block(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _pack_blocks(batches):
    doc_ids, raws, size = [], [], 0
    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
            doc_ids.append(doc_id)
            raws.append(raw)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield pa.RecordBatch.from_pydict({"docs": pa.array([_as_block(doc_ids, raws)], pa.binary())})
                doc_ids, raws, size = [], [], 0
    if raws:
        yield pa.RecordBatch.from_pydict({"docs": pa.array([_as_block(doc_ids, raws)], pa.binary())})


class BlockWords:
    """The distinct pre-tokens of a block in the order they come up, by slice."""

    def __init__(self, pattern: str, n_slices: int):
        self.pattern, self.n_slices = pattern, n_slices
        self.seen: set[bytes] = set()
        self.slices: dict[int, list[bytes]] = {}

    def add(self, words: list[bytes]) -> None:
        for word in words:
            if word not in self.seen:
                self.seen.add(word)
                self.slices.setdefault(zlib.crc32(word) % self.n_slices, []).append(word)

    def read(self, raws: list[bytes]) -> None:
        block = self

        class Rests(dict):
            def __missing__(self, rest):
                self[rest] = None
                block.add(spaced(rest, block.pattern))

        look = Rests().__getitem__
        for raw in raws:
            first, rest = parts(raw, self.pattern)
            self.add(first)
            deque(map(look, rest), maxlen=0)


class BlockIds(dict):
    """Ids of a block's pre-tokens, dealt out in the order they come up."""

    def __init__(self, n_slices: int, slices: dict[int, list[bytes]]):
        self.n_slices, self.slices = n_slices, {at: iter(ids) for at, ids in slices.items()}
        self.sums: dict[int, int] = {}

    def __missing__(self, word: bytes) -> bytes:
        at = zlib.crc32(word) % self.n_slices
        self.sums[at] = zlib.crc32(word, self.sums.get(at, 0))
        ids = self[word] = next(self.slices.get(at, iter(())), b"")
        return ids


class OwnIds(dict):
    """Ids of pre-tokens by encoding them here."""

    def __init__(self, encode_word):
        self.encode_word = encode_word

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.encode_word(word.decode()), "<u4").tobytes()
        return ids


def _put_together(raws: list[bytes], pattern: str, known: dict) -> list[bytes]:
    """The ids of each text, in place of its pre-tokens."""

    class Rests(dict):
        def __missing__(self, rest):
            found = self[rest] = b"".join([known[w] for w in spaced(rest, pattern)])
            return found

    look, out = Rests().__getitem__, []
    for raw in raws:
        first, rest = parts(raw, pattern)
        out.append(b"".join([*[known[w] for w in first], *map(look, rest)]))
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens.

    Documents are packed to blocks where they are read, once to list their words and
    once to be shuffled to the ids of those. Should a repeated read deal documents to
    blocks in another way, the check sums of the lists differ, and the block encodes
    its words itself.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, n_slices = (max(1, -(-size // each)) for each in (BLOCK_BYTES, SLICE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = rows.mapInArrow(_pack_blocks, "docs binary").withColumn("block", F.monotonically_increasing_id())

    def distinct_words(batches):
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist()):
                words = BlockWords(pattern, n_slices)
                words.read(_of_block(docs)["text"].to_pylist())
                for at, own in words.slices.items():
                    packed = _squeeze([len(w) for w in own], b"".join(own))
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([block], pa.int64()), "slice": pa.array([at], pa.int64()), "words": [packed]}
                    )

    def ids_of_words(batches):
        encode_word, known = _encoder(ranks_path, pattern), {}
        for batch in batches:
            sums, out = [], []
            for packed in batch.column("words").to_pylist():
                if len(known) > KNOWN_WORDS:
                    known.clear()
                words, found = _items(packed), []
                for word in words:
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode_word(word.decode()), "<u4").tobytes()
                    found.append(ids)
                sums.append(zlib.crc32(b"".join(words)))
                out.append(_squeeze([len(i) for i in found], b"".join(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("slice"), pa.array(sums, pa.int64()), pa.array(out, pa.binary())],
                ["block", "slice", "sum", "ids"],
            )

    words = blocks.mapInArrow(distinct_words, "block long, slice long, words binary")
    coded = words.repartition(n_slices, "slice").mapInArrow(ids_of_words, "block long, slice long, sum long, ids binary")

    def reassemble(packed: pa.Table, coded: pa.Table) -> pa.Table:
        docs = pa.concat_tables([_of_block(b) for b in packed["docs"].to_pylist()])
        raws = docs["text"].to_pylist()
        names = ("slice", "sum", "ids")
        sums, ids = {}, {}
        for at, check, own in zip(*(coded[c].to_pylist() for c in names)):
            sums[at], ids[at] = check, _items(own)
        known = BlockIds(n_slices, ids)
        data = _put_together(raws, pattern, known)
        if known.sums != sums:
            data = _put_together(raws, pattern, OwnIds(_encoder(ranks_path, pattern)))
        ends = np.cumsum([0, *(len(d) // 4 for d in data)])
        flat = pa.array(np.frombuffer(b"".join(data), "<i4"))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.table({"doc_id": docs["doc_id"], "ids": ids})

    together = blocks.repartition(n, "block").groupBy("block").cogroup(coded.repartition(n, "block").groupBy("block"))
    return together.applyInArrow(reassemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids``.

    The table of token bytes has an entry for each id of the vocabulary, so it goes
    along to every task.
    """

    def run(batches):
        table = ranks(ranks_path)
        tokens: list[bytes] = [b""] * (max(table.values()) + 2)
        for token, rank in table.items():
            tokens[rank] = token
        by_id = pa.array(tokens, pa.binary())
        last = len(tokens) - 1  # of no token
        for batch in batches:
            ids = batch.column("ids")
            at = ids.flatten().fill_null(last).to_numpy(zero_copy_only=False)
            at = np.where((at < 0) | (at > last), last, at)
            flat = by_id.take(pa.array(at))
            width = pc.binary_length(flat).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].astype("<i4")
            data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
            decoded = pa.Array.from_buffers(
                pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
