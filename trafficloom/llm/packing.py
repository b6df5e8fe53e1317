"""Mixture-controlled packing: deficit round-robin over one queue of documents per source.

In each round every source is granted tokens in proportion to its target share, one window's worth in all, and sends the
packets its credit covers; what is left over stays as its deficit. A source's credit after r rounds is r times its grant, so a
packet that ends at token e of its queue leaves in round ceil(e / grant): deficits are carried across windows and partitions
by running totals alone, with no sequential loop. Rounds, laid end to end, are cut into windows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import arrow_schema, emitted, rows_of, utf8
from trafficloom.plans.lookup import lookup
from trafficloom.plans.ordered import running_totals
from trafficloom.plans.pinning import pin, scratch_path

if TYPE_CHECKING:
    from tokenizers import Tokenizer

WINDOW = 2048
PACKET = 512
END_ID = 1
TOGETHER = 64
SLICE = 4 << 20
# A word of Latin letters and the ASCII marks that end it: the vocabulary's split parts them, and composition leaves both as they are.
_STEM = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-/:-@\[-`{-~]*)$"
_TOKENS = "doc_id long, source string, doc_tokens long, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


def _laid(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The pool's stretches of `units`, laid end to end."""
    lengths = sizes[units]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[units] - (ends - lengths), lengths)
    at += np.arange(total)
    return pool[at]


class Words:
    """Ids of a vocabulary that never joins what a space separates.

    Texts are cut at spaces, and each distinct item of a slice of texts is encoded once. Of an item that is a word of Latin letters
    with ASCII marks behind it, the lower-cased word and the marks are asked for, which many items share; words go
    through the library's model and byte level alone, as nothing is left to normalise or split. Other items go through the whole
    library, some at a time with a special token between them that none contains, and are told apart by its id.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.library, self.bare):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.mark_id, self.mark = min((i, t.content) for i, t in self.library.get_added_tokens_decoder().items())

    def _together(self, library: Tokenizer, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of items without the mark, end to end, and their number per item."""
        cuts = pa.array([*range(0, len(items), TOGETHER), len(items)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, items), self.mark).to_pylist()
        found = library.encode_batch_fast(joined, add_special_tokens=False)
        # a mark behind every group too, so that each item ends at one
        groups = [np.array([*e.ids, self.mark_id], dtype=self.kind) for e in found]
        ids = np.concatenate([np.empty(0, dtype=self.kind), *groups])
        marks = ids == self.mark_id
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _alone(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(items, add_special_tokens=False)]
        ids = [np.empty(0, dtype=self.kind), *[np.array(f, dtype=self.kind) for f in found]]
        return np.concatenate(ids), np.array([len(f) for f in found], dtype=np.int64)

    def _items(self, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct items, end to end, and their number per item."""
        parts = pc.extract_regex(items, _STEM)
        word = parts.is_valid().to_numpy(zero_copy_only=False)
        marked = pc.match_substring(items, self.mark).to_numpy(zero_copy_only=False) & ~word
        other = ~word & ~marked
        parts = parts.filter(pa.array(word))
        stems = pc.utf8_lower(pc.struct_field(parts, "stem")).dictionary_encode()
        rests = pc.struct_field(parts, "rest").dictionary_encode()
        known = [
            self._together(self.bare, stems.dictionary),
            self._together(self.library, rests.dictionary),
            self._together(self.library, items.filter(pa.array(other))),
            self._alone(items.filter(pa.array(marked)).to_pylist()),
            (np.empty(0, dtype=self.kind), np.zeros(1, dtype=np.int64)),
        ]
        pool, sizes = (np.concatenate(x) for x in zip(*known, strict=True))
        first = np.cumsum([0, *[len(k[1]) for k in known]])
        # an item is a stem and its marks, or itself and nothing
        units = np.full((len(items), 2), first[4], dtype=np.int64)
        units[word, 0] = stems.indices.to_numpy()
        units[word, 1] = first[1] + rests.indices.to_numpy()
        units[other, 0] = first[2] + np.arange(other.sum())
        units[marked, 0] = first[3] + np.arange(marked.sum())
        return _laid(pool, np.cumsum(sizes) - sizes, sizes, units.ravel()), sizes[units].sum(axis=1)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END_ID behind it, end to end, and their number per text. No text is null."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        items = cut.flatten().dictionary_encode()
        pool, sizes = self._items(items.dictionary)
        pool, sizes = np.append(pool, np.array([END_ID], dtype=self.kind)), np.append(sizes, 1)
        last = np.cumsum(np.diff(cut.offsets.to_numpy()) + 1) - 1
        units = np.full(len(items) + len(texts), len(sizes) - 1, dtype=np.int64)
        inside = np.ones(len(units), dtype=bool)
        inside[last] = False
        units[inside] = items.indices.to_numpy()
        upto = np.cumsum(sizes[units])[last]
        return _laid(pool, np.cumsum(sizes) - sizes, sizes, units), np.diff(upto, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with END_ID behind them."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@cache
def vocabulary(path: str) -> Words:
    return Words(path)


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE bytes of texts, at least a row each."""
    part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // SLICE
    cuts = np.append(0, np.flatnonzero(np.diff(part)) + 1).tolist()
    for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(i, j - i)


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = vocabulary(path), arrow_schema(_TOKENS)
        for batch in batches:
            for part in _by_bytes(batch) if batch.num_rows else ():
                ids, sizes = known.encode_all(part.column("text").cast(pa.string()))
                offsets = np.append(0, np.cumsum(sizes * ids.itemsize)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                columns = [part.column("doc_id"), part.column("source"), pa.array(sizes, pa.int64()), blobs]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source, utf8(text_col))
    return rows.mapInArrow(run, _TOKENS)


def _shares(sources: DataFrame, targets: Mapping[str, float] | None) -> DataFrame:
    """Tokens granted per round and token of window; the corpus's own mixture without targets. Sources that have no target
    come after the others."""
    if targets is None:
        return sources.withColumn("weight", F.col("tokens").cast("double"))
    listed = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return sources.withColumn("weight", F.coalesce(listed[F.col("source")].cast("double"), F.lit(0.0)))


def _cuts(window: int, total: int) -> tuple[int, list[int]]:
    """End of the full windows, and the starts of the sequences after them: the rest is cut at powers of two, which need
    no padding."""
    full = total // window * window
    starts, at = [], full
    for bit in reversed(range(window.bit_length())):
        if (total - full) >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return full, starts


def _pieces(first: Column, length: Column, window: int, full: int, tail: list[int]) -> Column:
    """Absolute starts of the parts of one packet."""
    end = first + length
    multiples = F.transform(
        F.filter(F.sequence(F.expr(f"first div {window}"), F.expr(f"(first + length - 1) div {window}")), lambda w: w * window > first),
        lambda w: w * window,
    )
    inside = F.filter(multiples, lambda x: x <= full)
    rest = F.filter(F.array(*[F.lit(t).cast("long") for t in tail]), lambda x: (x > first) & (x < end)) if tail else None
    parts = [F.array(first), inside, *([rest] if rest is not None else [])]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _checked(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            columns = ("doc_id", "source", "doc_tokens", "ids", "pieces")
            for doc_id, source, doc_tokens, blob, pieces in rows_of(batches, *columns):
                ids = np.frombuffer(blob, dtype=kind).astype("<u4")
                for p in pieces:
                    start, length = p["start"], p["length"]
                    crc = zlib.crc32(ids[start : start + length])
                    yield doc_id, start, length, crc, doc_tokens, p["sequence_id"], p["offset"], source

        return emitted(_PIECES, rows())

    return run


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    packet: int = PACKET,
    targets: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): all tokens of all documents in sequences.

    Each document's ids end with END_ID. All sequences but the last few hold `window` tokens; the rest is split into sequences
    whose lengths are powers of two. Documents enter as packets of at most `packet` tokens, so after any number of windows a
    source is within one packet of its target while its queue lasts (`targets` by source; by default the corpus's own mixture,
    in which all queues last to the end). Nothing is dropped: sources without target come last.

    Null text is empty (its one token is END_ID), null source is the source "", null and repeated ids are packed row by row,
    an empty table gives an empty result. Queues go by doc_id, nulls first.
    """
    if packet > window or window & (window - 1):
        raise ValueError("the window must be a power of two and a packet no longer than it")
    spark = docs.sparkSession
    stored = scratch_path(spark, "packing-tokens")
    found = tokenized(docs, path, id_col, text_col, source_col).withColumn("row_id", F.monotonically_increasing_id())
    found.write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema(found.schema).parquet(stored)

    rows = tokens.select("row_id", "doc_id", "source", "doc_tokens")
    n_rows = rows.count()
    order = [F.col("doc_id"), F.col("row_id")]
    queued = running_totals(rows, ["source"], order, {"upto": F.col("doc_tokens")}, n_rows)
    counted = rows.groupBy("source").agg(F.sum("doc_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sources = pin(counted, n_rows)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    weighted = pin(_shares(sources, targets).drop("tokens"), n_rows)
    all_weight = weighted.agg(F.sum("weight")).first()[0] or 1.0
    shared = lookup(queued, weighted, "source", "docs", "row_id")

    packets = shared.select(
        "row_id",
        "source",
        (F.col("upto") - F.col("doc_tokens")).alias("before"),
        "doc_tokens",
        (F.col("weight") * (window / all_weight)).alias("grant"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(packet).cast("long"))).alias("start"),
    ).withColumn("length", F.least(F.lit(packet).cast("long"), F.col("doc_tokens") - F.col("start")))
    ends = F.col("before") + F.col("start") + F.col("length")
    turn = F.when(F.col("grant") > 0, F.ceil(ends / F.col("grant"))).otherwise(F.lit(1 << 62)).cast("long")
    sent = packets.select("row_id", "source", "start", "length", ends.alias("ends"), turn.alias("turn"))
    order = [F.col("turn"), F.col("source"), F.col("ends")]
    placed = running_totals(sent, [], order, {"upto": F.col("length")}, total // packet + n_rows)

    full, tail = _cuts(window, total)
    firsts = placed.withColumn("first", F.col("upto") - F.col("length"))
    parts = firsts.withColumn("cuts", _pieces(F.col("first"), F.col("length"), window, full, tail)).select(
        "row_id",
        (F.col("first") - F.col("start")).alias("shift"),
        (F.col("first") + F.col("length")).alias("last"),
        "cuts",
        F.posexplode("cuts").alias("n", "at"),
    )
    until = F.coalesce(F.try_element_at("cuts", F.col("n") + 2), F.col("last"))
    after = F.filter(F.array(*[F.lit(t).cast("long") for t in tail]), lambda t: t <= F.col("at")) if tail else F.array()
    in_full = F.col("at") < full
    sequence = F.when(in_full, F.expr(f"at div {window}")).otherwise(F.lit(full // window - 1) + F.size(after))
    offset = F.when(in_full, F.col("at") % window).otherwise(
        F.col("at") - F.coalesce(F.array_max(after.cast("array<bigint>")), F.lit(0))
    )
    cut = parts.select(
        "row_id",
        "shift",
        (F.col("at") - F.col("shift")).alias("start"),
        (until - F.col("at")).alias("length"),
        sequence.cast("long").alias("sequence_id"),
        offset.cast("long").alias("offset"),
    )
    # packets of a document that lie side by side in a sequence are one piece
    joined = cut.groupBy("row_id", "sequence_id", "shift").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset")
    )
    per_row = joined.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces")
    )
    return tokens.join(per_row, "row_id").drop("row_id").mapInArrow(_checked(_kind(path)), _PIECES)


def _kind(path: str) -> str:
    return vocabulary(path).kind
