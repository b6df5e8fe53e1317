"""Exact dedup: full texts are inserted into Patricia tries, one owner per terminal.

Texts are partitioned by length and content hash. Tasks first merge their own rows in a trie (a group of copies leaves
a task as one row), then the tries of each partition take full texts under the key length, hash, text. Rows arrive
sorted by that head, so a subtree whose head has passed is complete; once the trie holds more than its budget, complete
subtrees are written out and dropped. Equality is decided by the bytes, never by the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import LOWER, emitted, narrow, rows_of
from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin

HEAD = 16
BUDGET = 24 << 20
_PARTS = "n_bytes long, content_hash long, text binary, owner long, members long"
_OWNERS = "text_sha256 binary, keep_id long, group_size long"
_KEYS = "doc_id long, text_sha256 binary"


class _Node:
    __slots__ = ("label", "children", "owner", "members")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, _Node] = {}
        self.owner: int | None = None
        self.members = 0


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of `label` and `text[at:]`."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie; every terminal keeps the owner among its ids and the number of rows."""

    def __init__(self, keep: str) -> None:
        self.better = max if keep == "largest" else min
        self.root, self.size = _Node(b""), 0

    def insert(self, text: bytes, owner: int | None, members: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = _Node(text[at:])
                node.children[text[at]] = child
                self.size += len(child.label) + 200
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = _shared(child.label, text, at)
                middle = _Node(child.label[:k])
                child.label = child.label[k:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = middle
                self.size += 200
                node, at = middle, at + k
        node.members += members
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.members:
                yield path, node.owner, node.members
            stack.extend((child, path) for child in node.children.values())


def _head(text: bytes) -> bytes:
    return len(text).to_bytes(8, "big") + xxhash.xxh64_digest(text)


def _local(keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = Trie(keep)
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                text = text.translate(LOWER)
                trie.insert(_head(text) + text, doc_id, 1)
                if trie.size > BUDGET:
                    yield from flush(trie)
                    trie = Trie(keep)
            yield from flush(trie)

        def flush(trie: Trie) -> Iterator[tuple]:
            for key, owner, members in trie.terminals():
                content = int.from_bytes(key[8:HEAD], "big", signed=True)
                yield len(key) - HEAD, content, key[HEAD:], owner, members

        return emitted(_PARTS, rows())

    return run


def _merged(keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, last = Trie(keep), None
            columns = ("n_bytes", "content_hash", "text", "owner", "members")
            for n_bytes, content, text, owner, members in rows_of(batches, *columns):
                head = n_bytes.to_bytes(8, "big") + content.to_bytes(8, "big", signed=True)
                if trie.size > BUDGET and head != last:
                    yield from flush(trie)
                    trie = Trie(keep)
                last = head
                trie.insert(head + text, owner, members)
            yield from flush(trie)

        def flush(trie: Trie) -> Iterator[tuple]:
            for key, owner, members in trie.terminals():
                yield hashlib.sha256(key[HEAD:]).digest(), owner, members

        return emitted(_OWNERS, rows())

    return run


def owners(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(text_sha256, keep_id, group_size): one row per distinct text of (doc_id, text as bytes)."""
    parts = docs.mapInArrow(_local(keep), _PARTS)
    heads = ("n_bytes", "content_hash")
    return parts.repartition(*heads).sortWithinPartitions(*heads).mapInArrow(_merged(keep), _OWNERS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((i, hashlib.sha256(t.translate(LOWER)).digest()) for i, t in rows_of(batches, "doc_id", "text"))
    return emitted(_KEYS, found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal when they are identical after lower-casing A-Z only. Null counts as the empty text, and empty texts
    are copies of one another. Of a group the `largest` or `smallest` doc_id stays; null ids come last either way, so a
    group of null ids only keeps all its rows. Repeated rows with one doc_id share its decision. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = narrow(docs, id_col, text_col)
    groups = pin(owners(rows, keep))
    found = lookup(rows.mapInArrow(_keys, _KEYS), groups, "text_sha256", "group_size", "doc_id")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )
