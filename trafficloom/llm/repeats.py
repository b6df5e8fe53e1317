"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of enhanced suffix arrays.

Every window of `length` bytes has an anchor: the smallest hash among its 16-byte strings. Equal windows have equal anchors, so
windows that share an anchor are brought together and no repeat is cut apart:

1. The anchors of every text are compared across documents; an anchor that only one text has leads nowhere.
2. Runs of windows with a shared anchor travel as one string (the union of the windows) to the anchor's group.
3. A group's strings get an enhanced suffix array (suffix order and common prefixes). A stack scan walks its common-prefix
   intervals; an interval of at least `length` bytes whose occurrences differ in the byte before them (or stand at the start
   of a string) is a maximal repeat, reported with all occurrences. One that always follows the same byte lies inside the
   repeat that starts one byte earlier, which is in the same group.

Copies are merged on the way: texts equal as a whole count as one, and equal strings of a task leave it once, with the
smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import arrow_schema, emitted, narrow, rows_of, utf8
from trafficloom.plans.lookup import lookup
from trafficloom.plans.pinning import pin

LENGTH = 50
ANCHOR = 16
LONGEST_RUN = 512
SLICE = 8 << 20
GROUP_BYTES = 1 << 18
NO_ID = (1 << 63) - 1
PART_BYTES = 16 << 20
_ANCHORS = "part long, several boolean, keys binary, counts binary, anchors binary"
_SHARED = "_text_key long, anchor long"
_STRINGS = "anchor long, _text_key long, _rank long, start long, content binary, size long"
_PACKED = "part long, strings binary"
_SPANS = "_text_key long, _rank long, start long, stop long"
_CUT = "_text_key long, _rank long, n_removed long, n_spans long, cut_sha string"
_REPEATS = "repeat_id long, length long, doc_id long, start long"


def anchors(text: bytes, length: int, size: int = ANCHOR) -> np.ndarray:
    """Anchor of every window of the text, the least hash of its strings of `size` bytes; empty for a text shorter than a window."""
    n = len(text)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=text, strides=(1,))
    h = np.zeros(n - size + 1, dtype=np.uint64)
    for at in (*range(0, size - 8, 8), size - 8):
        h += words[at : at + len(h)]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    width, reach = length - size + 1, 1
    while reach * 2 <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[: len(h) - (width - reach)], h[width - reach :])


def runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of runs with one anchor, none above LONGEST_RUN."""
    begins = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
    sizes = np.diff(np.append(begins, len(found)))
    if sizes.max(initial=0) > LONGEST_RUN:
        parts = -(-sizes // LONGEST_RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.repeat(begins, parts) + k * LONGEST_RUN
        sizes = np.minimum(LONGEST_RUN, np.repeat(sizes, parts) - k * LONGEST_RUN)
    return begins, sizes


def sizes(length: int) -> tuple[int, ...]:
    """Sizes of the strings that anchors are taken from, ever longer, until a window is its own anchor.

    The longer the string, the less may differ around it: windows that only share a frequent short string part.
    """
    slack = length - ANCHOR
    return ANCHOR, length - slack // 2, length - slack // 6, length


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _slices(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[text_at])
        if weight >= SLICE:
            yield held
            held, weight = [], 0
    if held:
        yield held


def _packed(part: int, several: bool, values: np.ndarray, owner: np.ndarray) -> tuple:
    """Anchors in order of their texts, with each text's key and number of anchors."""
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    counts = np.diff(np.append(begins, len(owner))).astype("<u4")
    return part, several, owner[begins].tobytes(), counts.tobytes(), values.tobytes()


def _anchor_rows(length: int, text_col: str, parts: int):
    """Anchors of the texts in packed rows, dealt over `parts` by their hash.

    An anchor that several texts of a task have goes on once, marked, so that a common passage leaves a task as one anchor;
    the texts that already know go on under the numbers from `parts` on, by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for held in _slices(((_bytes(t),) for (t,) in rows_of(batches, text_col)), 0):
                texts = {t for (t,) in held if len(t) >= length}
                if not texts:
                    continue
                keys, found = [], []
                for text in texts:
                    values = anchors(text, length)
                    found.append(np.unique(values[runs(values)[0]]))
                    keys.append(_signed(xxhash.xxh64_intdigest(text, 42)))
                values = np.concatenate(found)
                owner = np.repeat(np.array(keys, dtype="<i8"), [len(f) for f in found])
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                first = np.append(True, values[1:] != values[:-1])
                several = np.append(~first[1:], False) & first
                part = _mixed(values) % parts
                part = np.where(first, part, parts + owner % parts)
                kind = part * 2 + several
                order = np.argsort(kind, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(kind[order]) != 0)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    at = order[i:j]
                    yield _packed(int(part[at[0]]), bool(several[at[0]]), values[at], owner[at])

        return emitted(_ANCHORS, rows(), size=500)

    return run


def _shared_anchors(parts: int):
    """(text, anchor) where some other text has the anchor as well."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        def whole(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(b.as_buffer(), dtype=kind) for b in group.column(name)]

        anchor_lists = whole("anchors", "<u8")
        values = np.concatenate(anchor_lists)
        owner = np.concatenate([np.repeat(k, c) for k, c in zip(whole("keys", "<i8"), whole("counts", "<u4"), strict=True)])
        if key[0].as_py() < parts:
            several = np.repeat(group.column("several").to_numpy(), [len(a) for a in anchor_lists])
            order = np.lexsort((owner, values))
            values, owner, several = values[order], owner[order], several[order]
            begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            sizes = np.diff(np.append(begins, len(values)))
            shared = (owner[begins] != owner[begins + sizes - 1]) | np.logical_or.reduceat(several, begins)
            keep = np.repeat(shared, sizes)
            values, owner = values[keep], owner[keep]
        return pa.table({"_text_key": pa.array(owner), "anchor": pa.array(values.view(np.int64))})

    return run


def _bytes(text: str | bytes | None) -> bytes:
    return text.encode() if isinstance(text, str) else text or b""


def _mixed(values: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so their upper bits are not even: they are mixed once more before they are dealt out."""
    return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)


def _string_parts(length: int, text_col: str, merge: bool, parts: int):
    """The strings of `_string_rows`, dealt over `parts` by anchor, as compressed Arrow tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in _string_rows(length, text_col, merge)(batches):
                part = _mixed(batch.column("anchor").to_numpy()) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    sink = pa.BufferOutputStream()
                    dealt = batch.take(pa.array(order[i:j]))
                    with pa.ipc.new_stream(sink, dealt.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(dealt)
                    yield int(part[order[i]]), sink.getvalue().to_pybytes()

        return emitted(_PACKED, rows(), size=500)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of one part after the other, each part in order of the anchors. Rows come in order of the parts."""
    held, last = [], None
    for part, blob in rows_of(batches, "part", "strings"):
        if held and part != last:
            yield from pa.concat_tables(held).sort_by("anchor").to_batches(2000)
            held = []
            pa.default_memory_pool().release_unused()
        held.append(pa.ipc.open_stream(blob).read_all())
        last = part
    if held:
        yield from pa.concat_tables(held).sort_by("anchor").to_batches(2000)


def _string_rows(length: int, text_col: str, merge: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            found = rows_of(batches, "_text_key", "_rank", text_col, "_shared")
            for part in _slices(((k, r, _bytes(t), s) for k, r, t, s in found), 2):
                strings: dict[bytes, tuple[int, list]] = {}
                for text_key, rank, text, shared in part:
                    values = anchors(text, length)
                    begins, sizes = runs(values)
                    known = values[begins]
                    keep = np.isin(known, np.array(shared, dtype=np.int64).view(np.uint64))
                    begins, sizes, known = begins[keep].tolist(), sizes[keep].tolist(), known[keep].view(np.int64).tolist()
                    for a, n, anchor in zip(begins, sizes, known, strict=True):
                        places = strings.setdefault(text[a : a + n + length - 1], (anchor, []))[1]
                        places.append((rank, text_key, a))
                for content, (anchor, places) in strings.items():
                    least = min(places)[0]
                    for rank, text_key, a in places:
                        if rank == least or not merge:
                            yield anchor, text_key, rank, a, content, len(content)
                        else:
                            # a smaller document of this task has it: decided, only the place goes on
                            yield text_key, text_key, rank, a, None, len(content)

        return emitted(_STRINGS, rows(), size=1 << 18, max_bytes=SLICE)

    return run


class Array:
    """Enhanced suffix array of some strings; suffixes shorter than `length` are left out."""

    def __init__(self, strings: list[bytes], length: int) -> None:
        self.length = length
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.text = np.frombuffer(b"\0".join(strings) + b"\0" * 8, dtype=np.uint8)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        suffixes = sizes - length + 1
        self.string = np.repeat(np.arange(len(strings)), suffixes)
        inside = np.arange(len(self.string)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        start = self.begins[self.string] + inside
        left = np.where(inside > 0, self.text[start - 1].astype(np.int64), -1)
        self._sort(start, np.repeat(sizes, suffixes) - inside, left, inside, int(sizes.max()))

    def _sort(self, start: np.ndarray, remaining: np.ndarray, left: np.ndarray, inside: np.ndarray, longest: int) -> None:
        n = len(self.text) - 7
        words = np.ndarray(shape=(n,), dtype=">u8", buffer=self.text.tobytes(), strides=(1,)).astype(np.uint64)
        ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 8
        while width < longest and ranks[-1].max() + 1 < n:
            now = ranks[-1]
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - width)] = now[width:]
            ranks.append(np.unique(now * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
            width *= 2
        order = np.argsort(ranks[-1][start], kind="stable")
        self.start, self.left, self.inside, self.string = start[order], left[order], inside[order], self.string[order]
        remaining = remaining[order]
        i, j, common = self.start[:-1], self.start[1:], np.zeros(max(0, len(order) - 1), dtype=np.int64)
        for rank in reversed(ranks):
            same = rank[np.minimum(i + common, n - 1)] == rank[np.minimum(j + common, n - 1)]
            common += np.where(same, width, 0)
            width //= 2
        differ = words[np.minimum(i + common, n - 1)] ^ words[np.minimum(j + common, n - 1)]
        for byte in range(1, 8):
            common += differ < np.uint64(1 << 8 * byte)
        self.common = np.minimum(common, np.minimum(remaining[:-1], remaining[1:]))

    def repeats(self, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(length, first, last, least owner): maximal repeats as ranges of the suffix order, by a scan with a stack.

        `owner` gives a number for every string, of which each repeat is told the least.
        """
        length, mixed = self.length, -2
        common = np.append(self.common, 0)
        wanted = np.flatnonzero(common >= length)
        if not len(wanted):
            return
        # clusters of suffixes between which the common prefix never falls below the length
        cut = np.flatnonzero(np.diff(wanted) > 1)
        firsts, lasts = wanted[np.append(0, cut + 1)], wanted[np.append(cut, len(wanted) - 1)] + 1
        lefts, owners = self.left, owner[self.string]
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            stack: list[list[int]] = []
            prefix = common[first : last + 1].tolist()
            prefix[-1] = 0
            before, mine = lefts[first : last + 1].tolist(), owners[first : last + 1].tolist()
            for k, value in enumerate(prefix):
                # the suffix as a leaf: place, least owner, byte before it (-1 at a string's start always differs)
                at, least, byte = k, mine[k], before[k] if before[k] >= 0 else mixed
                while stack and stack[-1][0] > value:
                    size, begin, lower, side = stack.pop()
                    lower = min(lower, least)
                    side = side if side == byte else mixed
                    if side == mixed:
                        yield size, first + begin, first + k, lower
                    at, least, byte = begin, lower, side
                if stack and stack[-1][0] == value:
                    top = stack[-1]
                    top[2] = min(top[2], least)
                    top[3] = top[3] if top[3] == byte else mixed
                elif value >= length:
                    stack.append([value, at, least, byte])


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows sorted by anchor in lists of whole anchor groups, each of about GROUP_BYTES of strings."""
    held, weight, last = [], 0, None
    for row in rows:
        if weight >= GROUP_BYTES and row[0] != last:
            yield held
            held, weight = [], 0
        held.append(row)
        weight += len(row[4])
        last = row[0]
    if held:
        yield held


def _arrays(part: list[tuple], length: int) -> tuple[dict[bytes, list[tuple]], list[bytes]]:
    """Places of every distinct string, and the strings whose anchor has several."""
    places: dict[bytes, list[tuple]] = {}
    for _, text_key, rank, start, content, _ in part:
        places.setdefault(content, []).append((rank, text_key, start))
    by_anchor: dict[int, set[bytes]] = {}
    for anchor, *_, content, _ in part:
        by_anchor.setdefault(anchor, set()).add(content)
    return places, [c for found in by_anchor.values() if len(found) > 1 for c in sorted(found)]


_COLUMNS = ("anchor", "_text_key", "_rank", "start", "content", "size")


def _placed(strings: dict[bytes, list[tuple]], content: bytes, place: tuple) -> list[tuple]:
    """Puts a place (rank, text_key, start) of a string beside the others; gives the places that have a smaller document now.

    Only places of the smallest document are kept, so memory follows the distinct strings.
    """
    found = strings.get(content)
    if found is None or place[0] < found[0][0]:
        strings[content] = [place]
        return found or []
    if place[0] > found[0][0]:
        return [place]
    found.append(place)
    return []


class _Covers:
    """Bytes of strings that also stand in a smaller document, as (text_key, rank, start, stop).

    Strings come by anchor, as places by content (see `_placed`). Small groups are gathered into one suffix array; a
    group above GROUP_BYTES is parted by anchors from longer strings until it is small. Equal windows stay together
    on the way, and a whole window is its own anchor in the end, so nothing is lost and no array is larger.
    """

    def __init__(self, length: int) -> None:
        self.length, self.sizes = length, sizes(length)
        self.held: dict[bytes, list[tuple]] = {}
        self.weight = 0

    def add(self, strings: dict[bytes, list[tuple]], level: int = 0) -> Iterator[tuple]:
        """What is known already; the rest follows with `rest` or a later group."""
        if len(strings) < 2:
            return
        weight = sum(map(len, strings))
        if weight > GROUP_BYTES and level + 1 < len(self.sizes):
            yield from self._parted(strings, level + 1)
            return
        if self.weight and self.weight + weight > GROUP_BYTES:
            yield from self.rest()
        self.held |= strings
        self.weight += weight

    def _parted(self, strings: dict[bytes, list[tuple]], level: int) -> Iterator[tuple]:
        """The strings by longer anchors; an anchor that one string only has leads nowhere."""
        contents = list(strings)
        found = [anchors(c, self.length, self.sizes[level]) for c in contents]
        cuts = [runs(values) for values in found]
        owner = np.repeat(np.arange(len(contents)), [len(b) for b, _ in cuts])
        value = np.concatenate([v[b] for v, (b, _) in zip(found, cuts, strict=True)])
        begin, count = (np.concatenate([c[k] for c in cuts]) for k in (0, 1))
        del found, cuts
        order = np.lexsort((owner, value))
        value, owner, begin, count = value[order], owner[order], begin[order], count[order]
        firsts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        lasts = np.append(firsts[1:], len(value)) - 1
        shared = np.flatnonzero(owner[firsts] != owner[lasts])
        group: dict[bytes, list[tuple]] = {}
        for i, j in zip(firsts[shared].tolist(), lasts[shared].tolist(), strict=True):
            for k in range(i, j + 1):
                content, a = contents[owner[k]], int(begin[k])
                part = content[a : a + int(count[k]) + self.length - 1]
                for rank, key, start in strings[content]:
                    for r, t, s in _placed(group, part, (rank, key, start + a)):
                        yield t, r, s, s + len(part)
            yield from self.add(group, level)
            group = {}

    def rest(self) -> Iterator[tuple]:
        if not self.held:
            return
        places, strings = self.held, sorted(self.held)
        array = Array(strings, self.length)
        owner = np.array([places[s][0][0] for s in strings], dtype=np.int64)
        ranks, opened, closed = owner[array.string], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for size, first, last, least in array.repeats(owner):
            begin = array.start[first : last + 1][ranks[first : last + 1] > least]
            opened.append(begin)
            closed.append(begin + size)
        n = len(array.text) + 1
        cover = np.bincount(np.concatenate(opened), minlength=n) - np.bincount(np.concatenate(closed), minlength=n)
        covered = np.cumsum(cover) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        owning = np.searchsorted(array.begins, begins, side="right") - 1
        for s, a, b in zip(owning.tolist(), begins.tolist(), ends.tolist(), strict=True):
            shift = int(array.begins[s])
            for rank, text_key, start in places[strings[s]]:
                yield text_key, rank, start + a - shift, start + b - shift
        self.held, self.weight = {}, 0


def _span_rows(length: int):
    """Bytes that also stand in a smaller document, as spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            covers, last, group = _Covers(length), None, {}
            for anchor, text_key, rank, start, content, size in rows_of(_unpacked(batches), *_COLUMNS):
                if content is None:
                    yield text_key, rank, start, start + size
                    continue
                if anchor != last:
                    yield from covers.add(group)
                    last, group = anchor, {}
                for r, k, a in _placed(group, content, (rank, text_key, start)):
                    yield k, r, a, a + size
            yield from covers.add(group)
            yield from covers.rest()

        return emitted(_SPANS, rows(), size=20_000)

    return run


def _repeat_rows(length: int):
    """Maximal repeats with all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in _groups(rows_of(_unpacked(batches), *_COLUMNS)):
                places, strings = _arrays(part, length)
                single = [c for c, found in places.items() if len(found) > 1]
                strings = list(dict.fromkeys(strings + single))
                if not strings:
                    continue
                # a string with several places is a repeat of itself: it enters twice, so that its places differ
                doubled = strings + [s for s in strings if len(places[s]) > 1]
                array = Array(doubled, length)
                for size, first, last, _ in array.repeats(np.zeros(len(doubled), dtype=np.int64)):
                    at = int(array.start[first])
                    name = _signed(xxhash.xxh64_intdigest(array.text[at : at + size].tobytes()))
                    found = {
                        (None if rank == NO_ID else rank, start + int(array.inside[k]))
                        for k in range(first, last + 1)
                        for rank, _, start in places[doubled[array.string[k]]]
                    }
                    if len(found) > 1:
                        yield from ((name, size, doc_id, start) for doc_id, start in found)

        return emitted(_REPEATS, rows(), size=20_000)

    return run


class _Plan:
    """The shared steps over `texts`, which has the text and whatever else the caller needs.

    The texts go through one exchange by text and document, which all joins with them use again.
    """

    def __init__(self, texts: DataFrame, length: int, id_col: str, text_col: str, merge: bool = True) -> None:
        if length < 2 * ANCHOR:
            raise ValueError(f"repeats of at least {2 * ANCHOR} bytes only")
        key = F.xxhash64(utf8(text_col)).alias("_text_key")
        rank = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_rank")
        sha = F.unhex(F.sha2(utf8(text_col), 256)).alias("sha")
        n_bytes = F.length(utf8(text_col)).cast("long").alias("n_bytes")
        self.keyed = pin(texts.select(F.col(id_col).cast("long").alias("doc_id"), rank, key, n_bytes, sha))
        self.owners = pin(
            self.keyed.groupBy("sha").agg(
                F.min("_rank").alias("owner"), F.count(F.lit(1)).alias("copies"), F.first("_text_key").alias("_text_key")
            )
        )
        self.texts = texts.withColumns({"_text_key": key, "_rank": rank}).repartition("_text_key", "_rank")
        size = self.keyed.agg(F.sum("n_bytes")).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))
        shared = (
            texts.select(text_col)
            .mapInArrow(_anchor_rows(length, text_col, parts), _ANCHORS)
            .groupBy("part")
            .applyInArrow(_shared_anchors(parts), _SHARED)
            .groupBy("_text_key")
            .agg(F.collect_set("anchor").alias("_shared"))
        )
        owned = self.owners.select("_text_key", F.col("owner").alias("_rank"))
        self.strings = (
            self.texts.join(shared.join(owned, "_text_key"), ["_text_key", "_rank"])
            .mapInArrow(_string_parts(length, text_col, merge, 4 * parts), _PACKED)
            .repartition("part")
            .sortWithinPartitions("part")
        )

    def told(self) -> DataFrame:
        """Every row with the smallest document of its text."""
        return lookup(self.keyed, self.owners.select("sha", "owner", "copies"), "sha", "copies", "doc_id")

    @staticmethod
    def copied(length: int) -> Column:
        return (F.col("_rank") > F.col("owner")) & (F.col("n_bytes") >= length)

    def spans(self, length: int) -> DataFrame:
        """(_text_key, _rank, _spans) of the smallest document of each text."""
        found = self.strings.mapInArrow(_span_rows(length), _SPANS)
        return found.groupBy("_text_key", "_rank").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))


def _left(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What stays of a text, the number of bytes removed, and of maximal removed runs."""
    kept, at, removed, n = [], 0, 0, 0
    begin = end = -1
    for a, b in [*sorted((s["start"], s["stop"]) for s in spans), (len(text) + 1, 0)]:
        if a <= end:
            end = max(end, b)
            continue
        if end >= 0:
            kept.append(text[at:begin])
            removed, n, at = removed + end - begin, n + 1, end
        begin, end = a, b
    kept.append(text[at:])
    return b"".join(kept), removed, n


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for text_key, rank, text, spans in rows_of(batches, "_text_key", "_rank", "text", "_spans"):
            kept, removed, n = _left(text, spans)
            yield text_key, rank, removed, n, hashlib.sha256(kept).hexdigest()

    return emitted(_CUT, rows())


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of `docs`.

    Removed is each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id, judged on
    the input. Null text is empty; a null doc_id counts as larger than any other and as equal to another null. Rows that repeat
    a doc_id do not remove from each other. An empty table gives an empty result.
    """
    keys = ["_text_key", "_rank"]
    plan = _Plan(narrow(docs, id_col, text_col), length, "doc_id", "text")
    cut = plan.texts.join(plan.spans(length), keys).mapInArrow(_cut, _CUT)
    found = plan.told().join(cut.dropDuplicates(keys), keys, "left")
    copied, nothing = plan.copied(length), F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with what `remove_repeats` removes cut from the texts.

    A character that lost some of its bytes goes as a whole. Every row stays, if with an empty text; null stays null.
    """
    keys = ["_text_key", "_rank"]
    plan = _Plan(docs, length, id_col, text_col)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copies = plan.told().where(plan.copied(length)).select(*keys, whole.alias("_spans"))
    spans = plan.spans(length).unionByName(copies.dropDuplicates(keys))
    tagged = plan.texts.join(spans, keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, 1024):
                batch = part.slice(start, 1024)
                texts = batch.column(text_col).to_pylist()
                for k, found in enumerate(batch.column("_spans").to_pylist()):
                    if found is not None and texts[k] is not None:
                        texts[k] = _left(texts[k].encode(), found)[0].decode(errors="ignore")
                columns = [pa.array(texts, f.type) if f.name == text_col else batch.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).select(names)

    names = docs.columns
    return tagged.mapInArrow(run, docs.schema)


def maximal_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat_id, length, doc_id, start): strings that several documents share, with all their occurrences.

    Texts equal as a whole count as their smallest document. A repeat is as long as it goes within one run of windows with the same
    anchor; a longer one is reported as several that overlap and cover it. repeat_id is a hash of the string.
    """
    plan = _Plan(narrow(docs, id_col, text_col), length, "doc_id", "text", merge=False)
    return plan.strings.mapInArrow(_repeat_rows(length), _REPEATS).distinct()
