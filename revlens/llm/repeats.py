"""Suffix-array dedup: maximal repeats across documents, by lcp-interval trees of sharded suffix arrays.

A byte is removed if it lies in a ``LEAST``-byte string that also starts in a document with
a smaller ``doc_id``. No suffix array of the whole corpus is needed for that:

0. A later copy of a whole text loses all its bytes, and its strings are found in the first one
   anyway: such copies, told by 128 bits of hash, take no part in what follows.
1. Texts are dealt row by row into blocks (a bucketed table, written once and, as a block holds
   rows of one input partition, without a shuffle; the later passes read it without one too;
   dropped when the result is written). Every ``LEAST``-byte window has an anchor, its
   ``ANCHOR``-byte string of smallest hash; neighbouring windows mostly share one. Blocks
   send their distinct anchors (4 bytes each, with the number of runs where a block has
   several) to anchor shards, which return those that lie in more than one document.
2. Runs of windows with a returned anchor are cut out as segments, one per distinct string
   and block with its smallest doc_id, and sent to the shard of their anchor. Equal windows
   have equal anchors, so all occurrences of a window meet in one shard.
3. A shard sorts its windows' suffixes, takes the lcp of neighbours, and scans them with a
   stack: lcp-intervals of ``LEAST`` bytes or more that can be extended to the left by
   different letters (or not at all) are the segments' maximal repeats, each with all its
   occurrences and its smallest doc_id. A repeat longer than a segment (``RUN`` windows) comes
   as several that overlap; their union is the same. Occurrences in later documents are
   joined into runs, which return to their block.
4. Blocks join the runs of all shards and hash what is left.

Bounds: blocks hold about ``BLOCK`` bytes of text and shards what as much text gives,
whatever the corpus: their numbers grow with it. A passage that a third of all documents
share counts once per block. Anchors of ``HOT`` runs or more (a common phrase with ever
different text around it) have their windows sent one by one to shards of the window's own
hash, so they do not gather in the anchor's shard. That takes some ten times the room, so
the bound is a share of what a shard holds, not a number of blocks, which a larger corpus
reaches with ever more anchors. A document is the smallest unit, read in slices when long.

Defined cases: null text is empty; texts below ``LEAST`` bytes keep all; null ``doc_id``
comes after all others (and removes nothing from other null ones); rows with equal
``doc_id`` are one document and remove nothing from each other; matches end at a text's
ends; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut, documents

LEAST = 50
ANCHOR = 24
BLOCK = 4 << 20
#: Runs of windows that may meet in the shard of one anchor; a shard holds some 10^5 in all.
HOT = 1 << 14
#: Runs of one anchor in a block from which on they are counted, whatever their documents.
OFTEN = 16
SLICE = 1 << 20
#: Windows of a segment, at most.
RUN = 64
#: Parts that a shard's segments are worked off in, one after another.
PARTS = 16
#: Spans that a shard gives to their places at a time.
_SPANS = 1 << 15

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULT)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return up, down


_UP, _DOWN = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each ``size``-byte window."""
    global _UP, _DOWN
    if len(_UP) <= len(data):
        _UP, _DOWN = _powers(max(1 << 16, 2 * len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _DOWN[: len(data) - size + 1])


def anchor_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, end window) of the runs of windows with one anchor, slice by slice."""
    for at in range(0, len(data) - LEAST + 1, SLICE):
        x = window_hashes(data[at : at + SLICE + LEAST - 1], ANCHOR)
        width, size = LEAST - ANCHOR + 1, 1  # smallest of `width` neighbours, by doubling
        while size * 2 <= width:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        if size < width:
            x = np.minimum(x[: len(x) - (width - size)], x[width - size :])
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        yield x[edge], edge + at, np.append(edge[1:], len(x)) + at


def _texts(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for d, text in zip(part["d"], part["text"]):
        yield d, np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _key(anchors: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the upper, 32 more bits of the anchor in the lower half."""
    return ((anchors % np.uint64(shards)) << np.uint64(32)) | (anchors >> np.uint64(32))


def _without_copies(part: pd.DataFrame, copies: pd.DataFrame) -> np.ndarray:
    """Which rows of a block are no later copy of a whole text."""
    gone = set(zip(copies["d"], copies["t"], copies["u"]))
    return np.array([row not in gone for row in zip(part["d"], part["t"], part["u"])], bool)


def _block_anchors(part: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Per shard the block's distinct anchors: those of one document, and those of more (or of ``OFTEN``
    runs) with their numbers of runs."""
    keys, owners = [], []
    for d, data in _texts(part.sort_values("d", kind="stable")):
        for anchors, _, _ in anchor_runs(data):
            keys.append(_key(anchors, shards))
            owners.append(np.full(len(anchors), d))
    if not keys:
        return pd.DataFrame({"shard": [], "block": [], "one": [], "many": [], "runs": []})
    k, d = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k, kind="stable")  # documents stay in order within a key
    k, d = k[order], d[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(k)) - 1
    runs = (end - start + 1).astype(np.uint32)
    many = (d[start] != d[end]) | (runs >= OFTEN)
    k = k[start]
    shard = (k >> np.uint64(32)).astype(np.int64)
    rows, low = [], k.astype(np.uint32)
    for s in np.unique(shard):
        i, j = np.searchsorted(shard, [s, s + 1])
        several = many[i:j]
        found = low[i:j][~several].tobytes(), low[i:j][several].tobytes(), runs[i:j][several].tobytes()
        rows.append((int(s), int(part["block"].iloc[0]), *found))
    return pd.DataFrame(rows, columns=["shard", "block", "one", "many", "runs"])


def _repeated_anchors(part: pd.DataFrame, hot_from: int) -> pd.DataFrame:
    """What of a shard's anchors goes back to each block: repeated ones, and the hot among them."""
    one = [np.frombuffer(b, np.uint32) for b in part["one"]]
    many = [np.frombuffer(b, np.uint32) for b in part["many"]]
    counted = [np.ones(sum(map(len, one)), np.int64), *[np.frombuffer(b, np.uint32) for b in part["runs"]]]
    value, which, blocks = np.unique(np.concatenate(one + many), return_inverse=True, return_counts=True)
    runs = np.bincount(which, np.concatenate(counted))
    again = (blocks > 1) | (runs > 1)
    value, hot = value[again], runs[again] >= hot_from
    rows = []
    for block, a, b in zip(part["block"], one, many):
        own = np.isin(value, np.concatenate([a, b]))
        if own.any():
            rows.append((block, part["shard"].iloc[0], value[own & ~hot].tobytes(), value[own & hot].tobytes()))
    return pd.DataFrame(rows, columns=["block", "shard", "value", "hot"])


def _segments(part: pd.DataFrame, first: np.ndarray, back: pd.DataFrame, shards: int):
    """The distinct segments of the block's ``first`` rows as {(shard, part, bytes): [places]}; a place is (document index, offset)."""
    wide = lambda col: np.sort(
        np.concatenate(
            [np.zeros(0, np.uint64)]
            + [
                (np.uint64(s) << np.uint64(32)) | np.frombuffer(v, np.uint32).astype(np.uint64)
                for s, v in zip(back["shard"], back[col])
            ]
        )
    )
    value, hot = wide("value"), wide("hot")

    def known(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(among, keys), max(0, len(among) - 1))
        return among[at] == keys if len(among) else np.zeros(len(keys), bool)

    found: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
    for i, (_, data) in zip(np.flatnonzero(first).tolist(), _texts(part[first])):
        raw = data.tobytes()
        for anchors, begin, end in anchor_runs(data):
            keys = _key(anchors, shards)
            for r in np.flatnonzero(known(keys, value)).tolist():
                key, last = int(keys[r]), int(end[r])
                # A periodic text is one long run; whole, its repeats would nest as deep as it is long.
                for at in range(int(begin[r]), last, RUN):
                    piece = raw[at : min(at + RUN, last) + LEAST - 1]
                    found.setdefault((key >> 32, key % PARTS, piece), []).append((i, at))
            runs = np.flatnonzero(known(keys, hot))
            if len(runs):
                for r in runs.tolist():
                    a, b = int(begin[r]), int(end[r])
                    to = _key(window_hashes(data[a : b + LEAST - 1], LEAST), shards).tolist()
                    for at, key in zip(range(a, b), to):
                        found.setdefault((key >> 32, key % PARTS, raw[at : at + LEAST]), []).append((i, at))
    return found


def _joined(runs: np.ndarray) -> np.ndarray:
    """Rows (key ..., start, end) with the overlapping and touching runs of one key joined, in order."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort(runs[:, -2::-1].T)]
    fresh = np.concatenate([[True], (runs[1:, :-2] != runs[:-1, :-2]).any(axis=1)])
    apart = (np.cumsum(fresh) - 1) * (int(runs[:, -1].max()) + 2)  # keys side by side on one line
    start, end = runs[:, -2] + apart, np.maximum.accumulate(runs[:, -1] + apart)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    out = runs[first]
    out[:, -1] = (end - apart)[np.append(first[1:], len(runs)) - 1]
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Rows of numbers, compressed column by column."""
    return zstandard.compress(np.ascontiguousarray(numbers.T).tobytes())


def _unpacked(data: bytes, dtype: type, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype).reshape(columns, -1).T


def _block_segments(part: pd.DataFrame, back: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Per shard the block's segments: their bytes, numbers (part, length, smallest and largest
    document, places), places (document index, offset) and the places' documents, all compressed:
    segments overlap by ``LEAST - 1`` bytes, and their numbers are small.

    A segment repeats as a whole for all but its smallest document in the block: those spans
    are sent along, joined, in a row of their own with the block's own negative shard, and
    so are the later copies of whole texts, which ``back`` holds under shard -1.
    """
    ids = part["d"].to_numpy()
    block = int(part["block"].iloc[0])
    by: dict[int, list] = {}
    first = _without_copies(part, back[back["shard"] < 0])
    own = [(i, 0, len(part["text"].iloc[i].encode("utf-8", "replace"))) for i in np.flatnonzero(~first).tolist()]
    for (shard, turn, raw), places in _segments(part, first, back[back["shard"] >= 0], shards).items():
        docs = [ids[i] for i, _ in places]
        lo, hi = min(docs), max(docs)
        by.setdefault(shard, []).append((turn, len(raw), lo, hi, len(places), raw, places, docs))
        if lo != hi:
            own += [(i, at, at + len(raw)) for (i, at), d in zip(places, docs) if d > lo]
    rows = []
    for shard, found in by.items():
        found.sort(key=lambda x: x[0])
        numbers = np.array([x[:5] for x in found], np.int64)
        places = np.array([p for x in found for p in x[6]], np.int32)
        docs = np.array([d for x in found for d in x[7]], np.int64)
        raw = zstandard.compress(b"".join([x[5] for x in found]))
        rows.append((shard, block, raw, _packed(numbers), _packed(places), _packed(docs)))
    own = _joined(np.array(own, np.int64).reshape(-1, 3)).astype(np.int32)
    rows.append((-1 - block, block, b"", b"", own.tobytes(), b""))
    return pd.DataFrame(rows, columns=["shard", "block", "raw", "numbers", "places", "docs"])


def suffix_array(text: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` (each ``room`` bytes long) and the lcp of each with the one before.

    Sorted by the first ``LEAST`` bytes at once, as big-endian words; longer suffixes of one
    group are then sorted on, eight bytes at a time, only where still equal.
    """
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def words(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(eight[np.minimum(at, len(text))]).view(">u8").ravel().astype(np.uint64)
        cut_off = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left <= 0, np.uint64(0), (w >> np.minimum(cut_off, np.uint64(63))) << np.minimum(cut_off, np.uint64(63)))

    n = len(starts)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # of each place in the order; equal so far
    open_ = np.arange(n)  # places still to be sorted
    depth = 0
    while len(open_) > 1:
        rows = order[open_]
        left = room[rows] - depth
        w = words(starts[rows] + depth, left)
        key = np.minimum(left, 8)  # a suffix that ends here comes before longer ones of the same bytes
        by = np.lexsort((key, w, group[open_]))
        rows, w, key = rows[by], w[by], key[by]
        order[open_] = rows
        same_group = np.concatenate([[False], group[open_][1:] == group[open_][:-1]])
        alike = same_group & np.concatenate([[False], (w[1:] == w[:-1]) & (key[1:] == key[:-1])])
        parted = same_group & ~alike
        at = np.flatnonzero(parted)
        if len(at):
            x = w[at] ^ w[at - 1]
            bits = np.where(x == 0, 64, 63 - np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64))
            # log2 in floating point can be one off next to a power of two
            bits = np.where((x >> (np.uint64(63) - np.clip(bits, 0, 63).astype(np.uint64))) == 0, bits + 1, bits)
            lcp[open_[at]] = depth + np.minimum.reduce([bits // 8, np.maximum(key[at], 0), np.maximum(key[at - 1], 0)])
        group[open_] = open_[np.maximum.accumulate(np.where(alike, 0, np.arange(len(open_))))]
        ended = key < 8
        done = alike & ended
        lcp[open_[done]] = room[rows[done]]
        follow = np.concatenate([alike[1:], [False]])
        open_ = open_[(alike | follow) & ~ended]
        depth += 8
    return order, lcp


def maximal_repeats(
    lcp: np.ndarray, left: np.ndarray, least: int = LEAST
) -> list[tuple[int, int, int]]:
    """(length, first, end) of the left-diverse lcp-intervals of ``least`` or more, places in the suffix order.

    ``left``: the byte before each suffix, below 0 where there is none. One scan with a
    stack of open intervals; each keeps the one left byte it has seen, or that it saw several.
    """
    several, none = -2, -3
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # [lcp, first place, left byte or several]
    join = lambda a, b: b if a == none else a if b == none else several if a != b or a < 0 else a
    n = len(lcp)
    heights, lefts = lcp.tolist(), left.tolist()
    for i in range(1, n + 1):
        h = heights[i] if i < n else 0
        if h < least:
            h = 0
        first, carried = i - 1, lefts[i - 1] if lefts[i - 1] >= 0 else several
        while stack and stack[-1][0] > h:
            length, start, seen = stack.pop()
            seen = join(seen, carried)
            if seen == several:
                found.append((length, start, i))
            first, carried = start, seen
        if h:
            if stack and stack[-1][0] == h:
                stack[-1][2] = join(stack[-1][2], carried)
            else:
                stack.append([h, first, carried])
    return found


def _shard_spans(part: pd.DataFrame) -> pd.DataFrame:
    """Runs (document index, start, end) that the shard's maximal repeats remove, joined, by block."""
    if part["shard"].iloc[0] < 0:  # a block's own spans pass through
        return pd.DataFrame({"block": part["block"], "spans": part["places"]})
    blobs = []
    for b, raw, x, places, docs in zip(part["block"], part["raw"], part["numbers"], part["places"], part["docs"]):
        x = _unpacked(x, np.int64, 5)
        ends = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(x[:, [1, 4]], axis=0)])
        blobs.append((b, zstandard.decompress(raw), x, _unpacked(places, np.int32, 2), _unpacked(docs, np.int64, 1)[:, 0], ends))
    out = [np.zeros((0, 4), np.int64)]
    for turn in range(PARTS):
        texts, blocks, numbers, places, docs = [], [], [], [], []
        for b, raw, x, at, d, ends in blobs:
            i, j = np.searchsorted(x[:, 0], [turn, turn + 1])
            texts.append(raw[ends[i, 0] : ends[j, 0]])
            numbers.append(x[i:j, 1:])
            places.append(at[ends[i, 1] : ends[j, 1]])
            docs.append(d[ends[i, 1] : ends[j, 1]])
            blocks.append(np.full(j - i, b))
        numbers, places, docs, block = (np.concatenate(x) for x in (numbers, places, docs, blocks))
        spans = _part_spans(np.frombuffer(b"".join(texts), np.uint8), *numbers[:, :3].T)
        count = numbers[:, 3]
        first = np.cumsum(count) - count
        for k in range(0, spans.shape[1], _SPANS):
            seg, offset, length, m = spans[:, k : k + _SPANS]
            each = np.repeat(np.arange(len(seg)), count[seg])  # a span at each place of its segment
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count[seg]) - count[seg], count[seg])
            place = first[seg[each]] + nth
            hit = docs[place] > m[each]  # only documents after the smallest lose bytes
            place, each = place[hit], each[hit]
            start = places[place, 1] + offset[each]
            out.append(_joined(np.stack([block[seg[each]], places[place, 0], start, start + length[each]], axis=1)))
    runs = _joined(np.concatenate(out))
    blocks, at = np.unique(runs[:, 0], return_index=True)
    each = np.split(runs[:, 1:].astype(np.int32), at[1:])
    return pd.DataFrame({"block": blocks, "spans": [np.ascontiguousarray(s).tobytes() for s, _ in zip(each, blocks)]})


def _part_spans(text, sizes, lo, hi) -> np.ndarray:
    """Columns (segment, offset, length, smallest document) for every segment whose largest
    document is larger than the smallest in a maximal repeat."""
    none = np.zeros((4, 0), np.int64)
    if not len(sizes):
        return none
    begin = np.cumsum(sizes) - sizes
    windows = sizes - LEAST + 1
    seg = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[seg] + offset
    # Only windows that repeat, and that follow different bytes (or none) somewhere, can begin a
    # left-diverse interval. Their hashes tell; hashes equal by chance only keep more windows.
    h = window_hashes(text, LEAST)[starts]
    by = np.argsort(h, kind="stable")
    left = np.where(offset > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1)[by]
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    group = np.cumsum(new) - 1
    change = ~new & ((left != np.roll(left, 1)) | (left < 0))
    diverse = np.zeros(group[-1] + 1, bool)
    diverse[group[change]] = True
    stay = np.sort(by[diverse[group]])
    seg, offset, starts = seg[stay], offset[stay], starts[stay]
    if not len(seg):
        return none
    order, lcp = suffix_array(text, starts, sizes[seg] - offset)
    seg, offset, starts = seg[order], offset[order], starts[order]
    left = np.where(offset > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1)
    # A group of suffixes that all follow one byte has no left-diverse interval: leave it out.
    new = lcp < LEAST
    top = np.cumsum(new) - 1
    change = ~new & ((left != np.roll(left, 1)) | (left < 0))
    diverse = np.zeros(top[-1] + 1, bool)
    diverse[top[change]] = True
    diverse &= np.bincount(top) > 1
    stay = diverse[top]
    seg, offset, lcp, left = seg[stay], offset[stay], np.where(new, 0, lcp)[stay], left[stay]
    found = np.array(maximal_repeats(lcp, left), np.int64).reshape(-1, 3)
    if not len(found):
        return none
    length, first, end = found.T
    members = end - first
    each = np.repeat(np.arange(len(found)), members)
    rows = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(members) - members, members)
    m = np.minimum.reduceat(lo[seg[rows]], np.cumsum(members) - members)
    hit = hi[seg[rows]] > m[each]
    rows, each = rows[hit], each[hit]
    return np.stack([seg[rows], offset[rows], length[each], m[each]])


def _apply(part: pd.DataFrame, spans: list[bytes]) -> pd.DataFrame:
    """The block's documents with their removed runs and what is left."""
    found = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(b, np.int32).reshape(-1, 3) for b in spans]])
    gone = _joined(found.astype(np.int64))
    first = np.searchsorted(gone[:, 0], np.arange(len(part) + 1))
    rows = []
    for i, (d, data) in enumerate(_texts(part)):
        raw = data.tobytes()
        runs = gone[first[i] : first[i + 1], 1:].tolist()
        kept, at = [], 0
        for a, b in runs:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        left = b"".join(kept)
        rows.append((d, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), runs, left))
    names = ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
    return pd.DataFrame(rows, columns=names).assign(known=part["known"].to_numpy())


def _dealt(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The rows of an input partition with their ``block``, of about that many bytes: no text is shuffled for it."""
    first, filled = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = filled + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        filled = int(ends[-1]) if len(ends) else filled
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + ends // block)], names=[*batch.schema.names, "block"])


def dedup(docs: DataFrame, with_text: bool = True, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``with_text``, removed (start and end of each run of bytes) and kept (the bytes left)."""
    spark = docs.sparkSession
    last = (1 << 63) - 1
    plain = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("d"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(7), "text")})
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    shards = max(8, -(-total // block))
    table = f"llm_texts_{uuid.uuid4().hex}"
    # by row, not by document: rows that share a doc_id (or have none) may be a third of all
    dealt = plain.mapInArrow(lambda batches: _dealt(batches, block), "d long, known boolean, text string, t long, u long, block long")
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(blocks, "block").saveAsTable(table)
    texts = spark.table(table)

    keys = texts.where(F.octet_length("text") >= LEAST).select("block", "d", "t", "u")
    firsts = keys.groupBy("t", "u").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = cut(keys.join(firsts, ["t", "u"]).where("d > first").select("block", "d", "t", "u"), "repeats-copies")
    sent = texts.groupBy("block").cogroup(copies.groupBy("block")).applyInPandas(
        lambda part, copied: _block_anchors(part[_without_copies(part, copied)], shards), "shard long, block long, one binary, many binary, runs binary"
    )
    back = cut(
        sent.groupBy("shard").applyInPandas(
            lambda part: _repeated_anchors(part, hot), "block long, shard long, value binary, hot binary"
        ),
        "repeats-anchors",
    )
    returned = back.select("*", *[F.lit(0).cast("long").alias(c) for c in ("d", "t", "u")]).unionByName(
        copies.select("*", F.lit(-1).cast("long").alias("shard"), *[F.lit(b"").alias(c) for c in ("value", "hot")])
    )
    cutouts = (
        texts.groupBy("block")
        .cogroup(returned.groupBy("block"))
        .applyInPandas(
            lambda part, returned: _block_segments(_ordered(part), returned, shards) if len(part) and len(returned) else _NO_SEGMENTS,
            "shard long, block long, raw binary, numbers binary, places binary, docs binary",
        )
    )
    spans = cut(cutouts.groupBy("shard").applyInPandas(_shard_spans, "block long, spans binary"), "repeats-spans")

    def apply(part: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        out = _apply(_ordered(part), returned["spans"].tolist())
        return out if with_text else out.assign(removed=None, kept=None)

    out = (
        texts.groupBy("block")
        .cogroup(spans.groupBy("block"))
        .applyInPandas(
            apply,
            "d long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "removed array<array<long>>, kept binary",
        )
    )
    out = cut(out, "repeats-kept")
    spark.sql(f"DROP TABLE {table}")
    more = ["removed", "kept"] if with_text else []
    doc = F.when(F.col("known"), F.col("d")).cast(docs.schema["doc_id"].dataType)
    return out.select(doc.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *more)


_NO_SEGMENTS = pd.DataFrame({c: [] for c in ("shard", "block", "raw", "numbers", "places", "docs")})


def _ordered(part: pd.DataFrame) -> pd.DataFrame:
    """A block's documents in an order that every pass finds again; equal rows are interchangeable."""
    return part.sort_values(["d", "text"], kind="stable").reset_index(drop=True)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_text=False)
