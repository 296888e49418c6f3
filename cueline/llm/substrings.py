"""Exact removal of repeated 50-byte strings by deep-shallow suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller
id. Sorting every suffix of a corpus in one place doesn't scale, so suffixes are cut
down and dealt out first, without losing a match:

0. Exact copies of a smaller document's text are found by digest and are done.
1. Each 50-byte window has an anchor: of its 24-byte grams the one with the least hash.
   Equal windows have equal anchors at equal places, so only anchors need to meet. About
   one position in 14 is an anchor.
2. Anchors are dealt by hash, packed in blobs; those in two documents or more are shared.
3. The suffixes at shared anchors (50 bytes, and 26 before them) are dealt by anchor and
   put in order: multikey quicksort to a shallow depth, then blind tries for the groups
   that still share a long prefix. The order's common prefixes, with the bytes before an
   anchor, say which windows are equal and what their smallest document is. Equal records
   leave a task once, and anchors with very many occurrences are dealt window by window,
   so that a passage of very many documents is spread.
4. Each document's hits are joined back to its text.

Text is shuffled by document id only; blobs take a few bytes for each anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import chunks, materialise

LENGTH = 50
GRAM = 24
SPREAD = LENGTH - GRAM + 1
BEFORE = SPREAD - 1
#: Bytes compared by the multikey quicksort; longer common prefixes go to blind tries.
SHALLOW = 32
FLUSH = 24 << 20
#: An anchor with more occurrences is hot: its windows are dealt by their own content.
HOT = 4096
#: Stands for a null id; such rows are told by the sign of their tag, so that an id may have this value too.
NO_ID = (1 << 63) - 1
#: Bytes of text at most for each bucket that anchors, suffixes and hits are dealt to.
BUCKET_BYTES = 64 << 20


# --- anchors -------------------------------------------------------------------------


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, hash) of the anchors of joined documents.

    ``starts``: where each document begins, and the end. Windows don't cross documents.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    c = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(c, k, 1 << 64))
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    x = h16[: n - GRAM + 1] * power(8) + h8[16 : 16 + n - GRAM + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    # hash above, position below: the minimum over a window is its leftmost least gram
    key = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    key = np.minimum(key[: n - LENGTH + 1], key[SPREAD - 16 : SPREAD - 16 + n - LENGTH + 1])
    size = np.diff(starts)
    edge = np.zeros(n + 1, np.int8)
    long_ = size >= LENGTH
    edge[starts[:-1][long_]] += 1
    edge[(starts[1:] - LENGTH + 1)[long_]] -= 1
    window = np.flatnonzero(np.cumsum(edge[: n - LENGTH + 1], dtype=np.int8))
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64)
    at = (key[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    return at[first], window[first], window[last], x[at[first]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


# --- blobs ---------------------------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays with the same number of rows, in byte planes, compressed."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1) for a in arrays]
    body = b"".join(p.tobytes() if p.shape[1] > 8 else np.ascontiguousarray(p.T).tobytes() for p in planes)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        wide = kind if isinstance(kind, int) else np.dtype(kind).itemsize
        part = body[at : at + n * wide]
        at += n * wide
        if isinstance(kind, int):
            out.append(part.reshape(n, wide) if wide > 8 else np.ascontiguousarray(part.reshape(wide, n).T))
        else:
            out.append(np.ascontiguousarray(part.reshape(wide, n).T).view(kind).ravel())
    return out


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _dealt(bucket: np.ndarray, arrays: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1]))) if len(dealt) else np.zeros(0, np.int64)
    cut = np.append(first, len(dealt)).tolist()
    return dealt[first].tolist(), [_pack([a[order[x:y]] for a in arrays]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _lists(ids: np.ndarray, tags: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each (id, tag) with a list of each column."""
    order = np.lexsort((tags, ids))
    i, t = ids[order], tags[order]
    first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])))) if len(i) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(i)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].astype(np.int32))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(t[first]), *lists], names=["k", "tag", *names])


# --- deep-shallow sorting ------------------------------------------------------------


def shallow_sort(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of byte rows on their first ``depth`` bytes, 8 bytes a character.

    Every group is parted around a pivot into smaller, equal and larger rows, and its
    equal part goes on with the next character; all groups of a round are parted at once.
    Returns the order and, for each place in it, whether a new group begins there.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
    order = np.arange(n)
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = True
    char = np.zeros(n, np.int64)  # by place: the character its group is parted on next
    live = np.arange(n)  # places in groups that aren't done
    while len(live):
        head = fresh[live]
        group = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(live)))
        keep = (size > 1)[group] & (char[live] < words.shape[1])
        if not keep.all():
            live = live[keep]
            continue
        value = words[order[live], char[live]]
        pivot = value[begin + size // 2][group]
        part = (value > pivot).astype(np.int64) - (value < pivot) + 1
        move = np.argsort(group * 3 + part, kind="stable")
        order[live] = order[live][move]
        part = part[move]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
        fresh[live] = new
        char[live] += part == 1
    return order, fresh


class _Trie:
    """Blind trie: nodes keep the place of the first byte in which their children differ."""

    __slots__ = ("at", "some", "kids")

    def __init__(self, at: int, some: bytes) -> None:
        self.at, self.some, self.kids = at, some, {}


def blind_trie_order(texts: list[bytes]) -> list[bytes]:
    """Distinct texts of equal length in order, by insertion into a blind trie."""
    end = len(texts[0])
    root: _Trie | None = None
    for text in texts:
        leaf = _Trie(end, text)
        if root is None:
            root = leaf
            continue
        # descend blindly to a leaf, compare once, and go back to where the texts part
        node = root
        while node.kids:
            node = node.kids.get(text[node.at]) or next(iter(node.kids.values()))
        other = node.some
        if other == text:
            continue
        differ = next(i for i in range(end) if other[i] != text[i])
        above, node = None, root
        while node.kids and node.at < differ:
            above, node = node, node.kids[text[node.at]]
        if node.kids and node.at == differ:
            node.kids[text[differ]] = leaf
            continue
        split = _Trie(differ, text)
        split.kids = {other[differ]: node, text[differ]: leaf}
        if above is None:
            root = split
        else:
            above.kids[text[above.at]] = split
    out: list[bytes] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node.kids:
            stack += [kid for _, kid in sorted(node.kids.items(), reverse=True)]
        else:
            out.append(node.some)
    return out


def suffix_order(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and the common prefix of each with the one before it (0 for the first)."""
    n, wide = rows.shape
    order, fresh = shallow_sort(rows, shallow)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, n))
    sorted_ = rows[order]
    # groups whose rows are all equal are in order already
    odd = np.zeros(n, bool)
    if n:
        odd[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1) & ~fresh[1:]
    group = np.cumsum(fresh) - 1
    mixed = np.unique(group[odd])
    for g in mixed.tolist():
        lo, hi = int(begin[g]), int(begin[g] + size[g])
        texts = [r.tobytes() for r in sorted_[lo:hi]]
        place = {t: i for i, t in enumerate(blind_trie_order(list(dict.fromkeys(texts))))}
        move = np.argsort([place[t] for t in texts], kind="stable")
        order[lo:hi] = order[lo:hi][move]
    sorted_ = rows[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = sorted_[1:] != sorted_[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, lcp


def repeats(doc: np.ndarray, none: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which rows have a smaller document in their group. Rows are in groups, which begin at ``begin``; ``none``: without an id."""
    size = np.diff(np.append(begin, len(doc)))
    least = np.repeat(np.minimum.reduceat(doc, begin), size)
    # NO_ID is the largest id: rows without one are larger still
    any_id = np.repeat(np.logical_or.reduceat(~none, begin), size)
    return (doc > least) | (none & any_id)


def repeated_spans(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, doc: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each anchor that repeat a smaller document (0, 0: none).

    ``right``: LENGTH bytes from the anchor on; ``left``: BEFORE bytes before it, backwards;
    ``none``: rows without an id, which are larger than all others.
    """
    n = len(doc)
    order, lcp = suffix_order(right)
    doc_o, none_o, nl, nr, left_o = doc[order], none[order], n_left[order], n_right[order], left[order]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    h = np.zeros(n, np.uint64)
    for l in range(SPREAD):  # noqa: E741
        if l:
            h = (h + left_o[:, l - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        own = np.flatnonzero((nl >= l) & (nr >= LENGTH - l))
        if not len(own):
            continue
        # equal windows: one class of suffixes to this depth, and equal bytes before the anchor
        kind = np.cumsum(lcp < LENGTH - l).astype(np.uint64)[own]
        key = (kind * np.uint64(0xD6E8FEB86659FD93)) ^ h[own]
        by = np.argsort(key)
        sorted_key = key[by]
        bytes_ = left_o[own[by], :l]
        if ((sorted_key[1:] == sorted_key[:-1]) & (bytes_[1:] != bytes_[:-1]).any(axis=1)).any():
            # two kinds of bytes have one hash: group by the bytes themselves
            exact = np.column_stack([kind[by].view(np.uint8).reshape(-1, 8), bytes_])
            sorted_key = np.unique(exact, axis=0, return_inverse=True)[1].ravel()
            again = np.argsort(sorted_key, kind="stable")
            by, sorted_key = by[again], sorted_key[again]
        begin = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        hit = own[by][repeats(doc_o[own][by], none_o[own][by], begin)]
        before[hit] = l
        first = hit[after[hit] == 0]
        after[first] = LENGTH - l
    out_b, out_a = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_b[order], out_a[order] = before, after
    return out_b, out_a


# --- the operator --------------------------------------------------------------------


def _send_anchors(n: int):
    most = _flush_at(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, k, tag, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            own, blobs = _dealt(_buckets(h, n), [(h & np.uint64(0xFFFFFFFF)).astype(np.uint32), k, tag, pos])
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            ks, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start, texts in chunks(batch.column(2), 2 << 20):
                data, starts = _joined(texts)
                at, _, _, h = anchors(data, starts)
                if len(at):
                    d = np.searchsorted(starts, at, "right") - 1
                    held.append((h, ks[start + d], tags[start + d], (at - starts[d]).astype(np.uint32)))
                    size += len(data)
                if size > most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _doc_bucket(k: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    mixed = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tag.view(np.uint64)
    return _buckets(mixed * np.uint64(0xD6E8FEB86659FD93), n)


def _rows_of(bucket: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _shared_anchors(n: int, most_cold: int):
    """Places of shared anchors, dealt by document; those of hot anchors as negative numbers."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, [np.uint32, np.int64, np.int64, np.uint32]) for b in table.column("blob").to_pylist()]
        h, k, tag, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
        size = np.diff(np.append(begin, len(by)))
        shared = np.repeat(np.logical_or.reduceat(repeats(k[by], tag[by] < 0, begin), begin), size)
        own, hot = by[shared], np.repeat(size > most_cold, size)[shared]
        place = pos[own].astype(np.int64)
        order = np.lexsort((place, k[own]))
        place = np.where(hot, -1 - place, place).astype(np.int32)
        return _rows_of(*_dealt(_doc_bucket(k[own][order], tag[own][order], n), [k[own][order], tag[own][order], place[order]]))

    return run


def _by_doc(kinds: list, names: list[str]):
    """Blobs of one bucket as a row for each document."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, [np.int64, np.int64, *kinds]) for b in table.column("blob").to_pylist()]
        k, tag, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.Table.from_batches([_lists(k, tag, columns, names)])

    return run


_MIX = np.random.default_rng(20240502).integers(1, 1 << 63, size=BEFORE + LENGTH + 2, dtype=np.uint64) | np.uint64(1)


def _row_hash(body: np.ndarray, nl: np.ndarray, nr: np.ndarray) -> np.ndarray:
    h = nl.astype(np.uint64) * _MIX[-2] + nr.astype(np.uint64) * _MIX[-1]
    for j in range(body.shape[1]):
        h += body[:, j] * _MIX[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _contexts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """BEFORE bytes before each place and LENGTH from it on; zero outside low..high."""
    place = at[:, None] + np.arange(-BEFORE, LENGTH)
    body = data[np.clip(place, 0, len(data) - 1)]
    body[(place < low[:, None]) | (place >= high[:, None])] = 0
    return body


def _suffix_records(data: np.ndarray, at: np.ndarray, s0: np.ndarray, s1: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(dealing key, context, bytes before, bytes after, place): one for each anchor, or each window of a hot one."""
    few = ~hot
    body = _contexts(data, at[few], s0[few], s1[few] + LENGTH)
    plain = (h[few], body, (at - s0)[few].astype(np.uint8), (s1 + LENGTH - at)[few].astype(np.uint8), at[few])
    if not hot.any():
        return plain
    n = (s1 - s0 + 1)[hot]
    a = np.repeat(at[hot], n)
    start = np.repeat(s0[hot], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    nl, nr = (a - start).astype(np.uint8), (start + LENGTH - a).astype(np.uint8)
    body = _contexts(data, a, start, start + LENGTH)
    windows = (_row_hash(body, nl, nr), body, nl, nr, a)
    return tuple(np.concatenate(c) for c in zip(plain, windows, strict=True))


def _send_suffixes(n: int):
    """Buckets 0 to n - 1 get records, dealt by key; n to 2n - 1 spans that are settled already, by document."""
    most = _flush_at(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, body, nl, nr, k, tag, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            # of equal records the smallest document's goes on; the others repeat it whole
            by = np.lexsort((tag < 0, k, _row_hash(body, nl, nr), key))
            key, body, nl, nr, k, tag, pos = (c[by] for c in (key, body, nl, nr, k, tag, pos))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (nl[1:] != nl[:-1]) | (nr[1:] != nr[:-1]) | (body[1:] != body[:-1]).any(axis=1)))
            first = np.flatnonzero(new)
            done = repeats(k, tag < 0, first)
            go = ~done
            own, blobs = _dealt(_buckets(key[go], n), [c[go] for c in (body, nl, nr, k, tag, pos)])
            if done.any():
                at = pos[done].astype(np.int64)
                order = np.lexsort((at, k[done]))
                spans = [k[done], tag[done], (at - nl[done]).astype(np.uint32), (at + nr[done]).astype(np.uint32)]
                more, settled = _dealt(_doc_bucket(k[done][order], tag[done][order], n), [c[order] for c in spans])
                own, blobs = own + [n + b for b in more], blobs + settled
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            ks, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            for start, texts in chunks(batch.column(2), 2 << 20):
                data, starts = _joined(texts)
                at, s0, s1, h = anchors(data, starts)
                own = lists.slice(start, len(texts))
                counts = np.array([len(x) for x in own])
                told = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(starts[:-1], counts) + np.where(told < 0, -1 - told, told)
                inside = place < len(data)
                shared = np.zeros(len(data) + 1, np.int8)
                shared[place[inside]] = 1 + (told[inside] < 0)
                pick = shared[at] > 0
                at, s0, s1, h = at[pick], s0[pick], s1[pick], h[pick]
                if not len(at):
                    continue
                key, body, nl, nr, at = _suffix_records(data, at, s0, s1, h, shared[at] == 2)
                d = np.searchsorted(starts, at, "right") - 1
                held.append((key, body, nl, nr, ks[start + d], tags[start + d], (at - starts[d]).astype(np.uint32)))
                size += body.size
                if size > most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _spans(n: int):
    """Spans that repeat a smaller document, dealt by document; settled ones go through."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n:
            return _rows_of([bucket - n] * len(blobs), blobs)
        parts = [_unpack(b, [BEFORE + LENGTH, np.uint8, np.uint8, np.int64, np.int64, np.uint32]) for b in blobs]
        del blobs
        body, nl, nr, k, tag, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        right = np.zeros((len(body), 56), np.uint8)
        right[:, :LENGTH] = body[:, BEFORE:]
        before, after = repeated_spans(right, body[:, BEFORE - 1 :: -1][:, :BEFORE], nr, nl, k, tag < 0)
        hit = np.flatnonzero(after)
        hit = hit[np.lexsort((pos[hit], k[hit]))]
        at = pos.astype(np.int64)[hit]
        spans = [k[hit], tag[hit], (at - before[hit]).astype(np.uint32), (at + after[hit]).astype(np.uint32)]
        return _rows_of(*_dealt(_doc_bucket(k[hit], tag[hit], n), spans))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, begins, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if not begins:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, begins, 1)
            np.add.at(edge, ends, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rows(docs: DataFrame, key: str, text: str, unique: bool = False) -> DataFrame:
    """(k, tag, text). ``tag`` tells apart rows with one id: 63 bits of the text's hash, or 0 if ids are ``unique``; its sign says that there is no id."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{key}`").cast("bigint")
    tag = F.xxhash64(whole).bitwiseAND(F.lit(NO_ID))
    tag = F.when(id_.isNull(), F.bitwise_not(tag)).otherwise(F.lit(0).cast("bigint") if unique else tag)
    return docs.select(F.coalesce(id_, F.lit(NO_ID)).alias("k"), tag.alias("tag"), whole.cast("binary").alias("text"))


def _unique(docs: DataFrame, key: str) -> bool:
    """Whether no id repeats; null ids don't count."""
    ids = docs.select(F.col(f"`{key}`").cast("bigint").alias("k")).where("k IS NOT NULL")
    return ids.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _n_buckets(rows: DataFrame) -> int:
    """As many as shuffle partitions, or more where a bucket would have more than BUCKET_BYTES of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _flush_at(n: int) -> int:
    """Bytes of text or records that a task holds before it deals them: more for many buckets, so that blobs keep some rows."""
    return min(8 * FLUSH, max(FLUSH, 224 * n))


def _copies(rows: DataFrame) -> DataFrame:
    """(k, tag, begins, ends) of the rows whose whole text a smaller document has too.

    Known by digest; they are settled here, so their anchors are neither sent nor sorted.
    """
    ids = rows.select("k", "tag", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("n")).where(f"n >= {LENGTH}")
    # written, so that the join below can split the rows of a text with very many copies
    order = F.struct("k", (F.col("tag") < 0).alias("none"))
    firsts = materialise(ids.groupBy("digest").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").drop("most"), "first-copies")
    copies = ids.join(firsts, "digest").where(order > F.col("least")).select("k", "tag", "n").distinct()
    return copies.select("k", "tag", F.array(F.lit(0)).alias("begins"), F.array("n").alias("ends"))


def repeated_parts(whole: DataFrame, hot: int = HOT) -> DataFrame:
    """(k, tag, begins, ends) of the documents that repeat strings of smaller ones: byte spans, which may overlap. ``whole``: see :func:`_rows`."""
    n = _n_buckets(whole)
    # a bucket is a partition of its own: hashed ones would meet several in a task
    grouped = lambda df: df.repartitionById(n, F.col("bucket")).groupBy("bucket")
    copies = materialise(_copies(whole), "copies")
    # one exchange of the texts by (k, tag) serves this join, the one below and the caller's
    rows = whole.join(copies.select("k", "tag").hint("merge"), ["k", "tag"], "left_anti")
    blobs = "bucket int, blob binary"
    sent = rows.select("k", "tag", "text").mapInArrow(_send_anchors(n), blobs)
    shared = grouped(sent).applyInArrow(_shared_anchors(n, hot), blobs)
    by_doc = grouped(shared).applyInArrow(_by_doc([np.int32], ["at"]), "k bigint, tag bigint, at array<int>")
    suffixes = rows.join(by_doc, ["k", "tag"]).select("k", "tag", "text", "at").mapInArrow(_send_suffixes(n), blobs)
    spans = grouped(suffixes).applyInArrow(_spans(n), blobs)
    found = grouped(spans).applyInArrow(_by_doc([np.uint32, np.uint32], ["begins", "ends"]), "k bigint, tag bigint, begins array<int>, ends array<int>")
    return found.unionByName(copies)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A null text is empty. A null id counts as larger than all others. Rows with equal ids
    are one document: none of them is smaller than the other. ``hot``: occurrences above which
    an anchor's windows are dealt one by one; the result is the same. Texts under 50 bytes keep
    all their bytes. An empty table stays empty.
    """
    rows = _rows(docs, key, text, _unique(docs, key))
    found = repeated_parts(rows, hot)
    joined = rows.join(found, ["k", "tag"], "left")
    id_ = F.when(F.col("tag") >= 0, F.col("k")).alias("doc_id")
    return joined.select(id_, "text", "begins", "ends").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
