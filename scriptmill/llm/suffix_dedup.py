"""Removal of repeated passages with a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Of all suffixes
only anchors are sorted: each window of LENGTH bytes picks the least hash among its K-grams, the leftmost of
equals, so equal windows pick the same anchor, and about one suffix in 35 is kept. All windows that pick an
anchor at A lie in its context, the bytes from A - REACH to A + LENGTH.

1. Splitters sampled from anchors' leading tokens (eight bytes each, big-endian) range-partition the suffixes,
   into at most FAN buckets at a time. Where the corpus needs more, each bucket is sampled again for its own
   splitters and dealt out again, so that neither the splitters nor the blobs of a task grow with the corpus.
   A task sends a context that it has seen twice only once; the later ones are covered whole.
2. Each bucket sorts its suffixes by multikey quicksort (a token at a time, among ties of the tokens before),
   then by a digest of the context. Suffixes with equal K-grams are neighbours: in a run of equal contexts all
   but the first are covered whole; first ones whose K-gram has other contexts too are asked for.
   Leading tokens that fill several splitters alone are dealt over those buckets by digest, and what would
   have to be compared across such a boundary is asked for.
3. Contexts asked for (the ends of passages, mostly) are cut from their texts and grouped by their K-gram's
   hash; within a K-gram, windows are compared one offset at a time, and those that have an earlier equal are
   covered. All of these windows hold the anchor, so their union is one run. Contexts of a frequent lead go to
   several groups instead, one for each class of neighbouring offsets, by a hash of the 93 bytes that the
   class's windows share: equal windows still meet, and a common line doesn't fill a group.

Texts are joined to their messages twice; messages are a few bytes for each anchor that repeats.

Edge cases: null and empty texts have 0 bytes and the digest of nothing; texts under LENGTH bytes lose nothing
and remove nothing; a null doc_id counts as the least; rows that repeat a doc_id are documents of their own,
ordered by a hash of their text; an empty table gives an empty result; other columns are carried or ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, materialize, short_batches, utf8_view

LENGTH, K = 100, 32
REACH = LENGTH - K
SEGMENT = 1 << 19
POSITION_BITS = np.uint64(20)
CHUNK_BYTES = 6 << 20
#: Text for each bucket, documents sampled for the first splitters, anchors taken from each.
BUCKET_BYTES, SAMPLE_DOCS, SAMPLE_EVERY = 8 << 20, 2000, 8
#: Buckets that one step deals to; leads sampled for each bucket of a later step; text for an anchor, about.
FAN, SAMPLE_EACH, ANCHOR_BYTES = 512, 40, 32
#: Texts whose anchors one task deals out again.
DEAL_BYTES = 1 << 30
#: A small corpus has this many buckets too, as far as they have BUCKET_BYTES / LEAST_BUCKETS, so that tasks share it.
LEAST_BUCKETS = 32
LEAST_ID = -(1 << 63)

_U = np.uint64
_rng = np.random.default_rng(2024)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        n = SEGMENT + 4 * LENGTH + 1
        inverse = _U(pow(int(_STEP), -1, 1 << 64))
        for name, x in (("up", _STEP), ("down", inverse)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _segments(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, first window start, end of window starts): runs of whole texts, or parts of a long one."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > SEGMENT:
            for p in range(int(at[i]), int(at[i + 1]), SEGMENT):
                q = min(p + SEGMENT, int(at[i + 1]))
                yield max(int(at[i]), p - REACH), min(int(at[i + 1]), q + 2 * LENGTH), p, q
            i += 1
            continue
        j = int(np.searchsorted(at, at[i] + SEGMENT, "right")) - 1
        yield int(at[i]), int(at[j]), int(at[i]), int(at[j])
        i = j


def anchors(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in the joined texts, their K-grams' hashes and their contexts' digests."""
    up, down = _tables()
    found = []
    mask = (_U(1) << POSITION_BITS) - _U(1)
    for lo, hi, first, end in _segments(at):
        n = hi - lo
        if n < LENGTH:
            continue
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[body[lo:hi]] * up[:n], out=total[1:])
        grams = mix((total[K:] - total[:-K]) * down[: n - K + 1])
        key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):  # least of 2, 4, ... 64 neighbours
            key = np.minimum(key[:-step], key[step:])
        rest = LENGTH - K + 1 - 64
        key = np.minimum(key[:-rest], key[rest:])
        # Windows start in the segment's own part and end in the text they start in.
        i, j = np.searchsorted(at, [lo, hi], "left") if first == lo and end == hi else (0, 0)
        edge = np.zeros(n + 1, np.int32)
        starts, stops = (at[i:j] - lo, at[i + 1 : j + 1] - lo) if j > i else (np.array([first - lo]), np.array([n]))
        fits = stops - starts >= LENGTH
        np.add.at(edge, starts[fits], 1)
        np.add.at(edge, np.minimum(stops[fits] - LENGTH + 1, end - lo if j == i else n), -1)
        place = (key & mask)[np.cumsum(edge[: len(key)]) > 0].astype(np.int64)
        if not len(place):
            continue
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        text = np.searchsorted(at, place + lo, "right") - 1
        a = np.maximum(at[text], place + lo - REACH) - lo
        b = np.minimum(at[text + 1], place + lo + LENGTH) - lo
        whole = (total[b] - total[a]) * down[a]
        digest = mix(whole + (place - a).astype(np.uint64) * _U(0x632BE59BD9B4E019) + (b - place).astype(np.uint64) * _U(0xD1342543DE82EF95))
        found.append((place + lo, grams[place], digest))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, grams, digest = (np.concatenate(c) for c in zip(*found))
    # Parts of a long text may find the same anchor.
    _, once = np.unique(place, return_index=True)
    return place[once], grams[once], digest[once]


def tokens(body: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """(n, anchors): the suffixes' leading tokens."""
    if not len(place):
        return np.zeros((n, 0), np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(body, 8 * n)[place]
    return np.ascontiguousarray(view).view(">u8").astype(np.uint64).T


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by several keys: each is looked at only among ties of those before it."""
    order = np.argsort(keys[0], kind="stable")
    run = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    for level, key in enumerate(keys):
        if level:
            own = order[tied]
            own = own[np.lexsort((key[own], run[tied]))]
            order[tied] = own
        k = key[order[tied]]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (run[tied][1:] != run[tied][:-1])]) if len(k) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        more = np.bincount(group, minlength=1)[group] > 1
        run[tied] = group
        tied = tied[more]
        if len(tied) < 2:
            break
    return order


def _leads(t: np.ndarray) -> np.ndarray:
    """Two tokens as one comparable key of 16 bytes."""
    return np.ascontiguousarray(t[:2].T.astype(">u8")).view("S16").ravel()


def bucket_of(t: np.ndarray, digest: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The bucket of each suffix; leads that fill several splitters are dealt over them by the digest."""
    lead = _leads(t)
    p = np.searchsorted(splitters, lead, "right")
    width = p - np.searchsorted(splitters, lead, "left")
    return np.where(width > 1, p - (digest % np.maximum(width, 1).astype(np.uint64)).astype(np.int64), p)


def is_hot(t: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    lead = _leads(t)
    return np.searchsorted(splitters, lead, "right") - np.searchsorted(splitters, lead, "left") > 1


# -- what map tasks send to buckets ----------------------------------------------------------------------------------


def _pack(columns: list[np.ndarray]) -> bytes:
    import zstandard

    out = [np.array([len(columns), *(len(c) for c in columns)], "<i8").tobytes()]
    for c in columns:  # bytes of one weight together
        out.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = np.frombuffer(raw, "<i8", len(kinds) + 1)
    at, out = 8 * (len(kinds) + 1), []
    for size, kind in zip(n[1:].tolist(), kinds):
        width = np.dtype(kind).itemsize
        own = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(own).view(kind).ravel())
        at += size * width
    return out


#: Tokens, K-gram, digest, text, place, whether the lead is frequent; the texts' ids.
_KINDS = ["<u8", "<u8", "<u4", "<u8", "<u4", "<u4", "<u1", "<i8", "<i8"]
#: Text and place of anchors that are covered already; the texts' ids.
_GONE_KINDS = ["<u4", "<u4", "<i8", "<i8"]
GONE = -1  # their bucket


def _deal(c: list[np.ndarray], splitters: np.ndarray, base: int) -> pa.RecordBatch:
    """Anchors (columns of _KINDS) to the buckets from ``base`` on, a blob for each; and one blob of covered ones."""
    t0, t1, gram, digest, text, own, hot, ids, again = c
    # Of equal contexts here, the first in the corpus' order goes on.
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((again, ids))] = np.arange(len(ids))
    both = mix(t0 ^ mix(t1 ^ mix(gram.astype(np.uint64) ^ mix(digest))))
    first_in_order = np.lexsort((own, rank[text]))
    order = first_in_order[np.argsort(both[first_in_order], kind="stable")]
    repeat = np.zeros(len(order), bool)
    repeat[order[1:]] = both[order[1:]] == both[order[:-1]]
    t = np.stack([t0, t1])
    p = bucket_of(t, digest, splitters) + base
    hot = hot | is_hot(t, splitters)
    buckets, blobs, counts = [], [], []

    def send(bucket: int, rows: np.ndarray, columns: list[np.ndarray]) -> None:
        texts, short = np.unique(text[rows], return_inverse=True)
        blobs.append(_pack([*(x[rows] for x in columns), short.astype("<u4"), own[rows].astype("<u4"), *([hot[rows].astype("<u1")] if columns else []), ids[texts].astype("<i8"), again[texts].astype("<i8")]))
        buckets.append(bucket)
        counts.append(len(rows))

    go = np.flatnonzero(~repeat)
    go = go[np.lexsort((t1[go], t0[go], p[go]))]
    cuts = np.flatnonzero(np.diff(p[go])) + 1
    for rows in np.split(go, cuts) if len(go) else []:
        send(int(p[rows[0]]), rows, [t0, t1, gram.astype("<u4"), digest])
    if repeat.any():
        send(GONE, np.flatnonzero(repeat), [])
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["p", "n", "blob"])


_DEALT = "p long, n long, blob binary"


def _send(ids: np.ndarray, again: np.ndarray, body: np.ndarray, at: np.ndarray, splitters: np.ndarray) -> pa.RecordBatch:
    place, grams, digest = anchors(body, at)
    text = np.searchsorted(at, place, "right") - 1
    t = tokens(body, place, 2)
    return _deal([t[0], t[1], grams >> _U(32), digest, text, place - at[text], np.zeros(len(place), bool), ids, again], splitters, 0)


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of several blobs of anchors as one; texts are numbered on."""
    parts, shift = [], 0
    for blob in blobs:
        c = _unpack(blob, _KINDS)
        c[4] = c[4].astype(np.int64) + shift
        shift += len(c[-1])
        parts.append(c)
    return [np.concatenate(c) for c in zip(*parts)]


def _some_leads(every: int):
    """Leads of the blobs' anchors, one in ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            leads = []
            for blob in b.column(2).to_pylist():
                c = _unpack(blob, _KINDS)
                leads.append(_leads(np.stack(c[:2]))[zlib.crc32(blob) % every :: every].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leads, pa.binary())], ["p", "n", "leads"])

    return run


def _own_splitters(bucket_anchors: int):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's splitters, if it is to be dealt out again."""
        fan = min(FAN, -(-sum(table.column("n").to_pylist()) // bucket_anchors))
        leads = np.sort(np.frombuffer(b"".join(table.column("leads").to_pylist()), "S16"))
        found = leads[np.linspace(0, len(leads) - 1, fan + 1).astype(int)[1:-1]] if fan > 1 and len(leads) else leads[:0]
        return pa.table({"of": table.column("p").slice(0, 1), "splitters": pa.array([found.tobytes()], pa.binary())})

    return run


def _deal_again(chunk_anchors: int):
    """Blobs, in order of their buckets, to smaller buckets: several of one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n, splitters = None, [], 0, np.zeros(0, "S16")

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield _deal(_joined(held), splitters, last * FAN)
                held.clear()

        for b in batches:
            for p, size, blob, own in zip(*(c.to_pylist() for c in b.columns)):
                if p != last or n >= chunk_anchors:
                    yield from flush()
                    n = 0
                if p != last:
                    last, splitters = p, np.frombuffer(own or b"", "S16")
                held.append(blob)
                n += size
        yield from flush()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with CHUNK_BYTES of text, or one longer row."""
    hold("suffix_dedup", _powers.clear)
    for b in batches:
        body, at = utf8_view(b.column(b.schema.get_field_index("text")))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            yield b.slice(i, j - i), body[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def _messages(ids: np.ndarray, again: np.ndarray, covered: np.ndarray, text: np.ndarray, place: np.ndarray, names=("covered", "asked")) -> pa.Table:
    """A row for each document with the places of its covered and asked-for anchors."""
    order = np.lexsort((place, ~covered, again[text], ids[text]))
    d, a, c, p = ids[text][order], again[text][order], covered[order], place[order].astype(np.int64)
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1])]) if len(d) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    doc = np.cumsum(new) - 1
    lists = []
    for kind in (True, False):
        n = np.bincount(doc[c == kind], minlength=len(starts))
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(p[c == kind])))
    return pa.table({"id": pa.array(d[starts]), "again": pa.array(a[starts].astype(np.int64)), names[0]: lists[0], names[1]: lists[1]})


#: Places asked for are doubled, and odd if their lead is frequent.
_MESSAGES = "id long, again long, covered array<long>, asked array<long>"


def _sort_bucket(blobs: list[bytes]) -> pa.Table:
    t0, t1, gram, digest, text, place, hot, ids, again = _joined(blobs)
    order = multikey_order([t0, t1, gram, digest, ids[text], again[text], place])
    same_gram = np.zeros(len(order), bool)
    x, y = order[1:], order[:-1]
    same_gram[1:] = (t0[x] == t0[y]) & (t1[x] == t1[y]) & (gram[x] == gram[y])
    covered = same_gram.copy()
    covered[1:] &= digest[x] == digest[y]
    group = np.cumsum(~same_gram) - 1
    contexts = np.bincount(group, ~covered, minlength=1)
    asked = ~covered & ((contexts[group] > 1) | (hot[order] > 0))
    use = covered | asked
    rows, covered = order[use], covered[use]
    at = place[rows].astype(np.int64)
    return _messages(ids, again, covered, text[rows], np.where(covered, at, 2 * at + hot[rows]))


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order of their buckets: a bucket at a time."""
    hold("suffix_dedup", _powers.clear)
    last, held = None, []
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if p == GONE:
                text, place, ids, again = _unpack(blob, _GONE_KINDS)
                yield from _messages(ids, again, np.ones(len(text), bool), text, place).to_batches()
                continue
            if p != last and held:
                yield from _sort_bucket(held).to_batches()
                held = []
            last = p
            held.append(blob)
    if held:
        yield from _sort_bucket(held).to_batches()


#: Offsets of one class, where a frequent lead's contexts are dealt out by what their windows share; and the mark of all.
CLASS_OFFSETS, ALL = 8, 255


def _hash_columns(context: np.ndarray, lo: int, hi: int) -> np.ndarray:
    h = np.zeros(len(context), np.uint64)
    for j in range(lo, hi):
        h = h * _STEP + _BYTES[context[:, j]]
    return h


# -- contexts that are asked for -------------------------------------------------------------------------------------


def _cut(groups: int):
    """The contexts of asked-for anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = REACH + LENGTH
        for b, body, at in _chunks(batches):
            asked = b.column(3)
            text = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            own = asked.flatten().to_numpy()
            padded = np.concatenate([np.zeros(REACH, np.uint8), body, np.zeros(LENGTH, np.uint8)])
            for lo in range(0, len(own), 20_000):
                k, a, frequent = text[lo : lo + 20_000], own[lo : lo + 20_000] >> 1, own[lo : lo + 20_000] % 2 > 0
                context = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[at[k] + a])
                left, right = np.minimum(a, REACH), np.minimum(at[k + 1] - at[k] - a, LENGTH)
                column = np.arange(width)
                context[(column < REACH - left[:, None]) | (column >= REACH + right[:, None])] = 0
                t = np.ascontiguousarray(context[:, REACH : REACH + K]).view(">u8").astype(np.uint64).T
                gram = mix(t[0] ^ mix(t[1] ^ mix(t[2] ^ mix(t[3]))))
                places = [(np.flatnonzero(~frequent), gram[~frequent], ALL)]
                for first in range(0, REACH + 1, CLASS_OFFSETS) if frequent.any() else ():
                    last = min(first + CLASS_OFFSETS - 1, REACH)
                    rows = np.flatnonzero(frequent & (left >= first) & (right >= LENGTH - last))
                    # What all windows of the class share; windows that are equal agree on it.
                    shared = _hash_columns(context[rows], REACH - first, REACH + LENGTH - last)
                    places.append((rows, mix(shared ^ _U(first)), first))
                for m, h, first in places:
                    if len(m):
                        flat = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, width * len(m) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(context[m]))])
                        numbers = (h % _U(groups), left[m], right[m], b.column(0).to_numpy()[k[m]], b.column(1).to_numpy()[k[m]], a[m], np.full(len(m), first))
                        yield pa.RecordBatch.from_arrays([flat, *(pa.array(x.astype(np.int64)) for x in numbers)], ["context", "p", "left", "right", "id", "again", "place", "first"])

    return run


_CONTEXTS = "context binary, p long, left long, right long, id long, again long, place long, first long"


def repeated_windows(context: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset before the anchor of windows with an earlier equal; -1 if there are none.

    Rows are in the corpus' order within a group; only rows of a group are compared, at all offsets or those of
    the class that begins with ``first``.
    """
    n = len(group)
    least, most = np.full(n, -1), np.full(n, -1)
    up, down = _tables()
    values = lambda j: _BYTES[context[:, j]]
    h = np.zeros(n, np.uint64)
    for j in range(REACH, REACH + LENGTH):  # offset 0
        h = h * up[1] + values(j)
    salt = mix(group.astype(np.uint64) + _U(1))
    for o in range(REACH + 1):
        if o:
            h = (h - values(REACH + LENGTH - o)) * down[1] + values(REACH - o) * up[LENGTH - 1]
        rows = np.flatnonzero((left >= o) & (right >= LENGTH - o) & ((first == ALL) | (first == o - o % CLASS_OFFSETS)))
        x = mix(h[rows]) ^ salt[rows]
        order = np.argsort(x, kind="stable")
        again = rows[order[1:][x[order[1:]] == x[order[:-1]]]]
        most[again] = o
        least[again[least[again] < 0]] = o
    return least, most


def _compare(table: pa.Table) -> pa.Table:
    hold("suffix_dedup", _powers.clear)
    left, right, ids, again, place, first = (table.column(c).to_numpy() for c in ("left", "right", "id", "again", "place", "first"))
    context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, REACH + LENGTH)
    gram = np.ascontiguousarray(context[:, REACH : REACH + K]).view(">u8").astype(np.uint64)
    order = multikey_order([*gram.T, first, ids, again, place])
    g = np.concatenate([gram, first[:, None].astype(np.uint64)], axis=1)[order]
    group = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]).any(1)])) - 1
    use = np.bincount(group)[group] > 1
    order, group = order[use], group[use]
    least, most = repeated_windows(context[order], left[order], right[order], group, first[order])
    hit = most >= 0
    rows = order[hit]
    return pa.table({"id": ids[rows], "again": again[rows], "lo": place[rows] - most[hit], "hi": place[rows] - least[hit] + LENGTH})


# -- the operator ----------------------------------------------------------------------------------------------------


def _runs(n: int, covered: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    lo = np.concatenate([np.maximum(covered - REACH, 0), lo])
    hi = np.concatenate([np.minimum(covered + LENGTH, n), hi])
    out: list[list[int]] = []
    for i in np.argsort(lo, kind="stable").tolist():
        if out and lo[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(hi[i]))
        else:
            out.append([int(lo[i]), int(hi[i])])
    return [(a, b) for a, b in out]


def _numbered(docs: DataFrame) -> DataFrame:
    """id, again and row (all columns): rows of one id are told apart, in order of a hash of their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    most = docs.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    if most is None or most == 1:
        return docs.select(key, F.lit(0).cast("long").alias("again"), row)
    # Sorted as a whole, so that rows of a frequent id lie in several partitions; numbers rise along the order.
    order = ["id", "h", "salt"]
    own = docs.select(key, row, F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("salt"))
    return materialize(own.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.monotonically_increasing_id().alias("again"), "row"))


def dealers(n_bytes: int, buckets: int) -> int:
    """Tasks for each bucket that is dealt out again: a task gets DEAL_BYTES of the texts, whatever their size."""
    return max(1, -(-n_bytes // (buckets * DEAL_BYTES)))


def dealt(texts: DataFrame, n_bytes: int) -> DataFrame:
    """The anchors of texts (id, again, text) as blobs of buckets p."""
    share = int(1_000_000 * min(1.0, SAMPLE_DOCS / max(1, texts.count()))) + 1

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, at in _chunks(batches):
            place, _, _ = anchors(body, at)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _leads(tokens(body, place[::SAMPLE_EVERY], 2))], pa.binary())], ["lead"])

    buckets = max(1, -(-n_bytes // BUCKET_BYTES), min(LEAST_BUCKETS, n_bytes * LEAST_BUCKETS // BUCKET_BYTES))
    splitters = np.zeros(0, "S16")
    if buckets > 1:
        sample = texts.where(F.pmod(F.xxhash64("id", "again"), F.lit(1_000_000)) < share).mapInArrow(lead, "lead binary")
        leads = np.sort(np.array([bytes(r["lead"]) for r in sample.orderBy(F.xxhash64("lead")).limit(SAMPLE_EACH * SAMPLE_DOCS).collect()], "S16"))
        if len(leads):
            splitters = leads[np.linspace(0, len(leads) - 1, min(FAN, buckets) + 1).astype(int)[1:-1]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, body, at in _chunks(batches):
            yield _send(b.column(0).to_numpy(), b.column(1).to_numpy(), body, at, splitters)

    sent = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(send, _DEALT)
    bucket_anchors, reached = max(1, BUCKET_BYTES // ANCHOR_BYTES), FAN
    while reached < buckets:
        sent = materialize(sent)
        total = sent.where(F.col("p") != GONE).agg(F.sum("n")).head()[0] or 0
        reached *= FAN
        every = max(1, total // (SAMPLE_EACH * min(reached, buckets)))
        some = sent.where(F.col("p") != GONE).mapInArrow(_some_leads(every), "p long, n long, leads binary")
        own = some.groupBy("p").applyInArrow(_own_splitters(bucket_anchors), "of long, splitters binary")
        there = sent.where(F.col("p") != GONE)
        # On the second level buckets are at most FAN, with FAN splitters each; blobs of a bucket go to several tasks then.
        own = own.withColumnRenamed("of", "p")
        there = there.join(F.broadcast(own) if reached == FAN * FAN else own, "p", "left").select("p", "n", "blob", "splitters")
        again = there.repartition("p", F.pmod(F.xxhash64("blob"), F.lit(dealers(n_bytes, reached // FAN)))).sortWithinPartitions("p").mapInArrow(_deal_again(CHUNK_BYTES // ANCHOR_BYTES), _DEALT)
        sent = sent.where(F.col("p") == GONE).unionByName(again)
    return sent


def marked(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) with covered, lo and hi, from which the removed byte spans follow."""
    own = _numbered(short_batches(docs))
    texts = own.select("id", "again", F.col("row")["text"].alias("text"))
    n_bytes = int(texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0)
    # 1. Anchors to buckets. 2. Sorted buckets; what is covered already is spread over all tasks.
    sent = dealt(texts, n_bytes)
    messages = materialize(sent.repartition("p", F.when(F.col("p") == GONE, F.xxhash64("blob"))).sortWithinPartitions("p").mapInArrow(_sort_buckets, _MESSAGES))
    # 3. Contexts that were asked for.
    asked = messages.where(F.size("asked") > 0).groupBy("id", "again").agg(F.flatten(F.collect_list("asked")).alias("asked"))
    wanted = texts.join(asked.hint("shuffle_hash"), ["id", "again"]).select("id", "again", "text", "asked")
    found = wanted.mapInArrow(_cut(max(1, -(-n_bytes // BUCKET_BYTES))), _CONTEXTS).groupBy("p").applyInArrow(_compare, "id long, again long, lo long, hi long")
    marks = messages.where(F.size("covered") > 0).select("id", "again", "covered", F.array().cast("array<long>").alias("lo"), F.array().cast("array<long>").alias("hi"))
    marks = marks.unionByName(found.select("id", "again", F.array().cast("array<long>").alias("covered"), F.array("lo").alias("lo"), F.array("hi").alias("hi")))
    marks = marks.groupBy("id", "again").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("covered", "lo", "hi")])
    return own.join(marks.hint("shuffle_hash"), ["id", "again"], "left").select("row", "covered", "lo", "hi")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, list[tuple[int, int]]]]]]:
    """Rows with their texts and removed runs."""
    for b, body, at in _chunks(batches):
        lists = [b.column(c).to_pylist() for c in (2, 3, 4)]
        raw, out = body.tobytes(), []
        for i, (c, lo, hi) in enumerate(zip(*lists)):
            text = raw[at[i] : at[i + 1]]
            out.append((text, _runs(len(text), *(np.array(x or [], np.int64) for x in (c, lo, hi))) if c or lo else []))
        yield b, out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return text
    edges = [0, *(e for r in runs for e in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _each(batches):
            n = [len(t) for t, _ in rows]
            gone = [sum(y - x for x, y in r) for _, r in rows]
            sha = [hashlib.sha256(_kept(t, r)).hexdigest() for t, r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for _, r in rows], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = marked(docs.select("doc_id", "text")).select(F.col("row")["doc_id"].cast("long").alias("doc_id"), F.col("row")["text"].alias("text"), "covered", "lo", "hi")
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """The documents with the repeated bytes taken out of text; a character that lost some of its bytes goes too."""
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _each(batches):
            columns = b.column(0).flatten()
            columns[k] = pa.array([_kept(t, r).decode("utf-8", "ignore") if there else None for there, (t, r) in zip(columns[k].is_valid().to_pylist(), rows)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    own = marked(docs).select("row", F.col("row")["text"].alias("text"), "covered", "lo", "hi")
    return own.mapInArrow(run, docs.schema)
