"""Exact repeats of a fixed length, from sparse suffixes.

A window is ``width`` consecutive tokens (bytes or words) of one document.  Every
window holds ``width - seed + 1`` seeds of ``seed`` tokens; its *anchor* is the
leftmost one with the least hash, so equal windows have equal anchors at equal
offsets.  Neighbouring windows share anchors: a *run* is a maximal stretch of
windows with one anchor, and only runs, about one for ``width - seed`` / 2
tokens, are ever moved:

1. a window holds its anchor and, on one side of it at least, half of its other
   tokens: this *extension* of the anchor, to the left if there is room, else to
   the right, is the window's key.  Every chunk asks how many chunks hold each
   key's hash (sorted, truncated to a size that leaves few false hits; those only
   cost time).  Anchors recur by chance in a large corpus, extensions hardly do;
2. windows whose key recurs are sent, by runs, as suffixes with their context to
   the bucket of their leading tokens, equal ones of a chunk once;
3. the bucket sorts the suffixes, and answers per window.

A key that very many chunks hold (a common line) would bring all its contexts
into one bucket; its windows are sent one by one, dealt by their whole content and
counted once per chunk.  So no bucket holds more than a bounded number of
contexts, and nothing is dropped.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import exchange as X

HOT_CHUNKS = 64
SLICE = 1_000_000
LEAD = 24
U = np.uint64
_MIX = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)]
_P = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * _MIX[3]
        x = (x ^ (x >> U(29))) * _MIX[4]
        return x ^ (x >> U(32))


def _powers(n: int, p: int) -> np.ndarray:
    """p ** 0 .. p ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(1, U)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * U(pow(p, len(out), 1 << 64))])
    return out[:n]


_P_INVERSE = pow(_P, -1, 1 << 64)
LONG_WORD = 64  #: words of more eights of bytes are hashed one by one
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words_of(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE):
    """Words of rows laid end to end: (start, end, first word of each row), a word being a run of bytes that aren't separators."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~separator[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each word: its bytes by eights, mixed after each; equally long words of up to eight bytes never share one."""
    size = ends - starts
    out = mix(size.astype(U) * _MIX[1] + _MIX[0])
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    left = np.arange(len(starts))
    for k in range(LONG_WORD):
        if not len(left):
            return out
        rest = size[left] - 8 * k
        with np.errstate(over="ignore"):
            out[left] = mix((out[left] ^ (eights[starts[left] + 8 * k] & _MASK[np.minimum(rest, 8)])) * _MIX[0] + _MIX[2])
        left = left[rest > 8]
    for i in left.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


@dataclass(frozen=True)
class Repeats:
    """What counts as a token, a window and a repeat. kind: bytes or words; least: a window repeats where a smaller id holds it, else where it is anywhere twice."""

    kind: str
    width: int
    seed: int
    least: bool
    hot: int = HOT_CHUNKS  #: windows whose key is in more chunks are sent one by one

    @property
    def w(self) -> int:
        return self.width - self.seed + 1

    @property
    def span(self) -> int:
        return self.width + self.w - 1

    def tokens(self, raw: np.ndarray, at: np.ndarray):
        if self.kind == "bytes":
            return raw, at, None, None
        starts, ends, first = words_of(raw, at)
        return word_hashes(raw, starts, ends), first, starts, ends

    def seeds(self, t: np.ndarray) -> np.ndarray:
        """The hash of the seed that begins at each token."""
        n = len(t) - self.seed + 1
        with np.errstate(over="ignore"):
            if self.kind == "bytes":
                t = np.ascontiguousarray(t)
                eight = np.ndarray((len(t) - 7,), "<u8", t.data, strides=(1,))
                h = np.zeros(n, U)
                for i, p in enumerate([*range(0, self.seed - 8, 8), self.seed - 8]):
                    h = (h ^ eight[p : p + n]) * _MIX[i % 3]
                    h ^= h >> U(31)
                return mix(h)
            power = _powers(len(t) + 1, _P)
            total = np.zeros(len(t) + 1, U)
            np.cumsum(t * power[:-1], out=total[1:])
            return mix((total[self.seed :] - total[: -self.seed]) * _powers(n, _P_INVERSE))

    def runs(self, t: np.ndarray, at: np.ndarray):
        """Every window of every row by run: (first window, windows, anchor's hash, tokens from the first window to the anchor)."""
        found = []
        a = 0
        while a + self.width <= len(t):  # slices overlap by a window less a token, so that each window is in one
            b = min(len(t), a + SLICE + self.width - 1)
            found.append(self._runs(t[a:b], at, a))
            a += SLICE
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, U), z
        return tuple(np.concatenate(x) for x in zip(*found))

    def _runs(self, t: np.ndarray, at: np.ndarray, base: int):
        h = self.seeds(t)
        least = sliding(h, self.w, np.minimum)
        n = len(least)
        valid = np.ones(n, bool)
        for e in at[np.searchsorted(at, base, "right") : np.searchsorted(at, base + n + self.width)]:  # no window crosses into the row that begins at e
            valid[max(0, e - self.width + 1 - base) : max(0, e - base)] = False
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | begin[1:]
        first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        off = np.empty(len(first), np.int64)
        near = np.lib.stride_tricks.sliding_window_view(h, self.w)
        for i in range(0, len(first), 200_000):
            off[i : i + 200_000] = near[first[i : i + 200_000]].argmin(axis=1)
        return first + base, last - first, h[first + off], off

    @property
    def more(self) -> int:
        """Tokens of an extension besides the anchor's."""
        return (self.width - self.seed + 1) // 2

    def keys(self, t: np.ndarray, first: np.ndarray, length: np.ndarray, off: np.ndarray):
        """Of each run: how many windows are keyed by the extension to the left (the others are by that to the right), and both hashes (where no window needs one, it is not to be used)."""
        left = np.clip(off - self.more + 1, 0, length)
        size = self.seed + self.more
        out = []
        for tag, shift in ((1, -self.more), (2, 0)):
            h = np.zeros(len(first), U)
            use = np.flatnonzero(left > 0 if tag == 1 else left < length)
            every = np.lib.stride_tricks.sliding_window_view(t, size) if len(t) >= size else None
            for i in range(0, len(use), 100_000):
                at = use[i : i + 100_000]
                h[at] = mix(row_hash(columns(every[first[at] + off[at] + shift])) ^ _MIX[tag])
            out.append(h)
        return left, *out

    def contexts(self, t: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A row of ``span`` tokens for each run, zero beyond its last window."""
        if len(t) < self.span:
            t = np.concatenate([t, np.zeros(self.span, t.dtype)])
        start = np.minimum(first, len(t) - self.span)
        out = np.lib.stride_tricks.sliding_window_view(t, self.span)[start]
        late = np.flatnonzero(start != first)
        for i in late:
            out[i] = np.concatenate([out[i][first[i] - start[i] :], np.zeros(first[i] - start[i], t.dtype)])
        out[np.arange(self.span) >= (length + self.width - 1)[:, None]] = 0
        return out


def columns(rows: np.ndarray) -> np.ndarray:
    """Rows of tokens as 64-bit columns whose order is the tokens'."""
    if rows.dtype == U:
        return rows
    pad = -rows.shape[1] % 8
    rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad))) if pad else rows)
    return rows.view(">u8").astype(U)


def row_hash(cols: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cols), U)
    with np.errstate(over="ignore"):
        for c in range(cols.shape[1]):
            h = (h ^ cols[:, c]) * _MIX[c % 3]
            h ^= h >> U(29)
    return mix(h)


def multikey(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, one 64-bit character after another: only rows tied so far are looked at again.

    Returns the order, and for each place how many columns it shares with the place before it (a common prefix)."""
    n, width = cols.shape
    order = np.argsort(cols[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    common = np.zeros(n, np.int32)
    if not n:
        return order, common
    key = cols[order, 0]
    common[1:] = key[1:] == key[:-1]
    for c in range(1, width):
        tied = common == c
        part = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(part):
            break
        value = cols[order[part], c]
        group = np.cumsum(~tied[part])
        by = np.lexsort((value, group))
        order[part] = order[part[by]]
        value = value[by]
        group = group[by]
        same = np.zeros(len(part), bool)
        same[1:] = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        common[part[same]] = c + 1
    return order, common


def groups_of(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal content: an order that brings them together and where each group begins. Compared in full; a clash of hashes could only split a group of bit-equal rows."""
    order = np.argsort(row_hash(cols), kind="stable")
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 500_000):
        part = cols[order[a - 1 : a + 500_000]]
        new[a : a + 500_000] = (part[1:] != part[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def merge(values: np.ndarray, starts: np.ndarray, least: bool) -> np.ndarray:
    return (np.minimum if least else np.add).reduceat(values, starts) if len(values) else values


def expand(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window within it) for all windows of runs."""
    run = np.repeat(np.arange(len(length)), length)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)


def window_rows(rows: np.ndarray, run: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(run), width), rows.dtype)
    for s in range(int(shift.max()) + 1 if len(shift) else 0):
        at = np.flatnonzero(shift == s)
        out[at] = rows[run[at], s : s + width]
    return out


# ---- stage 1: which keys recur


def hash_bits(n_bytes: int) -> int:
    """Enough for one false hit in about 2 ** 13 keys."""
    return min(64, max(32, math.ceil(math.log2(max(n_bytes, 2))) + 11))


def _bounds(buckets: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // buckets for i in range(1, buckets)], dtype=U)


def _run_keys(spec: Repeats, t: np.ndarray, at: np.ndarray, bits: int):
    """Runs (first, length, off, windows keyed to the left), the sorted keys of a chunk, how often each occurs, and which of them are each run's (left, then right; -1: none)."""
    first, length, _, off = spec.runs(t, at)
    left, to_left, to_right = spec.keys(t, first, length, off)
    has = np.concatenate([left > 0, left < length])
    keys, of, here = np.unique(np.concatenate([to_left, to_right])[has] >> U(64 - bits), return_inverse=True, return_counts=True)
    which = np.full(len(has), -1)
    which[has] = of
    return first, length, off, left, keys, here, which[: len(first)], which[len(first) :]


def ask_keys(spec: Repeats, buckets: int, bits: int, text: str):
    def ask(batch):
        raw, at = X.text_buffer(batch.column(text))
        t, at, _, _ = spec.tokens(raw, at)
        keys = _run_keys(spec, t, at, bits)[4]
        cut = [0, *np.searchsorted(keys, _bounds(buckets, bits)), len(keys)]
        for i in range(buckets):
            if cut[i + 1] > cut[i]:
                part = keys[cut[i] : cut[i + 1]]
                yield i, X.pack_planes(np.diff(part, prepend=U(0)))

    return ask


def answer_keys(spec: Repeats, blobs: list[bytes]) -> list[bytes]:
    """0: in one chunk, 1: in several, 2: in very many."""
    parts = [np.cumsum(X.unpack_planes(b, "<u8")) for b in blobs]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    key = every[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(starts, len(key)))
    code = np.empty(len(key), np.uint8)
    code[order] = np.repeat(np.where(count > spec.hot, 2, np.where(count > 1, 1, 0)).astype(np.uint8), count)
    cut = np.cumsum([0, *map(len, parts)])
    return [X.pack(code[a:b]) for a, b in zip(cut[:-1], cut[1:])]


# ---- stage 2: the suffixes of a chunk that recur


@dataclass
class Suffixes:
    """Distinct runs of a chunk: content, windows, tokens before the anchor, and what is merged over equal ones (the least id, or how many); of: which of them each run is."""

    rows: np.ndarray
    length: np.ndarray
    off: np.ndarray
    value: np.ndarray
    first: np.ndarray
    of: np.ndarray
    hot: np.ndarray


def suffixes(spec: Repeats, batch, got: dict[int, bytes], bits: int, text: str, ids: str | None) -> Suffixes | None:
    """The same every time it is called for a chunk, so that answers find their windows again."""
    raw, at = X.text_buffer(batch.column(text))
    t, at, _, _ = spec.tokens(raw, at)
    first, length, off, left, keys, here, to_left, to_right = _run_keys(spec, t, at, bits)
    if not len(first):
        return None
    code = np.concatenate([np.frombuffer(X.unpack(got[b]), np.uint8) for b in sorted(got)])
    code = np.append(np.maximum(code, here > 1), 0)  # the last: no key
    lc, rc = code[to_left], code[to_right]
    begin, end = np.where(lc == 1, 0, left), np.where(rc == 1, length, left)  # calm windows of a run stay together
    calm = np.flatnonzero(end > begin)
    burst, shift = [], []
    for some, a, b in ((np.flatnonzero(lc == 2), np.zeros(len(first), np.int64), left), (np.flatnonzero(rc == 2), left, length)):
        run, j = expand((b - a)[some])
        burst.append(some[run])
        shift.append(a[some[run]] + j)
    single, shift = np.concatenate(burst), np.concatenate(shift)
    if not len(calm) + len(single):
        return None
    length = np.concatenate([(end - begin)[calm], np.ones(len(single), np.int64)])
    first, off = np.concatenate([first[calm] + begin[calm], first[single] + shift]), np.concatenate([off[calm] - begin[calm], off[single] - shift])
    hot = np.concatenate([np.zeros(len(calm), bool), np.ones(len(single), bool)])
    rows = spec.contexts(t, first, length)
    cols = np.concatenate([columns(rows), ((length.astype(U) << U(16)) | (off.astype(U) << U(1)) | hot.astype(U))[:, None]], axis=1)
    order, starts = groups_of(cols)
    del cols
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    if spec.least:
        value = id_values(batch.column(ids))[np.searchsorted(at, first, "right") - 1]
    else:
        value = np.ones(len(first), np.int64)
    value = merge(value[order], starts, spec.least)
    pick = order[starts]
    return Suffixes(rows[pick], length[pick], off[pick], value, first, of, hot[pick])


def id_values(column: pa.Array) -> np.ndarray:
    """Ids as integers; a null id is larger than any."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def lead(spec: Repeats, s: Suffixes) -> np.ndarray:
    """The leading bytes (24, or three words) of each suffix, from its anchor on, as bytes that sort as its tokens do; no more than all suffixes of an anchor share."""
    out = window_rows(s.rows, np.arange(len(s.off)), s.off, min(LEAD, spec.seed) if s.rows.dtype == np.uint8 else LEAD // 8)
    out = np.ascontiguousarray(out if out.dtype == np.uint8 else out.astype(">u8"))
    return out.view(f"S{LEAD}").ravel()


def place(spec: Repeats, s: Suffixes, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each suffix: by its leading tokens, single windows of very common anchors by their whole content."""
    out = np.searchsorted(bounds, lead(spec, s), "right").astype(np.int64)
    hot = np.flatnonzero(s.hot)
    if len(hot):
        out[hot] = (row_hash(columns(s.rows[hot])) % U(buckets)).astype(np.int64)
    return out


def by_bucket(spec: Repeats, s: Suffixes, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by bucket, roughly sorted within (neighbours then compress), and where each bucket begins."""
    where = place(spec, s, bounds, buckets)
    order = np.lexsort((columns(window_rows(s.rows, np.arange(len(s.off)), s.off, 16 if s.rows.dtype == np.uint8 else 2))[:, 0], where))
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


def _encode(s: Suffixes, at: np.ndarray) -> bytes:
    rows = s.rows[at]
    if rows.dtype == np.uint8:
        body, book = rows.tobytes(), b""
    else:  # a vocabulary of the blob's own
        book, code = np.unique(rows, return_inverse=True)
        body, book = X.pack_planes(code.ravel().astype("<u4")), book.tobytes()
    head = np.array([len(at), len(book), len(body)], "<i8").tobytes()
    return X.pack(head + s.length[at].astype(np.uint8).tobytes() + s.off[at].astype(np.uint8).tobytes() + s.hot[at].astype(np.uint8).tobytes() + X.planes(s.value[at].astype("<i8")) + book + body, 3)


def _decode(spec: Repeats, blob: bytes) -> Suffixes:
    raw = X.unpack(blob)
    n, book, body = np.frombuffer(raw, "<i8", 3)
    at = 24
    parts = []
    for size, dtype in ((n, np.uint8), (n, np.uint8), (n, np.uint8), (8 * n, "<i8"), (book, "<u8")):
        parts.append(np.frombuffer(raw, dtype, size // np.dtype(dtype).itemsize, at))
        at += int(size)
    length, off, hot, value, words = parts
    value = X.whole(value.view(np.uint8), "<i8")
    if len(words):
        rows = words[X.unpack_planes(raw[at : at + body], "<u4")].reshape(n, spec.span)
    else:
        rows = np.frombuffer(raw, np.uint8, int(body), at).reshape(n, spec.span)
    return Suffixes(rows, length.astype(np.int64), off.astype(np.int64), value, np.zeros(0), np.zeros(0), hot.astype(bool))


# ---- stage 3: one bucket


def answer_windows(spec: Repeats, tree):
    """For each window of each suffix asked about, what ``tree`` merges over all equal windows of the bucket."""

    def reply(blobs: list[bytes]) -> list[bytes]:
        parts = [_decode(spec, b) for b in blobs]
        sizes = [len(p.length) for p in parts]
        rows = np.concatenate([p.rows for p in parts])
        length, off, value, hot = (np.concatenate([getattr(p, k) for p in parts]) for k in ("length", "off", "value", "hot"))
        del parts
        cols = np.concatenate([columns(rows), ((length.astype(U) << U(16)) | (off.astype(U) << U(1)) | hot.astype(U))[:, None]], axis=1)
        order, starts = groups_of(cols)
        del cols
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        pick = order[starts]
        found = tree(spec, rows[pick], length[pick], off[pick], hot[pick], merge(value[order], starts, spec.least))
        at = np.cumsum(length[pick]) - length[pick]
        run, shift = expand(length)
        every = found[at[of[run]] + shift]
        if not spec.least:
            every = every.astype(np.uint8)
        cut = np.cumsum([0, *(int(length[a : a + n].sum()) for a, n in zip(np.cumsum([0, *sizes[:-1]]), sizes))])
        return [X.pack_planes(every[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    return reply


def ask_windows(spec: Repeats, bounds: np.ndarray, buckets: int, bits: int, text: str, ids: str | None):
    def use(batch, got, chunk_id):
        s = suffixes(spec, batch, got, bits, text, ids)
        if s is None:
            return
        order, cut = by_bucket(spec, s, bounds, buckets)
        which = [i for i in range(buckets) if cut[i + 1] > cut[i]]
        for i in range(0, len(which), 16):
            yield X.row_batch(chunk_id, 1, which[i : i + 16], [_encode(s, order[cut[b] : cut[b + 1]]) for b in which[i : i + 16]])

    return use


def covered(spec: Repeats, batch, anchors: dict[int, bytes], windows: dict[int, bytes], bounds: np.ndarray, buckets: int, bits: int, text: str, ids: str | None):
    """Which tokens a repeated window covers, and the first token of each row."""
    raw, at = X.text_buffer(batch.column(text))
    t, at, _, _ = spec.tokens(raw, at)
    n = len(t)
    change = np.zeros(n + 1, np.int32)
    s = suffixes(spec, batch, anchors, bits, text, ids)
    if s is not None:
        order, _ = by_bucket(spec, s, bounds, buckets)
        got = np.concatenate([X.unpack_planes(windows[b], "<i8" if spec.least else "u1") for b in sorted(windows)])
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(s.length[order]) - s.length[order]
        run, shift = expand(s.length[s.of])
        value = got[begin[s.of[run]] + shift]
        start = s.first[run] + shift
        if spec.least:
            owner = id_values(batch.column(ids))[np.searchsorted(at, start, "right") - 1]
            start = start[value < owner]
        else:
            start = start[value > 0]
        change = np.bincount(start, minlength=n + 1) - np.bincount(start + spec.width, minlength=n + 1)
    return np.cumsum(change[:n]) > 0, at


def bucket_windows(spec: Repeats, rows, length, off, hot, value, sort, seed_columns: int) -> np.ndarray:
    """What is merged over equal windows, for each window of distinct suffixes. ``sort`` orders columns and says how many each shares with the one before."""
    order, common = sort(columns(window_rows(rows, np.arange(len(off)), off, spec.width)))
    new = np.flatnonzero(common < seed_columns)
    size = np.diff(np.append(new, len(order)))
    several = np.zeros(len(order), bool)
    several[order] = np.repeat(size > 1, size)
    at = np.cumsum(length) - length
    out = np.repeat(value, length)
    many = np.flatnonzero(several)
    if len(many):
        run, shift = expand(length[many])
        flat = at[many][run] + shift
        order, common = sort(columns(window_rows(rows[many], run, shift, spec.width)))
        starts = np.flatnonzero(common < columns(rows[:1, : spec.width]).shape[1])
        out[flat[order]] = np.repeat(merge(value[many][run[order]], starts, spec.least), np.diff(np.append(starts, len(order))))
    return out if spec.least else out > 1


def sample_leads(chunks, n_chunks: int, spec: Repeats, text: str, chunks_read: int = 96, each: int = 256) -> np.ndarray:
    """The leading tokens of some suffixes, sorted: at most ``2 * chunks_read * each`` of them, however large the input; they only place bucket bounds."""
    from pyspark.sql import functions as F

    def run(batches):
        for b in batches:
            for data in b.column("data"):
                raw, at = X.text_buffer(X.bytes_batch(data.as_py()).column(text))
                t, at, _, _ = spec.tokens(raw, at)
                if len(t) >= spec.width:
                    first, length, _, off = spec.runs(t, at)
                    if len(first):
                        take = np.linspace(0, len(first) - 1, min(each, len(first))).astype(np.int64)
                        s = Suffixes(spec.contexts(t, first[take], length[take]), length[take], off[take], None, first, None, None)
                        yield pa.RecordBatch.from_pydict({"lead": pa.array([x.ljust(LEAD, b"\0") for x in lead(spec, s).tolist()], pa.binary())})

    step = max(1, n_chunks // chunks_read)
    some = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(step)) == 0)
    return np.sort(np.array([bytes(r[0]) for r in X.arrow(some).mapInArrow(run, "lead binary").collect()], f"S{LEAD}"))


def covered_rows(docs, spec: Repeats, text: str, ids: str | None, boundaries, tree, rewrite, schema):
    """Run the stages over ``docs``. ``boundaries(sorted sample, buckets)`` cuts the suffixes' range, ``tree`` works on a bucket, and ``rewrite(batch, covered, first token of each row)`` makes the result rows of a chunk."""
    chunks, n_chunks, n_bytes = X.make_chunks(docs, text)
    buckets, bits = X.bucket_count(n_bytes), hash_bits(n_bytes)
    keys = X.checkpoint(X.answer(X.scatter(chunks, ask_keys(spec, buckets, bits, text)), lambda blobs: answer_keys(spec, blobs)))
    bounds = boundaries(sample_leads(chunks, n_chunks, spec, text), buckets)
    asked = X.absorb(chunks, keys, ask_windows(spec, bounds, len(bounds) + 1, bits, text, ids), X.CHUNK_SCHEMA)
    windows = X.answer(asked, answer_windows(spec, tree))

    def use(batch, got, chunk_id):
        seen = {b: d for (kind, b), d in got.items() if kind == 2}
        said = {b: d for (kind, b), d in got.items() if kind == 3}
        cover, at = covered(spec, batch, seen, said, bounds, len(bounds) + 1, bits, text, ids)
        yield from rewrite(batch, cover, at)

    return X.absorb_kinds(chunks, [keys, windows], use, schema)
