"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Every string of ``length`` bytes has an anchor: the leftmost of its ``gram``-byte grams with
the least hash. Equal strings have their anchor at the same place, so it is enough to sort
the suffixes that start at anchors (a few in a hundred positions), each with the bytes to
its left behind it. The steps are:

1. One pass finds the anchors; their gram hashes, packed, are dealt by hash, and those seen
   once are dropped.
2. Texts and their repeated anchors meet by document bucket. Each task sorts its anchors'
   suffixes, keeps the earliest of equal ones (the others are repeats at once), and writes
   front-coded runs: the length of the prefix shared with the entry before, and the rest.
   Of grams with more than HOT anchors every string is a suffix of its own, one of each in a
   run, so a passage that very many rows share makes no group large.
3. A sample of the runs gives the borders of ranges. Runs are cut there and exchanged, so the
   buckets are in the order of the suffixes, and each is merged by a loser tree that carries
   common-prefix lengths: two candidates are compared only beyond the prefix that both are
   known to share with the last output.
4. The merge's prefix lengths decide. Two strings whose anchor stands k bytes behind their
   start are equal if no prefix length between their suffixes is below length - k, and their k
   bytes to the left agree, which an order of the left sides tells in the same way. All but
   the earliest of equal strings are repeats. Nothing is compared by hash.
5. Repeats and texts meet by document bucket; covered bytes are removed.

Earlier means a smaller key (null last), or the same row and an earlier start.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernel as K
from quillon.session import store

#: Packed anchors of a bucket, bytes of text of a document bucket, and suffixes of a range, about.
ANCHORS, TEXT_BYTES, SUFFIXES = 500_000, 8_000_000, 150_000
#: Ranges of a small table.
RANGES = 16
#: Anchors of one gram beyond which its strings are sorted one by one, and strings of one run of these.
HOT, RUN_STRINGS = 5000, 200_000
#: Borders that a run proposes, and that the driver takes and broadcasts at most (of `length` bytes each); neither bears on results.
PROPOSED, BORDERS = 64, 50_000
#: Groups that one task works off, one after the other.
TASK_GROUPS = 4
LAST = (1 << 63) - 1


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, row, place in the row, least and greatest offset of an owned string) of each anchor.

    The anchor at place q owns the strings that start at q - hi ... q - lo.
    """
    n, span = len(buf), length - gram + 1
    rows = len(offs) - 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(K.U), z, z, z, z
    p = K.prefix_hash(buf)
    at = np.arange(n - gram + 1)
    h = K.span_hash(p, at, at + gram)
    m, w = h, 1
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < span:
        m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
    # m[s]: the least hash of the string that starts at s; strings must lie within one row
    row = np.repeat(np.arange(rows), np.diff(offs))[: len(m)]
    valid = np.arange(len(m)) + length <= offs[1:][row]
    cut = np.flatnonzero(valid & np.concatenate(([True], (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1])))
    stop = np.flatnonzero(valid & np.concatenate(((m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~valid[1:], [True])))
    if not len(cut):
        z = np.zeros(0, np.int64)
        return z.astype(K.U), z, z, z, z
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    q = cut + view[cut].argmin(1)
    first, last = cut, np.minimum(stop, q)
    more = np.flatnonzero(q < stop)  # a gram that recurs within one string
    if len(more):
        xs, fs, ls = [q], [first], [last]
        for i in more:
            e = int(q[i]) + 1 + np.flatnonzero(h[q[i] + 1 : stop[i] + span] == m[cut[i]])
            f = np.concatenate(([q[i] + 1], e[:-1] + 1))
            ok = f <= stop[i]
            xs.append(e[ok])
            fs.append(f[ok])
            ls.append(np.minimum(e[ok], stop[i]))
        q, first, last = np.concatenate(xs), np.concatenate(fs), np.concatenate(ls)
    r = row[first]
    return h[q], r, q - offs[r], q - last, q - first


def _find(length: int, gram: int, buckets: int, doc_buckets: int):
    def pack(parts: list) -> pa.RecordBatch:
        v, d, q, lo, hi = (np.concatenate(x) for x in zip(*parts))
        at = (v >> K.U(40)) % K.U(buckets)
        order = np.argsort(at, kind="stable")
        at = at[order]
        rec = np.zeros(len(v), REC)
        rec["v"], rec["d"], rec["db"], rec["q"], rec["lo"], rec["hi"] = v, d >> K.U(32), d.view(np.int64) % doc_buckets, q, lo, hi
        rec = rec[order]
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(cut[1:], len(at))
        return pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int64)), pa.array([_columns(rec[a:e]) for a, e in zip(cut, ends)], pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            buf, offs = K.column_bytes(b.column("text"))
            dh = b.column("dh").to_numpy(zero_copy_only=False).view(K.U)
            for i, j in K.chunks(offs):
                v, r, q, lo, hi = anchors(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram)
                parts.append((v, dh[i + r], q, lo, hi))
                held += len(v)
            if held >= 1_000_000:
                yield pack(parts)
                parts, held = [], 0
        if held:
            yield pack(parts)
        parts.clear()
        K.settle()

    return run


#: An anchor on its way: low bits of the gram hash, high bits of the row hash, document bucket, place, offsets.
REC = np.dtype([("v", "u4"), ("d", "u4"), ("db", "u4"), ("q", "u4"), ("lo", "u2"), ("hi", "u2"), ("hot", "u1")])


def _columns(rec: np.ndarray) -> bytes:
    """Field by field, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(rec[k]).tobytes() for k in rec.dtype.names)


def _rows(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for k in kind.names:
        size = n * kind[k].itemsize
        out[k] = np.frombuffer(data[at : at + size], kind[k])
        at += size
    return out


def _split(rec: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    by, rec = by[order], rec[order]
    cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else []
    for a, e in zip(cut, [*cut[1:], len(by)]):
        yield int(by[a]), rec[a:e]


def _repeated(hot: int):
    def run(table: pa.Table) -> pa.Table:
        return _shared_anchors(table, hot)

    return run


def _shared_anchors(table: pa.Table, hot: int) -> pa.Table:
    K.settle()
    rec = np.concatenate([_rows(x, REC) for x in table.column("data").to_pylist()])
    rec = rec[np.argsort(rec["v"], kind="stable")]
    v = rec["v"]
    same = v[1:] == v[:-1]
    keep = np.zeros(len(v), bool)
    keep[1:] |= same
    keep[:-1] |= same
    cut = np.flatnonzero(np.concatenate(([True], ~same))) if len(v) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(v)))
    rec["hot"] = np.repeat(n > hot, n)
    out = list(_split(rec[keep], rec["db"][keep]))
    return pa.table({"db": pa.array([x for x, _ in out], pa.int64()), "data": pa.array([_columns(x) for _, x in out], pa.binary())})


#: Repeated strings of a row: those that start at start ... stop - 1.
MARK = np.dtype([("dh", "i8"), ("start", "u4"), ("stop", "u4")])
#: A suffix of a run: prefix shared with the one before, length of the rest, offsets, row, place.
ENTRY = np.dtype([("lcp", "u2"), ("rest", "u2"), ("lo", "u2"), ("hi", "u2"), ("key", "i8"), ("dh", "i8"), ("q", "u4")])
#: kind 0: MARKs; 1: a run of suffixes; 2: a run of single strings. sample: prefixes, of gram or length bytes.
RUNS = "kind byte, bucket long, data binary, tails binary, n long, sample binary"


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which the first ``known`` bytes are not looked at."""
    n = min(len(x), len(y)) - known
    a, b = x[known : known + n], y[known : known + n]
    if a == b:
        return known + n
    return known + n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def front_code(entries: list[tuple]) -> tuple[bytes, bytes]:
    """(ENTRY columns, tails) of sorted (suffix, lo, hi, key, dh, q)."""
    rec, tails, before = np.empty(len(entries), ENTRY), [], b""
    for i, (s, lo, hi, key, dh, q) in enumerate(entries):
        c = common_prefix(before, s)
        rec[i] = (c, len(s) - c, lo, hi, key, dh, q)
        tails.append(s[c:])
        before = s
    return _columns(rec), b"".join(tails)


def decode(data: bytes, tails: bytes) -> Iterator[tuple]:
    """(lcp, suffix, lo, hi, key, dh, q) in order."""
    at, s = 0, b""
    for lcp, rest, lo, hi, key, dh, q in _rows(data, ENTRY).tolist():
        s = s[:lcp] + tails[at : at + rest]
        at += rest
        yield lcp, s, lo, hi, key, dh, q


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs; each item comes with its prefix shared with the item before."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    runs = [iter(r) for r in runs]
    head = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k  # shared with the last output
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes the prefix that it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        s, t = x[1], y[1]
        c = common_prefix(s, t, lcp[a])
        if c == len(s) == len(t):
            first = x[2:] <= y[2:]
        else:
            first = c == len(s) or c < len(t) and s[c] < t[c]
        w, z = (a, b) if first else (b, a)
        lcp[z] = c
        return w, z

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, z = play(build(2 * node), build(2 * node + 1))
        loser[node] = z
        return w

    w = build(1) if k > 1 else 0
    while head[w] is not None:
        x = head[w]
        yield (lcp[w], *x[1:])
        head[w] = next(runs[w], None)
        lcp[w] = head[w][0] if head[w] is not None else 0
        node = (w + k) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2


def _sample(rows: list[bytes], size: int) -> bytes:
    step = -(-len(rows) // PROPOSED)
    return b"".join(x[:size] for x in rows[step // 2 :: step])


def _runs(length: int, gram: int, doc_buckets: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        K.settle()  # what the group before has freed
        marks, best, at_row, many = [], {}, {}, set()
        if len(found) and len(texts):
            rec = np.unique(np.concatenate([_rows(x, REC) for x in found.column("data").to_pylist()])[["d", "q", "lo", "hi", "hot"]])
            keys, dhs, col = texts.column("key").to_pylist(), texts.column("dh").to_pylist(), texts.column("text")
            for r, dh in enumerate(dhs):
                at_row.setdefault((dh & 0xFFFFFFFFFFFFFFFF) >> 32, {})[dh] = r
            cut = np.flatnonzero(np.concatenate(([True], rec["d"][1:] != rec["d"][:-1])))
            lists = {int(rec["d"][a]): rec[a:e][["q", "lo", "hi", "hot"]].tolist() for a, e in zip(cut, [*cut[1:], len(rec)])}
            todo = sorted((keys[r], dh, r, d) for d in lists for dh, r in at_row.get(d, {}).items())
            for key, dh, r, d in todo:
                t = (col[r].as_py() or "").encode()
                for q, lo, hi, hot in lists[d]:
                    if q < hi or q - lo + length > len(t):
                        continue  # of another row whose hash begins alike
                    s = t[q : q + length - lo] + t[q - hi : q][::-1]
                    if hot:
                        many.add((s, lo, hi))
                    if best.setdefault((s, lo, hi), (key, dh, q)) != (key, dh, q):
                        marks.append((dh, q - hi, q - lo + 1))
        out: list[tuple] = []
        m = [np.array(marks, MARK)]
        for rec, tails, sample, own in _string_runs([(*x, *best.pop(x)) for x in many], length):
            out.append((2, None, K.squeeze(_columns(rec)), K.squeeze(tails), len(rec), sample))
            m.append(own)
        m = np.concatenate(m)
        out += [(0, b, _columns(x), None, None, None) for b, x in _split(m, m["dh"] % doc_buckets)]
        entries = sorted((s, lo, hi, key, dh, q) for (s, lo, hi), (key, dh, q) in best.items())
        if entries:
            out.append((1, None, *map(K.squeeze, front_code(entries)), len(entries), _sample([x[0] for x in entries], gram)))
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, (pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["kind", "bucket", "data", "tails", "n", "sample"])

    return run


def _string_runs(items: list[tuple], length: int) -> Iterator[tuple]:
    """(ENTRYs, tails, sample, MARKs) of runs of the strings that the items own, each a suffix of its own.

    A run keeps the earliest of equal strings; the others are repeats at once.
    """
    items = sorted(items, key=lambda x: x[3:])
    while items:
        n, take = 0, 0
        while take < len(items) and (not take or n < RUN_STRINGS):
            n += items[take][2] - items[take][1] + 1
            take += 1
        part, items = items[:take], items[take:]
        text = np.frombuffer(b"".join(s[: length - lo - 1 : -1] + s[: length - lo] for s, lo, *_ in part), np.uint8)
        size = np.array([x[2] - x[1] + 1 for x in part], np.int64)
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        item = np.repeat(np.arange(len(part)), size)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        rows = np.lib.stride_tricks.sliding_window_view(text, length)[begin[item] + nth]
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
        rows = rows[order]
        lcp = _row_prefix(rows)
        first = lcp < length
        mark = np.zeros(len(order), bool)
        mark[order[~first]] = True
        own, rows, lcp = order[first], rows[first], lcp[first]
        rec = np.empty(len(own), ENTRY)
        start = np.array([x[5] - x[2] for x in part], np.int64)[item[own]] + nth[own]
        rec["lcp"], rec["rest"], rec["lo"], rec["hi"], rec["q"] = lcp, length - lcp, 0, 0, start
        rec["key"], rec["dh"] = np.array([x[3] for x in part], np.int64)[item[own]], np.array([x[4] for x in part], np.int64)[item[own]]
        tails = rows[np.arange(length) >= lcp[:, None]].tobytes()
        yield rec, tails, _sample([x.tobytes() for x in rows[:: max(1, len(rows) // (4 * PROPOSED))]], length), _marks(mark, item, nth, part)


def _row_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before, 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 1 << 16):
        same = rows[i : i + (1 << 16)] == rows[i - 1 : i - 1 + len(rows[i : i + (1 << 16)])]
        out[i : i + (1 << 16)] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return out


def _marks(mark: np.ndarray, item: np.ndarray, nth: np.ndarray, items: list[tuple]) -> np.ndarray:
    """MARKs of the strings that mark names, neighbours joined."""
    on = np.flatnonzero(mark & np.concatenate(([True], ~mark[:-1] | (item[1:] != item[:-1]))))
    off = np.flatnonzero(mark & np.concatenate((~mark[1:] | (item[1:] != item[:-1]), [True])))
    dh, first = np.array([x[4] for x in items], np.int64), np.array([x[5] - x[2] for x in items], np.int64)
    out = np.empty(len(on), MARK)
    out["dh"], out["start"] = dh[item[on]], first[item[on]] + nth[on]
    out["stop"] = out["start"] + (off - on) + 1
    return out


def _borders(runs: DataFrame, kind: int, size: int) -> list[bytes]:
    """Prefixes of `size` bytes between which about SUFFIXES entries of the runs of this kind lie."""
    of = runs.where(F.col("kind") == kind)
    rows, n = of.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return []
    ranges = min(BORDERS, max(n // SUFFIXES, min(RANGES, n // 1000)) + 1)
    share = min(1.0, BORDERS / PROPOSED / rows)  # so many runs are asked as propose BORDERS borders
    asked = of.where(F.pmod(F.xxhash64("n", "sample"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("sample").toLocalIterator()
    found = sorted(r["sample"][i : i + size] for r in asked for i in range(0, len(r["sample"]), size))
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _exchanged(borders: dict[int, list[bytes]], size: dict[int, int]):
    """Pieces of the runs, by kind and range; a prefix that equals a border begins the range behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, data, tails in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), b.column("tails").to_pylist()):
                rec, tails = _rows(K.unsqueeze(data), ENTRY), K.unsqueeze(tails)
                cuts, heads, begins, behind = [], [], [], []  # of each piece: first entry, (range, its suffix), place of its rest and of what follows
                at, s, now, known = 0, b"", -1, borders[kind]
                for i, (lcp, rest) in enumerate(zip(rec["lcp"].tolist(), rec["rest"].tolist())):
                    s = s[:lcp] + tails[at : at + rest]
                    if now < 0 or now < len(known) and s[: size[kind]] >= known[now]:
                        now = bisect_right(known, s[: size[kind]])
                        cuts.append(i)
                        heads.append((now, s))
                        begins.append(at)
                        behind.append(at + rest)
                    at += rest
                rec["lcp"][cuts], rec["rest"][cuts] = 0, [len(s) for _, s in heads]
                ends, stops = [*cuts[1:], len(rec)], [*begins[1:], len(tails)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(cuts), pa.int8()), pa.array([r for r, _ in heads], pa.int64()), pa.array([K.squeeze(_columns(rec[a:e])) for a, e in zip(cuts, ends)], pa.binary()), pa.array([K.squeeze(s + tails[a:e]) for (_, s), a, e in zip(heads, behind, stops)], pa.binary())],
                    ["kind", "bucket", "data", "tails"],
                )

    return run


def _by_order(items: list[tuple], lcp: list[int], length: int) -> np.ndarray:
    """MARKs of strings that an earlier item owns too, from the order alone.

    items: (suffix, lo, hi, key, dh, q) as merged, lcp: prefix that each shares with the one before.
    """
    n = len(items)
    lo, hi = np.array([x[1] for x in items], np.int64), np.array([x[2] for x in items], np.int64)
    right = np.array(lcp, np.int64)
    span = int(hi.max()) if n else 0
    left = np.zeros((n, max(1, span)), np.uint8)
    for i, (s, a, b, *_) in enumerate(items):
        if b:
            left[i, :b] = np.frombuffer(s, np.uint8, b, length - a)
    order = np.argsort(left.view(f"S{left.shape[1]}").ravel(), kind="stable")
    shared = _row_prefix(left[order])
    age = np.array(sorted(range(n), key=lambda i: items[i][3:]), np.int64)  # earlier ones first
    size = hi - lo + 1
    begin = np.cumsum(size) - size
    mark = np.zeros(int(size.sum()), bool)
    beside = np.empty(n, np.int64)
    for k in range(int(lo.min()) if n else 0, span + 1):
        own = age[(lo[age] <= k) & (hi[age] >= k)]
        if len(own) < 2:
            continue
        behind = np.cumsum(right < length - k)
        beside[order] = np.cumsum(shared < k)
        code = behind[own] * (n + 1) + beside[own]
        later = np.ones(len(own), bool)
        later[np.unique(code, return_index=True)[1]] = False
        own = own[later]
        mark[begin[own] + hi[own] - k] = True
    item = np.repeat(np.arange(n), size)
    return _marks(mark, item, np.arange(len(item)) - begin[item], items)


def _merged(length: int, gram: int, doc_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        K.settle()
        marks, whole, batch, lcps, group, near = [], [], [], [], [], []
        last, single = None, table.column("kind")[0].as_py() == 2  # single strings are equal only as a whole

        def close() -> None:
            if len(group) > 1:
                batch.extend(group)
                lcps.extend(near)
            group.clear()
            near.clear()

        for x in merge([decode(K.unsqueeze(a), K.unsqueeze(b)) for a, b in zip(table.column("data").to_pylist(), table.column("tails").to_pylist())]):
            lcp, s, lo, hi, key, dh, q = x
            if last is not None and lcp == len(s) == len(last[1]) and (lo, hi) == last[2:4]:
                whole.append((dh, q - hi, q - lo + 1))  # the same suffix in a later row
                continue
            if lcp < gram:
                close()
                if len(batch) > 50_000:
                    marks.append(_by_order(batch, lcps, length))
                    batch, lcps = [], []
            if not single:
                group.append(x[1:])
                near.append(lcp)
            last = x
        close()
        if batch:
            marks.append(_by_order(batch, lcps, length))
        m = np.concatenate([*marks, np.array(whole, MARK)])
        out = list(_split(m, m["dh"] % doc_buckets))
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int64()), "data": pa.array([_columns(x) for _, x in out], pa.binary())})

    return run


def _cut(length: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        K.settle()
        by: dict[int, np.ndarray] = {}
        if len(found):
            m = np.concatenate([_rows(x, MARK) for x in found.column("data").to_pylist()])
            by = dict(_split(m, m["dh"]))
        n, gone, spans, sha, begin, end = [], [], [], [], [], []
        for t, dh in zip(texts.column("text"), texts.column("dh").to_pylist()):
            t = (t.as_py() or "").encode()
            b = e = np.zeros(0, np.int64)
            if (m := by.get(dh)) is not None:
                d = np.zeros(len(t) + 1, np.int32)
                np.add.at(d, m["start"].astype(np.int64), 1)
                np.add.at(d, m["stop"].astype(np.int64) - 1 + length, -1)
                on = np.cumsum(d)[:-1] > 0
                edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
                b, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = np.frombuffer(t, np.uint8)[~on].tobytes()
            else:
                kept = t
            n.append(len(t))
            gone.append(len(t) - len(kept))
            spans.append(len(b))
            sha.append(hashlib.sha256(kept).hexdigest())
            begin.append(b)
            end.append(e)
        lists = pa.list_(pa.int64())
        return pa.table({"key": texts.column("key"), "dh": texts.column("dh"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "starts": pa.array(begin, lists), "ends": pa.array(end, lists)})

    return run


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 20, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, starts, ends.

    Removed is each byte of the UTF-8 text that a string of ``length`` bytes covers which also
    starts earlier; starts and ends are the maximal removed runs in bytes. Strings are judged
    on the input and never cross rows. Null and empty texts have no bytes; very long texts are
    read whole. A null key comes after all others. Repeated rows (equal key and text) count as
    one row, and each gets the same result; rows with equal keys and unlike texts are ordered
    by a hash of the text. Empty tables give no rows; other columns are neither read nor returned.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # a row's hash is negative if its key isn't null, so a null key is behind all others, the greatest too
    own = F.xxhash64("key", "text").bitwiseAND(F.lit(LAST))
    rows = rows.withColumn("dh", F.when(F.col("key").isNull(), own).otherwise(own.bitwiseOR(F.lit(-LAST - 1)))).withColumn("key", F.coalesce("key", F.lit(LAST)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs_n = max(8, int(size / TEXT_BYTES) + 1)
    n = max(8, int(size / (length - gram + 1) * 2 / ANCHORS) + 1)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda groups: max(min(least, groups), groups // TASK_GROUPS)
    by_row = tasks(docs_n)
    texts = rows.withColumn("db", F.pmod("dh", F.lit(docs_n))).select("db", "key", "dh", "text").repartition(by_row, "db")
    packed = rows.select("dh", "text").mapInArrow(_find(length, gram, n, docs_n), "bucket long, data binary")
    found = packed.repartition(tasks(n), "bucket").groupBy("bucket").applyInArrow(_repeated(hot), "db long, data binary").repartition(by_row, "db")
    runs = store(texts.groupBy("db").cogroup(found.groupBy("db")).applyInArrow(_runs(length, gram, docs_n), RUNS)).df
    size = {1: gram, 2: length}
    borders = {k: _borders(runs, k, n) for k, n in size.items()}
    pieces = runs.where("kind > 0").select("kind", "data", "tails").mapInArrow(_exchanged(borders, size), "kind byte, bucket long, data binary, tails binary")
    ranges = sum(len(b) + 1 for b in borders.values())
    late = pieces.repartition(tasks(ranges), "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_merged(length, gram, docs_n), "bucket long, data binary")
    marks = runs.where("kind = 0").select("bucket", "data").union(late).repartition(by_row, "bucket")
    out = texts.groupBy("db").cogroup(marks.groupBy("bucket")).applyInArrow(_cut(length), "key long, dh long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
    return out.withColumn("key", F.when(F.col("dh") < 0, F.col("key"))).drop("dh").withColumnRenamed("key", key)
