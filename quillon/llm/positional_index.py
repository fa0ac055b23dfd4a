"""Benchmark decontamination with a positional inverted index that is split by document.

A segment indexes the texts of one part of a batch: for each of its terms the ascending
positions of its occurrences, where positions run on over the segment's documents with a gap
between them, so no phrase crosses two documents. Segments of all terms of all rows are
written as a table (``store_index``) that any later test set can be searched in; no term is
gathered over the corpus, so a term or passage in a third of all documents makes no task larger.

A phrase is found by intersecting its terms' lists, shifted by their offsets in the phrase,
from the segment's rarest term on. Test items are cut into blocks of a bounded number of
words; each block is broadcast for one pass over the index, and the driver holds one at a
time. ``decontaminate`` returns what exact phrase hits come to, ``search_near`` proximity
matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernel as K
from quillon.session import store

#: Words of test text in one block, 8 bytes each; larger sets take several passes over the index.
BLOCK_WORDS = 2_000_000
#: Contaminated rows whose keys (16 bytes each) are broadcast at most.
SMALL_TABLE = 1_000_000
SEGMENT_BYTES = 4 << 20
GAP = 64
INDEX = "keys array<long>, ths array<long>, words array<long>, base array<long>, lists binary"
#: Document of a segment, its hit words as intervals, items found.
HITS = "segment long, place int, starts array<long>, ends array<long>, items array<string>"


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, offsets by row) of a text column."""
    buf, offs = K.column_bytes(col)
    parts, at = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in K.chunks(offs):
        b = K.LOWER[buf[offs[i] : offs[j]]]
        ws, we, wo = K.word_spans(b, offs[i : j + 1] - offs[i], K.ALNUM)
        parts.append(K.span_hash(K.prefix_hash(b), ws, we))
        at.append(wo[1:] + total)
        total += len(ws)
    K.trim_powers()
    return (np.concatenate(parts) if parts else np.zeros(0, K.U)), np.concatenate(at)


class Segment:
    """Lists of one segment: ends[i] closes the list of terms[i] in positions."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, only: np.ndarray | None = None):
        """only: sorted terms; the lists of others are left out."""
        begin, size = np.concatenate(([0], ends))[: len(terms)].astype(np.int64), np.diff(np.concatenate(([0], ends))).astype(np.int64)
        if only is not None and len(terms):
            at = np.minimum(np.searchsorted(terms, only), len(terms) - 1)
            at = at[terms[at] == only]
            terms, begin, size = terms[at], begin[at], size[at]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            positions, begin = positions[np.repeat(begin, size) + within], np.cumsum(size) - size
        self.terms, self.positions, self.begin, self.size = terms, positions.astype(np.int64), begin, size
        self.keyed = (np.repeat(np.arange(len(terms)), self.size) << 34) | self.positions

    def ids(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the terms here, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of each occurrence of the windows, rows of equally many terms."""
        ids = self.ids(windows)
        alive = np.flatnonzero((ids >= 0).all(1))
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = ids[alive]
        order = np.argsort(self.size[ids], 1, kind="stable")
        rare = ids[np.arange(len(ids)), order[:, 0]]
        n = self.size[rare]
        w = np.repeat(np.arange(len(ids)), n)
        nth = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        pos = self.positions[self.begin[rare][w] + nth] - order[w, 0]
        for k in range(1, windows.shape[1]):
            if not len(w):
                break
            off = order[w, k]
            want = (ids[w, off] << 34) | (pos + off)
            at = np.minimum(np.searchsorted(self.keyed, want), len(self.keyed) - 1)
            ok = (self.keyed[at] == want) & (pos >= 0)
            w, pos = w[ok], pos[ok]
        return alive[w], pos

    def pack(self) -> bytes:
        """The lists, positions as steps within a list."""
        steps = np.diff(self.positions, prepend=0)
        steps[self.begin] = self.positions[self.begin]
        return K.squeeze(len(self.terms).to_bytes(8, "little") + self.terms.tobytes() + self.size.astype(np.uint32).tobytes() + steps.astype(np.uint32).tobytes())

    @classmethod
    def unpack(cls, data: bytes, only: np.ndarray | None = None) -> Segment:
        raw = K.unsqueeze(data)
        n = int.from_bytes(raw[:8], "little")
        ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64))
        run = np.cumsum(np.frombuffer(raw, np.uint32, -1, 8 + 12 * n).astype(np.int64))
        begin = np.concatenate(([0], ends))[:n].astype(np.int64)
        before = np.where(begin > 0, run[begin - 1], 0)
        return cls(np.frombuffer(raw, K.U, n, 8), ends, run - np.repeat(before, np.diff(np.concatenate(([0], ends)))), only)

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with each other term at most slop words away."""
        ids = self.ids(np.unique(terms))
        if not len(ids) or (ids < 0).any():
            return np.zeros(0, np.int64)
        ids = ids[np.argsort(self.size[ids], kind="stable")]
        pos = self.positions[self.begin[ids[0]] : self.begin[ids[0]] + self.size[ids[0]]]
        for i in ids[1:]:
            other = self.positions[self.begin[i] : self.begin[i] + self.size[i]]
            at = np.searchsorted(other, pos - slop)
            pos = pos[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= pos + slop)]
        return pos


def _index(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for b in batches:
            sizes = np.diff(K.column_bytes(b.column("text"))[1])
            for i, j in K.chunks(np.concatenate(([0], np.cumsum(sizes))), SEGMENT_BYTES):
                h, wo = tokens(b.column("text").slice(i, j - i))
                words = np.diff(wo)
                base = wo[:-1] + np.arange(j - i) * gap
                pos = np.arange(len(h)) + np.repeat(np.arange(j - i) * gap, words)
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                packed = Segment(h[cut], np.append(cut[1:], len(h)) if len(h) else cut, pos).pack()
                of = lambda c: b.column(c).slice(i, j - i).to_pylist()  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([of("key")], lists), pa.array([of("th")], lists), pa.array([words], lists), pa.array([base], lists), pa.array([packed])], ["keys", "ths", "words", "base", "lists"])

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """Segments of the positional index over all terms of all rows, not yet stored.

    Null texts have no words and stay in the list of rows; texts of any length are indexed
    whole. gap bounds the length of phrases and slop of searches that must not cross documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(_index(gap), INDEX)


def store_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """build_index() written to the shared folder, each segment with a number of its own."""
    return store(build_index(docs, key, text, gap).withColumn("segment", F.monotonically_increasing_id())).df


class Block:
    """Words of some items; their windows are views."""

    def __init__(self, ids: list, words: list[np.ndarray], n: int):
        self.items, self.words, self.n = ids, words, n
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, K.U)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows of one length, item of each)."""
        by: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if size := min(self.n, len(w)):
                by.setdefault(size, []).append((i, w))
        for size, own in by.items():
            each = [np.lib.stride_tricks.sliding_window_view(w, size) for _, w in own]
            yield np.concatenate(each), np.repeat([i for i, _ in own], [len(x) for x in each])


def _item_words(n: int):
    """Words of each item, a long one in pieces that share n - 1 words, so every window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, wo = tokens(b.column("text"))
            ids, words = [], []
            for i, (x, a, e) in enumerate(zip(b.column("id").to_pylist(), wo[:-1], wo[1:])):
                for at in range(a, max(a + 1, e - n + 1), BLOCK_WORDS):
                    ids.append(x)
                    words.append(h[at : min(e, at + BLOCK_WORDS + n - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary())], ["id", "words"])

    return run


def read_items(items: DataFrame, n: int, key: str = "item_id", text: str = "text") -> Iterator[Block]:
    """Blocks of about BLOCK_WORDS words (one piece of an item more at most); the driver holds one at a time."""
    rows = items.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    ids, words, held = [], [], 0
    for r in store(rows.mapInArrow(_item_words(n), "id string, words binary")).df.toLocalIterator():
        ids.append(r["id"])
        words.append(np.frombuffer(r["words"], K.U))
        held += len(words[-1])
        if held >= BLOCK_WORDS:
            yield Block(ids, words, n)
            ids, words, held = [], [], 0
    if ids:
        yield Block(ids, words, n)


def _search(handle):
    """Documents that have windows of the block, with their hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = handle.value
        windows = list(block.windows())
        lists = pa.list_(pa.int64())
        for b in batches:
            for s in b.to_pylist():
                words, base = np.array(s["words"], np.int64), np.array(s["base"], np.int64)
                seg = Segment.unpack(s["lists"], block.vocabulary)
                found, spans = {}, []
                for rows, item in windows:
                    w, pos = seg.phrases(rows)
                    spans.append(np.stack((pos, pos + rows.shape[1]), 1))
                    for d, i in np.unique(np.stack((np.searchsorted(base, pos, "right") - 1, item[w]), 1), axis=0).tolist():
                        found.setdefault(d, set()).add(block.items[i])
                if not found:
                    continue
                spans = np.concatenate(spans)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                reach = np.maximum.accumulate(spans[:, 1])
                new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))  # the gap keeps documents apart
                start, end = spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
                doc = np.searchsorted(base, start, "right") - 1
                at = sorted(found)
                cut = np.searchsorted(doc, [*at, len(base)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["segment"]] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([start[x:y] - base[d] for d, x, y in zip(at, cut, cut[1:])], lists),
                        pa.array([end[x:y] - base[d] for d, x, y in zip(at, cut, cut[1:])], lists), pa.array([sorted(x for x in found[d] if x is not None) for d in at], pa.list_(pa.string())),
                    ],
                    ["segment", "place", "starts", "ends", "items"],
                )

    return run


def search(index: DataFrame, items: DataFrame, n: int = 10, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(segment, place, starts, ends, items) of the documents of a stored index that have a window.

    starts and ends are maximal runs of hit words. One pass over the index for each block of
    items; with several, the hits of each are stored, which are as many as documents with hits.
    """
    sc, parts = index.sparkSession.sparkContext, []
    for block in read_items(items, n, item_key, item_text):
        handle = sc.broadcast(block)
        parts.append(store(index.select("segment", "words", "base", "lists").mapInArrow(_search(handle), HITS)).df)
        handle.destroy()
    if not parts:
        return index.sparkSession.createDataFrame([], HITS)
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.groupBy("segment", "place").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))))).alias("z"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    run = "aggregate(z, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> if(size(a) > 0 and x.s <= element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))), concat(a, array(named_struct('s', x.s, 'e', x.e)))))"
    every = every.withColumn("z", F.expr(run))
    return every.select("segment", "place", F.col("z.s").alias("starts"), F.col("z.e").alias("ends"), "items")


def _hits(docs: DataFrame, items: DataFrame, n: int, key: str, text: str, item_key: str, item_text: str, index: DataFrame | None) -> DataFrame:
    """key, th, n_words, n_hit, items of every document of the index."""
    index = store_index(docs, key, text, max(GAP, n + 1)) if index is None else index
    hits = search(index, items, n, item_key, item_text).withColumn("n_hit", F.expr("aggregate(arrays_zip(starts, ends), 0L, (a, z) -> a + z.ends - z.starts)"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "ths", "words")).alias("place", "z")).select("segment", "place", F.col("z.keys").alias("key"), F.col("z.ths").alias("th"), F.col("z.words").alias("n_words"))
    out = rows.join(hits.select("segment", "place", "n_hit", "items"), ["segment", "place"], "left")
    return out.select("key", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: key, n_words, n_hit, items (sorted as strings).

    A window is n consecutive words of an item, or all of a shorter one; a document's word is
    hit when it lies inside an occurrence of a window. Words are runs of ASCII letters, digits
    and non-ASCII characters after lower-casing A-Z, compared by 64-bit hash. Null or wordless
    texts have no words and no hits; null or wordless items no windows. An item with a null id
    can hit but isn't listed; equal ids count once. Repeated rows each get a row; very long
    texts and items are searched whole. Empty tables give no rows or no hits. index: one that
    was stored before, with a gap above n.
    """
    return _hits(docs, items, n, key, text, item_key, item_text, index).drop("th").withColumnRenamed("key", key)


def digest(hits: DataFrame) -> DataFrame:
    """Replaces items by n_items, items_sha256 and contaminated."""
    return hits.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0}).drop("items")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """The rows of docs with no hit word, all columns as they are.

    Rows go by key and a hash of the text, so null keys and unlike rows of one key are told
    apart; repeated rows go or stay together. Null and wordless texts stay, and so does
    everything if there are no items; an empty table stays empty. The contaminated rows' keys
    are broadcast if there are few, so the texts aren't shuffled.
    """
    bad = _hits(docs, items, n, key, text, item_key, item_text, index).where("n_hit > 0")
    bad = store(bad.select(F.col("key").alias("_k"), F.col("th").alias("_h")).distinct()).df
    if bad.count() <= SMALL_TABLE:
        bad = F.broadcast(bad)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_th"))
    return packed.join(bad, (F.col("_th") == F.col("_h")) & F.col("_key").eqNullSafe(F.col("_k")), "left_anti").select("_row.*")


def search_near(index: DataFrame, queries: list[str], slop: int, key: str = "doc_id", gap: int = GAP) -> DataFrame:
    """(key, query, word): proximity matches of a short list of queries in an index.

    A match is an occurrence, numbered by word from 0, of the query's rarest term of the segment
    (the least hash of equals) with each other term at most slop words away in the same document.
    A query without words matches nothing.
    """
    if slop >= gap:
        raise ValueError("slop must be below the index's gap")
    asked = [(q, tokens(pa.array([q], pa.string()))[0]) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.unique(np.concatenate([np.zeros(0, K.U), *[t for _, t in asked]]))
        for b in batches:
            for s in b.to_pylist():
                base, seg = np.array(s["base"], np.int64), Segment.unpack(s["lists"], only)
                for q, terms in asked:
                    pos = seg.near(terms, slop)
                    doc = np.searchsorted(base, pos, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array([s["keys"][d] for d in doc], pa.int64()), pa.array([q] * len(pos), pa.string()), pa.array(pos - base[doc], pa.int64())], ["key", "query", "word"])

    return index.select("keys", "base", "lists").mapInArrow(run, "key long, query string, word long").withColumnRenamed("key", key)
