"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to three bytes long holds how often each byte
followed. A byte's probability in a context is count / (total + distinct) where the context
has seen it, else the escape probability distinct / (total + distinct) times the probability
in the context one byte shorter (method C, without exclusions); a context never seen costs
nothing and gives way to the shorter one, and below the empty context all 256 bytes are
equally likely. Trees are frozen after training. A text's score under a language is the
exact code length of all its bytes; the shortest code wins.

Every language and every context of the sample takes part. Workers flatten the trees of a few
languages at a time into sparse tables: code lengths by (context, byte) that some of them has
seen, and escapes by context for the rest, so that scoring is mostly one look-up for each byte
and block of languages. Memory grows with what the sample holds, not with all contexts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernel as K
from quillon.session import store

#: Training text of a language, in bytes, about; whole documents are drawn by a hash of the key.
SAMPLE_BYTES = 6_000_000
#: Values of the draw, so many that the share of a language of any size is above zero.
DRAWS = 1 << 48
#: Languages that are scored together, and entries of their largest table; neither bears on results but for the rounding of sums.
BLOCK_LANGUAGES, BLOCK_ENTRIES = 8, 1 << 23
#: Entries (12 bytes as sent, some 40 as flattened) of the languages of one pass; no bearing on results either.
GROUP_ENTRIES = 8_000_000


def _shifted(b: np.ndarray, offs: np.ndarray, pad: int, k: int) -> np.ndarray:
    """The byte k places before each, or pad where the row has none."""
    out = np.full(len(b), pad, b.dtype)
    out[k:] = b[:-k] if k < len(b) else b[:0]
    for x in range(k):
        at = offs[:-1] + x
        out[at[at < offs[1:]]] = pad
    return out


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                buf, offs = K.column_bytes(b.column("text").filter(pa.array(langs == lang)))
                buf = buf.astype(np.uint32)
                code = buf.copy()
                for k in (1, 2, 3):
                    code |= _shifted(buf, offs, 0, k) << np.uint32(8 * k)
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    return run


class _Index:
    """Places of 32-bit keys, by open addressing; keys must differ."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, 0).astype(np.uint32)  # one more, so that a miss can be compared
        n = 1 << max(4, int(2 * len(keys)).bit_length())
        self.table, self.mask, self.shift = np.full(n, -1, np.int32), n - 1, np.uint32(33 - n.bit_length())
        slot, todo = self._slot(self.keys[:-1]), np.arange(len(keys))
        while len(todo):
            free = todo[self.table[slot[todo]] < 0]
            self.table[slot[free]] = free
            todo = todo[self.table[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 without one."""
        slot = self._slot(keys)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = at = self.table[slot[todo]]
            todo = todo[(at >= 0) & (self.keys[at] != keys[todo])]
        return out


def _escapes(ctx: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By context: bits of an escape, 0 where nothing was seen, and log2 of total plus distinct."""
    kinds = np.bincount(ctx, minlength=size)
    whole = np.log2(np.maximum(np.bincount(ctx, n, size) + kinds, 1))
    return np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0), whole


class _Block:
    """Flattened trees of a few languages; grams: by language, (codes of four bytes, counts)."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        grams = [(np.asarray(c).astype(np.uint32), np.asarray(n).astype(np.float64)) for c, n in grams]
        k = len(grams)
        four = np.unique(np.concatenate([c for c, _ in grams]))
        three = np.unique(four & np.uint32(0xFFFFFF))
        ctx = np.unique(four >> np.uint32(8))
        self.one = np.empty((1 << 16, k), np.float32)
        self.esc2 = np.zeros((1 << 16, k), np.float32)
        self.three = np.empty((len(three), k), np.float32)
        self.esc3 = np.zeros((len(ctx) + 1, k), np.float32)  # the last one is for contexts that no language has seen
        self.four = np.empty((len(four), k), np.float32)
        low = np.searchsorted(three, four & np.uint32(0xFFFFFF))
        above = np.searchsorted(ctx, four >> np.uint32(8))
        for i, (code, n) in enumerate(grams):
            b, pair = (code & np.uint32(255)).astype(np.int64), (code & np.uint32(0xFFFF)).astype(np.int64)
            n0 = np.bincount(b, n, 256)
            esc, whole = _escapes(np.flatnonzero(n0) * 0, n0[n0 > 0], 1)
            zero = np.where(n0 > 0, whole[0] - np.log2(np.maximum(n0, 1)), esc[0] + 8)
            n1 = np.bincount(pair, n, 1 << 16)
            seen = np.flatnonzero(n1)
            esc, whole = _escapes(seen >> 8, n1[seen], 256)
            one = (esc[:, None] + zero[None]).reshape(-1)
            one[seen] = whole[seen >> 8] - np.log2(n1[seen])
            c, at = np.unique(code & np.uint32(0xFFFFFF), return_inverse=True)
            n2, c2 = np.bincount(at, n), (c >> np.uint32(8)).astype(np.int64)
            esc2, whole = _escapes(c2, n2, 1 << 16)
            deep = esc2[three >> np.uint32(8)] + one[three & np.uint32(0xFFFF)]
            deep[np.searchsorted(three, c)] = whole[c2] - np.log2(n2)
            at = np.searchsorted(ctx, code >> np.uint32(8))
            esc3, whole = _escapes(at, n, len(ctx))
            full = esc3[above] + deep[low]
            full[np.searchsorted(four, code)] = whole[at] - np.log2(n)
            self.one[:, i], self.esc2[:, i], self.three[:, i], self.esc3[:-1, i], self.four[:, i] = one, esc2, deep, esc3, full
        self.at4, self.at3, self.ctx3 = _Index(four), _Index(three), _Index(ctx)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code behind the three before it, by language."""
        at = self.at4.find(code)
        out = self.four[at] if len(self.four) else np.empty((len(code), self.one.shape[1]), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            rest = code[new]
            low = self.at3.find(rest & np.uint32(0xFFFFFF))
            short = self.three[low] if len(self.three) else out[new]
            lost = np.flatnonzero(low < 0)
            c = rest[lost]
            short[lost] = self.esc2[(c >> np.uint32(8)) & np.uint32(0xFFFF)] + self.one[c & np.uint32(0xFFFF)]
            out[new] = self.esc3[self.ctx3.find(rest >> np.uint32(8))] + short
        return out


class Model:
    """Flattened trees. counts: by language, (codes of four bytes, counts)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.blocks, now, entries = [], [], 0
        for lang in self.langs:
            entries += len(counts[lang][0])
            if now and (len(now) == BLOCK_LANGUAGES or entries * (len(now) + 1) > BLOCK_ENTRIES):
                self.blocks.append(_Block(now))
                now, entries = [], len(counts[lang][0])
            now.append(counts[lang])
        if now:
            self.blocks.append(_Block(now))

    def code_lengths(self, col: pa.Array) -> np.ndarray:
        """Bits of each row's text under each language."""
        buf, offs = K.column_bytes(col)
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for i, j in K.chunks(offs, 1 << 18):
            o = offs[i : j + 1] - offs[i]
            for lo in range(0, int(o[-1]), 1 << 18):  # a very long text goes piece by piece
                hi = min(int(o[-1]), lo + (1 << 18))
                back = max(0, lo - 3)
                raw = buf[offs[i] + back : offs[i] + hi].astype(np.uint32)
                cuts = np.clip(o, back, hi) - back
                code = raw.copy()
                for k in (1, 2, 3):
                    code |= _shifted(raw, cuts, 0, k) << np.uint32(8 * k)
                code = code[lo - back :]
                cuts = np.clip(o, lo, hi) - lo
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                at = 0
                for block in self.blocks:
                    bits = block.bits(code)
                    out[i + full, at : at + bits.shape[1]] += np.add.reduceat(bits, cuts[full], 0, np.float64)
                    at += bits.shape[1]
        return out


STATE = ["letters", "pred", "best", "mass"]


def _pass(handle, first: bool, last: bool):
    """Adds a group of languages to the state: the best one, its bits, and the sum of 2 ** -(excess bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = K.kept("languages", handle.id, lambda: Model(handle.value))
        for b in batches:
            bits = model.code_lengths(b.column("text"))
            best, pred = bits.min(1), np.array(model.langs, object)[bits.argmin(1)]
            mass = np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(1)
            if not first:
                old, had = b.column("best").to_numpy(), b.column("mass").to_numpy()
                pred = np.where(best < old, pred, np.array(b.column("pred").to_pylist(), object))  # ties go to the first language
                least = np.minimum(best, old)
                mass = mass * np.exp2(np.maximum(least - best, -1000)) + had * np.exp2(np.maximum(least - old, -1000))
                best = least
            out = [b.column("key"), b.column("letters"), pa.array(pred, pa.string()), pa.array(best), pa.array(mass)]
            yield pa.RecordBatch.from_arrays([*out, *([] if last else [b.column("text")])], ["key", *STATE, *([] if last else ["text"])])

    return run


def held_out(key: str):
    """crc32 of the key as text leaves 1 modulo 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


class Trained:
    """A trained model: its languages in order with their numbers of entries, and the stored counts (lang, code, n)."""

    def __init__(self, sizes: dict[str, int], counts: DataFrame | None):
        self.sizes, self.counts = sizes, counts

    def __len__(self) -> int:
        return len(self.sizes)

    def groups(self) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Counts of a group of languages at a time."""
        group, held = [], 0
        for lang in sorted(self.sizes):
            if group and held + self.sizes[lang] > GROUP_ENTRIES:
                yield self._read(group)
                group, held = [], 0
            group.append(lang)
            held += self.sizes[lang]
        if group:
            yield self._read(group)

    def _read(self, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for i in range(0, len(langs), BLOCK_LANGUAGES):
            part = self.counts.where(F.col("lang").isin(langs[i : i + BLOCK_LANGUAGES])).toPandas()
            out |= {k: (g["code"].to_numpy(np.int64).astype(np.uint32), g["n"].to_numpy(np.int64)) for k, g in part.groupby("lang")}
        return out | {k: (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for k in langs if k not in out}


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Trained:
    """Counts by language, from about sample_bytes bytes of each, of rows that aren't held out.

    Rows with a null key, text or language don't take part; a language of empty texts alone is
    a language without entries; repeated rows count each; long texts count whole. An empty
    table gives a model without languages.
    """
    one = lambda c, name: F.col(f"`{c}`").alias(name)
    rows = docs.select(one(key, "key"), one(text, "text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("key is not null and text is not null and lang is not null")
    rows = rows.where(F.crc32(F.col("key").cast("string")) % 3 != 1)
    sizes = store(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))).df
    share = F.floor(F.lit(float(DRAWS)) * F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.lit(1), "size")))
    drawn = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(DRAWS)) < F.col("share"))  # a row for each language
    counts = store(drawn.select("text", "lang").mapInArrow(_count(), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))).df
    entries = {r["lang"]: 0 for r in sizes.collect()} | {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return Trained(entries, counts)


def identify(docs: DataFrame, model: Trained, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, lang_pred, score, code_bits.

    score is the winner's share of probability when all languages were equally likely
    before. A null text, or one without a letter, and any text under a model without languages,
    gets `und` with the score 0. Ties go to the first language in order. Only the text is read,
    whole, piece by piece if it is very long. Repeated rows each get a row, an empty table none.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    kind, state, held, groups = docs.schema[key].dataType.simpleString(), "letters boolean, pred string, best double, mass double", None, model.groups()
    group = next(groups, None)
    if group is None:
        rows = rows.select("key", F.lit(False).alias("letters"), F.lit("und").alias("pred"), F.lit(0.0).alias("best"), F.lit(1.0).alias("mass"))
    first = True
    while group is not None:
        handle, group = _Handle(sc.broadcast(group)), next(groups, None)
        last = group is None
        rows = rows.mapInArrow(_pass(handle, first, last), f"key {kind}, {state}" + ("" if last else ", text string"))
        if not last:
            stored = store(rows)
            rows = stored.df
            handle.broadcast.destroy()
            if held is not None:
                held.drop()
            held = stored
        first = False
    known = F.col("letters")
    return rows.select(F.col("key").alias(key), F.when(known, F.col("pred")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("mass")).otherwise(0.0).alias("score"), F.when(known, F.col("best")).otherwise(0.0).alias("code_bits"))


class _Handle:
    """A broadcast with a name of its own, by which workers keep the flattened model."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> dict:
        return self.broadcast.value
