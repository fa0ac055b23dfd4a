"""Personal data and the terms that give it away.

Emails, IP addresses, card and phone numbers are found by pattern in every text. Words near
them are then judged by information: a term reveals an entity (one address, one number) when
the share of the term's texts that have it near the entity, P(entity | term), is at least
MIN_SHARE, in two or more different texts, and chance gives so many with a probability of at
most 2**-MIN_BITS at the entity's rate in the whole corpus, however frequent the entity is.
Copies of a text count once. Every occurrence of such a term in any text becomes a span of the
kind `term`; ``sanitise`` replaces base spans by their kind, generalises revealing terms,
and removes those with a share of REMOVE_SHARE or more.

Terms near an entity are few and are counted by (term, entity); how many texts have a
term is counted over the whole corpus, for terms that pass a bit filter of a fixed size made
from the candidates. A fuller filter lets more terms through, never fewer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernel as K
from quillon.session import store

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words on either side of a span that count as near.
NEAR = 8
MIN_SHARE, MIN_BITS, REMOVE_SHARE = 0.5, 8.0, 0.9
FILTER_BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @, in time linear in the text."""
    end, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > end and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            end = m.end()
            yield a, end
        at = t.find("@", max(at + 1, end))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str, n_digits: int = 1 << 30) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind; n_digits bounds the text's ASCII digits."""
    out = [(a, b, 0) for a, b in _emails(t)] if "@" in t else []
    if n_digits >= 4:
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if n_digits >= 14:
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(t) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if n_digits >= 10 and "+" in t:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(t) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _words(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first character, end character) of each word."""
    b = np.frombuffer(t.encode(), np.uint8)
    low = K.LOWER[b]
    ws, we, _ = K.word_spans(low, np.array([0, len(b)]), K.ALNUM)
    h = K.span_hash(K.prefix_hash(low), ws, we)
    char = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return h, char[ws], char[we]


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
CONTEXT = pa.struct([("term", pa.int64()), ("entity", pa.int64())])
FOUND = "key long, th long, base array<struct<kind:int,start:bigint,end:bigint>>, entities array<bigint>, near array<struct<term:bigint,entity:bigint>>"


def _outside(spans: list[tuple[int, int, int]], ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Which words touch none of the spans, which are in order of their starts."""
    if not spans:
        return np.ones(len(ws), bool)
    before = np.searchsorted([x[0] for x in spans], we)
    reach = np.concatenate(([0], np.maximum.accumulate([x[1] for x in spans])))
    return reach[before] <= ws


def contexts(t: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[dict]]:
    """(entities, words near them): each entity and each (term, entity) of the text once."""
    h, ws, we = _words(t)
    free = _outside(spans, ws, we)
    wordy = np.array([any(c.isalpha() for c in t[a:b]) and b - a >= 3 for a, b in zip(ws, we)], bool) & free if len(h) else free
    near: dict[tuple[int, int], None] = {}
    ids = []
    for a, b, kind in spans:
        e = t[a:b].lower() if kind == 0 else t[a:b] if kind == 1 else _digits(t[a:b])
        raw = np.frombuffer(f"{KINDS[kind]}:{e}".encode(), np.uint8)
        e = int(K.span_hash(K.prefix_hash(raw), np.array([0]), np.array([len(raw)])).view(np.int64)[0])
        ids.append(e)
        left, right = np.searchsorted(we, a, "right"), np.searchsorted(ws, b)
        for i in [*range(max(0, left - NEAR), left), *range(right, min(len(h), right + NEAR))]:
            if wordy[i]:
                near[int(h[i].view(np.int64)), e] = None
    return list(dict.fromkeys(ids)), [{"term": t_, "entity": e} for t_, e in near]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = K.column_bytes(b.column("text"))
        digits, mails = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
        for i, j in K.chunks(offs):
            part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            at = np.concatenate(([0], np.cumsum((part >= 48) & (part <= 57))))
            digits[i:j] = at[o[1:]] - at[o[:-1]]
            mails[i + np.searchsorted(o, np.flatnonzero(part == 64), "right") - 1] = True
        base, entities, near = [[] for _ in digits], [[] for _ in digits], [[] for _ in digits]
        col = b.column("text")
        for r in np.flatnonzero(mails | (digits >= 4)):
            t = col[r].as_py()
            spans = base_spans(t, int(digits[r]))
            if spans:
                base[r] = [{"kind": k, "start": a, "end": e} for a, e, k in spans]
                entities[r], near[r] = contexts(t, spans)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("th"), pa.array(base, pa.list_(SPAN)), pa.array(entities, pa.list_(pa.int64())), pa.array(near, pa.list_(CONTEXT))], ["key", "th", "base", "entities", "near"])
    K.trim_powers()


def _known_words(bits: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start byte, end byte) of each word that passes the filter."""
    low = K.LOWER[buf]
    ws, we, wo = K.word_spans(low, offs, K.ALNUM)
    h = K.span_hash(K.prefix_hash(low), ws, we)
    at = h & K.U(FILTER_BITS - 1)
    ok = (bits[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63))) & K.U(1) > 0
    return np.repeat(np.arange(len(offs) - 1), np.diff(wo))[ok], h[ok], ws[ok], we[ok]


def _document_counts(handle, copied):
    """(term, th, n): texts with the term; th is null for texts that surely have no copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, twice = np.frombuffer(handle.value, np.uint64), np.frombuffer(copied.value, np.uint64)
        for b in batches:
            buf, offs = K.column_bytes(b.column("text"))
            th = b.column("th").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = th & K.U(FILTER_BITS - 1)
            again = (twice[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63))) & K.U(1) > 0
            once, pairs = [np.zeros(0, K.U)], [np.zeros((0, 2), K.U)]
            for i, j in K.chunks(offs):
                row, h, _, _ = _known_words(bits, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                order = np.lexsort((row, h))
                h, row = h[order], row[order] + i
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                once.append(h[~again[row]])
                pairs.append(np.unique(np.stack((h, th[row]), 1)[again[row]], axis=0))
            t, n = np.unique(np.concatenate(once), return_counts=True)
            two = np.concatenate(pairs)
            terms = pa.concat_arrays([K.ints(t), K.ints(two[:, 0])])
            yield pa.RecordBatch.from_arrays([terms, pa.concat_arrays([pa.nulls(len(t), pa.int64()), K.ints(two[:, 1])]), pa.array(np.concatenate((n, np.ones(len(two)))).astype(np.int64))], ["term", "th", "n"])

    return run


PLACES = "key long, th long, term long, starts array<bigint>, ends array<bigint>"


def _places(handle):
    """Every occurrence outside base spans of the words that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(handle.value, np.uint64)
        for b in batches:
            buf, offs = K.column_bytes(b.column("text"))
            col, rows, terms, starts, ends = b.column("text"), [], [], [], []
            for i, j in K.chunks(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, h, ws, we = _known_words(bits, part, o)
                if not len(h):
                    continue
                char = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                ws, we = char[ws] - char[o[row]], char[we] - char[o[row]]
                cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    s, e, t = ws[lo:hi], we[lo:hi], h[lo:hi]
                    spans = base_spans(col[i + int(row[lo])].as_py())
                    free = _outside(spans, s, e)
                    s, e, t = s[free], e[free], t[free]
                    order = np.argsort(t, kind="stable")
                    s, e, t = s[order], e[order], t[order].view(np.int64)
                    edges = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True]))) if len(t) else [0]
                    for x, y in zip(edges[:-1], edges[1:]):
                        rows.append(i + int(row[lo]))
                        terms.append(int(t[x]))
                        starts.append(s[x:y])
                        ends.append(e[x:y])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("th").take(at), pa.array(terms, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["key", "th", "term", "starts", "ends"])
        K.trim_powers()

    return run


def _filter(df: DataFrame, value: str) -> bytes | None:
    """The bit filter of a column of longs, or None if there are none."""
    slot = F.pmod(value, F.lit(FILTER_BITS))
    words = df.groupBy(F.floor(slot / 64).cast("long").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(pmod({value}, {FILTER_BITS}), 64) as int)))").alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.tobytes() if len(words) else None


def evidence(n: Column, df: Column, p: Column) -> Column:
    """Bits by which n of df texts are too many for chance at the rate p, by Chernoff's bound on the binomial tail; 0 if they aren't."""
    share = n / df
    rest = F.when(n < df, (df - n) * F.log2((1 - share) / (1 - p))).otherwise(0.0)
    return F.when((share > p) & (p < 1), n * F.log2(share / p) + rest).otherwise(0.0)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """One row for each row of docs: key, th (xxhash64 of the text), base, terms (spans with share).

    Spans are character offsets, end exclusive; base has kind numbers of KINDS in order of
    start, then kind. Null and empty texts have none. A revealing term has a span wherever it
    stands outside base spans, in documents without base spans too. Repeated rows get the same
    spans; copies of one text count once, and two different texts must show a term near an
    entity before it can reveal it. Very long texts are read whole, in time linear in their
    length but for the sorting of their spans. Empty tables give no rows; other columns are not returned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = store(rows.mapInArrow(_find, FOUND)).df
    near = found.select("th", F.explode("near").alias("x")).select("th", "x.term", "x.entity").distinct()
    pairs = store(near.groupBy("term", "entity").agg(F.count("*").alias("n")).where("n >= 2")).df
    share = lambda data: spark.sparkContext.broadcast(data or bytes(FILTER_BITS // 8))
    telling = None
    if (candidates := _filter(pairs, "term")) is not None:
        copied = _filter(found.groupBy("th").agg(F.count("*").alias("n")).where("n > 1"), "th")
        df = rows.select("th", "text").mapInArrow(_document_counts(share(candidates), share(copied)), "term long, th long, n long")
        # texts with copies by (term, th) once, the others by their sums
        df = df.groupBy("term", "th").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum(F.when(F.col("th").isNull(), F.col("n")).otherwise(1)).alias("df"))
        entity = found.select("th", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
        total = found.select("th").distinct().count()
        scored = pairs.join(df, "term").join(entity, "entity").withColumn("share", F.col("n") / F.col("df"))
        judged = scored.where((F.col("share") >= min_share) & (evidence(F.col("n"), F.col("df"), F.col("n_entity") / F.lit(float(total))) >= min_bits))
        telling = store(judged.groupBy("term").agg(F.max("share").alias("share"))).df
    if telling is not None and (bits := _filter(telling, "term")) is not None:
        places = rows.mapInArrow(_places(share(bits)), PLACES)
        spans = places.join(telling, "term").select("key", "th", "share", F.explode(F.arrays_zip("starts", "ends")).alias("z"))
        spans = spans.groupBy("key", "th", F.col("z.starts").alias("s"), F.col("z.ends").alias("e")).agg(F.max("share").alias("share"))
        terms = spans.groupBy("key", "th").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "share"))).alias("terms")).toDF("k", "h", "terms")
        out = found.join(terms, found["key"].eqNullSafe(terms["k"]) & (found["th"] == terms["h"]), "left")
    else:
        out = found.withColumn("terms", F.lit(None).cast("array<struct<start:bigint,end:bigint,share:double>>"))
    return out.select(F.col("key").alias(key), "th", "base", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,share:double>>")).alias("terms"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256, spans from detect()'s rows."""
    kinds = "array('email', 'ip', 'card', 'phone', 'term')"
    line = "concat_ws(',', transform({0}, x -> concat_ws(':', " + kinds + "[x.kind], x.start, x.end)))"
    every = "sort_array(concat(transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)), transform(terms, x -> named_struct('start', x.start, 'kind', 4, 'end', x.end))))"
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)") for i, k in enumerate(KINDS[:4])}
    out = found.withColumns(counts | {"base_sha256": F.sha2(F.expr(line.format("base")), 256), "_all": F.expr(every), "n_term": F.size("terms").cast("long")})
    return out.withColumn("spans", F.expr(line.format("_all"))).select(key, *counts, "base_sha256", "spans", "n_term")


def replace_spans(t: str | None, base: list, terms: list) -> str | None:
    """The text with base spans as [KIND] and revealing terms generalised or removed."""
    if t is None:
        return None
    todo = sorted([(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base] + [(s["start"], s["end"], "" if s["share"] >= REMOVE_SHARE else "[TERM]") for s in terms])
    out, at = [], 0
    for a, b, r in todo:
        if a >= at:
            out += [t[at:a], r]
            at = b
        else:  # overlaps the span before, whose replacement stands
            at = max(at, b)
    return "".join([*out, t[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """docs with the text sanitised; rows, order of columns and other columns stay."""
    found = detect(docs, key, text, **thresholds).where("size(base) > 0 or size(terms) > 0").dropDuplicates([key, "th"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_h"))
    both = packed.join(found, packed["_k"].eqNullSafe(found[key]) & (packed["_h"] == found["th"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [replace_spans(r[0], r[1] or [], r[2] or []) for r in zip(b.column("t").to_pylist(), b.column("base").to_pylist(), b.column("terms").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(new, pa.string())], ["_row", "t"])

    done = both.select("_row", F.col(f"_row.{text}").alias("t"), "base", "terms").mapInArrow(run, both.select("_row").schema.add("t", "string"))
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
