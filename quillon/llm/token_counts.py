"""Token counts of fields or sections from one encoding of the whole document.

The document is encoded once. Token spans, known from the tokens' byte lengths, are joined
with the section spans by position; a token that crosses a boundary goes to one section by
the rule: `majority` (the section that holds most of its bytes, the earliest of equals) or
`start` (the section in which it starts). Counts therefore add up to the document's count.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's texts are cut before merging: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, crossing tokens): ends of the tokens and starts of the sections, in bytes.

    Sections follow one another without gaps; bounds[0] is 0. A section may be empty.
    """
    n = np.zeros(len(bounds), np.int64)
    if not len(ends):
        return n, 0
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    cross = np.flatnonzero(first != last)
    home = first.copy()
    if rule == "majority":
        for i in cross:
            cut = np.clip(np.append(bounds[first[i] : last[i] + 1], ends[i]), starts[i], ends[i])
            home[i] = first[i] + int(np.diff(cut).argmax())
    return np.bincount(home, minlength=len(bounds)), len(cross)


def _count(vocabulary, pattern: str, rule: str, fields: int):
    name = uuid.uuid4().hex  # workers are reused, and an object's number may come again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        def make():
            ranks = vocabulary.value
            size = np.zeros(max(ranks.values()) + 1, np.int64)
            for t, i in ranks.items():
                size[i] = len(t)
            return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size

        encoder, size = K.kept("tokens", name, make)
        for b in batches:
            total, each, starts, crossing = [], [], [], []
            cols = [b.column(f"f{i}") for i in range(fields)] if fields else [b.column("f0")]
            for r in range(b.num_rows):
                parts = [c[r].as_py() or "" for c in cols]
                text = "\n".join(parts)
                raw = text.encode()
                ends = np.cumsum(size[np.array(encoder.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
                if fields:
                    bounds = np.concatenate(([0], np.cumsum([len(p.encode()) + 1 for p in parts])[:-1])).astype(np.int64)
                else:
                    lines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                    bounds = np.concatenate(([0], lines)) if raw else np.zeros(0, np.int64)
                n, c = allocate(ends, bounds, rule) if len(bounds) else (np.zeros(0, np.int64), 0)
                total.append(len(ends))
                each.append(n)
                crossing.append(c)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                starts.append(chars[np.minimum(bounds, len(raw))])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(total, pa.int64()), pa.array(crossing, pa.int64()), pa.array(starts, lists), pa.array(each, lists)], ["key", "n_tokens", "n_crossing", "section_starts", "section_tokens"])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", fields: list[str] | None = None, rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each row of docs: key, n_tokens, n_crossing, section_starts, section_tokens.

    Sections are the lines of the text, each with its line end; or, with fields, these
    columns joined by newlines, each field with the newline after it. Starts are in
    characters. Null counts as empty; an empty text has no lines and no tokens, an empty
    field is an empty section. The vocabulary is read on the driver and broadcast (some
    50,000 entries). Repeated rows each get a row; other columns are not returned.
    """
    if rule not in ("majority", "start"):
        raise ValueError("rule is majority or start")
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    cols = [F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields or [text])]
    rows = docs.select(F.col(key).alias("key"), *cols)
    out = rows.mapInArrow(_count(ranks, pattern, rule, len(fields or [])), f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, n_crossing long, section_starts array<long>, section_tokens array<long>")
    return out.withColumnRenamed("key", key)
