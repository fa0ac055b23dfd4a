"""Containment of reference texts in long records."""

import random
import time

from quillon.operators import similarity


def test_long_texts_take_linear_time(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30000)) for _ in range(8)]
    refs = [(i, " ".join(t.split(" ")[i * 3000 : i * 3000 + 5 + 4 * i])) for i, t in enumerate(texts)]
    began = time.time()
    got = similarity.containing(spark.createDataFrame([*enumerate(texts)], "ord long, norm_text string"), spark.createDataFrame(refs, "ord long, norm_text string")).collect()
    assert {tuple(r) for r in got} == {(i, i) for i in range(8)}
    assert time.time() - began < 25


def test_passes_and_pieces(spark, monkeypatch):
    # words that repeat, references of one word to all of a text, several passes, texts beyond a piece
    monkeypatch.setattr(similarity, "HEADS", 7)
    monkeypatch.setattr(similarity, "WINDOW_BYTES", 64)
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["a", "bé", "cc", "漢字", "d2"]) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 60))) for i in range(40)] + [(90, ""), (91, None)]
    refs = [(i, say(rng.choice([1, 2, 3, 5, 9, 12]))) for i in range(40)] + [(50, docs[3][1]), (51, docs[3][1]), (52, "a b"), (53, ""), (54, None)]
    want = {(d, r) for d, x in docs for r, y in refs if x and y and f" {y} " in f" {x} "}
    df = lambda rows: spark.createDataFrame(rows, "ord long, norm_text string")
    assert {tuple(r) for r in similarity.containing(df(docs), df(refs), words=4).collect()} == want
    strings = similarity.containing(df(docs).selectExpr("cast(ord as string) ord", "norm_text"), df(refs))
    assert {(int(r[0]), r[1]) for r in strings.collect()} == want
