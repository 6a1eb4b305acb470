"""Near-duplicates: what is compared and joined where many texts share buckets."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomrank.llm import near_dedup
from loomrank.llm.common import stored


def hashes(words):
    return near_dedup.words(np.frombuffer(" ".join(words).encode(), np.uint8))


def test_repeats_of_a_word_count_in_parities():
    """Two more of a word are two edits, so two bits, also where their number stays even; an edit never changes more."""
    gen = random.Random(2)
    bits = lambda w: np.unpackbits(near_dedup.parities(hashes(w)).view(np.uint8))
    assert (bits(["of"] * 4 + ["no"]) != bits(["of"] * 2 + ["no"])).sum() == 2
    for n in (3, 40, 700):
        a = [f"w{gen.randrange(n)}" for _ in range(n)]
        b, edits = list(a), 0
        for _ in range(n // 8 + 1):
            k, how = gen.randrange(len(b)), gen.randrange(3)
            b[k : k + 1] = [[], [f"w{gen.randrange(n)}"], [b[k], "more"]][how]
            edits += 2 if how == 1 else 1
        assert (bits(a) != bits(b)).sum() <= edits


def test_a_pair_of_several_buckets_is_compared_once(spark, monkeypatch):
    """Against all pairs in different classes that may be links, with many tiles of few texts."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    gen = random.Random(3)
    base = [f"w{gen.randrange(60)}" for _ in range(50)]
    texts = [[w if gen.random() > 0.12 else f"v{gen.randrange(9)}" for w in base[: gen.randint(36, 50)]] for _ in range(40)]
    rows = [(i, " ".join(t), i % 3, sorted(gen.sample(range(5), 3))) for i, t in enumerate(texts)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    own = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "id long, label long, sig array<long>")
    reps = stored(near_dedup.sketched(df).withColumn("id", F.col("doc_id")).drop("sig").join(own.select("id", "sig"), "id"), "reps")
    got = near_dedup.unsettled(own.select(F.explode("sig").alias("bucket"), "id", "label"), reps).collect()
    words = [hashes(t) for t in texts]
    want = set()
    for i, a in enumerate(words):
        for j in range(i):
            most, apart = int(0.2 * max(len(a), len(words[j])) + 1e-9), abs(len(a) - len(words[j]))
            flips = np.bitwise_count((near_dedup.parities(a) ^ near_dedup.parities(words[j])).view(np.uint64)).sum()
            if i % 3 != j % 3 and set(rows[i][3]) & set(rows[j][3]) and apart <= most and flips <= 2 * most - apart:
                want.add((j, i, j % 3, i % 3))
    assert len(want) > 50 and sorted(tuple(r) for r in got) == sorted(want)


def test_rounds_join_classes(spark, monkeypatch):
    """Links of later rounds join what is still apart: the links of the first round aren't gone through again."""
    gen, sizes, plain = random.Random(4), [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: (sizes.append(edges.count()), plain(edges))[1])
    words = lambda n: [f"w{gen.randrange(10**6)}" for _ in range(n)]
    # thirty copies of one text meet in the first bucket, two of another in a later one only
    one, two = words(60), words(60)
    texts = [[*one[:k], "changed", *one[k + 1 :]] for k in range(30)] + [two, [*two[:9], "changed", *two[10:]]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sig = F.when(F.col("doc_id") < 30, F.array(*[F.lit(1).cast("long")] * near_dedup.FIRST)).otherwise(F.array(*(F.col("doc_id") + 100 + k * 50 for k in range(near_dedup.FIRST)), F.lit(2).cast("long")))
    reps = stored(near_dedup.sketched(df).withColumns({"id": F.col("doc_id"), "sig": sig}), "reps")
    got = sorted((r["id"], r["label"]) for r in near_dedup.classes(df, reps).collect())
    assert got == [(i, 0) for i in range(30)] + [(30, 30), (31, 30)]
    assert sizes[0] >= 29 and sizes[1] == 1 and sum(sizes[1:]) == 1


def test_long_texts_are_told_apart_before_they_are_read(spark):
    """Unlike texts of thousands of words share a bucket: their parities rule a link out, and keep those that are links,
    also where one has twice as many parities as the other."""
    gen = random.Random(5)
    often = [f"w{k}" for k in range(40)]
    make = lambda n: [gen.choice(often) if gen.random() < 0.4 else f"v{gen.randrange(10**6)}" for _ in range(n)]
    texts = [make(n) for n in (3000, 3100, 3200, 4000, 4090)]
    long = make(4090)
    texts += [long, [*long[:2000], *make(30), *long[2000:]]]  # 8192 and 16384 parities
    assert [len(near_dedup.parities(hashes(t))) * 64 for t in texts[-2:]] == [8192, 16384]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    reps = stored(near_dedup.sketched(df).withColumns({"id": F.col("doc_id"), "sig": F.array(F.lit(1).cast("long"))}), "reps")
    members = reps.select(F.lit(1).cast("long").alias("bucket"), "id", F.col("id").alias("label"))
    assert [tuple(r) for r in near_dedup.unsettled(members, reps).collect()] == [(5, 6, 5, 6)]
    every = [(i, j, i, j) for j in range(7) for i in range(j)]
    pairs = spark.createDataFrame(every, "low long, high long, low_class long, high_class long")
    assert [tuple(r) for r in near_dedup.possible(pairs, reps).collect()] == [(5, 6, 5, 6)]


def test_only_members_that_meet_go_on(spark):
    """Buckets of one text, and members of a bucket that no other one's number of words comes near, go no further."""
    rows = [(1, 1, 50), (2, 2, 50), (2, 3, 50), (3, 4, 50), (3, 5, 90), (4, 6, 80), (4, 7, 100), (4, 8, 500), (5, 9, 1), (5, 10, 1), (5, 11, 3)]
    members = spark.createDataFrame(rows, "bucket long, id long, n_words int")
    assert sorted(tuple(r)[:2] for r in near_dedup.met(members, "id").collect()) == [(2, 2), (2, 3), (4, 6), (4, 7), (5, 9), (5, 10), (5, 11)]
    # whatever may be a link stays
    n = [*range(1, 300), *range(300, 4000, 37)]
    pairs = [(i * 10**6 + a * 1000 + k, 2 * i + s, x) for i, a in enumerate(n) for k, b in enumerate(x for x in n if a <= x <= a / 0.8 + 1e-9) for s, x in enumerate((a, b))]
    members = spark.createDataFrame(pairs, "bucket long, id long, n_words int")
    assert near_dedup.met(members, "id").count() == len(pairs)
