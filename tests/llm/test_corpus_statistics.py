"""Ranked search, toxicity and source divergence against plain versions of themselves, over texts with nulls, copies, ties,
odd characters and columns of clashing names, and over empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomrank.llm import divergence, ranked_search, terms, toxicity

rng = random.Random(8)
SCHEMA = "doc_id long, text string, lang string, source string, q long, term string, rank int, score long, k int, rows int, shard string"
WORDS = [f"{a}{b}" for a in ("ta", "Ré", "mi9", "日本", "zo") for b in ("", "n", "KO", "ë", "lu2")]


def prose(n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ", ", "_", "\n", "-", "\x00"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(rng.randint(1, 60)) for _ in range(60)]
    texts = [*base, base[0], base[0], None, "", " \n", "!!! ???", "a", "A", "z" * 900, "ta " * 300, prose(3000)]
    out = [(i * 3, t, rng.choice(["xx", "yy", None, "zz"]), rng.choice(["s1", "s2", "s3", None, "é"])) for i, t in enumerate(texts)]
    return [*out, (3, texts[1], "xx", "s1"), (None, texts[2], "yy", "s2"), (None, "ta ta", "qq", "only")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text, digits):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_terms_by_parts(rows, step):
    raw = [(r[1] or "").encode() for r in rows]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row, term, n = terms.counted(data, at, terms.ALNUM, step)
    want = Counter((i, t) for i, r in enumerate(rows) for t in tokens(r[1], True))
    assert Counter({(i, t): c for i, t, c in zip(row.tolist(), term.to_pylist(), n.tolist(), strict=True)}) == want and len(row) == len(want)


def ranking(rows, items, k):
    """The contract's formula, with Python's whole numbers."""
    bags = [(i, Counter(tokens(t, True))) for i, t, *_ in rows]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            s = 0
            for t, times in Counter(tokens(text, True)).items():
                if b[t]:
                    df = sum(t in x for _, x in bags)
                    m = 25 + 75 * sum(b.values()) * n // total
                    s += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "ta rélu2 zoko"), (2, prose(20)), (3, None), (4, "!!"), (5, "unknown words"), (6, "ta " * 9), (6, "日本 a a"), (None, prose(8))]


def test_ranked_search(spark, rows, docs, empty):
    queries = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, rank int")
    index = ranked_search.build(docs.repartition(9), shard_bytes=700)
    assert index.shards.count() == 9
    for k in (1, 3, 10, 500):
        want = ranking(rows, ITEMS, k)
        for block in (1, 1 << 20):  # a query a block, or all in one
            got = ranked_search.search(index, queries, k, block_bytes=block)
            assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want
    assert ranked_search.search(index, queries.limit(0)).count() == 0
    none = ranked_search.build(empty)
    assert (none.n, none.total) == (0, 0) and ranked_search.search(none, queries).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(none, queries).count() == 0


def test_best_is_tie_safe():
    for _ in range(300):
        scores = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 30))], np.int64)
        k = rng.randint(1, 12)
        want = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:k]
        assert sorted(ranked_search.best(scores, k).tolist()) == sorted(want)


def test_lengths_beyond_64_bits():
    n = np.array([5, 10**9], np.int64)
    assert ranked_search.lengths_factor(n, 10**12, 10**13).tolist() == [25 + 75 * 5 * 10**12 // 10**13, 25 + 75 * 10**21 // 10**13]


def divergences(rows, min_docs):
    bags = [((lang or ""), (src or ""), Counter(tokens(t, False))) for _, t, lang, src in rows]
    out = []
    for lang in {b[0] for b in bags}:
        of = [b for b in bags if b[0] == lang]
        df = Counter(t for _, _, b in of for t in b)
        kept = sorted(t for t in df if df[t] >= min_docs)
        counts = defaultdict(Counter)
        for _, src, b in of:
            for t, n in b.items():
                if df[t] >= min_docs:
                    counts[src][t] += n
        sources = {s for _, s, _ in of}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept))  # noqa: E731, B023
        n = {s: sum(counts[s].values()) for s in sources}
        p = {s: {t: share(counts[s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[s][t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("min_docs", [1, 10, 1000])
def test_divergence(rows, docs, min_docs, monkeypatch):
    monkeypatch.setattr(divergence, "GATHER", 500)  # several rounds of counting
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in divergence.audit(docs, min_docs).select(*columns).collect()) == divergences(rows, min_docs)


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    one = spark.createDataFrame([(1, None, "xx", "s", 0), (1, None, "xx", "t", 0)], "doc_id long, text string, lang string, source string, value int")
    assert Counter(tuple(r) for r in divergence.audit(one).collect()) == Counter([("xx", "s", "pair", "t", 0, 1), ("xx", "t", "pair", "s", 0, 1)])


def test_sql_twins(spark, rows, docs):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "lang", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame[frame["doc_id"].notna()])
    con.register("benchmark", __import__("pandas").DataFrame([x for x in ITEMS if x[0] is not None], columns=["item_id", "text"]))
    known = docs.filter("doc_id is not null")
    queries = spark.createDataFrame([x for x in ITEMS if x[0] is not None], "item_id long, text string")
    got = ranked_search.search(ranked_search.build(known), queries)
    assert Counter(tuple(r) for r in got.collect()) == Counter(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({ranked_search.ORACLE})").fetchall())
    got = divergence.audit(known)
    assert Counter(tuple(r) for r in got.collect()) == Counter(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall())


def test_toxicity(spark):
    bad, words = ["vileword", "nastyish", "grubling"], [f"{a}{b}" for a in ("tar", "min", "sel", "kod", "wen") for b in ("a", "ol", "ess", "ing")]
    made = []
    for i in range(900):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(12, 150))]
        for _ in range(max(1, len(text) // 25) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(bad).upper() if i % 3 else rng.choice(bad)
        made.append((i, " ".join(text), int(toxic), "zz", "x"))
    docs = spark.createDataFrame([(*r, 1, 2, 3.0) for r in made], "doc_id long, text string, toxic int, lang string, source string, y int, k int, score double").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], r[2], "no") for r in made] + [(0, 0, 0, ""), (None, 0, 1, ""), (5, 1, None, "")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 900 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    # labels of held-out rows, and languages and sources, change nothing; nor does the layout of the table
    flipped = spark.createDataFrame([(r[0], r[0], (r[2] ^ 1) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[2]) for r in made], "doc_id long, quality int, toxic int")
    again = toxicity.scored(docs, toxicity.fit(docs.withColumn("lang", docs["text"]).repartition(7), flipped))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in again.collect()) == Counter((r["doc_id"], round(r["score"], 9)) for r in got)
    # odd rows: null, empty and repeated texts, a null id, a very long text; a toxic one is caught wherever its words stand
    long = " ".join(rng.choice(words) for _ in range(200_000))
    odd = [(1, None), (1, ""), (2, "vileword vileword"), (2, "vileword vileword"), (None, long), (9, " ".join([long, "vileword " * 20_000]))]
    s = toxicity.scored(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), model).collect()
    assert [r["predicted"] for r in s] == [0, 0, 1, 1, 0, 1] and s[0]["score"] == s[1]["score"] and s[2]["score"] == s[3]["score"]
    # ids that repeat don't make the sample grow
    copies = docs.unionByName(docs).unionByName(docs.limit(50))
    assert toxicity.sample(copies, labels)[0].count() == toxicity.sample(docs, labels)[0].count()
    # no label, one kind of label, an empty table
    assert toxicity.fit(docs, labels.limit(0)) is None and {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}
    for y in (0, 1):
        one = toxicity.fit(docs, labels.filter(f"toxic = {y} and doc_id <> 0"))
        assert {r["predicted"] for r in toxicity.scored(docs.limit(20), one).collect()} == {y}
    assert toxicity.scored(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels) is None


def test_toxic_features_are_plain_counts():
    """A text's features against a dictionary of its n-grams."""
    for text in ("", "Ab", "The  IDIOT, the idiot!", "größe 日本"):
        folded = re.sub(r" +", " ", "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in f" {text} ")).encode()
        want = Counter(folded[i : i + n] for n in range(3, 7) for i in range(len(folded) - n + 1))
        some, x = toxicity.present(np.frombuffer(text.encode(), np.uint8))
        assert len(some) == len(want)  # no two n-grams of these texts share a bucket
        assert np.allclose(sorted(x**2), sorted(v / max(1, sum(want.values())) for v in want.values()))
        assert np.allclose(toxicity.shares(np.frombuffer(text.encode(), np.uint8), np.arange(1 << toxicity.BITS), 1 << toxicity.BITS)[some], x)
