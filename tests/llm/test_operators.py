"""Each corpus operator against a plain version of itself, over texts with nulls, copies, ties, odd characters and columns
of clashing names, and over an empty table."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomrank.llm import decontaminate, fingerprint, html_main, language, licenses, near_dedup, packing, quality, repeats, sentence_dedup
from loomrank.llm.common import stored

rng = random.Random(3)
SYLLABLES = "ta re mi no lu sé kö ba di fe go hu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, spans int, label string"


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(n):
    return " ".join(" ".join(word() for _ in range(rng.randint(3, 12))).capitalize() + rng.choice(".!?") + rng.choice(["", "", "\n"]) for _ in range(n)).replace("\n ", "\n")


PASSAGE = prose(9)
BASE = [prose(rng.randint(1, 25)) for _ in range(30)]
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1], None, "", "", " \n ", "!!! ???", "a", "x" * 700, "ab " * 400, f"{prose(2)}\n{PASSAGE}\n{prose(3)}", f"{PASSAGE} {prose(2)}",
    BASE[2].replace("ta", "tu", 2), BASE[3] + " more", "日本語 テキスト " * 40, "Released under the MIT License.", "gnu GENERAL public-license, mit license; cc by", "it's <|endoftext|> a 'test'\x01", "Σίσυφος ΣΑΣ İ", prose(900),
]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 7 % 1000, t) for i, t in enumerate(TEXTS)]
    return [*out, (7, TEXTS[1]), (None, "text of no id, with several words. And one more sentence of words here.")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", 1, "k", 5, 2, "l") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_decontaminate(spark, rows, docs, empty):
    items = [(1, PASSAGE), (2, " ".join(BASE[4].split()[:6])), (3, None), (4, "!!"), (5, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {i: decontaminate.windows_of(decontaminate.words_of(t)) for i, t in items}
    want = Counter()
    for i, t in rows:
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for item, ws in windows.items():
            for n in {len(x.split()) for x in ws}:
                for k in range(len(w) - n + 1):
                    if b" ".join(w[k : k + n]) in ws:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[i, len(w), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(decontaminate.digest(decontaminate.occurrences(docs, bench)), *columns) == want
    # a benchmark beyond one automaton's bound takes several
    assert got(decontaminate.digest(decontaminate.occurrences(docs, bench, limit=100)), *columns) == want
    assert decontaminate.occurrences(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs, bench).columns == docs.columns
    spans = decontaminate.occurrences(docs, bench).filter(F.size("spans") > 0).join(docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")), F.expr("d = doc_id")).first()
    assert spans["t"][spans["spans"][0]["start"] : spans["spans"][0]["end"]].split()[0].lower() in (PASSAGE + BASE[4]).lower()


def test_packing(rows, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    ids = {(i, t): [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = packing.packed(docs).collect()
    want = Counter()
    for (i, t), n in Counter(rows).items():
        want[i, len(ids[i, t])] += n
    have = Counter()
    for r in pieces:
        if r["start"] == 0:
            have[r["doc_id"], r["doc_tokens"]] += 1
        match = [x for (i, _), x in ids.items() if i == r["doc_id"] and len(x) == r["doc_tokens"]]
        cut = [bytes().join(v.to_bytes(4, "little") for v in x[r["start"] : r["start"] + r["length"]]) for x in match]
        assert r["ids_crc32"] in [zlib.crc32(c) for c in cut]
    assert have == want and sum(r["length"] for r in pieces) == sum(len(ids[k]) * n for k, n in Counter(rows).items())
    by = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert by.setdefault(r["sequence_id"], 0) == r["offset"]  # no gaps
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= packing.SIZE
    assert packing.packed(empty).count() == 0


def test_plan_is_cheapest():
    for _ in range(60):
        n, size = rng.randint(1, 9), 16
        cuts, at = [], 0
        for _ in range(n):
            at += rng.randint(1, size)
            cuts.append(at)
        fee = [rng.choice([0.0, 0.5, 4.0]) for _ in cuts]

        def cost(stops):
            total, a = 0.0, 0
            for s in stops:
                w = s - a
                if w > size:
                    return None
                total += (0 if w & (w - 1) == 0 else size - w) + fee[cuts.index(s)] + packing.WINDOW_COST
                a = s
            return total

        best = min(c for m in range(1 << (n - 1)) if (c := cost([x for k, x in enumerate(cuts[:-1]) if m >> k & 1] + [cuts[-1]])) is not None)
        import numpy as np

        assert cost(packing.plan(np.array(cuts), np.array(fee), size)) == pytest.approx(best)


def test_fingerprints(spark, rows, docs, empty):
    order = sorted(((i if i is not None else fingerprint.LEAST_ID, t or "") for i, t in rows), key=lambda r: -r[0])
    out = fingerprint.fingerprints(docs).collect()
    assert len(out) == len(rows)
    have = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out}
    single = [k for k, r in enumerate(order) if [x[0] for x in order].count(r[0]) == 1]
    for k in single:
        i, t = order[k]
        j, nxt = order[(k + 1) % len(order)]
        if [x[0] for x in order].count(j) == 1:
            n = len(t) // 3
            new = t[: len(t) - n] + nxt[:n]
            assert (None if i == fingerprint.LEAST_ID else i, len(t), hashlib.sha256(new.encode()).hexdigest()) in have
    a, b = "one two three\nfour five six", "four five six\none two three"
    s, t = fingerprint.State.of(a.encode()), fingerprint.State.of(b.encode())
    assert s.printed() == t.printed() and s.likeness(t) == 1.0
    more = s + fingerprint.State.of(b"seven eight nine ten")
    assert (more - fingerprint.State.of(b"seven eight nine ten")).printed() == s.printed() != more.printed() == fingerprint.updated(s.printed(), inserted=(b"seven eight nine ten",))
    assert 0.4 < s.likeness(more) < 1 and s.likeness(fingerprint.State.of(b"nothing of the kind at all")) < 0.3
    assert fingerprint.fingerprints(empty).count() == 0
    # every column of the query, by a plain sum of each paragraph's numbers
    def plain(text):
        total = [0] * fingerprint.LANES
        for line in text.encode().split(b"\n"):
            d = hashlib.shake_128(line).digest(4 * fingerprint.LANES)
            total = [(x + int.from_bytes(d[4 * k : 4 * k + 4], "little")) % 2**32 for k, x in enumerate(total)]
        return "".join(x.to_bytes(4, "little").hex() for x in total)

    def shingles(text):
        return Counter(tuple(w[k : k + 3]) for line in text.split("\n") for w in [line.split()] for k in range(max(1, len(w) - 2)) if w)

    for k in single:
        i, t = order[k]
        j, nxt = order[(k + 1) % len(order)]
        if [x[0] for x in order].count(j) == 1:
            n = len(t) // 3
            new = t[: len(t) - n] + nxt[:n]
            r = next(r for r in out if r["doc_id"] == (None if i == fingerprint.LEAST_ID else i))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (plain(t), plain(new))
            for near, other in ((r["near_edited"], new), (r["near_next"], nxt)):
                a, b = shingles(t), shingles(other)
                # the dot product of counts over the norms' mean, which the sketch estimates
                want = 1.0 if plain(t) == plain(other) else 2 * sum(a[x] * b[x] for x in a) / max(1, sum(v * v for v in a.values()) + sum(v * v for v in b.values()))
                assert abs(near - want) < 0.2, (t[:50], near, want)


def test_sentence_spans(rows, docs, empty):
    order = sorted(set((i if i is not None else sentence_dedup.LEAST_ID, t or "") for i, t in rows))
    out = {(r["doc_id"], r["text"]) for r in sentence_dedup.deduplicated(docs).collect()}
    assert sum(PASSAGE[:60] in (t or "") for _, t in out) == 1
    seen, want = set(), {}
    ids = Counter(i for i, _ in order)
    for i, t in order:
        if ids[i] > 1:
            continue
        parts = sentence_dedup.sentences(t)
        assert "".join(parts) == t
    if max(ids.values()) == 1:
        for i, t in order:
            parts, gone = sentence_dedup.sentences(t), set()
            for h, a, n in sentence_dedup.spans(parts):
                gone |= set(range(a, a + n)) if h in seen else set()
                seen.add(h)
            want[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
        assert out == {(None if i == sentence_dedup.LEAST_ID else i, t) for i, t in want.items()}
    assert sentence_dedup.deduplicated(empty).count() == 0


def test_sentence_runs(spark):
    """Against all runs of two sentences or more, of any number of words, and sentences of LONG words."""
    gen = random.Random(4)
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + ". "
    passage, footer = [say(20), say(5), say(4)], [say(2), say(3)]
    pool = [say(gen.choice([1, 3, 8, 40])) for _ in range(12)]
    texts = [[say(9), *passage, say(9), *footer], [say(7), *passage, say(30), *footer], [*passage, *footer], *([gen.choice(pool) for _ in range(gen.randint(1, 12))] for _ in range(20))]
    seen, want = set(), {}
    for i, parts in enumerate(texts):
        low, gone = [p.strip().lower() for p in parts], set()
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if b - a > 1 or len(low[a].split()) >= sentence_dedup.LONG:
                    gone |= set(range(a, b)) if tuple(low[a:b]) in seen else set()
                    seen.add(tuple(low[a:b]))
        want[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    df = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in sentence_dedup.deduplicated(df).collect()} == want


def test_near_duplicates(rows, docs, empty):
    import numpy as np

    words = {t: near_dedup.words(np.frombuffer((t or "").encode(), np.uint8)) for _, t in rows}
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    texts = list({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and near_dedup.similar(words[a], words[b]):
                parent[top(a)] = top(b)
    want = {}
    for i, t in rows:
        want.setdefault(top(t or ""), []).append(near_dedup.LEAST_ID if i is None else i)
    assert Counter(tuple(sorted(v)) for v in want.values()) == Counter(
        tuple(sorted(near_dedup.LEAST_ID if r["doc_id"] is None else r["doc_id"] for r in g)) for g in _grouped(out)
    )
    kept = near_dedup.one_of_each(docs)
    assert kept.count() == len(want) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def _grouped(out):
    groups = {}
    for r in out:
        groups.setdefault((r["class_id"], r["n_texts"]), []).append(r)
    return groups.values()


def test_near_duplicates_in_a_crowd(docs):
    """Texts of one template that all share a bucket: each has one near copy, and most of them are no bucket's leader."""
    gen = random.Random(8)
    template = " ".join("".join(gen.choice(SYLLABLES) for _ in range(3)) for _ in range(30))
    own = [[f"w{k}x{j}" for j in range(30)] for k in range(20)]
    crowd = [f"{template} {' '.join(w)}" for w in own] + [f"{template} {' '.join(w[:-6])} {' '.join(reversed(w[-6:]))}" for w in own]
    df = docs.sparkSession.createDataFrame(list(enumerate(crowd)), "doc_id long, text string")
    reps = near_dedup.sketched(df).withColumns({"id": F.col("doc_id"), "sig": F.array(F.lit(1).cast("long"))})
    reps = stored(reps, "reps")
    assert sorted((r["id"], r["label"]) for r in near_dedup.classes(df, reps).collect()) == [(i, i % 20) for i in range(40)]


def test_sketches_of_several_texts(monkeypatch):
    """A text's sketches are its two least k-mers, whatever texts it is sketched with."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "GROUP", 50)
    rng, odd = np.random.default_rng(3), near_dedup._ODD
    texts = [near_dedup.kmers(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 1, 2, 3, 30, 0, 200, 12, 1)]
    for h, own in zip(texts, near_dedup.all_sketches(texts), strict=True):
        assert len(own) == (near_dedup.SKETCHES if len(h) else 0)
        for k in range(len(own)):
            with np.errstate(over="ignore"):
                two = sorted(np.argsort((h ^ odd[40 + k]) * odd[8 + k])[:2])
                want = near_dedup.mix(h[two[:1]] * odd[1] + (h[two[-1:]] ^ odd[2]) * odd[3] + np.uint64(k))
            assert own[k] == want[0]
    assert near_dedup.all_sketches([]) == []


def test_candidates_at_the_threshold():
    """Texts with a fifth of their words changed, inserted or left out share a bucket."""
    import numpy as np

    gen = random.Random(5)
    for n, tries, most_lost in [(5, 60, 0), (9, 60, 0), (13, 60, 0), (16, 60, 0), (19, 60, 0), (25, 200, 4), (60, 200, 3), (300, 200, 2)]:
        lost = 0
        for _ in range(tries):
            a = [f"w{gen.randrange(10**6)}" for _ in range(n)]
            b = list(a)
            for k in gen.sample(range(n), n // 5):
                b[k] = gen.choice([f"v{k}", f"v{k}", f"v{k}", "", f"{b[k]} v{k}"]) if len(a) > 9 else f"v{k}"
            x, y = (near_dedup.words(np.frombuffer(" ".join(t).encode(), np.uint8)) for t in (a, b))
            if near_dedup.similar(x, y):
                sigs = [set(near_dedup.sketches(near_dedup.kmers(w)).tolist()) | set(near_dedup.pieces(w).tolist()) for w in (x, y)]
                lost += not sigs[0] & sigs[1]
        assert lost <= most_lost, (n, lost)


def test_long_texts_are_read_in_blocks(monkeypatch):
    """What is worked out block by block is what it is at once, on every text, and a long one takes bounded memory."""
    import tracemalloc

    import numpy as np

    from loomrank.llm import common

    raws = [np.frombuffer((t or "").encode(), np.uint8) for t in TEXTS]
    whole = [(near_dedup.words(r).tolist(), fingerprint.sketch(r.tobytes()).tolist(), [x.tolist() for x in repeats.anchors(r)]) for r in raws]
    ids = packing.tokens(packing.vocabulary())
    apart = [ids.of([t or ""])[0][0].tolist() for t in TEXTS]
    assert [x.tolist() for x, _ in ids.of([t or "" for t in TEXTS], most=70)] == apart
    long = np.frombuffer((prose(4000) * 60).encode()[: 24 << 20], np.uint8)
    for work in (near_dedup.words, repeats.anchors, lambda x: fingerprint.sketch(x.tobytes())):
        tracemalloc.start()
        work(long)
        assert tracemalloc.get_traced_memory()[1] < 12 * len(long) + (160 << 20)
        tracemalloc.stop()
    small = lambda data, ends, most=64: common.blocks(data, ends, most)
    monkeypatch.setattr(near_dedup, "blocks", small)
    monkeypatch.setattr(fingerprint, "blocks", small)
    assert [(near_dedup.words(r).tolist(), fingerprint.sketch(r.tobytes()).tolist(), [x.tolist() for x in repeats.anchors(r, 300)]) for r in raws] == whole


def test_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(400):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(1, 20))] for _ in range(2))
        most = rng.randint(1, 8)
        d = plain(a, b)
        if d <= most < max(len(a), len(b)):
            assert near_dedup.distance(a, b, most) == d
        elif d > most:
            assert near_dedup.distance(a, b, most) > most


@pytest.mark.parametrize("hot", [30_000, 3])
def test_repeats(rows, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[s : s + 200] for _, r in raw for s in range(len(r) - 199))
    want = Counter()
    for i, r in raw:
        gone = [False] * len(r)
        for s in range(len(r) - 199):
            if count[r[s : s + 200]] > 1:
                gone[s : s + 200] = [True] * 200
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()] += 1
    assert got(repeats.deduplicated(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if hot > 3:
        assert repeats.deduplicated(empty).count() == 0
        assert repeats.without_repeats(docs).count() == len(rows)


def test_licenses(rows, docs, empty):
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.scanned(docs).collect()}
    for i, t in rows:
        w = [x.decode() for x in decontaminate.words_of(t)]
        r = out[i, len(w)]
        starts = [(k, x.label) for x in licenses.BASE for k in range(len(w)) if w[k : k + len(x.phrase)] == x.phrase]
        assert r["n_base"] == len(starts) and r["base_labels"] == ",".join(sorted({x for _, x in starts}))
        assert (r["first_word"], r["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scanned(empty).count() == 0


def test_license_notices(spark):
    mit = next(t for t in licenses.NOTICES if t.label == "mit").body
    df = spark.createDataFrame([(1, mit.upper()), (2, mit.replace("charge", "cost")), (3, "Licensed CC BY-SA 4.0")], "doc_id long, text string")
    got_ = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.scanned(df).collect()}
    assert got_ == {1: ("mit", 0), 2: ("", 0), 3: ("cc-by,cc-by-sa", 1)}


def test_language(spark, empty):
    de, en = "der die und nicht ist ein schön".split(), "the and not is of with that".split()
    data = [(k, " ".join(rng.choice(de if k % 2 else en) for _ in range(30)), "de" if k % 2 else "en") for k in range(300)]
    df = spark.createDataFrame([*data, (900, None, "de"), (901, "12 !?", None), (902, "", "en")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.predict(df, language.fit(df)).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang in data)
    assert [(out[k]["lang_pred"], out[k]["score"]) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0
    assert language.predict(df, None).filter("lang_pred <> 'und'").count() == 0
    one = df.withColumn("lang", F.lit("de"))
    assert {r["lang_pred"] for r in language.predict(one, language.fit(one)).collect()} == {"de", "und"}
    for n in (2, 3, 7, 20):
        codes = language.codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n


def test_quality(spark, empty):
    data = [(k, " ".join(word().upper() + "!!" for _ in range(25)) if k % 3 == 0 else prose(3), int(k % 3 > 0)) for k in range(240)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(5000, 1, 0), (900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    out = {r["doc_id"]: r for r in quality.scored(df, model).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert 0 <= out[900]["score"] <= 1 and out[900]["score"] == out[901]["score"]
    assert quality.kept(df, model).columns == df.columns
    assert quality.fit(df, labels.limit(0)) is None and quality.scored(empty, model).count() == 0
    assert {r["score"] for r in quality.scored(df, None).collect()} == {0.5}


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>Title &amp;amp</h1><p><b>First   words here, and many more of them.<br><p>Second paragraph of the text, quite long.</article>"
        "<section id='comments'><div class='comment'><p>Nice one!</p></div></section><footer>&copy; me &middot; about</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (3, "u", "", 5)], "page_id long, url string, html string, text int")
    out = html_main.extracted(df).orderBy("page_id").collect()
    assert out[0]["text"] == "Title &amp\nFirst words here, and many more of them.\nSecond paragraph of the text, quite long." and out[0]["n_chars"] == len(out[0]["text"])
    assert [(r["text"], r["n_chars"]) for r in out[1:]] == [("", 0)] * 3
    assert html_main.extracted(df.limit(0)).count() == 0


def test_main_text_of_other_layouts():
    """Layouts that training left out."""
    for layout, precision, recall in [("semantic", 0.9, 0.93), ("named", 0.9, 0.93), ("unnamed", 0.85, 0.93), ("table", 0.9, 0.93), ("breaks", 0.9, 0.75)]:
        model, gen = html_main.fitted(200, 11, tuple(x for x in html_main.LAYOUTS if x != layout)), random.Random(123)
        n = Counter()
        for _ in range(40):
            nodes, chunks = html_main.parse(html_main.labelled_page(gen, layout), "data-y")
            marginal = model.marginals(nodes, html_main.features(nodes, chunks))
            for k, s in chunks:
                if k >= 0 and nodes[k].label >= 0:
                    n[bool(marginal[k] > 0.5), nodes[k].label] += len(s.strip())
        assert n[True, 1] >= precision * (n[True, 1] + n[True, 0]) and n[True, 1] >= recall * (n[True, 1] + n[False, 1]), (layout, n)


def test_main_text_of_odd_pages():
    import time

    model = html_main.fitted()
    text = lambda page: html_main.main_text(page, model)
    assert text("<div class='x1'><a href=/>home</a> <a href=/b>about</a></div><div class='x3'><h1>Heading</h1><div>story</div><div>story</div></div>") == "Heading\nstory\nstory"
    assert text("<div data-id='comment-nav-footer'><p>article</p></div>") == "article"
    assert text("<p data-y='12.5'>hello there, this is a text.</p>") == "hello there, this is a text."
    table = "<table><tr><td><a href=a>A</a><br><a href=b>B</a></td><td><h1>T</h1>Some long text here. With some sentences, and so on.</td></tr><tr><td>Copyright 2001 us</td></tr></table>"
    assert text(table) == "T\nSome long text here. With some sentences, and so on."
    gen = random.Random(2)
    for _ in range(200):
        text("".join(gen.choice(["<", ">", "/", "!", "--", "'", '"', "=", "a", "p", "div", " ", "&amp;", "&#0;", "\x00", "script", "é", "td", "li"]) for _ in range(gen.randint(0, 60))))
    for unit in ["<a '", "<a x='", "<a x=\"'", "<b>", "<div>", "<p><b>", "</x>", "<!--", "<a ", "<td>", "<li><ul>", "<a x='>'", "<script>"]:
        began = time.time()
        text(unit * 20_000)
        assert time.time() - began < 5, unit


def test_messages_are_exact():
    import itertools
    import math

    model = html_main.fitted()
    nodes, chunks = html_main.parse("<div><p>some text here</p><ul><li>one</li></ul></div>")
    x = html_main.features(nodes, chunks)
    u = x @ model.weights
    total, on = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(u[k] * y[k] for k in range(len(nodes))) + sum(model.pairs[html_main._KIND.get(v.tag, 2)][y[v.parent]][y[k]] for k, v in enumerate(nodes) if k)
        total += math.exp(s)
        on = [o + math.exp(s) * y[k] for k, o in enumerate(on)]
    assert model.marginals(nodes, x) == pytest.approx([o / total for o in on])
