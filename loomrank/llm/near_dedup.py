"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are as in decontamination (A-Z lower-cased, runs of digits, letters and characters beyond ASCII). A text's k-mers
are its runs of two words (a shorter text is one k-mer), each labelled with its occurrence number, so that repeats
count. A sketch takes the two k-mers of least hash, in the order of the text; SKETCHES sketches, each with hashes of its
own. Texts that agree on a sketch share a bucket. Texts of few words have too few k-mers for that, so they also share
buckets by pieces: the shorter of two texts is cut into one piece more than the edits that a link allows, so one piece
at least stands unchanged in the longer one, moved by no more places than there are edits. Nothing is lost where the
longer text has up to SHORT words.

Copies are first brought together by a 128-bit hash of the text: only one row for each different text goes on. Texts are
dealt to their buckets once; what goes on from there is who shares a bucket with a text of about as many words. In each
bucket every text is compared with the bucket's leader (the least by id): n texts of a bucket give n pairs, and leaders
come from aggregates, so a bucket of any size is spread over tasks. The first round takes a few sketches only, the second
all of them and a second leader (the least by a hash of its id). Leaders only save work: after that every pair of a
bucket whose texts are still in different classes is compared, except where numbers of words or parities of words rule
a link out; so two texts of one bucket that are linked are in one class. Large buckets are dealt in tiles for that, and
a pair that shares several buckets is made in the first of them only. Links found in a round join classes, not texts, so
each round's graph is as small as what is left to join.

A pair is a link if its edit similarity is 0.8 or more: one less the edit distance of the two sequences of words over
the longer one's length. The distance comes from an alignment in a band around the diagonal, as wide as the distance
that the threshold allows (bit-parallel, one long integer for a column of the band). Sketches see k-mers, so the chance
to miss a pair depends on the share J of labelled k-mers in common: about (1 - J * J) ** SKETCHES. A similarity of 0.8
by single words changed here and there leaves J of about 0.47, so 4 in 10,000 such pairs never meet; if no two of the
words are neighbours, J is 0.43 and it is 2 in 1,000, and 5 in 1,000 for texts of 20 words.

Classes are the connected components of links, found by spreading least ids with pointer jumping; the class id is the
least id of the class's documents.

Defined cases: a null text is empty; texts without words are alike only if they are equal; repeated rows are copies of
each other; a null id counts as less than any other and its class id is null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, bounded, bytes_of, dropped, mix, narrowed, read, runs, small_batches, span_hashes, stored, texts
from .decontaminate import WORD_BYTES

WORDS, SKETCHES, SIMILARITY = 2, 32, 0.8
#: Words of the longer text up to which pieces find every pair.
SHORT = 19
#: Sketches of the first round, which brings together most of what is close; classes don't depend on it.
FIRST = 6
#: K-mers that are sketched at once.
GROUP = 1 << 15
#: Texts of a tile of a bucket, and bits of the parities of a text's words, at least.
TILE, PARITIES = 256, 2048
_TABLE = np.frombuffer(WORD_BYTES, np.uint8)
_ODD = mix(np.arange(1, 100, dtype=np.uint64)) | np.uint64(1)
LEAST_ID = -(1 << 63)


def words(raw: np.ndarray) -> np.ndarray:
    """The hashes of a text's words in order. A long text is read in blocks."""
    out = []
    for a, b in blocks(raw, _TABLE == 32):
        low = np.concatenate([[32], _TABLE[raw[a:b]], [32]]).astype(np.uint8)
        word = low != 32
        start, end = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
        out.append(span_hashes(low, start, end))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def kmers(w: np.ndarray) -> np.ndarray:
    """The hashes of the k-mers of some words in order, each labelled with its occurrence number."""
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = sum((w[i : len(w) - k + 1 + i] * _ODD[i] for i in range(k)), np.zeros(1, np.uint64))
        return numbered(mix(h + np.uint64(k)))


def numbered(h: np.ndarray) -> np.ndarray:
    """Some hashes in order, each labelled with its occurrence number, so that all differ."""
    order = np.argsort(h, kind="stable")
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
    if fresh.all():
        return h
    at = np.arange(len(h))
    nth = np.zeros(len(h), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(h + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), h)


def sketches(h: np.ndarray, n: int = SKETCHES) -> np.ndarray:
    """One value for each sketch: its two least k-mers in the order of the text."""
    return all_sketches([h], n)[0]


def all_sketches(texts: list[np.ndarray], n: int = SKETCHES) -> list[np.ndarray]:
    """The sketches of several texts, GROUP k-mers at a time, or one text."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    some = [k for k, h in enumerate(texts) if len(h)]
    edge = np.concatenate([[0], np.cumsum([len(texts[k]) for k in some])]).astype(np.int64)
    for a, b in runs(edge, GROUP):
        h, size = np.concatenate([texts[k] for k in some[a:b]]), np.diff(edge[a : b + 1])
        start = edge[a:b] - edge[a]

        def least(x, start=start, size=size):
            found = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, start), size))
            return found[np.searchsorted(found, start)]

        sig = np.zeros((b - a, n), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                x = (h ^ _ODD[40 + k]) * _ODD[8 + k]
                one = least(x)
                x[one] = np.uint64(0xFFFFFFFFFFFFFFFF)
                two = least(x)
                first, second = h[np.minimum(one, two)], h[np.maximum(one, two)]
                sig[:, k] = first * _ODD[1] + (second ^ _ODD[2]) * _ODD[3] + np.uint64(k)
        for k, own in zip(some[a:b], mix(sig), strict=True):
            out[k] = own
    return out


def pieces(w: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """One value for each piece of a text of few words, as the shorter and as the longer one of a pair."""
    n, found = len(w), set()

    def add(short, long, i, a, b):
        found.add(hash((short, long, i, *w[a:b].tolist())))

    for short in range(1, n + 1):
        for long in range(n, SHORT + 1):
            most = int((1 - least) * long + 1e-9)
            if n not in (short, long) or long - short > most:
                continue
            cut = [short * i // (most + 1) for i in range(most + 2)]
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                for move in range(-most, most + 1) if n == long else [0]:
                    if a + move >= 0 and b + move <= n:
                        add(short, long, i, a + move, b + move)
    return mix(np.array(sorted(found), np.int64).view(np.uint64))


def parities(w: np.ndarray) -> np.ndarray:
    """Whether each of PARITIES classes of words has an odd number of them, as bits; the repeats of a word are words of
    their own. An insertion or deletion changes one bit at most and a substitution two. A long text has more classes, a
    power of two and at least twice as many as words, as few would tell nothing of it; its halves together are the
    parities of half as many classes."""
    n = PARITIES
    while n < min(2 * len(w), 1 << 24):
        n *= 2
    odd = np.bincount((numbered(w) >> np.uint64(40)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(odd: np.ndarray, begin: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The parities of some rows in n words of 64 bits each, from those of all rows end to end and where each begins."""
    at, size = begin[rows], begin[rows + 1] - begin[rows]
    out = odd[at[:, None] + np.arange(n)]
    for k in range(n, int(size.max(initial=0)), n):
        more = size > k
        out[more] ^= odd[at[more, None] + np.arange(k, k + n)]
    return out


def distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if it is at most `most`, else some larger number. Aligns in a band of the
    diagonals up to `most` away: bit k of a column stands for the row k places above the band's lower edge."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if most >= len(a):
        most = max(1, len(a) - 1)
        if not b:
            return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most + 1
    full, top = (1 << width) - 1, width - 1
    up, down = full >> most << most, 0
    at, found = top - 1, most
    for i, x in enumerate(b):
        same = places.get(x, 0)
        first = i + most + 1 - width
        same = (same >> first if first >= 0 else same << -first) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = (down | ~(diagonal | up)) & full, diagonal & up
        if i < len(a) - most:
            found += not diagonal >> top & 1
        else:
            found += (rise >> at & 1) - (fall >> at & 1)
            at -= 1
        up, down = (fall | ~(diagonal >> 1 | rise)) & full, rise & (diagonal >> 1)
    return found


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two sequences of words is at least `least`."""
    return alike((a, numbered(a), kmers(a)), (b, numbered(b), kmers(b)), least)


def alike(one: tuple, other: tuple, least: float = SIMILARITY) -> bool:
    """The same of two texts given as their words, their numbered words and their k-mers."""
    (a, x, k), (b, y, m) = one, other
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if not shorter:
        return False
    most = int((1 - least) * longer + 1e-9)
    if longer - shorter > most:
        return False
    if not most:
        return np.array_equal(a, b)
    # an edit takes at most one word and two k-mers from what both have, so most pairs need no alignment
    if longer - len(np.intersect1d(x, y, assume_unique=True)) > most:
        return False
    if longer - WORDS + 1 - WORDS * most > len(np.intersect1d(k, m, assume_unique=True)):
        return False
    # what both begin and end with needs no alignment either
    apart = np.flatnonzero(a[:shorter] != b[:shorter])
    begin = int(apart[0]) if len(apart) else shorter
    apart = np.flatnonzero(a[len(a) - shorter + begin :][::-1] != b[len(b) - shorter + begin :][::-1])
    end = int(apart[0]) if len(apart) else shorter - begin
    return distance(a[begin : len(a) - end].tolist(), b[begin : len(b) - end].tolist(), most) <= most


def keyed(docs: DataFrame) -> DataFrame:
    """The id, text and a 128-bit hash of the text of each row."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))


def sketched(docs: DataFrame) -> DataFrame:
    """The id, a hash of the text, the sketches, the number of words, their parities and the packed text of each row."""
    import zstandard

    small_batches(docs.sparkSession)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, at = bytes_of(b.column("text"))
            own = [words(data[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
            sigs = []
            for a, c in runs(at, 1 << 20):
                sigs += [np.concatenate([x, pieces(w)]).view(np.int64) for x, w in zip(all_sketches([kmers(w) for w in own[a:c]]), own[a:c], strict=True)]
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            edge = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))
            odds = [parities(w) for w in own]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in odds])]).astype(np.int32)
            odd = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(odds) if odds else np.zeros(0, np.int64)))
            count = pa.array([len(w) for w in own], pa.int32())
            z = pa.array([pack.compress(data[at[k] : at[k + 1]].tobytes()) for k in range(len(at) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), sig, count, odd, z], names=["doc_id", "key", "sig", "n_words", "odd", "z"])

    return keyed(docs).mapInArrow(bounded(run), "doc_id long, key binary, sig array<long>, n_words int, odd array<long>, z binary")


def met(members: DataFrame, by: str) -> DataFrame:
    """The members (bucket, id, n_words and others) of buckets that hold several values of a column, as far as another
    member may have as many words as a link allows. Of a bucket only numbers are read, never a text."""
    # a link's numbers of words differ by a quarter at most, so their steps of 1.26 are the same or neighbours
    step = F.pmod(F.floor(F.log(F.greatest("n_words", F.lit(1))) / math.log(1.26)), F.lit(64)).cast("int")
    own, all_of = members.withColumn("step", step), Window.partitionBy("bucket")
    values = [F.min(by).over(all_of).alias("lo"), F.max(by).over(all_of).alias("hi"), F.count("*").over(all_of).alias("n"), F.expr("bit_or(shiftleft(1L, step))").over(all_of).alias("steps")]
    near = "steps & (shiftleft(1L, pmod(step + 1, 64)) | shiftleft(1L, pmod(step - 1, 64))) <> 0 or n > bit_count(steps)"
    return own.select("*", *values).filter("lo <> hi").filter(near).select(*members.columns)


def led(members: DataFrame, by_hash: bool) -> DataFrame:
    """The pairs (low, high, and the class of each) of a member (bucket, id, label, n_words) and a leader of its bucket that
    are in different classes and may be links by their numbers of words."""
    who = F.struct("id", "label", "n_words")
    agg = [F.min(who).alias("a"), F.min("label").alias("lo"), F.max("label").alias("hi")]
    if by_hash:
        agg.append(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "label", "n_words")).alias("b"))
    leaders = members.groupBy("bucket").agg(*agg).filter("lo <> hi")
    leaders = leaders.select("bucket", F.array_distinct(F.array("a", *([F.struct("b.id", "b.label", "b.n_words")] if by_hash else []))).alias("leaders"))
    sides = members.join(leaders, "bucket").select(who.alias("own"), F.explode("leaders").alias("with"))
    sides = sides.filter("own.label <> with.label").filter(apart(F.col("own"), F.col("with")) <= edits(F.col("own"), F.col("with")))
    return between(F.col("own"), F.col("with"), sides).distinct()


def between(x: Column, y: Column, df: DataFrame) -> DataFrame:
    """The pairs (low, high, and the class of each) of two columns of (id, label and others)."""
    both = df.select(F.when(x["id"] < y["id"], x).otherwise(y).alias("x"), F.when(x["id"] < y["id"], y).otherwise(x).alias("y"))
    return both.select(F.col("x.id").alias("low"), F.col("y.id").alias("high"), F.col("x.label").alias("low_class"), F.col("y.label").alias("high_class"))


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The classes (low, high) of the pairs that are links."""
    import zstandard

    wanted = pairs.select(F.col("low").alias("id")).union(pairs.select("high")).distinct()
    held = stored(wanted.join(narrowed(reps.select("id", "z"), wanted, "id"), "id"), "texts")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last: dict = {}

        def read_(side, i, z):
            if last.get(side, (None,))[0] != i:
                w = words(np.frombuffer(unpack.decompress(z), np.uint8))
                last[side] = i, (w, numbered(w), kmers(w))
            return last[side][1]

        for b in batches:
            sides = zip(*(b.column(c).to_pylist() for c in ("low", "high", "x", "y")), strict=True)
            keep = [alike(read_("x", low, x), read_("y", high, y)) for low, high, x, y in sides]
            yield pa.RecordBatch.from_arrays([b.column("low_class"), b.column("high_class")], names=["low", "high"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(held.select(F.col("id").alias("low"), F.col("z").alias("x")), "low")
    both = one.join(held.select(F.col("id").alias("high"), F.col("z").alias("y")), "high")
    return both.select("low", "high", "low_class", "high_class", "x", "y").mapInArrow(bounded(run), "low long, high long")


def edits(x: Column, y: Column) -> Column:
    """How many edits a link of two texts (n_words) allows."""
    return F.floor((1 - SIMILARITY) * F.greatest(x["n_words"], y["n_words"]) + 1e-9)


def apart(x: Column, y: Column) -> Column:
    return F.abs(x["n_words"] - y["n_words"])


def may_link(x: Column, y: Column) -> Column:
    """Whether two texts (n_words, odd) may be links by their numbers of words and by the parities of their words."""
    both = F.least(F.size(x["odd"]), F.size(y["odd"]))
    # the longer text may have twice as many parities; were it more, the numbers of words would rule a link out
    bits = lambda odd, k: F.when(F.size(odd) > both, odd[k].bitwiseXOR(odd[k + both])).otherwise(odd[k])
    flips = F.aggregate(F.sequence(F.lit(0), both - 1), F.lit(0), lambda n, k: n + F.bit_count(bits(x["odd"], k).bitwiseXOR(bits(y["odd"], k))))
    return (apart(x, y) <= edits(x, y)) & (flips <= 2 * edits(x, y) - apart(x, y))


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs of ids (low, high, and the class of each) that may be links, before any text is read."""
    side = lambda c, n: reps.select(F.col("id").alias(c), F.struct("n_words", "odd").alias(n))
    both = pairs.join(side("low", "x"), "low").join(side("high", "y"), "high")
    return both.filter(may_link(F.col("x"), F.col("y"))).select("low", "high", "low_class", "high_class")


def unsettled(members: DataFrame, reps: DataFrame) -> DataFrame:
    """All pairs (low, high, and the class of each) of a bucket's members (bucket, id, label) that are in different classes
    and may be links by their numbers of words and by the parities of their words."""
    own = met(members.select("bucket", "id", "label").join(reps.select("id", "n_words"), "id"), "label")
    size = own.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    own = own.drop("n_words").join(size, "bucket")
    own = own.groupBy("id").agg(F.first("label").alias("label"), F.collect_list(F.struct("bucket", "tiles")).alias("at"))
    own = stored(own.join(reps.select("id", "n_words", "odd"), "id"), "unsettled")
    columns = ["id", "label", "n_words", "odd", F.col("at.bucket").alias("buckets")]
    own = own.select(*columns, F.explode("at").alias("in")).select("in.*", "id", "label", "n_words", "odd", "buckets")
    # every tile of a bucket meets every other one, and itself, once
    own = own.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles")).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    own = own.withColumns({"lower": F.least("tile", "other"), "upper": F.greatest("tile", "other")}).drop("tiles", "other")
    at = ["bucket", "lower", "upper"]
    return own.repartition(*at).sortWithinPartitions(*at).mapInArrow(bounded(compared), "low long, high long, low_class long, high_class long")


def compared(batches):
    """The pairs of `unsettled` from its tiles' texts, in the order of the pairs of tiles."""
    names = ("bucket", "lower", "upper", "tile", "id", "label", "n_words")
    rest = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            table = pa.Table.from_batches([b])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None:
            continue
        rest = rest.combine_chunks()
        bucket, lower, upper, tile, ids, label, n = (rest.column(c).to_numpy() for c in names)
        edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])) + 1
        edge = np.concatenate([[0], edge, [] if b is not None else [len(bucket)]]).astype(np.int64)
        if len(edge) < 2:
            continue
        (odd, at), (shared, begin) = (flat(rest.column(c)) for c in ("odd", "buckets"))
        odd, size = odd.view(np.uint64), np.diff(at)
        low, high = [], []
        for a, c in itertools.pairwise(edge.tolist()):
            x, y = np.flatnonzero(tile[a:c] == lower[a]) + a, np.flatnonzero(tile[a:c] == upper[a]) + a
            i, j = (x[k] for k in np.triu_indices(len(x), 1)) if lower[a] == upper[a] else (np.repeat(x, len(y)), np.tile(y, len(x)))
            most, apart = np.floor((1 - SIMILARITY) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64), np.abs(n[i] - n[j])
            may = (label[i] != label[j]) & (apart <= most)
            i, j, flips = i[may], j[may], (2 * most - apart)[may]
            least, may = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
            for m in np.unique(least).tolist():
                of = np.flatnonzero(least == m)
                for k in np.split(of, range((1 << 19) // m or 1, len(of), (1 << 19) // m or 1)):
                    may[k] = np.bitwise_count(folded(odd, at, i[k], m) ^ folded(odd, at, j[k], m)).sum(1) <= flips[k]
            own: dict = {}
            for p, q in zip(i[may].tolist(), j[may].tolist(), strict=True):
                for k in (p, q):
                    if k not in own:
                        own[k] = frozenset(shared[begin[k] : begin[k + 1]].tolist())
                # every bucket that both share is among the buckets of each, as it holds both classes
                if min(own[p] & own[q]) == bucket[a]:
                    low.append(min(p, q, key=ids.__getitem__))
                    high.append(max(p, q, key=ids.__getitem__))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[low], ids[high], label[low], label[high])] if low else [pa.array([], pa.int64())] * 4, names=["low", "high", "low_class", "high_class"])
        rest = rest.slice(int(edge[-1]))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and where each row begins (one more than rows)."""
    array = column.chunk(0) if column.num_chunks else column.combine_chunks()
    at = array.offsets.to_numpy()
    return array.flatten().to_numpy(), at - at[0]


def classes(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The class (id, label) of every id of the different texts of some rows: reps has what `sketched` makes of them, and an
    id for each."""
    label: DataFrame | None = None
    tried: list[DataFrame] = []

    first = [F.posexplode("sig").alias("at", "bucket"), "id", "n_words"]
    shared = stored(met(reps.select(*first).select("bucket", "id", "n_words", (F.col("at") < FIRST).alias("early")), "id"), "shared")

    def classed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("label", F.col("id")) if label is None else rows.join(label, "id")

    def linked(pairs: DataFrame) -> None:
        nonlocal label
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            tried.append(pairs)
            links = stored(verified(pairs, reps), "links")
            joined = components(links).select(F.col("id").alias("label"), F.col("label").alias("to"))
            label = stored(classed(reps.select("id")).join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            dropped(links)

    def fresh(pairs: DataFrame) -> DataFrame:
        had = [p.select("low", "high") for p in tried]
        return pairs.join(functools.reduce(DataFrame.union, had), ["low", "high"], "left_anti") if had else pairs

    linked(possible(led(classed(shared.filter("early")), False), reps))
    linked(possible(fresh(led(classed(shared), True)), reps))
    linked(fresh(unsettled(classed(shared), reps)))
    dropped(shared, *tried)
    return classed(reps.select("id"))


def components(edges: DataFrame) -> DataFrame:
    """The least id that each id of some edges (low, high) is joined to."""
    both = stored(edges.union(edges.select("high", "low")).distinct().toDF("id", "to"), "edges")
    label = stored(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stored(step.join(jump, "label").select("id", "was", F.least("label", "further").alias("label")), "labels")
        dropped(label)
        if new.filter("was <> label").isEmpty():
            dropped(both)
            return new.select("id", "label")
        label = new.select("id", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row its class, whether it stands for it, how many rows have its very text, and how many different texts
    the class has; `key` is the hash of its text."""
    rows = sketched(docs).groupBy("key")
    reps = rows.agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("sig", "n_words", "odd", "z")), F.count("*").alias("n_copies"))
    # ids of the table may repeat, so different texts get numbers of their own, which storing makes fast
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    named = reps.select("id", "key", "doc_id", "n_copies").join(classes(docs, reps), "id")
    named = stored(named.select("key", "doc_id", "label", "n_copies"), "named")
    first = stored(named.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n_texts")), "firsts")
    named = stored(named.drop("doc_id").join(first, "label").drop("label"), "classes")
    out = keyed(docs).select("doc_id", "key").join(named, "key")
    own = F.when(F.col("doc_id") != LEAST_ID, F.col("doc_id")).alias("doc_id")
    of = F.when(F.col("first.doc_id") != LEAST_ID, F.col("first.doc_id")).alias("class_id")
    return out.select(own, of, (F.struct("doc_id", "key") == F.col("first")).alias("kept"), "n_copies", "n_texts", "key")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: the one of least id, and one row of it."""
    at = near_duplicates(docs).filter("kept").select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_id"), F.col("key").alias("_key")).distinct()
    return whole_rows(docs).join(at, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one value, whatever its columns are called, beside its id and the hash of its text."""
    key = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST_ID)).alias("_id"), key.alias("_key"))
