"""Packing token streams into sequences by order-preserving dynamic programming.

Each task packs the documents of its partition in their order, as one stream of token ids (each document's ids, then
an end id), so nothing is shuffled. Windows may be cut after a document or after a sentence; a long sentence
may also be cut inside, at a higher price. The plan minimises padding plus a penalty for each document cut: with p(i) the stream
position of cut i, the best plan ending at cut j costs f(j) = min over p(j) - p(i) <= size of f(i) + size - (p(j) - p(i))
+ penalty(j). The window only moves forward, so a monotone queue over f(i) + p(i) gives each minimum in constant time.
Sequences whose length is a power of two need no padding; those transitions are looked up beside the queue, and what is
left at the end of a partition is cut into such lengths if that costs less than padding.

The stream is planned in blocks of BLOCK tokens, whose last window is carried to the next, so memory is bounded.

Tokens: text is split into the vocabulary's pre-tokens in numpy, each distinct one is tokenised once for a batch, and
ids are laid out by index. Byte-pair merging runs in tiktoken with ranks derived from the vocabulary's merges; texts
that the splitter doesn't cover (apostrophes, control characters, special tokens) go to `tokenizers` itself.

Defined cases: a null or empty text is the end id alone; any other document gives at least one piece and its pieces
follow each other; repeated rows are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, read, small_batches, span_hashes, texts

SIZE = 2048
END = 1
#: What a cut after a sentence, inside a document, costs, in tokens of padding; and a cut inside a sentence.
SENTENCE_CUT, HARD_CUT = 0.5, 4.0
#: What each sequence costs, so that short ones aren't made for nothing.
WINDOW_COST = 4.0
BLOCK = 1 << 20
STOP = "\x01"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 9 left to the tokenizer, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = 1 if kind == "L" else 2
        elif kind == "C" and i >= 0x80:  # unassigned in one table may be a letter in another
            out[i] = 9
    space = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[space] = 0
    out[[1, ord("'")]] = 9
    out[ord("<")] = 3
    return out


class Tokens:
    """Ids of texts, and where a sentence may end, without a Python step for each word."""

    KNOWN = 1 << 19

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.classes = _classes()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        byte_of = {v: k for k, v in _byte_letters().items()}
        stop = STOP.encode()

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], stop) if token.endswith(suffix) else (token, b"")
            return bytes(byte_of[c] for c in body) + end

        ranks = {bytes([b]): b for b in range(256)}
        ids = np.full(256 + 256 + len(model["merges"]) + 1, -1, np.int64)
        letters = _byte_letters()
        for b in range(256):
            ids[b] = vocab[letters[b]]
            if b != 1:  # the last letter of a word and its end are one symbol from the start
                ranks[bytes([b]) + stop] = 256 + b
                ids[256 + b] = vocab[letters[b] + suffix]
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            key = raw(a) + raw(b)
            if key in ranks:
                continue
            ranks[key] = 512 + k
            ids[512 + k] = vocab[a + b]
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{STOP}]*{STOP}", mergeable_ranks=ranks, special_tokens={})
        self.ids = ids
        self.last = np.zeros(len(ids), bool)  # tokens that end a pre-token
        for key, rank in ranks.items():
            self.last[rank] = key.endswith(stop)
        self.seen = np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int64)

    def lookup(self, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in self.flat of each hash's ids; words(k) is the k-th one's text."""
        at = np.minimum(np.searchsorted(self.seen, hashes), max(len(self.seen) - 1, 0))
        new = np.flatnonzero(self.seen[at] != hashes) if len(self.seen) else np.arange(len(hashes))
        if len(new):
            got = self.bpe.encode_to_numpy(words(new), allowed_special=set(), disallowed_special=()).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(self.last[got]) + 1])
            if len(self.seen) + len(new) > self.KNOWN:  # starts anew, with what this batch needs
                old = np.setdiff1d(np.arange(len(hashes)), new)
                keep_start, keep_len = self._of(at[old])
                parts = _gather(self.flat, keep_start, keep_len)
                self.seen, begins, flat = np.concatenate([hashes[old], hashes[new]]), np.concatenate([keep_len, np.diff(first)]), np.concatenate([parts, self.ids[got]])
                start = np.concatenate([[0], np.cumsum(begins)])
            else:
                self.seen, flat = np.concatenate([self.seen, hashes[new]]), np.concatenate([self.flat, self.ids[got]])
                start = np.concatenate([self.start, first[1:] + len(self.flat)]) if len(self.flat) else first
            order = np.argsort(self.seen, kind="stable")
            lengths = np.diff(start)
            self.seen, self.flat = self.seen[order], _gather(flat, start[:-1][order], lengths[order])
            self.start = np.concatenate([[0], np.cumsum(lengths[order])])
            at = np.searchsorted(self.seen, hashes)
        return self._of(at)

    def _of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[at], self.start[at + 1] - self.start[at]

    def of(self, batch: list[str], most: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and the places (numbers of ids before) where a sentence ends. Works on
        about `most` characters at a time; a longer text is cut at a space before a plain letter, which parts pre-tokens."""
        out: list[list] = [[] for _ in batch]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            for (i, _), got in zip(held, self.some([t for _, t in held]), strict=True):
                out[i].append(got)
            held, size = [], 0

        for i, t in enumerate(batch):
            a = 0
            while a < len(t) or not a:
                b = len(t)
                if b - a > most and (m := _BREAK.search(t, a + most)):
                    b = m.start()
                if held and size + b - a > most:
                    flush()
                held.append((i, t[a:b]))
                size += b - a
                if b == len(t):
                    break
                a = b
        flush()
        return [parts[0] if len(parts) == 1 else _joined(parts) for parts in out]

    def some(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [None] * len(batch)
        plain, rows = [], []
        for i, t in enumerate(batch):
            if not t.isascii():
                t = unicodedata.normalize("NFC", t)
            # a case that lower() decides by context, or that special tokens may match, is the tokenizer's
            low = t.lower()
            code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
            if "Σ" in t or "<|" in t or (self.classes[code] == 9).any():
                out[i] = self.slow(batch[i])
            else:
                plain.append(code)
                rows.append(i)
        if rows:
            for i, got in zip(rows, self.fast(plain), strict=True):
                out[i] = got
        return out

    def slow(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.whole.encode(text, add_special_tokens=False)
        ids = np.array([*e.ids, END], np.int64)
        ends = [k + 1 for k, (_, b) in enumerate(e.offsets) if b and text[b - 1] in ".!?" and (b == len(text) or text[b].isspace())]
        return ids, np.array([*(x for x in dict.fromkeys(ends) if x < len(ids) - 1), len(ids)], np.int64)

    def fast(self, codes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        # a space after each text keeps pre-tokens apart
        code = np.concatenate([x for c in codes for x in (c, np.array([32], np.uint32))])
        edge = np.cumsum([0, *(len(c) + 1 for c in codes)])
        kind = self.classes[code]
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        start, end = start[kind[at[:-1]] > 0], end[kind[at[:-1]] > 0]
        if not len(start):
            return [(np.array([END], np.int64), np.array([1], np.int64)) for _ in codes]
        raw = code.astype("<u4").view(np.uint8)
        h = span_hashes(raw, start * 4, end * 4)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)

        def words(k: np.ndarray) -> str:
            s, n = start[first[k]], end[first[k]] - start[first[k]]
            text = np.full(int((n + 1).sum()), 1, np.uint32)
            at = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
            text[np.repeat(at - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))] = _gather(code, s, n)
            return text.astype("<u4").tobytes().decode("utf-32-le")

        begin, length = self.lookup(distinct, words)
        length = length[back]
        flat = _gather(self.flat, begin[back], length)
        upto = np.concatenate([[0], np.cumsum(length)])
        after = code[end % len(code)]  # an end mark before white space, or a line's end
        stops = (np.isin(code[end - 1], (33, 46, 63)) & (self.classes[after] == 0)) | (after == 10)
        out = []
        for a, b in zip(np.searchsorted(start, edge[:-1]), np.searchsorted(start, edge[1:]), strict=True):
            ids = np.append(flat[upto[a] : upto[b]], END)
            ends = upto[a + 1 : b + 1][stops[a:b]] - upto[a]
            out.append((ids, np.append(ends[ends < len(ids) - 1], len(ids))))
        return out


#: A space between plain letters.
_BREAK = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of one text as one, with one end id."""
    begin = np.cumsum([0, *(len(ids) - 1 for ids, _ in parts)])
    ids = np.concatenate([*(ids[:-1] for ids, _ in parts), parts[-1][0][-1:]])
    return ids, np.concatenate([*(ends[:-1] + b for (_, ends), b in zip(parts, begin)), [len(ids)]])


@functools.lru_cache(1)
def tokens(path: str) -> Tokens:
    """Made once for each worker process."""
    return Tokens(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at start, one after the other."""
    total = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(start - total[:-1], length) + np.arange(int(total[-1]))]


def plan(cuts: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """The cheapest plan over a stream from 0 to cuts[-1]: the positions where its windows end. cost: a cut's penalty.
    Neighbouring cuts are at most size apart."""
    p = [0, *cuts.tolist()]
    fee = [0.0, *cost.tolist()]
    n = len(p)
    f, back = [0.0] * n, [0] * n
    where = {0: 0}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    queue: deque[int] = deque([0])  # cuts in reach whose f + p rises
    key = [0.0] * n
    for j in range(1, n):
        at = p[j]
        while p[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - at
        for w in powers:  # such windows need no padding
            k = where.get(at - w)
            if k is not None and f[k] < best:
                best, i = f[k], k
        f[j] = best + fee[j] + WINDOW_COST
        back[j] = i
        key[j] = f[j] + at
        where[at] = j
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


def tail(length: int, size: int, penalty: float = 1.0) -> list[int]:
    """Lengths of the last sequences: whole, or in powers of two where those cost less than the padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if 1 < len(parts) and (len(parts) - 1) * penalty < size - length else [length]


class Packer:
    """Takes documents one after the other; gives their pieces as windows become settled."""

    def __init__(self, first: int, size: int = SIZE, block: int = BLOCK):
        self.size, self.block, self.sequence = size, max(block, 4 * size), first
        self.docs: list[tuple[int, np.ndarray, int]] = []  # id, ids, how many are placed
        self.cuts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray):
        self.docs.append((doc_id, ids, 0))
        self.cuts.append(ends + self.held)
        self.held += len(ids)
        return self.flush(False) if self.held >= self.block else []

    def flush(self, last: bool = True) -> list[tuple]:
        if not self.held:
            return []
        cuts = np.concatenate(self.cuts)
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        gap = np.diff(cuts, prepend=0)
        long = gap > self.size // 16
        if long.any():  # a long sentence may be cut inside
            step = max(1, self.size // 64)
            cuts = np.unique(np.concatenate([cuts, *(np.arange(c - g + step, c, step) for c, g in zip(cuts[long], gap[long], strict=True))]))
        soft = np.concatenate(self.cuts)
        fee = np.where(np.isin(cuts, ends), 0.0, np.where(np.isin(cuts, soft), SENTENCE_CUT, HARD_CUT))
        stops = plan(cuts, fee, self.size)
        if last:
            begin = stops[-2] if len(stops) > 1 else 0
            stops = [*stops[:-1], *(begin + np.cumsum(tail(stops[-1] - begin, self.size))).tolist()]
        else:
            stops = stops[:-1]
        done = stops[-1] if stops else 0
        out, d, at, begin = [], 0, 0, 0
        docs = self.docs
        for stop in stops:
            while begin < stop:
                doc_id, ids, placed = docs[d]
                n = min(len(ids) - placed, stop - begin)
                piece = ids[placed : placed + n]
                out.append((doc_id, placed, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, begin - at))
                begin += n
                docs[d] = (doc_id, ids, placed + n)
                d += placed + n == len(ids)
            at = stop
            self.sequence += 1
        self.docs = docs[d:]
        self.cuts = [cuts[np.isin(cuts, soft) & (cuts > done)] - done]
        self.held -= done
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece of each document: where it stands in the document and in which sequence."""
    small_batches(docs.sparkSession)
    path = path or vocabulary()

    def run(batches):
        from pyspark import TaskContext

        words, packer = tokens(path), Packer(TaskContext.get().partitionId() << 40, size)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in batches:
            rows = []
            got = words.of(b.column("text").to_pylist())
            for i, (ids, ends) in zip(b.column("doc_id").to_pylist(), got, strict=True):
                rows += packer.add(i, ids, ends)
            if rows:
                yield table(rows)
        if rows := packer.flush():
            yield table(rows)

    return texts(docs).mapInArrow(bounded(run), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
