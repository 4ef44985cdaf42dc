"""Quality rules: base counts of a text, and bands on the perplexity of a modified Kneser-Ney model.

Tokens are lower-cased runs of letters and digits. A Kneser-Ney model of order three counts, in its lower
orders, in how many different contexts an n-gram stands, not how often. Those two orders, bigrams and words, give
the score here: however often a text or a passage is copied, its contexts stay the same, so copies don't look
fluent and groups of thousands of them are judged as single texts are; words said over and over do, and fall below
the lower band. (The highest order is left out: its raw counts are what copies inflate.)

    p(w|v) = (c(v,w) - D) / c(v) + g(v) p(w),  g(v) = 1 - sum over kept (c - D) / c(v)
    p(w) = (n(w) - D') / N + g' / (V + 1)

c(v,w): different words before the bigram; c(v): their sum; n(w): different words before w; N: distinct bigrams;
V: words kept; all other words share the last cell. Bigrams with one context give their mass to the lower order,
at any corpus size, which keeps every distribution normalised. D and D' follow the modified estimate from counts of
counts (each for 1, 2 and 3 or more).

The model lies in sorted arrays, hash bucket by hash bucket, and is never gathered in one place. Tasks take
their rows in lots of about _FLUSH tokens and

1. ask: each lot's distinct bigrams, with the hashes of the words before them, go to the bucket of their second word;
2. buckets count contexts over all lots, answer each lot with c(v,w) and n(w) in the order of its own question
   (so no keys travel back), and pass sums by first word on to its bucket;
3. those give each lot c(v) and g(v) of its words;
4. lots meet their answers and score their rows.

A hot word's part is bounded: a lot asks once for each word before it, however often it occurs. Words before a
bigram are told apart by CONTEXT_BITS bits of a hash and the number of different ones is estimated from the cells
filled (linear counting): exact to the unit below 60, within a few percent up to some 30,000.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.session import cut, ship

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Bands of a language's log perplexity: so many distances from median to quartile beyond the quartile.
UPPER, LOWER = 6.0, 17.0
#: That distance is taken as this at least.
LEAST_SPREAD = 0.15
#: Bands are drawn from documents with this many tokens at least, and apply to all.
LEAST_TOKENS = 20
CONTEXT_BITS = 12
_FLUSH = 2_500_000

BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_HASH = (np.uint64(1) << np.uint64(40)) - np.uint64(1)


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit token hashes of a block, each row opened by a start mark (0), and where rows begin."""
    start, end = W.spans(off, data, BREAKS)
    h = W.span_hash(W.LOWER[data], start, end) & _HASH
    first = np.searchsorted(start, off)
    return np.insert(h, first[:-1], np.uint64(0)), first + np.arange(len(first))


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(v * W._BASE + w)


def base_counts(off: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(off) - 1
    w = W.words(off, data)

    def by_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    chars = by_row(~W.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = by_row(_IS_SYMBOL[data])
    # lines: exact bytes between newlines, those that hold a word
    cuts = np.flatnonzero(data == 10)
    start = np.union1d(off[:-1], cuts + 1)
    start = start[start < len(data)] if len(data) else start[:0]
    end = np.append(start[1:], len(data))
    newline = (end > start) & (data[np.maximum(end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    end = end - newline
    has = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    start, end = start[has], end[has]
    row = np.searchsorted(off, start, side="right") - 1
    dup = np.bincount(row, minlength=n) - _distinct(row, W.span_hash(data, start, end), n)
    # words inside windows that the text has twice or more
    s, ok = W.shingles(w.hash, WINDOW), W.inside(w.row, WINDOW)
    at = np.flatnonzero(ok)
    key = W.mix(s[at] ^ W.mix(w.row[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = sorted_key[1:] == sorted_key[:-1]
    hit = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return {"n_words": np.diff(w.first), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": np.bincount(w.row[covered], minlength=n)}


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each row has."""
    key = np.unique(np.stack([row.astype(np.uint64), h]), axis=1)[0] if len(row) < 64 else None
    if key is None:
        order = np.lexsort((h, row))
        r, x = row[order], h[order]
        new = np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]))
        return np.bincount(r[new], minlength=n)
    return np.bincount(key.astype(np.int64), minlength=n)


def _hashes(x: np.ndarray) -> list[tuple[int, bytes]]:
    """Ascending 40-bit numbers as compressed planes of the bytes of their gaps."""
    raw = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return [(len(x), _packed(raw[:, i])) for i in range(5)]


def _of_hashes(planes: list[tuple[int, bytes]]) -> np.ndarray:
    out = np.zeros((planes[0][0], 8), np.uint8)
    for i, (n, raw) in enumerate(planes):
        out[:, i] = _unpacked(raw, n)
    return np.cumsum(out.view(np.uint64).reshape(-1), dtype=np.uint64)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n, codec="zstd", asbytes=True) if n else b"", np.uint8)


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each element's index of them in four bytes: np.unique takes three times the memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    x = x[new]
    nth = np.cumsum(new, dtype=np.uint32)
    nth -= np.uint32(1)
    back = np.empty(len(order), np.uint32)
    back[order] = nth
    return x, back


def _discounts(coc: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many entries have counts 1, 2, 3, 4 (Chen and Goodman); kept within 0..count."""
    n1, n2, n3, n4 = (float(max(x, 0.5)) for x in coc[:4])
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


class Lot(NamedTuple):
    """Distinct token hashes by (bucket, hash); where each bucket's begin; distinct bigrams as (w, v) indices
    of them, by w; each token's bigram; where each bucket's bigrams begin."""

    vocab: np.ndarray
    first: np.ndarray
    w: np.ndarray
    v: np.ndarray
    back: np.ndarray
    cuts: np.ndarray


def lot_of(vocab: np.ndarray, x: np.ndarray, inner: np.ndarray, n_buckets: int) -> Lot:
    """vocab: distinct hashes in any order; x: each token's index of them; inner: which tokens aren't start marks."""
    side = (W.mix(vocab) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((vocab, side))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    vocab, first = vocab[order], np.searchsorted(side[order], np.arange(n_buckets + 1))
    rank = rank[x]
    pair = rank[1:][inner[1:]].astype(np.int64)
    pair *= len(vocab)
    pair += rank[:-1][inner[1:]]
    del rank
    pair, back = _unique(pair)
    w, v = pair // max(len(vocab), 1), pair % max(len(vocab), 1)
    return Lot(vocab, first, w, v, back, np.searchsorted(w, first))


def contexts_of(vocab: np.ndarray, x: np.ndarray, inner: np.ndarray, back: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bigram how many different words stand before it, and their cells of 2^CONTEXT_BITS, one after another (vocab, x, inner as in lot_of)."""
    cell = (W.mix(vocab ^ W._BASE) >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint16)
    none = (W.mix(np.zeros(1, np.uint64) ^ W._BASE) >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint16)[0]
    # a text's first bigram has the start mark as its word before, and nothing before that
    before = np.concatenate([np.array([none, none], np.uint16), cell[x[:-2]]])[: len(x)]
    before[1:][~inner[:-1]] = none
    both = back.astype(np.int64)
    both <<= CONTEXT_BITS
    both |= before[inner]
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return np.bincount(both >> CONTEXT_BITS, minlength=n_pairs), (both & ((1 << CONTEXT_BITS) - 1)).astype(np.uint16)


def estimate(filled: np.ndarray) -> np.ndarray:
    """Different contexts behind so many filled cells (linear counting)."""
    cells = 1 << CONTEXT_BITS
    return np.rint(-cells * np.log1p(-np.minimum(filled, cells - 0.5) / cells)).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _check(v: np.ndarray, w: np.ndarray) -> int:
    return int(bigram(v, w).sum())


def _lots(batches: Iterator[pa.RecordBatch], most: int, keep: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Lots of a task's rows (id, text, lang, th): number, token hashes, which aren't start marks, and the rows, if they are to be kept."""
    part, k = TaskContext.get().partitionId(), 0
    h, inner, rows, size = [], [], [], 0
    for batch in batches:
        for lo, hi, off, data in W.blocks(batch.column(1)):
            x, first = tokens(off, data)
            own = np.ones(len(x), bool)
            own[first[:-1]] = False
            h.append(x)
            inner.append(own)
            if keep:
                rows.append((batch.slice(lo, hi - lo), off, data, np.diff(first) - 1))
            size += len(x)
            if size >= most:
                whole, marks, held = np.concatenate(h), np.concatenate(inner), rows
                h, inner, rows, size, k = [], [], [], 0, k + 1
                lot = [(part << 32) + k - 1, whole, marks, held]
                del whole, marks, held
                # the reader's names are all that hold the lot
                yield (lot.pop(0), lot.pop(0), lot.pop(0), lot.pop(0))
    if size:
        yield (part << 32) + k, np.concatenate(h), np.concatenate(inner), rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "bucket", "lot", "body"])


_PART = "kind int, bucket int, lot long, body binary"
#: What the buckets give: answers to lots, words that lots ask about, sums by first word, counts of counts.
_ANSWER, _ASKED, _SUMS, _TOTALS, _LOT, _CONTEXT = range(6)


def _planes(x: np.ndarray) -> list[tuple[int, bytes]]:
    """Numbers below 2^32 as compressed planes of bytes, as many as the largest takes."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    raw = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [(len(x), _packed(raw[:, i])) for i in range(width)]


def _of_planes(planes: list[tuple[int, bytes]], kind: type = np.int64) -> np.ndarray:
    out = np.zeros((planes[0][0], 4), np.uint8)
    for i, (n, raw) in enumerate(planes):
        out[:, i] = _unpacked(raw, n)
    return out.view("<u4").reshape(-1).astype(kind, copy=False)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts, one after another; they go as they are copied."""
    out = np.empty(sum(map(len, parts)), parts[0].dtype)
    at = len(out)
    while parts:
        part = parts.pop()
        out[at - len(part) : at] = part
        at -= len(part)
    return out


def _pair_contexts(group: np.ndarray, n: np.ndarray, cell: np.ndarray, n_pairs: int) -> np.ndarray:
    """Different cells of each pair: the pairs' numbers, how many cells each has, the cells. In a sort in place: np.unique takes a copy more."""
    both = np.repeat(group, n).astype(np.int64)
    both <<= CONTEXT_BITS
    both |= cell
    both.sort()
    new = np.append(True, both[1:] != both[:-1]) if len(both) else np.zeros(0, bool)
    both >>= CONTEXT_BITS
    return np.bincount(both[new], minlength=n_pairs)


def log_perplexity(own: DataFrame) -> DataFrame:
    """Base counts, n_tokens and log_ppl of each row of (id, text, lang, th).

    The rows are read twice and must come in the same order both times, as from files; a lot whose answers
    don't match its question raises an error.
    """
    n_buckets, most = max(16, own.rdd.getNumPartitions() * 3 // 2), _FLUSH

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, h, inner, _ in _lots(batches, most, False):
            vocab, index = _unique(h)
            del h
            x = lot_of(vocab, index, inner, n_buckets)
            n_before, cell = contexts_of(vocab, index, inner, x.back, len(x.w))
            cell_at = np.concatenate([[0], np.cumsum(n_before)])
            out = []
            for b in range(n_buckets):
                i, j = x.cuts[b], x.cuts[b + 1]
                words = x.vocab[x.first[b] : x.first[b + 1]]
                if not len(words):
                    continue
                before, at = np.unique(x.vocab[x.v[i:j]], return_inverse=True)
                n = np.bincount(x.w[i:j] - x.first[b], minlength=len(words))
                body = _hashes(words), _planes(n), _hashes(before), _planes(at), _planes(n_before[i:j]), _planes(cell[cell_at[i] : cell_at[j]]), _check(x.vocab[x.v[i:j]], x.vocab[x.w[i:j]])
                out.append((0, b, k, pickle.dumps(body)))
            yield _rows(out)

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        lots, words, befores, at_w, at_v, ns, cells, checks = [], [], [], [], [], [], [], []
        for batch in parts:
            for lot, raw in zip(batch.column("lot").to_pylist(), batch.column("body"), strict=True):
                w, n, v, at, n_before, cell, check = pickle.loads(raw.as_buffer())
                lots.append(lot)
                words.append(_of_hashes(w))
                befores.append(_of_hashes(v))
                at_w.append(_of_planes(n, np.uint32))
                at_v.append(_of_planes(at, np.uint32))
                ns.append(_of_planes(n_before, np.uint16))
                cells.append(_of_planes(cell, np.uint16))
                checks.append(check)
        sizes = [len(x) for x in at_v]
        vocab, of_w = _unique(np.concatenate(words))
        before, of_v = _unique(np.concatenate(befores))
        pair, i, w_first, v_first = np.empty(sum(sizes), np.int64), 0, 0, 0
        wide = max(len(before), 1)
        for k, (w, n, v) in enumerate(zip(words, at_w, befores, strict=True)):
            own = pair[i : i + sizes[k]]
            own[:] = np.repeat(of_w[w_first : w_first + len(w)], n)
            own *= wide
            own += of_v[v_first : v_first + len(v)][at_v[k]]
            at_v[k] = None
            i, w_first, v_first = i + sizes[k], w_first + len(w), v_first + len(v)
        del at_v, at_w, befores, of_v, own
        pair, group = _unique(pair)
        c = estimate(_pair_contexts(group, _joined(ns), _joined(cells), len(pair)))
        n_w = np.bincount(pair // wide, minlength=len(vocab))
        v = pair % wide
        out, i, w_first = [], 0, 0
        for lot, w, n, check in zip(lots, words, sizes, checks, strict=True):
            out.append((_ANSWER, bucket, lot, pickle.dumps((_planes(c[group[i : i + n]]), _planes(n_w[of_w[w_first : w_first + len(w)]]), check))))
            out.append((_ASKED, bucket, lot, pickle.dumps(_hashes(w))))
            i, w_first = i + n, w_first + len(w)
        yield _rows(out)
        kept = c >= 2
        sums = [np.bincount(v[part], weight, minlength=len(before)).astype(np.int64) for part, weight in ((slice(None), c), (kept, c[kept]), (c == 2, None), (c >= 3, None))]
        side = (W.mix(before) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(side, kind="stable")
        cuts = np.searchsorted(side[order], np.arange(n_buckets + 1))
        out = []
        for b in range(n_buckets):
            own_v = order[cuts[b] : cuts[b + 1]]
            if len(own_v):
                out.append((_SUMS, b, None, pickle.dumps((_hashes(before[own_v]), *(_small(x[own_v]) for x in sums)))))
        many = n_w[n_w >= 2]
        totals = [*np.bincount(np.minimum(c, 5), minlength=6)[1:5], *np.bincount(np.minimum(n_w, 5), minlength=6)[1:5], len(c), many.sum(), (many == 2).sum(), (many >= 3).sum()]
        out.append((_TOTALS, bucket, None, np.array(totals, np.int64).tobytes()))
        yield _rows(out)

    merged = cut(own.mapInArrow(ask, _PART).groupBy("bucket").applyInArrow(merge, _PART), "kn-counts")
    # one row of twelve numbers a bucket
    totals = np.sum([np.frombuffer(r.body, np.int64) for r in merged.where(F.col("kind") == _TOTALS).select("body").collect()] or [np.zeros(12, np.int64)], axis=0)
    d, e = np.array((0, *_discounts(totals[:4]))), np.array((0, *_discounts(totals[4:8])))
    n_pairs, n_after, two, more = (int(x) for x in totals[8:])
    rest = max(1 - (n_after - e[2] * two - e[3] * more) / max(n_pairs, 1), 1e-6) / (two + more + 1)

    def contexts(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vs, sums = [], [], [[], [], [], []]
        for batch in parts:
            for kind, lot, raw in zip(batch.column("kind").to_pylist(), batch.column("lot").to_pylist(), batch.column("body"), strict=True):
                if kind == _ASKED:
                    asked.append((lot, _of_hashes(pickle.loads(raw.as_buffer()))))
                else:
                    v, *own_sums = pickle.loads(raw.as_buffer())
                    vs.append(_of_hashes(v))
                    for x, y in zip(sums, own_sums, strict=True):
                        x.append(y)
        if vs:
            v, back = np.unique(np.concatenate(vs), return_inverse=True)
            total, kept, twos, mores = (np.bincount(back, np.concatenate(x), minlength=len(v)) for x in sums)
            held = (kept - d[2] * twos - d[3] * mores) / total
            g = np.where(held > 0, np.maximum(1 - held, 1e-6), 1.0).astype(np.float32)
        out = []
        for lot, w in asked:
            n, own_g = np.zeros(len(w), np.int64), np.ones(len(w), np.float32)
            if vs:
                at = np.minimum(np.searchsorted(v, w), len(v) - 1)
                hit = v[at] == w
                n[hit], own_g[hit] = total[at[hit]], g[at[hit]]
            out.append((_CONTEXT, key[0].as_py(), lot, pickle.dumps((_small(n), own_g))))
        if out:
            yield _rows(out)

    of_v = merged.where(F.col("kind").isin(_ASKED, _SUMS)).groupBy("bucket").applyInArrow(contexts, _PART)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, h, inner, rows in _lots(batches, most, True):
            vocab, x = _unique(h)
            n = np.bincount(x, minlength=len(vocab))
            rank = np.empty(len(n), np.uint32)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.uint32)
            sink = pa.BufferOutputStream()
            writer = None
            for batch, off, data, n_tokens in rows:
                columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(y.astype(np.int64)) for y in base_counts(off, data).values()), pa.array(n_tokens.astype(np.int64))]
                table = pa.record_batch(columns, names)
                writer = writer or pa.ipc.new_stream(sink, table.schema)
                writer.write_batch(table)
            writer.close()
            yield _rows([(_LOT, 0, k, pickle.dumps((_hashes(vocab), _planes(rank), _planes(rank[x]), sink.getvalue().to_pybytes())))])

    names = ["id", "lang", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]

    def judge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, context, lot = {}, {}, None
        for batch in parts:
            for kind, bucket, raw in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("body"), strict=True):
                body = pickle.loads(raw.as_buffer())
                if kind == _LOT:
                    lot = body
                else:
                    (answers if kind == _ANSWER else context)[bucket] = body
        if lot is None:
            raise RuntimeError("rows came in another order on the second reading: write them to files first")
        rows = pa.ipc.open_stream(lot[3]).read_all().combine_chunks()
        word = _of_planes(lot[2]).astype(np.uint32)
        vocab = np.empty(lot[0][0][0], np.uint64)
        vocab[_of_planes(lot[1])] = _of_hashes(lot[0])
        n = rows.column("n_tokens").to_numpy()
        inner = np.ones(len(word), bool)
        inner[np.cumsum(n + 1) - n - 1] = False
        x = lot_of(vocab, word, inner, n_buckets)
        none = _planes(x.w[:0])
        for b in range(n_buckets):
            i, j = x.cuts[b], x.cuts[b + 1]
            found = answers.get(b, (none, none, 0))
            if found[0][0][0] != j - i or found[1][0][0] != x.first[b + 1] - x.first[b] or found[2] != _check(x.vocab[x.v[i:j]], x.vocab[x.w[i:j]]):
                raise RuntimeError("rows came in another order on the second reading: write them to files first")
        c, after = (np.concatenate([_of_planes(answers[b][k]) for b in sorted(answers)]) for k in (0, 1))
        total = np.concatenate([context[b][0] for b in sorted(context)]).astype(np.int64)
        g = np.concatenate([context[b][1] for b in sorted(context)])
        low = np.where(after >= 2, (after - e[np.minimum(after, 3)]) / max(n_pairs, 1), 0.0) + rest
        p = np.where(c >= 2, (c - d[np.minimum(c, 3)]) / np.maximum(total[x.v], 1), 0.0) + g[x.v] * low[x.w]
        row = np.repeat(np.arange(len(n)), n)
        loss = np.bincount(row, -np.log(p)[x.back], minlength=len(n)) if len(row) else np.zeros(len(n))
        ppl = pa.array(loss / np.maximum(n, 1), mask=n == 0)
        for batch in rows.append_column("log_ppl", ppl).to_batches():
            yield batch

    lots = own.mapInArrow(rows_of, _PART)
    met = lots.unionByName(merged.where(F.col("kind") == _ANSWER)).unionByName(of_v)
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, log_ppl double"
    return met.groupBy("lot").applyInArrow(judge, schema)


def judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """score()'s rows as (id, lang, th, ...); th is the text's hash, so a verdict can go back to its own row."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("th"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = cut(log_perplexity(own).withColumn("base_failed", failed), "kn-rows")
    # equal texts of a language count once, so a hot group of copies doesn't make the band
    fit_rows = rows.where(~F.col("base_failed") & (F.col("n_tokens") >= LEAST_TOKENS)).groupBy("lang", "th").agg(F.min("log_ppl").alias("log_ppl"))
    q = fit_rows.groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"))
    below, above = (F.greatest(x, F.lit(LEAST_SPREAD)) for x in (F.col("q")[1] - F.col("q")[0], F.col("q")[2] - F.col("q")[1]))
    bands = q.select(F.col("lang").alias("of"), (F.col("q")[0] - LOWER * below).alias("lower"), (F.col("q")[2] + UPPER * above).alias("upper"))
    out = rows.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    inside = F.col("log_ppl").between(F.coalesce("lower", F.lit(0.0)), F.coalesce("upper", F.lit(math.inf)))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row's id, lang, base counts, base_failed, n_tokens, log_ppl (mean of -ln p; null without tokens), lower, upper, kept.

    Null texts count as empty: no words, so base_failed. Null langs share a band of their own. Bands come
    from all different texts of a language that pass the base rules and have LEAST_TOKENS tokens; a language
    without such texts has none, and keeps what the base rules keep. Rows whose words hold no letter or digit are
    outside every band. Repeated rows get one verdict each, the same. An empty table gives no rows.
    """
    return judged(docs, id_col, text_col, lang_col).drop("th").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that score() rejects; rows that share an id, or have none, are judged each by itself."""
    bad = judged(docs, id_col, text_col, lang_col).where(~F.col("kept")).select("id", "lang", "th").distinct()
    same = docs[id_col].eqNullSafe(bad["id"]) & docs[lang_col].eqNullSafe(bad["lang"]) & (F.xxhash64(docs[text_col]) == bad["th"])
    return docs.join(bad, same, "left_anti")
