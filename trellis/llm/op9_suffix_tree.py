"""LM scoring by a probabilistic suffix tree over words.

A text is the sequence of its lower-cased words and one end; a start stands before the first word. A context is a run of words of any
length, read backwards from the word to predict. It lists the next words that occur LEAST times behind it in training. A
context of one word is tried; a longer one is tried if the context without its farthest word was retained. A tried context
is retained if its next words diverge from what is predicted without it: sum of n * ln(n / size / below) over the listed words is
above half of ln N for each of them, where below is the probability at the longest retained suffix. So contexts grow as
long as the test retains them; there is no greatest depth and no share of the text below which words or contexts vanish. (A far word that tells
nothing until a still farther one is added is not found: growth is step by step.)

A retained context gives (n + weight * below) / (stored + weight): stored is what its listed words occur, weight the rest of its
occurrences and as much again as words are listed. The root is the base distribution, add one. A word's probability is that
at its longest retained context.

The tree is never in one place. Texts are put into blocks, each with the numbers of its words among all words and the texts as numbers of these. Level
by level, a block sends the hashes of its contexts, and with each its next words, how often they occur and their probability so far, summed
within the block, to the parts of the hash space. A part has everything about its contexts: it decides which are retained, and sends the
totals back in the same order. The block carries on with the places whose context was retained. Places that are done are added up and leave the
state. A gram is in a block's message once. A context that occurs SPLIT times or more has several keys, its next words dealt among them by their numbers; a part
then sends its sums back, and every block adds them up and decides alike. So no context is too much for a part; parts grow in number with the places that are left.

No longer context is tried where none can be retained, which changes no result: a context that occurs less than LEAST times lists nothing, and
a retained one below a context needs a word with n * ln(T / n) above the threshold, T being the size and the kinds of the
context above, a bound that falls with every longer context.

Blocks and the state of their places are bucketed tables, so they stay where they are while messages come and go. Messages hold sorted hashes as differences, in planes of
bytes, which compress.

Defined results: null and empty texts, or those without words, are one end. Rows with null doc_id are in training. Rows that
repeat count as often as they occur. Without training texts N and V are 0. Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections import namedtuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import dropped, held_out, keep, mix, span_hashes, table

FOLDS, LEAST = 7, 2
#: The end in place of a word's hash, and the start in place of a word's number.
_END, _START = 1, 1 << 62
#: Tokens after which a block ends, places for each part of the hash space, and occurrences for each key of a context.
BLOCK_TOKENS, PART_PLACES, SPLIT = 750_000, 2_500_000, 250_000
_TEXTS = "block long, words binary, n_words long, ids binary, seen binary, idx binary, docs binary, nameless binary, held binary, lengths binary, tokens long, trained long"
_WORDS = "part long, block long, size long, keys binary, n binary"
_COUNTED = "part long, block long, size long, n binary, ids binary"
_STATE = "block long, alive long, places binary, listed binary, splits binary, p binary, done binary"
_ASKED = "part long, block long, size long, keys binary, split binary, n binary, kinds binary, grams long, next binary, times binary, below binary"
_TOLD = "part long, block long, size long, flags binary, stored binary, kinds binary, sizes binary, gain binary, first binary, second binary, grams long, n binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SHARED = 4
#: Bytes of texts that are split into words at a time.
PIECE = 8 << 20


def _columns(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def _packed(x: np.ndarray) -> bytes:
    """Numbers of at least 0 in planes of bytes: all lowest bytes, then the next, as many as the largest needs."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 0
    x = x.astype("<u8" if planes > 4 else "<u4")
    out = np.empty((planes, len(x)), np.uint8)
    for j in range(planes):
        np.right_shift(x, x.dtype.type(8 * j), out=out[j], casting="unsafe")
    return out.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for j, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(-1, n) if n else ()):
        out |= plane.astype(np.uint64) << np.uint64(8 * j)
    return out


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return _unpacked(raw, n).view(np.int64)


def _differences(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def _floats(x: np.ndarray) -> bytes:
    return _packed(x.astype("<f4").view("<u4"))


def _unfloats(raw: bytes, n: int) -> np.ndarray:
    return _unpacked(raw, n).astype("<u4").view("<f4")


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run of words a with one more, b."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _blocks(tokens: int):
    """Texts -> blocks: distinct words, the most frequent first, and each text's words as numbers of these."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []

        def row():
            texts, lengths, docs, nameless, out = zip(*held)
            found = pa.chunked_array(texts, pa.string()).combine_chunks().dictionary_encode()
            idx, words = found.indices.to_numpy(), np.zeros(0, np.uint64)
            if len(found.dictionary):
                _, ends, spelled = found.dictionary.buffers()
                ends = np.frombuffer(ends, np.int32)[: len(found.dictionary) + 1].astype(np.int64)
                words = span_hashes(memoryview(spelled)[: ends[-1]], ends[:-1], ends[1:])
            order = np.argsort(-np.bincount(idx, minlength=len(words)), kind="stable")
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            lengths, docs, nameless, out = (np.concatenate(x) for x in (lengths, docs, nameless, out))
            known = dict.fromkeys(_columns(_TEXTS), b"") | {
                "block": part << 32 | seq, "words": words[order].tobytes(), "n_words": len(words), "idx": _packed(new[idx]), "docs": docs.tobytes(), "nameless": _bits(nameless),
                "held": _bits(out), "lengths": _packed(lengths), "tokens": size, "trained": int((lengths + 1)[~out].sum()),
            }
            return _table(_TEXTS, [tuple(known[x] for x in _columns(_TEXTS))]).to_batches()[0]

        for b in (b.slice(x, rows) for b in batches for rows in [max(1, b.num_rows * PIECE // max(1, b.nbytes))] for x in range(0, b.num_rows, rows)):
            texts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column("text"), "")))
            words, lengths = texts.flatten(), pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            none = pc.equal(words, "").to_numpy(zero_copy_only=False)  # at the ends of texts
            if none.any():
                lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[none], minlength=len(lengths))
                words = words.filter(pa.array(~none))
            ends, total = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(lengths + 1))
            docs, nameless, out = pc.fill_null(b.column("doc_id"), 0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False)
            x = 0
            while x < len(lengths):
                y = min(int(np.searchsorted(total[1:], total[x] + tokens - size)) + 1, len(lengths))
                held.append((words.slice(ends[x], ends[y] - ends[x]), lengths[x:y], docs[x:y], nameless[x:y], out[x:y]))
                size += int(total[y] - total[x])
                if size >= tokens:
                    yield row()
                    seq, size, held = seq + 1, 0, []
                x = y
        if held:
            yield row()

    return run


class _Distinct:
    """The distinct codes of places. In order of codes: codes, first (a place that has it), at (which one each place has). In order of their
    hashes: keys, and rank, the place there of each."""

    def __init__(self, codes: np.ndarray, limit: int):
        """codes: of at least 0 and below limit."""
        n = len(codes)
        if limit <= 2 * n + 1000:
            first = np.full(limit, -1, np.int64)
            first[codes] = np.arange(n)
            self.codes = np.flatnonzero(first >= 0)
            self.first = first[self.codes]
            first[self.codes] = np.arange(len(self.codes))
            self.at = first[codes]
            return
        low = n.bit_length()
        if limit.bit_length() + low <= 63:
            by = np.sort(codes << low | np.arange(n))
            order, by = by & ((1 << low) - 1), by >> low
        else:
            order = np.argsort(codes, kind="stable")
            by = codes[order]
        new = np.ones(n, bool)
        new[1:] = by[1:] != by[:-1]
        self.codes, self.first = by[new], order[new]
        self.at = np.empty(n, np.int64)
        self.at[order] = np.cumsum(new) - 1

    def hashed(self, hashes: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.keys, self.rank = hashes[order], np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def parts(self, parts: int):
        """(part of the hash space, from, to) of the keys, where there are some."""
        cut = np.searchsorted(self.keys, np.array([(k << 64) // parts for k in range(parts)], np.uint64)).tolist() + [len(self.keys)]
        return [(k, a, b) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


class _Block:
    """A block's row: its texts as numbers of words, and the places that are not done at this level."""

    def __init__(self, r):
        self.row, w = r, r.n_words
        texts = len(r.docs) // 8
        self.lengths, self.held = _numbers(r.lengths, texts), _unbits(r.held, texts)
        ends = np.cumsum(self.lengths)
        self.begin = ends - self.lengths + np.arange(texts)
        self.numbers = np.insert(_numbers(r.idx, int(ends[-1])), ends, w)
        self.text = np.repeat(np.arange(texts), self.lengths + 1)
        self.train = np.repeat(~self.held, self.lengths + 1)

    def words(self) -> _Distinct:
        """Level 0: the words, and the end."""
        found = _Distinct(self.numbers, self.row.n_words + 1)
        found.hashed(np.append(np.frombuffer(self.row.words, np.uint64), np.uint64(_END))[found.codes])
        return found

    def base(self, n: int, v: int) -> np.ndarray:
        return ((_numbers(self.row.seen, self.row.n_words + 1) + 1.0) / (n + v + 1.0))[self.numbers]

    def level(self, k: int, n: int, v: int, split: int) -> None:
        """The places of level k: their probability so far, their contexts, and their grams where the shorter gram is listed. splits: how many keys more a place's context has."""
        self.ids = _numbers(self.row.ids, self.row.n_words + 1)
        self.hashes = mix(np.append(self.ids, _START).astype(np.uint64))
        seen = _numbers(self.row.seen, self.row.n_words + 1)
        if k == 1:
            self.places, self.p, self.listed = np.arange(len(self.numbers)), self.base(n, v), (seen >= LEAST)[self.numbers]
            at = np.append(0, self.numbers[:-1])
            at[self.begin] = len(seen) - 1  # the start occurs as often as the end
            self.splits = seen[at] // split
        else:
            self.places = np.flatnonzero(_unbits(self.row.places, len(self.numbers)))
            self.p, self.listed, self.splits = np.frombuffer(self.row.p, np.float32).astype(np.float64), _unbits(self.row.listed, len(self.places)), _numbers(self.row.splits, len(self.places))
        self.look(k)

    def look(self, k: int) -> None:
        """The contexts and grams of the places; context: the key of each place, several: which keys have a part of their context, both in order of keys; shared: these
        keys, one context after another, and where each begins."""
        width, word = len(self.hashes), self.numbers[self.places]
        self.here = self.places - self.begin[self.text[self.places]]
        far = [np.where(self.here >= j, self.numbers[np.maximum(self.places - j, 0)], width - 1) for j in range(1, k + 1)]
        self.contexts = _Distinct(far[0], width)
        for j in range(1, k):
            self.contexts = _Distinct(self.contexts.at * width + far[j], len(self.contexts.codes) * width)
        h = np.zeros(len(self.contexts.codes), np.uint64)
        for x in far:
            h = _joined(h, self.hashes[x[self.contexts.first]])
        at, keys = self.contexts.at, 1 + self.splits[self.contexts.first]
        several = np.flatnonzero(keys > 1)
        if len(several):
            begin = np.cumsum(keys) - keys
            of = np.repeat(np.arange(len(h)), keys)
            at, h = begin[at] + self.ids[word] % keys[at], np.where(keys[of] > 1, _joined(h[of], (np.arange(len(of)) - begin[of] + 1).astype(np.uint64)), h[of])
            several = np.flatnonzero(keys[of] > 1), np.flatnonzero(np.diff(of[keys[of] > 1], prepend=-1))
        self.contexts.hashed(h)
        self.context = self.contexts.rank[at]
        self.several, self.shared = np.zeros(len(h), bool), None
        if len(several):
            self.shared = self.contexts.rank[several[0]], several[1]
            self.several[self.shared[0]] = True
        self.some = np.flatnonzero(self.listed)
        self.grams = _Distinct(self.context[self.some] * width + word[self.some], len(h) * width)

    def asked(self, parts: int) -> list:
        """Messages: by key, each context's training occurrences here and its grams: next word, training occurrences here, probability so far."""
        keys, trained = self.contexts.keys, self.train[self.places]
        size = np.bincount(self.context[trained], minlength=len(keys))
        of, word = np.divmod(self.grams.codes, len(self.hashes))
        times = np.bincount(self.grams.at[trained[self.some]], minlength=len(of))
        word, below = self.ids[word], self.p[self.some[self.grams.first]]
        kinds = np.bincount(of, minlength=len(keys))
        to = np.append(0, np.cumsum(kinds)).tolist()
        return [
            (part, self.row.block, y - x, _differences(keys[x:y]), _bits(self.several[x:y]), _packed(size[x:y]), _packed(kinds[x:y]), to[y] - to[x], _packed(word[to[x] : to[y]]), _packed(times[to[x] : to[y]]), _floats(below[to[x] : to[y]]))
            for part, x, y in self.contexts.parts(parts)
        ]

    def carry_on(self, k: int, n_all: int, split: int, told: list) -> tuple:
        """Applies the retained contexts: how many places go to the next level, which, their state; done: the log10 of the places that end here, by text."""
        flags = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.flags, np.uint8) for x in told)])
        counts = [int(np.count_nonzero(np.frombuffer(x.flags, np.uint8))) for x in told]
        stored, kinds, size = (np.concatenate([np.zeros(0, np.int64), *(_numbers(getattr(x, name), c) for x, c in zip(told, counts))]) for name in ("stored", "kinds", "sizes"))
        number = np.cumsum(flags > 0) - 1
        if self.shared:
            (keys, start), part = self.shared, np.cumsum(flags == SHARED) - 1
            rows, gain = number[keys], np.concatenate([np.frombuffer(x.gain, np.float64) for x in told])[part[keys]]
            first, second = (np.concatenate([_numbers(getattr(x, name), len(x.gain) // 8) for x in told])[part[keys]] for name in ("first", "second"))
            many = np.diff(np.append(start, len(keys)))
            for x in (stored, kinds, size):
                x[rows] = np.repeat(np.add.reduceat(x[rows], start), many)
            gain, (first, second), rows = np.add.reduceat(gain, start), _two(first, second, start), rows[start]
            flags[keys] = np.repeat(_flags(n_all, size[rows], kinds[rows], stored[rows], gain, first, second), many)
        mine = np.where(flags > 0, number, -1)[self.context]
        at = np.flatnonzero(mine >= 0)
        n = np.zeros(len(self.places), np.int64)
        n[self.some] = np.concatenate([np.zeros(0, np.int64), *(_numbers(x.n, x.grams) for x in told)])[self.grams.at]
        weight, mine, every = size - stored + kinds, mine[at], np.append(size, 0)[mine]
        self.p[at] = (n[at] + weight[mine] * self.p[at]) / (stored + weight)[mine]
        # A longer context is the gram at the place before; -1 where that was not asked.
        before = np.full(len(self.numbers), -1, np.int64)
        before[self.places] = n
        on = (flags[self.context] == 3) & (self.here >= k)
        on[on] = before[self.places[on] - 1] != 0
        longer = before[self.places[on] - 1]
        longer = np.where(longer > 0, longer, every[on])
        done = np.bincount(self.text[self.places[~on]], np.log10(self.p[~on]), len(self.lengths))
        alive = np.zeros(len(self.numbers), bool)
        alive[self.places[on]] = True
        kept = self.p[on].astype(np.float32)
        return len(kept), _bits(alive), _bits(n[on] > 0), _packed(longer // split), kept.tobytes(), (done + (np.frombuffer(self.row.done, np.float64) if k > 1 else 0)).tobytes()


def _two(first: np.ndarray, second: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two largest of runs of pairs."""
    largest = np.maximum.reduceat(first, start)
    top = first == np.repeat(largest, np.diff(np.append(start, len(first))))
    return largest, np.where(np.add.reduceat(top.astype(np.int64), start) > 1, largest, np.maximum.reduceat(np.where(top, second, first), start))


def _flags(n_all: int, size: np.ndarray, kinds: np.ndarray, stored: np.ndarray, gain: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which contexts are retained, and below which longer ones can be (1 and 3). first, second: the largest counts of listed words."""
    least = 0.5 * math.log(max(2.0, n_all))
    kept = (kinds > 0) & (gain - stored * np.log(np.maximum(size, 1)) > least * kinds)
    whole = np.maximum(size + kinds, 1).astype(np.float64)
    rise = lambda x: x * np.log(whole / np.maximum(x, 1))
    more = (rise(first) > least) | (rise(np.minimum(second, whole / math.e)) > least)
    return np.where(kept, np.where(more, 3, 1), 0).astype(np.uint8)


def _table(kind: str, rows: list) -> pa.Table:
    kinds = [pa.int64() if x.endswith("long") else pa.binary() for x in kind.split(", ")]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], _columns(kind))


def _rows(table) -> list:
    """A table's or batch's rows, in order of parts where it has these."""
    row = namedtuple("Row", table.schema.names)
    rows = [row(*x) for x in zip(*(c.to_pylist() for c in table.columns))]
    return sorted(rows, key=lambda r: r.part) if "part" in row._fields else rows


def _ask_words(parts: int):
    def run(batches):
        for batch in batches:
            for r in _rows(batch):
                b = _Block(r)
                found = b.words()
                count = np.bincount(found.rank[found.at[b.train]], minlength=len(found.keys))
                yield from _table(_WORDS, [(part, r.block, y - x, _differences(found.keys[x:y]), _packed(count[x:y])) for part, x, y in found.parts(parts)]).to_batches()

    return run


def _ask(k: int, n: int, v: int, split: int, parts: int):
    def run(batches):
        for batch in batches:
            for r in _rows(batch):
                if k > 1 and not r.alive:
                    continue
                b = _Block(r)
                b.level(k, n, v, split)
                yield from _table(_ASKED, b.asked(parts)).to_batches()

    return run


def _gathered(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's messages: where each ends, and of all keys: which distinct one each is, and the sums of what came with them."""
    keys = np.concatenate([np.cumsum(_unpacked(r.keys, r.size), dtype=np.uint64) for r in rows])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    n = np.bincount(at, np.concatenate([_numbers(r.n, r.size) for r in rows]), int(new.sum())).astype(np.int64)
    return np.cumsum([r.size for r in rows]), at, n


def _count(parts: int):
    """For a part of the hash space: every message's totals and numbers among all words, in its order. One more row, of block -1, has how many words occur."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        ends, at, n = _gathered(rows)
        part = rows[0].part
        out = [(part, r.block, r.size, _packed(n[at[e - r.size : e]]), _packed(at[e - r.size : e] * parts + part)) for r, e in zip(rows, ends)]
        return _table(_COUNTED, [(part, -1, int((n > 0).sum()), b"", b""), *out])

    return run


def _decide(n_all: int):
    """For a part of the hash space: how often each gram occurs, 0 if under LEAST; which contexts are retained (_flags), and the sums of keys that have a part of their context (SHARED)."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        ends, at, size = _gathered(rows)
        word = np.concatenate([_numbers(r.next, r.grams) for r in rows])
        width = int(word.max(initial=0)) + 1
        grams = _Distinct(np.repeat(at, np.concatenate([_numbers(r.kinds, r.size) for r in rows])) * width + word, len(size) * width)
        n = np.bincount(grams.at, np.concatenate([_numbers(r.times, r.grams) for r in rows]), len(grams.codes)).astype(np.int64)
        n[n < LEAST] = 0
        listed = np.flatnonzero(n)
        by, times, below = grams.codes[listed] // width, n[listed], np.concatenate([_unfloats(r.below, r.grams) for r in rows])[grams.first[listed]].astype(np.float64)
        kinds = np.bincount(by, minlength=len(size))
        stored = np.bincount(by, times, len(size)).astype(np.int64)
        gain = np.bincount(by, times * np.log(times / below), len(size))
        first, second = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        if len(by):
            start = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            first[by[start]], second[by[start]] = _two(times, np.zeros(len(times), np.int64), start)
        flags = _flags(n_all, size, kinds, stored, gain, first, second)
        flags[at[np.concatenate([_unbits(r.split, r.size) for r in rows])]] = SHARED
        out, e, to = [], 0, 0
        for r in rows:
            mine, e = at[e : e + r.size], e + r.size
            f = flags[mine]
            some, shared = mine[f > 0], mine[f == SHARED]
            out.append((r.part, r.block, r.size, f.tobytes(), _packed(stored[some]), _packed(kinds[some]), _packed(size[some]), gain[shared].tobytes(), _packed(first[shared]), _packed(second[shared]), r.grams, _packed(n[grams.at[to : to + r.grams]])))
            to += r.grams
        return _table(_TOLD, out)

    return run


def _with_words(block: pa.Table, notes: pa.Table) -> pa.Table:
    """Blocks with the numbers of their words among all, and their training occurrences, the end's last."""
    out, told = [], _rows(notes)
    for r in _rows(block):
        found = _Block(r).words()
        known = {"words": b""}
        for column, name in (("n", "seen"), ("ids", "ids")):
            x = np.zeros(r.n_words + 1, np.int64)
            x[found.codes] = np.concatenate([_numbers(getattr(t, column), t.size) for t in told])[found.rank]
            known[name] = _packed(x)
        out.append(r._replace(**known))
    return _table(_TEXTS, out)


def _carry_on(k: int, n: int, v: int, split: int):
    """The blocks' next state."""

    def run(block: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        for r in _rows(block):
            if k > 1 and not r.alive:
                out.append(tuple(getattr(r, x) for x in _columns(_STATE)))
                continue
            b = _Block(r)
            b.level(k, n, v, split)
            out.append((r.block, *b.carry_on(k, n, split, _rows(notes))))
        return _table(_STATE, out)

    return run


def _results(n: int, v: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                b = _Block(r)
                base = np.add.reduceat(np.log10(b.base(n, v)), b.begin)
                known = np.add.reduceat((_numbers(r.seen, r.n_words + 1) > 0)[b.numbers].astype(np.int64), b.begin)
                ids = pd.array(np.frombuffer(r.docs, np.int64), "Int64", copy=True)
                ids[_unbits(r.nameless, len(ids))] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": b.lengths + 1, "n_known": known, "train_tokens": n, "base_score": base, "score": np.frombuffer(r.done, np.float64)})

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), FOLDS).alias("held_out"))
    blocks = keep(mine.mapInArrow(_blocks(BLOCK_TOKENS), _TEXTS), "op9-blocks")
    alive, n, many = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    buckets = "block", max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // 4)

    def parts() -> int:
        return max(16, alive // PART_PLACES)

    def told(state: DataFrame, notes: DataFrame, run, kind: str) -> DataFrame:
        return state.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(run, kind)

    def by_part(asked: DataFrame, run, kind: str) -> DataFrame:
        return asked.repartition(parts(), "part").groupBy("part").applyInArrow(run, kind)

    words = keep(by_part(blocks.mapInArrow(_ask_words(parts()), _WORDS), _count(parts()), _COUNTED), "op9-words")
    v = int(words.where("block = -1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    texts = keep(told(blocks, words.where("block >= 0"), _with_words, _TEXTS), "op9-texts", buckets)
    dropped(blocks, words)
    places, state, k = None, texts, 1
    while alive:
        notes = keep(by_part(state.mapInArrow(_ask(k, n, v, SPLIT, parts()), _ASKED), _decide(n), _TOLD), "op9-notes")
        after = keep(told(state, notes, _carry_on(k, n, v, SPLIT), _STATE), "op9-places", buckets)
        dropped(notes, *([places] if places else []))
        places, state, k = after, texts.join(after, "block"), k + 1
        alive = places.agg(F.sum("alive")).first()[0]
    if places is None:
        return docs.sparkSession.createDataFrame([], _OUT)
    return state.mapInPandas(_results(n, v), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL = None
