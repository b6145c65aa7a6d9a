"""Language-model scores by logistic context mixing.

A text is a sequence of tokens: lower-case words, then an end. The most frequent training tokens (the head) have a
binary code by frequency; all others share one codeword and are then told apart by their training counts. Coding a
token is a walk of yes-or-no decisions down the code tree. Each decision is predicted in several contexts:

- the tree node alone, and the node hashed with the last frequent word or with the token before: slots hold how often the
  training corpus decided each way there. These are the low orders, whose contexts are few, in tables of fixed size;
- the two whole tokens before, of any rarity: what followed them in the training corpus, most often, predicts each decision
  on the way to it, and after the shared codeword the very token. These statistics grow with the corpus: every pair of
  tokens has its own, kept in a shuffled table that blocks of texts ask (see exchange.py), never in one place.

The log-odds enter a mixer whose weights are chosen by a gate (how much evidence the contexts have). They start from
weights learned on all training texts and move on by gradient steps as a text is read, after the first decisions already;
each block of decisions is predicted before it is learned from. The mixed odds pass an adaptive refinement: a curve for each
gate, fitted on what such odds turned out to mean, and a correction for each step of the curve that moves with the text.
A training text is never predicted from its own occurrence of a pair.

What the first weights and curves are learned from is a table of whole numbers: how often each cell of log-odds, gate and
decision came up in the training texts, each decision without its own part in the counts. Tasks add their blocks up, Spark
the tasks; the table has a fixed number of cells, and its sums depend neither on partitions nor on an order.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Shared, arrow_schema, column, dropped_shuffles, remainder, save, session, texts
from scholia.llm.exchange import answered, blocks, by_bucket, from_planes, messages, place, planes, read, with_answers
from scholia.llm.exchange import opened as open_message
from scholia.llm.repeats import mix as scramble

#: Tokens with a code of their own. Bits of a low-order slot table.
HEAD, TABLE_BITS = 30_000, 20
#: Decisions between two steps of the weights: at first, at most; the size of a step.
FIRST, MOST, STEP = 64, 2048, 0.03
END = b""
TABLES = 2
INPUTS = TABLES + 2
_STEPS, _CHUNK = 33, 1 << 16
#: Bytes of a block of texts, and of all texts for each bucket of questions; buckets at least.
BLOCK, BUCKET, LEAST_BUCKETS = 2 << 20, 16 << 20, 64
#: Tokens whose decisions are made at a time: of one long text, of the texts of a block; numbers of a bucket that are settled at a time.
PIECE, PART, SLICE = 300_000, 1 << 16, 1 << 18
#: Tokens whose decisions are made in one go, few enough for their arrays to stay in a core's cache.
FEW = 1 << 12
#: Tokens of several blocks that are held until equal ones are counted together.
MANY = 1 << 20
#: Numbers that a context can be (Code.before): none or one of 64 words; none, one of 512 tokens or one of 52 code lengths.
_KINDS = (65, 566)
_GATES = 4**TABLES * 4
_LEVELS, _DEPTHS = 10, 4
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_TAIL = 0x80000000
_SEEN_BLOCK = -7
#: Cells of the table that weights are learned from: steps of 1 in a context's log-odds, to 8 at most, of 1/10 in the node's
#: own, which a code by frequency keeps below 0.7; what the pair before predicts (level, depth, which way), 0 for nothing.
_WIDE, _FINE = 8, 10
_CELLS = 2 * _WIDE + 1
_CLASSES = 1 + (_LEVELS - 1) * _DEPTHS * 2
_ALIKE = (*_KINDS, _LEVELS, 53)  # see alike()
_U = np.uint64


def tokens(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names), _U, len(names))


def _keys(node: list[int]) -> np.ndarray:
    x = np.array(node, np.uint32) * np.uint32(_MULT[2])
    return (x ^ (x >> np.uint32(16))) * np.uint32(_MULT[0])


def hashed(c: np.ndarray, table: int) -> np.ndarray:
    """Hashes of a table's contexts."""
    h = (c + np.uint32((1, 1000)[table])) * np.uint32(_MULT[table])
    h ^= h >> np.uint32(15)
    return h * np.uint32(_MULT[0])


@dataclass
class Code:
    """Head tokens (the last code is the shared one of all others) and their walks: nodes and decisions, flat."""

    ids: dict[bytes, int]
    start: np.ndarray
    size: np.ndarray
    word: np.ndarray  # the decisions of each token from the highest bit on
    node: np.ndarray
    bit: np.ndarray
    key: np.ndarray  # of the nodes, hashed
    odds: np.ndarray  # of deciding 1 at each node
    bits: int  # of a slot table
    known: np.ndarray  # hashes of the head tokens, ascending
    known_id: np.ndarray  # their ids

    @classmethod
    def build(cls, head: list[tuple[bytes, int]], rest: float, bits: int = TABLE_BITS) -> Code:
        weights = [float(c) for _, c in head] + [max(rest, 0.5)]
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, weight = [-1] * n, [0] * n, list(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            k = len(parent)
            parent.append(-1)
            side.append(0)
            weight.append(a + b)
            parent[i] = parent[j] = k
            side[i], side[j] = 0, 1
            heapq.heappush(heap, (a + b, k))
        one = [0.0] * len(parent)
        for i, p in enumerate(parent):
            if p >= 0 and side[i]:
                one[p] = weight[i]
        start, size, node, bit, word = [], [], [], [], []
        for i in range(n):
            walk = []
            k = i
            while parent[k] >= 0:
                walk.append((parent[k], side[k]))
                k = parent[k]
            walk.reverse()
            if len(walk) > 52:
                raise ValueError("a code of over 52 decisions")  # needs counts beyond 10**10 to 1
            start.append(len(node))
            size.append(len(walk))
            word.append(sum(x << (63 - d) for d, (_, x) in enumerate(walk)))
            node += [x for x, _ in walk]
            bit += [x for _, x in walk]
        odds = np.array([math.log((o + 0.4) / (w - o + 0.4)) if w > o else 0.0 for o, w in zip(one, weight, strict=True)], np.float32)
        hashes = _hashes([t for t, _ in head])
        rank = np.argsort(hashes)
        return cls({t: i for i, (t, _) in enumerate(head)}, np.array(start, np.int32), np.array(size, np.int32), np.array(word, _U), np.array(node, np.int32), np.array(bit, np.int8), _keys(node), odds, bits, hashes[rank], rank.astype(np.int32))

    def before(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """What stands before each token, as numbers below _KINDS: the last frequent word; the token before, rare ones by their
        code length. first: where in ids each text starts."""
        u = np.uint32
        n = len(ids)
        first = first[first < n]
        back = np.zeros(n, u)
        back[1:] = np.take(np.where(np.arange(len(self.size)) < 512, np.arange(len(self.size)), 512 + self.size).astype(u) + u(1), ids[:-1])
        back[first] = 0
        often = np.flatnonzero(ids < 64)
        last = np.searchsorted(often, first)  # frequent words before each text
        starts = np.zeros(n, np.int32)
        starts[(often + 1)[often + 1 < n]] = 1  # a frequent word stands before
        words = np.concatenate(([0], ids[often] + 1)).astype(u)
        one = np.take(words, np.cumsum(starts, dtype=np.int32))
        ends = np.minimum(np.append(often, n)[last] + 1, np.append(first[1:], n))  # up to its own first frequent word, that included
        if len(first):
            gap = ends - first
            none = np.repeat(first - (np.cumsum(gap) - gap), gap) + np.arange(gap.sum())
            one[none] = 0
        return [one, back]

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of what stands before each token."""
        return [hashed(c, k) for k, c in enumerate(self.before(ids, first))]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Of each decision of some tokens one after another: its place in the flat walks."""
        size = self.size[ids]
        at = np.repeat((self.start[ids] - (np.cumsum(size, dtype=np.int32) - size)).astype(np.intp), size)
        at += np.arange(len(at))
        return at

    def slots(self, ids: np.ndarray, contexts: list[np.ndarray], key: np.ndarray) -> list[np.ndarray]:
        """Their slots in each table. key: of their nodes."""
        size, out = self.size[ids], []
        for c in contexts:
            h = np.repeat(c, size)
            h ^= key
            h *= np.uint32(_MULT[1])
            h >>= np.uint32(32 - self.bits)
            out.append(h)
        return out

    def decisions(self, ids: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Nodes, decisions, slots in each table and depths, of the tokens of some texts one after another, with their contexts."""
        at = self.places(ids)
        return self.node[at], self.bit[at], self.slots(ids, contexts, self.key[at]), at - np.repeat(self.start[ids], self.size[ids])

    def add(self, total: np.ndarray, table: int, stood: np.ndarray) -> None:
        """Add to the counts of a slot table the decisions of tokens in its contexts. stood: id times _KINDS, plus context, of
        each token; is sorted. Tokens that agree in both are dealt with once."""
        stood.sort()
        lead = np.flatnonzero(np.diff(stood, prepend=-1))
        times = np.diff(lead, append=len(stood)).astype(np.uint32)
        for a in range(0, len(lead), FEW):
            ids, c = np.divmod(stood[lead[a : a + FEW]], _KINDS[table])
            at = self.places(ids)
            (slot,) = self.slots(ids, [hashed(c.astype(np.uint32), table)], np.take(self.key, at))
            np.add.at(total, slot.astype(np.intp) * 2 + np.take(self.bit, at), np.repeat(times[a : a + FEW], self.size[ids]))

    @cached_property
    def taken(self) -> np.ndarray:
        """The flat walks in 16 bytes a place: key, log-odds of going as it does, 1/64 with the decision's sign, the decision."""
        out = np.empty((len(self.key), 4), np.uint32)
        sign = (2 * self.bit - 1).astype(np.float32)
        out[:, 0], out[:, 3] = self.key, self.bit
        out[:, 1], out[:, 2] = (np.take(self.odds, self.node) * sign).view(np.uint32), (sign / 64).view(np.uint32)
        return out.view(np.complex128).ravel()

    @cached_property
    def celled(self) -> np.ndarray:
        """The flat walks in 8 bytes a place: key; what the node's own log-odds and the decision add to a cell."""
        out = np.empty((len(self.key), 2), np.uint32)
        out[:, 0], out[:, 1] = self.key, np.take(_cell(self.odds * _FINE), self.node) * np.int32(2) + self.bit
        return out.view(_U).ravel()

    @cached_property
    def ahead(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each grade, gate, number of decisions shared with the predicted token, and depth, in that order: grade, depth of
        trust, and whether that token goes the same way (1), the other (-1) or has parted before (0)."""
        most = int(self.size.max(initial=0)) + 1
        grade, _, far, depth = np.ogrid[:_LEVELS, :4, :most, :most]
        way = np.where(depth < far, 1, np.where(depth == far, -1, 0)).astype(np.int8)
        full = np.broadcast_arrays(grade, np.minimum(depth, _DEPTHS - 1), way, np.empty((_LEVELS, 4, most, most)))
        return full[0].ravel(), full[1].ravel(), full[2].ravel()

    def row(self, ids: np.ndarray, far: np.ndarray, grade: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Where ahead() holds each token's first decision."""
        most = int(self.size.max(initial=0)) + 1
        return ((grade.astype(np.intp) * 4 + third) * most + far) * most

    def agree(self, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many first decisions two tokens share."""
        _, e = np.frexp(((self.word[ids] ^ self.word[other]) >> _U(11)).astype(np.float64))
        return np.minimum(53 - e, self.size[ids])


class Reader:
    """The tokens of some texts: distinct ones by number, and which stand where."""

    def __init__(self, rows: list[bytes] | pa.Array) -> None:
        if isinstance(rows, list):
            rows = pa.array(rows, pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(rows, ""))))  # as tokens() does
        words = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = pc.list_flatten(split).dictionary_encode()
        listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        flat, names = coded.indices.to_numpy(), pc.binary_join(listed, "\n")[0].as_py().encode().split(b"\n")  # no token holds a line's end
        end = names.index(END) if END in names else len(names)
        names += [END] * (end == len(names))
        sizes = words + 1  # an empty text has split into one empty word, its end
        begin = np.cumsum(words) - words
        bare = np.zeros(len(words), bool)
        bare[words == 1] = flat[begin[words == 1]] == end
        sizes[bare] = 1
        at = np.full(int(sizes.sum()), end, np.int64)
        where = np.arange(len(flat)) + np.repeat(np.cumsum(sizes) - sizes - begin, words)
        if bare.any():
            kept = np.repeat(~bare, words)
            where, flat = where[kept], flat[kept]
        at[where] = flat
        crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
        order = np.argsort(crc, kind="stable")  # so buckets lie one after another
        self.hashes, self.distinct, place_ = None, [names[i] for i in order.tolist()], np.empty(len(names), np.int64)
        place_[order] = np.arange(len(names))
        self._set(sizes, place_[at])

    def _set(self, sizes: np.ndarray, at: np.ndarray) -> None:
        self.sizes, self.at = sizes, at
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)[: len(sizes)]

    def packed(self) -> dict[str, list]:
        """The columns that opened() reads again, of one row."""
        return {"names": [b"\n".join(self.distinct)], "at": [planes(self.at.astype("<u4"))], "sizes": [planes(self.sizes.astype("<i8"))]}

    @classmethod
    def opened(cls, row: dict) -> Reader:
        self = cls.__new__(cls)
        self.hashes, self.distinct = None, row["names"].as_py().split(b"\n")
        sizes, at = row["sizes"].as_py(), row["at"].as_py()
        self._set(from_planes(sizes, "<i8", len(sizes) // 8), from_planes(at, "<u4", len(at) // 4).astype(np.int64))
        return self

    def buckets(self, n: int) -> np.ndarray:
        """The distinct tokens' buckets, ascending."""
        return np.fromiter(map(zlib.crc32, self.distinct), np.int64, len(self.distinct)) * n >> 32

    def parts(self, size: int) -> Iterator[np.ndarray]:
        """Texts of about one length, the longest first, of at most `size` tokens together or one text."""
        order, a = np.argsort(-self.sizes, kind="stable"), 0
        ends = np.cumsum(self.sizes[order])
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - self.sizes[order[a]] + size, side="right")))
            yield order[a:b]
            a = b

    def ids(self, code: Code) -> np.ndarray:
        """Head ids of the distinct tokens, found by their hashes."""
        h, other = self._hashed(), len(code.ids)
        if not other:
            return np.zeros(len(h), np.int32)
        order = np.argsort(h)
        at = np.minimum(np.searchsorted(code.known, h[order]), other - 1)
        out = np.empty(len(h), np.int32)
        out[order] = np.where(code.known[at] == h[order], code.known_id[at], other)
        return out

    def _hashed(self) -> np.ndarray:
        if self.hashes is None:
            self.hashes = _hashes(self.distinct)
        return self.hashes

    def pairs(self, own: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the two tokens before each place, and a number that tells each token apart: its head id, or 31 bits of its hash."""
        h = self._hashed()
        name = np.where(own < other, own.astype(np.uint32), (h >> _U(33)).astype(np.uint32) | np.uint32(_TAIL))
        mult, none = _U(0x9E3779B97F4A7C15), np.ones(1, _U)
        pair, two = np.empty(len(self.at), _U), np.empty(len(self.at), _U)
        pair[1:], two[2:] = (h * mult)[self.at[:-1]], scramble(h)[self.at[:-2]]
        pair[self.first] = mult
        two[self.first] = two[(self.first + 1)[self.sizes > 1]] = scramble(none)[0]
        pair += two
        return scramble(pair), name[self.at]


def level(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A grade, 1 to 9, of what followed a pair c times of n, and its gate, 1 to 3; 0 where there is nothing."""
    share = np.where(c * 2 <= n, 0, np.where(c * 10 < n * 9, 1, 2))
    size = np.where(c < 2, 0, np.where(c < 4, 1, 2))
    return np.where(c > 0, 1 + 3 * size + share, 0), np.where(c > 0, 1 + share, 0)


@dataclass
class Model:
    code: Code
    slots: list[np.ndarray]  # log-odds in 1/64 times 4, plus a grade of evidence
    weights: np.ndarray  # gate x input
    curve: np.ndarray  # log-odds for each gate and step, flat
    trust: np.ndarray  # log-odds that a decision is that of the predicted token, by level and depth
    same: np.ndarray  # log-odds that a token outside the head is the predicted one, by level

    def inputs(self, ids: np.ndarray, contexts: list[np.ndarray], seen: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each decision: a row of log-odds that it goes as it does, in each context; the gate; the decision. contexts: the
        tokens' (Code.contexts); seen: of each token the predicted token's id, the level and the gate."""
        code = self.code
        grade, depth, way = code.ahead
        ahead = np.empty((len(way), 2), np.float32)
        ahead[:, 0] = self.trust[grade, depth] * way
        row = code.row(ids, code.agree(ids, seen[0]), seen[1], seen[2])
        most = int(code.size.max(initial=0)) + 1
        ahead[:, 1] = np.arange(len(way)) // most**2 % 4 * np.abs(way)  # the gate of what is predicted
        ahead = ahead.view(np.complex64).ravel()
        ends = np.cumsum(np.concatenate(([0], code.size[ids])))
        x, gate, bit = np.empty((ends[-1], INPUTS), np.float32), np.empty(ends[-1], np.uint8), np.empty(ends[-1], np.int8)
        for a in range(0, len(ids), FEW):
            own = ids[a : a + FEW]
            out = slice(ends[a], ends[a + len(own)])
            at, g = code.places(own), gate[out]
            taken = np.take(code.taken, at).view(np.float32).reshape(-1, 4)
            x[out, 0], bit[out], s = taken[:, 1], taken.view(np.uint32)[:, 3], taken[:, 2].copy()
            g[:] = 0
            for i, slot in enumerate(code.slots(own, [c[a : a + FEW] for c in contexts], taken.view(np.uint32)[:, 0])):
                got = np.take(self.slots[i], slot)
                np.multiply(got >> 2, s, out=x[out, i + 1])
                g *= np.uint8(4)
                g += got.astype(np.uint8) & np.uint8(3)
            at += np.repeat(row[a : a + FEW] - code.start[own], code.size[own])
            taken = np.take(ahead, at)
            x[out, -1] = taken.real
            g *= np.uint8(4)
            g += taken.imag.astype(np.uint8)
        return x, gate, bit

    def step(self, w: np.ndarray, shift: np.ndarray, x: np.ndarray, kind: np.ndarray, length: np.ndarray, more: int) -> np.ndarray:
        """Sums of natural logs of some decisions' probabilities, by text, from their columns of inputs(); then the weights and corrections of the first `more`
        texts move. kind: of text, gate and decision, ascending; length: decisions of each text."""
        lead = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        run, many = kind[lead].astype(np.int64), np.diff(lead, append=len(kind))  # decisions with the same weights and outcome lie together
        s = np.repeat((run % 2 * 2 - 1).astype(np.float32), many)
        run >>= 1
        own = w.reshape(-1, INPUTS)[run]
        sure = np.repeat(own[:, 0], many)
        sure *= x[0]
        for j in range(1, INPUTS):
            part = np.repeat(own[:, j], many)
            part *= x[j]
            sure += part
        mixed = sure * s
        place = mixed * np.float32(2)
        np.rint(place, out=place)
        np.maximum(place, np.float32(-(_STEPS // 2)), out=place)
        np.minimum(place, np.float32(_STEPS // 2), out=place)
        place = place.astype(np.intp)
        odds = np.take(self.curve, place + np.repeat(run % _GATES * _STEPS + _STEPS // 2, many))
        odds += mixed
        odds *= np.float32(0.5)
        place += np.repeat(np.arange(len(length)) * _STEPS + _STEPS // 2, length)
        odds += np.take(shift.ravel(), place)
        odds *= s
        odds = _one_more_exp(np.negative(odds, out=odds))
        if more:
            k = int(np.searchsorted(run, more * _GATES))
            n = int(many[:k].sum())
            miss = 1 / _one_more_exp(sure[:n])
            begin = np.flatnonzero(np.diff(run[:k], prepend=-1))  # both outcomes of a gate move it
            lead, seen = lead[begin], np.maximum(np.add.reduceat(many[:k], begin), 64).astype(np.float32)
            moved = w.reshape(-1, INPUTS)
            moved[run[begin]] += np.stack([STEP * np.add.reduceat(miss * x[j, :n], lead) / seen for j in range(INPUTS)], axis=1)
            # counts in the thousands, sums of parts below 1 under them
            both = np.bincount(place[:n], (s[:n] - s[:n] / odds[:n]) + np.float64(2 * MOST), more * _STEPS)
            seen = np.rint(both / (2 * MOST))
            shift[:more] += ((both - seen * (2 * MOST)) / (seen + 64)).reshape(more, _STEPS)
        return -np.add.reduceat(np.log(odds), np.cumsum(length) - length, dtype=np.float64)

    def score(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural-log probability of each text's decisions. All texts are read side by side, a block of decisions a time;
        the decisions of a block, which are predicted before any is learned from, lie by gate."""
        n = len(ends) - 1
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        begin, size, total = ends[:-1][order], size[order], np.zeros(n)
        w = np.repeat(self.weights[None], n, axis=0)
        shift = np.zeros((n, _STEPS), np.float32)
        done, width = 0, FIRST
        kinds = gate * np.uint8(2) + bit.view(np.uint8)
        while n and done < size[0]:
            m = int(np.searchsorted(-size, -done, side="left"))  # texts that have decisions left
            length = np.minimum(size[:m] - done, width)
            start = np.cumsum(length) - length
            at = np.repeat(begin[:m] + done - start, length)
            at += np.arange(len(at))
            low = len(at).bit_length()
            key = np.take(kinds, at).astype(np.int32 if (2 * _GATES * m) << low < 1 << 31 else np.int64)
            key += np.repeat((np.arange(m) * (2 * _GATES)).astype(key.dtype), length)
            key <<= low
            key |= np.arange(len(at), dtype=key.dtype)
            key.sort()
            at = np.take(at, key & ((1 << low) - 1))
            key >>= low
            more = int(np.searchsorted(-size, -(done + width), side="left"))
            total[:m] += self.step(w, shift, _columns(x, at), key, length, more)
            done += width
            width = min(MOST, 2 * width)
        out = np.empty(n)
        out[order] = total
        return out

    def score_long(self, ids: np.ndarray, contexts: list[np.ndarray], seen: tuple, piece: int = PIECE) -> float:
        """score() of one text, whose decisions are made `piece` tokens at a time."""
        w, shift, width, total = self.weights[None].copy(), np.zeros((1, _STEPS), np.float32), FIRST, 0.0
        x, gate, bit = np.empty((0, INPUTS), np.float32), np.empty(0, np.uint8), np.empty(0, np.int8)
        for a in range(0, len(ids), piece):
            own = slice(a, a + piece)
            new = self.inputs(ids[own], [c[own] for c in contexts], tuple(v[own] for v in seen))
            x, gate, bit = np.concatenate((x, new[0])), np.concatenate((gate, new[1])), np.concatenate((bit, new[2]))
            last, at = a + piece >= len(ids), 0
            while at < len(bit) and (last or len(bit) - at > width):
                kinds = gate[at : at + width] * np.uint8(2) + bit[at : at + width].view(np.uint8)
                b = np.argsort(kinds, kind="stable")
                total += float(self.step(w, shift, _columns(x, at + b), kinds[b], np.array([len(b)]), int(at + width < len(bit)))[0])
                at += width
                width = min(MOST, 2 * width)
            x, gate, bit = x[at:], gate[at:], bit[at:]
        return total


def _one_more_exp(x: np.ndarray) -> np.ndarray:
    """1 + exp(x), in place; x at most 30."""
    np.minimum(x, np.float32(30), out=x)
    np.exp(x, out=x)
    x += 1
    return x


def _columns(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns of some rows. A row's numbers stand together, so each is looked up once."""
    return np.ascontiguousarray(np.take(x.view(np.complex128).ravel(), at).view(np.float32).reshape(-1, INPUTS).T)


def mix(w: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Sum over the contexts of weight times log-odds. The weights of a gate stand together, so each decision looks up once."""
    own = np.take(w.reshape(-1, INPUTS).view(np.complex128).ravel(), gate).view(np.float32).reshape(-1, INPUTS)
    out = own[:, 0] * x[0]
    for j in range(1, INPUTS):
        out += own[:, j] * x[j]
    return out


def _packed(counts: np.ndarray) -> np.ndarray:
    """Log-odds and a grade of evidence in 16 bits, from the counts of 0 and of 1."""
    n0, n1 = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    n = n0 + n1
    odds = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
    grade = np.where(n < 1, 0, np.where(n < 8, 1, np.where(n < 128, 2, 3))).astype(np.int16)
    return (np.clip(np.rint(odds * 64), -8000, 8000).astype(np.int16) << 2) | grade


@cache
def _graded() -> tuple[np.ndarray, np.ndarray]:
    """level() of every two bytes."""
    return tuple(v.astype(np.int8).ravel() for v in level(*np.indices((256, 256))))


def _guess(name: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray], training: np.ndarray, other: int) -> tuple:
    """Of each token: the predicted token's id, its level and gate, and whether it is the token itself; without a training
    text's own occurrence. asked: predicted names, times, times of any."""
    m, c, n = asked
    right = m == name
    c, n = (np.where(v > taken, v - taken, 0).astype(np.intp) for v, taken in ((c, (training & right).view("u1")), (n, training.view("u1"))))
    c *= 256
    c += n
    grade, third = (np.take(v, c) for v in _graded())
    return np.where(m < _TAIL, m, other).astype(np.int64), grade, third, right & (grade > 0)


def _relieved(counts: np.ndarray) -> np.ndarray:
    """The cells of each slot for a decision of 0 and of 1, of which its own occurrence has been taken: grade, log-odds."""
    out = []
    for bit in range(2):
        n = counts.copy()
        n[:, bit] -= np.minimum(n[:, bit], 1)
        packed = _packed(n)
        out.append((packed & 3) * _CELLS + _cell((packed >> 2) / np.float32(64)))
    return np.stack(out, axis=1).astype(np.uint8).ravel()


def _cell(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds), -_WIDE, _WIDE).astype(np.int16) + _WIDE


def alike(code: Code, ids: np.ndarray, before: list[np.ndarray], seen: tuple) -> np.ndarray:
    """One number for all that the cells of a training token depend on. before: of each token (Code.before)."""
    key = ids.astype(np.int64)
    for v, kind in zip((*before, seen[1], code.agree(ids, seen[0])), _ALIKE, strict=True):
        key *= kind
        key += v
    return key


def cells(code: Code, relieved: list[np.ndarray], key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the decisions of some training tokens: which cells of the table they count in, and how often. relieved: of each slot
    table (_relieved); key: of each token (alike), is sorted; equal ones are dealt with once."""
    key.sort()
    lead = np.flatnonzero(np.diff(key, prepend=-1))
    times, key, parts = np.diff(lead, append=len(key)).astype(np.uint32), key[lead], []
    for kind in reversed(_ALIKE):
        key, own = np.divmod(key, kind)
        parts.append(own)
    far, grade, *before = parts
    grades, depths, way = code.ahead
    ahead = np.where((grades > 0) & (way != 0), ((grades - 1) * _DEPTHS + depths) * 2 + (way < 0), -2).astype(np.int32)
    row = code.row(key, far, grade, np.zeros_like(far)) - code.start[key]
    contexts = [hashed(c.astype(np.uint32), k) for k, c in enumerate(reversed(before))]
    for a in range(0, len(key), FEW):
        own = key[a : a + FEW]
        at = code.places(own)
        walk = np.take(code.celled, at).view(np.int32).reshape(-1, 2)
        base = walk[:, 1].copy()
        bit = base & 1
        at += np.repeat(row[a : a + FEW], code.size[own])
        cell = np.take(ahead, at)
        cell ^= bit  # which way the predicted token goes
        cell += 1
        np.maximum(cell, 0, out=cell)
        for s, table in zip(code.slots(own, [c[a : a + FEW] for c in contexts], walk.view(np.uint32)[:, 0]), relieved, strict=True):
            s <<= np.uint32(1)
            s |= bit.view(np.uint32)
            cell *= 4 * _CELLS
            cell += np.take(table, s)
        cell *= _CELLS * 2
        cell += base
        yield cell, np.repeat(times[a : a + FEW], code.size[own])


def _seen(code: Code, name: np.ndarray, times: np.ndarray, guess: tuple) -> np.ndarray:
    """What came of predictions by the pair before, of tokens that stand `times` times: hits and all by level and depth, then
    hits and all of tokens outside the head by level."""
    other = len(code.ids)
    ids = np.where(name < _TAIL, name, other).astype(np.int64)
    m, grade, _, right = guess
    far = code.agree(ids, m)
    live = np.minimum(far, code.size[ids] - 1) + 1  # decisions that the predicted token speaks of
    out = np.zeros((2, _LEVELS, _DEPTHS))
    n = np.arange(53)  # a code has fewer decisions
    for k, reached in enumerate((far, live)):
        many = np.bincount(grade.astype(np.int64) * len(n) + reached, times, _LEVELS * len(n)).reshape(_LEVELS, len(n))
        for d in range(_DEPTHS):
            out[k, :, d] = many @ (np.maximum(n - d, 0) if d == _DEPTHS - 1 else n > d)
    out[:, 0] = 0
    tail = (ids == other) & (m == other) & (grade > 0)
    same = [np.bincount(grade[tail], (times * w)[tail], _LEVELS) for w in (right, 1)]
    return np.concatenate((out.ravel(), *same)).astype(np.int64)


def fit(code: Code, counts: list[np.ndarray], seen: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model. counts: of each slot table, (slots, 2); seen: sums of _seen(); table: cells of all training decisions and
    how many each has. Weights are those of least cost over the table (Newton steps for each gate, drawn to 1/4)."""
    weights = np.full((_GATES, INPUTS), 0.25, np.float32)
    curve = np.tile(((np.arange(_STEPS) - _STEPS // 2) / 2).astype(np.float32), _GATES)
    model = Model(code, [_packed(x) for x in counts], weights, curve, np.zeros((_LEVELS, _DEPTHS), np.float32), np.zeros(_LEVELS, np.float32))
    if not (len(table) and len(table[0])):
        return model
    hit, every = seen[: 2 * _LEVELS * _DEPTHS].reshape(2, _LEVELS, _DEPTHS)
    model.trust = np.where(every > 0, np.log((hit + 0.5) / (every - hit + 0.5)), 0).astype(np.float32)
    hit, every = seen[2 * _LEVELS * _DEPTHS :].reshape(2, _LEVELS)
    model.same = np.log((hit + 0.5) / (every - hit + 1)).astype(np.float32)
    key, n = table
    key, bit = np.divmod(key, 2)
    x = np.empty((INPUTS, len(key)), np.float32)
    key, own = np.divmod(key, _CELLS)
    x[0] = (own - _WIDE) / _FINE
    gate = np.zeros(len(key), np.int32)
    for i in reversed(range(TABLES)):
        key, own = np.divmod(key, 4 * _CELLS)
        x[i + 1] = own % _CELLS - _WIDE
        gate += (own // _CELLS * 4 ** (TABLES - i)).astype(np.int32)
    level_, way = np.divmod(key - 1, 2)
    x[-1] = np.where(key > 0, np.take(model.trust.ravel(), np.maximum(level_ + _DEPTHS, 0)) * (2 * way - 1), 0)
    gate += np.where(key > 0, level_ // _DEPTHS % 3 + 1, 0).astype(np.int32)
    sign, pull = 2 * bit.astype(np.float32) - 1, 20.0
    for _ in range(12):
        p = 1 / _one_more_exp(sign * mix(model.weights, x, gate))  # of the other decision
        slope, bend = n * sign * p, n * p * (1 - p)
        g = np.stack([np.bincount(gate, slope * x[j], _GATES) for j in range(INPUTS)], axis=1) - pull * (model.weights - 0.25)
        h = np.empty((_GATES, INPUTS, INPUTS))
        for j in range(INPUTS):
            for k in range(j + 1):
                h[:, j, k] = h[:, k, j] = np.bincount(gate, bend * x[j] * x[k], _GATES)
        move = np.linalg.solve(h + pull * np.eye(INPUTS), g[..., None])[..., 0]
        model.weights = (model.weights + np.clip(move, -0.5, 0.5)).astype(np.float32)
    step = gate * _STEPS + np.clip(np.rint(mix(model.weights, x, gate) * 2) + _STEPS // 2, 0, _STEPS - 1).astype(np.int32)
    ones = np.bincount(step, n * bit, _GATES * _STEPS) + 30 / (1 + np.exp(-model.curve))
    p = np.clip(ones / (np.bincount(step, n, _GATES * _STEPS) + 30.0), 1e-6, 1 - 1e-6)
    model.curve = np.log(p / (1 - p)).astype(np.float32)
    return model


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A block whose texts are read: tokens by number, and the bytes of each text."""
    text = batch.column(batch.schema.get_field_index("text")).flatten()
    n_bytes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    columns = {"block": batch.column(0), "doc_id": batch.column(1), "held": batch.column(2), "n_bytes": [n_bytes]} | Reader(text).packed()
    return pa.RecordBatch.from_pydict({c: columns[c] for c in _BLOCK_DDL.replace(",", "").split()[::2]}, schema=_BLOCK_SCHEMA)


_BLOCK_DDL = "block long, doc_id array<long>, held array<boolean>, n_bytes array<long>, names binary, at binary, sizes binary"
_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_bytes", pa.list_(pa.int64())), ("names", pa.binary()), ("at", pa.binary()), ("sizes", pa.binary())]
)


def _training(row: dict) -> np.ndarray:
    """Which texts of a block are learned from."""
    return ~np.array(row["held"].as_py(), bool)


def count_tokens(held: DataFrame, n_buckets: int) -> DataFrame:
    """What became of each block's question how often its tokens stand in training texts; a block of -1 holds a bucket's tokens."""
    kind = arrow_schema("bucket long, block long, blob binary")

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        reader = Reader.opened(row)
        count = np.bincount(reader.at, np.repeat(_training(row), reader.sizes), len(reader.distinct)).astype("<i8")
        own = reader.buckets(n_buckets)
        cut = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
            blob = (b - a).to_bytes(8, "little") + planes(count[a:b]) + b"\n".join(reader.distinct[a:b])
            yield pa.RecordBatch.from_pydict({"bucket": [int(own[a])], "block": [row["block"].as_py()], "blob": [blob]}, schema=kind)

    def settle(groups: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        for bucket, held in groups:
            sizes = [int.from_bytes(blob[:8], "little") for _, blob in held]
            flat = pa.array([b"\n".join(blob[8 + 8 * k :] for k, (_, blob) in zip(sizes, held, strict=True))], pa.large_binary())
            coded = pc.list_flatten(pc.split_pattern(flat, b"\n")).dictionary_encode()  # each distinct token by number
            at = coded.indices.to_numpy()
            count = np.concatenate([from_planes(blob, "<i8", k, 8) for k, (_, blob) in zip(sizes, held, strict=True)])
            total = np.zeros(len(coded.dictionary), "<i8")
            np.add.at(total, at, count)
            back, ends = total[at], np.cumsum(sizes)
            for (block, _), k, end in zip(held, sizes, ends.tolist(), strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [block], "blob": [planes(back[end - k : end])]}, schema=kind)
            known = np.flatnonzero(total)
            if len(known):
                own = len(known).to_bytes(8, "little") + planes(total[known]) + b"\n".join(coded.dictionary.take(pa.array(known)).to_pylist())
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [-1], "blob": [own]}, schema=kind)

    return answered(held, ask, settle, "tokens", n_buckets)


def _head(counted: DataFrame, head: int) -> tuple[int, int, list[tuple[bytes, int]]]:
    """All training tokens, distinct ones, and the head most frequent with their counts."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in column(batch, "blob"):
                k = int.from_bytes(blob[:8], "little")
                count, names = from_planes(blob, "<i8", k, 8), blob[8 + 8 * k :].split(b"\n")
                best = np.argsort(-count, kind="stable")
                least = count[best[min(head, k) - 1]]
                best = best[count[best] >= least].tolist()
                n = len(best)
                yield pa.RecordBatch.from_pydict({"token": [names[i] for i in best], "c": count[best], "n": [int(count.sum())] + [0] * (n - 1), "v": [k] + [0] * (n - 1)}, schema=arrow_schema("token binary, c long, n long, v long"))

    rows = counted.where("block = -1").select("blob").mapInArrow(tops, "token binary, c long, n long, v long")
    stat = rows.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    top = rows.orderBy(F.desc("c"), "token").limit(head).collect()  # at most head rows
    return stat["n"] or 0, stat["v"] or 0, [(bytes(r["token"]), r["c"]) for r in top]


def followers(code: Code, size: np.ndarray, low: np.ndarray, name: np.ndarray, count: np.ndarray, at_a_time: int = SLICE) -> tuple:
    """What followed each pair, of some blocks' messages one after another: `size` numbers each, pairs ascending in each.
    Returns where each block's pairs begin and end; of each pair the most frequent follower, how often it came and how often
    any did, both scaled to a byte; and the sum of _seen() over all. About `at_a_time` numbers are sorted at a time."""
    came = np.zeros(2 * _LEVELS * _DEPTHS + 2 * _LEVELS, np.int64)
    new = np.concatenate(([True], low[1:] != low[:-1]))
    new[(np.cumsum(size) - size)[size > 0]] = True
    lead = np.flatnonzero(new)
    mine = np.add.reduceat(count, lead)  # a block's own times of a pair
    number = np.cumsum(new, dtype=np.int32) - 1
    best, few, every = np.zeros(len(lead), "<u4"), np.zeros(len(lead), "u1"), np.zeros(len(lead), "u1")
    n_slices = -(-len(low) // at_a_time)
    for k in range(n_slices):
        own = np.flatnonzero((low >= np.uint32((k << 32) // n_slices)) & (low <= np.uint32((k + 1 << 32) // n_slices - 1)))
        both, at = np.unique(low[own].astype(_U) << _U(32) | name[own], return_inverse=True)
        total = np.bincount(at, count[own], len(both)).astype(np.int64)
        pair, name_ = both >> _U(32), both.astype("<u4")
        parted = np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)]
        first, which = np.flatnonzero(parted), np.cumsum(parted) - 1
        top, n_all = (f.reduceat(total, first) if len(first) else first for f in (np.maximum, np.add))
        tops = np.flatnonzero(total == top[which])  # of equal ones the smallest name
        m = name_[tops[np.diff(which[tops], prepend=-1) > 0]]
        scale = np.maximum(n_all / 255, 1)
        c, n_ = (np.where(n_all > 1, np.rint(v / scale), 0).astype("u1") for v in (top, n_all))
        m_ = np.where(c > 0, m, 0).astype("<u4")
        came += _seen(code, name_, total, _guess(name_, (m_[which], c[which], n_[which]), total > 0, len(code.ids)))
        heads = own[new[own]]
        q, to = which[at[new[own]]], number[heads]
        rest = (n_all[q] > mine[to]) | (n_all[q] > 1)  # else no other block knows the pair
        few[to], every[to] = np.where(rest, np.rint(top[q] / scale[q]), 0), np.where(rest, np.rint(n_all[q] / scale[q]), 0)
        best[to] = np.where(few[to] > 0, m[q], 0)
    ends = [0, *np.searchsorted(lead, np.cumsum(size)).tolist()]
    return ends, best, few, every, came


def _ranked(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ascending, and which one stands at each place."""
    low = len(pair).bit_length()
    if not len(pair) or int(pair.max()).bit_length() + low > 64:
        return np.unique(pair, return_inverse=True)
    key = pair << _U(low)
    key |= np.arange(len(pair), dtype=_U)
    key.sort()  # numbers that hold their places sort faster than places do
    at = (key & _U((1 << low) - 1)).astype(np.intp)
    key >>= _U(low)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(len(pair), np.intp)
    rank[at] = np.cumsum(new) - 1
    return key[new], rank


def _followed(pair: np.ndarray, name: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct pairs and names, ascending, and how often each stands in texts that are learned from."""
    pairs, rank = _ranked(pair)
    key = np.sort(rank.astype(_U) << _U(33) | name.astype(_U) << _U(1) | learn.astype(_U))  # under 2^31 tokens
    both = key >> _U(1)
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))  # every text has its end token
    count = np.add.reduceat((key & _U(1)).astype("<u4"), new)
    return pairs[(both[new] >> _U(32)).astype(np.int64)], [(both[new] & _U(0xFFFFFFFF)).astype("<u4"), count]


def gather(held: DataFrame, code: Code, n_buckets: int) -> DataFrame:
    """Answers what followed each block's pairs of tokens in training texts; buckets below 0 hold sums of slots, and blocks
    of _SEEN_BLOCK those of what came of the predictions. Tasks sum the tables over their blocks; a block sends its
    distinct pairs with what followed. A bucket is held as flat numbers, of which a slice is sorted at a time."""
    spark = session(held)
    own_code = Shared(spark, code)  # of the head's size
    n = min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = 1 << code.bits
    width = min(_CHUNK, 2 * slots)
    kind = arrow_schema("bucket long, block long, blob binary")
    names = held.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = own_code.value
        sums = [np.zeros(2 * slots, np.uint32) for _ in range(TABLES)]
        stood: list[list[np.ndarray]] = []  # of some blocks: each token with its contexts

        def count() -> None:
            for c, total in enumerate(sums if stood else ()):
                code.add(total, c, np.concatenate([x[c] for x in stood]))
            stood.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k] for j, c in enumerate(names)}
                reader = Reader.opened(row)
                own = reader.ids(code)
                learn = np.repeat(_training(row), reader.sizes)
                pair, name = reader.pairs(own, len(code.ids))
                pair = place(pair, n_buckets)
                yield messages(row["block"].as_py(), *_followed(pair, name, learn))
                ids = own[reader.at]
                stood.append([ids[learn] * np.int32(n_kinds) + c[learn].astype(np.int32) for c, n_kinds in zip(code.before(ids, reader.first), _KINDS, strict=True)])
                if sum(len(x[0]) for x in stood) > MANY:
                    count()
        count()
        for c, total in enumerate(sums):
            for k, piece in enumerate(total.reshape(-1, width)):
                if piece.any():
                    yield pa.RecordBatch.from_pydict({"bucket": [-1 - (c << 32 | k)], "block": [-1], "blob": [planes(piece.astype("<u4"))]}, schema=kind)

    def settle(groups: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        code, came = own_code.value, 0
        for bucket, held in groups:
            if bucket < 0:
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [-1], "blob": [planes(held[0][1])]}, schema=kind)
                continue
            blocks_, parts = [], []
            while held:  # frees each message once it is opened
                block, blob = held.pop()
                blocks_.append(block)
                parts.append(open_message(blob, ["<u4", "<u4"]))
            del blob
            size = np.array([len(p[0]) for p in parts])
            low, name, count = (np.concatenate([p.pop(0) for p in parts]) for _ in range(3))
            del parts
            ends, best, few, every, own = followers(code, size, low, name, count)
            came = came + own
            for block, a, b in zip(blocks_, ends[:-1], ends[1:], strict=True):
                blob = b"".join(((b - a).to_bytes(8, "little"), planes(best[a:b]), planes(few[a:b]), planes(every[a:b])))
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [block], "blob": [blob]}, schema=kind)
        if not isinstance(came, int):
            yield pa.RecordBatch.from_pydict({"bucket": [0], "block": [_SEEN_BLOCK], "blob": [came.astype("<i8").tobytes()]}, schema=kind)

    def add(total: np.ndarray | None, blob: bytes) -> np.ndarray:
        piece = from_planes(blob, "<u4", width).astype(np.int64)
        return piece if total is None else total + piece

    sent = held.mapInArrow(send, "bucket long, block long, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return save(sent.mapInArrow(lambda b: settle(by_bucket(b, add)), "bucket long, block long, blob binary"), "pairs")


def _asked(blobs: list[bytes] | None, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted names, times and times of any, for each place with its pair."""
    parts: tuple[list, list, list] = ([], [], [])
    for blob in blobs or ():
        n = int.from_bytes(blob[:8], "little")
        for part, kind, at in zip(parts, ("<u4", "u1", "u1"), (8, 8 + 4 * n, 8 + 5 * n), strict=True):
            part.append(from_planes(blob, kind, n, at))
    if not parts[0]:
        return np.empty(0, "<u4"), np.empty(0, "u1"), np.empty(0, "u1")
    at = _ranked(pair)[1]
    return tuple(np.concatenate(p)[at] for p in parts)


def learned(held: DataFrame, pairs: DataFrame, code: Code, counts: list[np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the decisions of all training texts, ascending, and how many each has."""
    spark = session(held)
    own = Shared(spark, (code, [_relieved(x) for x in counts]))  # of the head's and the tables' size
    n_cells = _CLASSES * (4 * _CELLS) ** TABLES * _CELLS * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, relieved = own.value
        other, total = len(code.ids), np.zeros(n_cells, np.uint32)  # zeros that are never touched take no memory
        keys: list[np.ndarray] = []  # of some blocks

        def count() -> None:
            for cell, times in cells(code, relieved, np.concatenate(keys)) if keys else ():
                np.add.at(total, cell, times)
            keys.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
                reader = Reader.opened(row)
                learn = np.repeat(_training(row), reader.sizes)
                own_ids = reader.ids(code)
                ids = own_ids[reader.at]
                pair, name = reader.pairs(own_ids, other)
                guess = _guess(name, _asked(row["answers0"].as_py(), place(pair, n_buckets)), learn, other)
                before = code.before(ids, reader.first)
                keys.append(alike(code, ids[learn], [c[learn] for c in before], (guess[0][learn], guess[1][learn])))
                if sum(map(len, keys)) > MANY:
                    count()
        count()
        found = np.flatnonzero(total)
        for a in range(0, len(found), _CHUNK):
            yield pa.RecordBatch.from_pydict({"cell": found[a : a + _CHUNK], "n": total[found[a : a + _CHUNK]].astype(np.int64)}, schema=arrow_schema("cell long, n long"))

    asked = with_answers(held.select("block", "held", "names", "at", "sizes"), pairs.where("bucket >= 0 and block >= 0"))
    table = asked.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # n_cells rows at most
    key, n = (table.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(key)
    return key[order], n[order]


def scores(docs: DataFrame, folds: int = 10, head: int = HEAD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out (crc32 of doc_id modulo folds is 0), n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte.

    base_score is the log10 probability under smoothed training frequencies, score that under the mixing model.
    Training texts are those not held out. Null and empty texts hold the end token alone. Rows that repeat an
    id are scored, and learned from, each; a null id counts as the empty text for crc32. Extra columns play no part.
    """
    spark = session(docs)
    with dropped_shuffles(spark):
        rows = texts(docs).withColumn("held", remainder(folds) == 0)
        held = blocks(rows, {"doc_id": "bigint", "held": "boolean", "text": "string"}, size=BLOCK, made=_read, ddl=_BLOCK_DDL)
        size = held.agg(F.sum(F.expr("aggregate(n_bytes, 0L, (n, x) -> n + x)"))).first()[0] or 0
        n_buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
        counted = count_tokens(held, n_buckets)
        n, v, top = _head(counted, head)
        rest, rest_types = n - sum(c for _, c in top), v - len(top)
        code = Code.build(top, rest + 0.1)
        pairs = gather(held, code, n_buckets)
        counts = [np.zeros((1 << code.bits, 2), np.int64) for _ in range(TABLES)]
        for r in pairs.where("bucket < 0").toLocalIterator():  # tables of fixed size
            part = -1 - r["bucket"]
            x = np.ascontiguousarray(np.frombuffer(r["blob"], np.uint8).reshape(8, -1).T).view("<i8").reshape(-1, 2)
            low = (part & 0xFFFFFFFF) * len(x)
            counts[part >> 32][low : low + len(x)] = x
        seen = sum(np.frombuffer(r["blob"], "<i8") for r in pairs.where(f"block = {_SEEN_BLOCK}").toLocalIterator())  # one small row a task
        model = fit(code, counts, seen, learned(held, pairs, code, counts, n_buckets))
        del counts
    used = Shared(spark, model)  # of the head's and the tables' size
    all_mass, other_mass = math.log10(n + 0.1 * (v + 1)), math.log10(rest + 0.1 * (rest_types + 1))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = used.value
        code, other = model.code, len(model.code.ids)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}
                reader, training = Reader.opened(row), _training(row)
                count = read(row["answers0"].as_py(), "<i8")
                logs, known = np.log10(count + 0.1), count > 0
                own = reader.ids(code)
                ids = own[reader.at]
                pair, name = reader.pairs(own, other)
                guess = _guess(name, _asked(row["answers1"].as_py(), place(pair, n_buckets)), np.repeat(training, reader.sizes), other)
                contexts = code.contexts(ids, reader.first)
                coded = np.empty(len(training))
                for some in reader.parts(PART):
                    sizes = reader.sizes[some]
                    begin = np.cumsum(sizes) - sizes
                    at = np.repeat(reader.first[some] - begin, sizes) + np.arange(sizes.sum())
                    part = ids[at], [c[at] for c in contexts], tuple(x[at] for x in guess[:3])
                    if len(some) == 1:
                        coded[some] = model.score_long(*part)
                    else:
                        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(code.size[part[0]], begin, dtype=np.int64))))
                        coded[some] = model.score(*model.inputs(*part), ends)
                coded /= math.log(10)
                tail = ids == other
                asked = tail & (guess[0] == other) & (guess[1] > 0)
                odds = model.same[guess[1][asked]].astype(np.float64)
                own_logs = logs[reader.at]
                rare = np.where(tail & ~(asked & guess[3]), own_logs - other_mass, 0.0)
                rare[asked] -= np.log1p(np.exp(np.where(guess[3][asked], -odds, odds))) / math.log(10)
                of = lambda z: np.add.reduceat(z, reader.first)  # noqa: E731  every text has its end token
                n_bytes = np.array(row["n_bytes"].as_py(), np.int64)
                score = coded + of(rare)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": row["doc_id"].as_py(), "held_out": ~training, "n_tokens": reader.sizes, "n_known": of(known[reader.at].astype(np.int64)), "train_tokens": np.full(len(training), n),
                        "base_score": of(own_logs) - reader.sizes * all_mass, "score": score, "n_bytes": n_bytes, "bits_per_byte": -score * math.log2(10) / np.maximum(n_bytes, 1),
                    },
                    schema=arrow_schema(ddl),
                )

    return with_answers(held, counted, pairs.where("bucket >= 0")).mapInArrow(run, ddl)
