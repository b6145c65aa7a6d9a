"""Token counts of whole texts, huge ones by overlap resynchronisation.

A long text is cut into chunks that overlap. Each chunk is encoded with offsets. Two neighbours are spliced at a
common boundary in their overlap: a position at white space that no token of either straddles, and from which on
both give the same tokens up to the end of the overlap. Such a boundary is stable: the vocabulary's
pre-tokeniser drops white space and joins nothing across it, its normaliser works on what lies between, and no
special string holds any; so what stands before the boundary and what stands after are encoded alike with or
without the other side. Text without white space is spliced between two letters which no token of the vocabulary
holds side by side: no merge can ever cross there, so each side merges as it would alone. Where an overlap holds no
such boundary it is widened, up to the whole left chunk; if that has none either, the next chunk is as long as what
is left open, so the work stays in proportion to the text.
A text of one chunk is the sum of its parts between white space, and a part seen before is not encoded again. What lies
between a chunk's overlaps is counted so too, where it begins and ends at white space: only overlaps need their tokens.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import column, session, texts

#: Code points of a chunk and of the overlap of two chunks at first.
CHUNK, OVERLAP = 20_000, 400
#: What every vocabulary takes for white space, and so parts may be split at.
BLANK = " \t\n\r"
#: Parts remembered by one worker, and the longest that are.
MEMORY, PART = 800_000, 64
#: Token counts above this are over the limit.
LIMIT = 2048


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next unused one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class Counter:
    """Counts with one tokeniser; made once in each worker."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.blank = re.compile(f"[{BLANK}]+")
        self.known: dict[str, int] = {}
        vocabulary = json.loads(spec)["model"]["vocab"]
        self.joined = {t[i : i + 2] for t in vocabulary for i in range(len(t) - 1)}
        self.letters = _byte_letters()
        self.parted: dict[str, bool] = {}

    def apart(self, two: str) -> bool:
        """Two letters that stand for themselves after the normaliser, and that no token holds side by side."""
        if len(self.parted) > MEMORY:
            self.parted.clear()
        if two not in self.parted:
            plain = all(unicodedata.category(x) in ("Ll", "Lo") and x.lower() == x and unicodedata.is_normalized("NFC", x) for x in two)
            jamo = "\u1100" <= two[1] <= "\u11ff" or "\ud7b0" <= two[1] <= "\ud7ff"  # these join the letter before
            self.parted[two] = plain and not jamo and self.letters[two[0].encode()[-1]] + self.letters[two[1].encode()[0]] not in self.joined
        return self.parted[two]

    def tokens(self, text: str, at: int) -> tuple[list[int], list[int], list[int]]:
        """Starts and ends (in the whole text, whose part from `at` on this is) and ids of a part's tokens."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [a + at for a, _ in e.offsets], [b + at for _, b in e.offsets], e.ids

    def thin(self, text: str, at: int, head: int, stop: int) -> tuple[list[int], list[int], list[int], int]:
        """tokens() of the chunk from `at` to `stop`, but for those between its overlaps (with the chunk before up to `head`, with the
        one after), of which there is only the number, last; and where they end, so from where on the tokens are whole again."""
        a = self.blank.search(text, head, stop)
        b = -1 if not a else stop if stop == len(text) else max(text.rfind(x, a.start(), max(a.start(), stop - self.overlap)) for x in BLANK)
        if b < 0:
            return *self.tokens(text[at:stop], at), 0, at
        own = self.tokens(text[at : a.start()], at), self.tokens(text[b:stop], b)
        return *(x + y for x, y in zip(*own, strict=True)), self.short([text[a.start() : b]])[0], b

    def boundary(self, text: str, low: int, high: int, left, right) -> int | None:
        """A stable common boundary in [low, high), the nearest to the middle from the left on, or None."""
        middle = (low + high) // 2
        for b in sorted(range(low + 1, high - 1), key=lambda x: (x < middle, abs(x - middle))):
            if text[b] not in BLANK:
                if self.apart(text[b - 1 : b + 1]):
                    at = [(bisect_left(starts, b), starts, ends) for starts, ends, _ in (left, right)]
                    if all(0 < i < len(starts) and starts[i] == b and ends[i - 1] <= b for i, starts, ends in at):
                        return b
                continue
            parts = []
            for starts, ends, ids in (left, right):
                i = bisect_left(starts, b)
                if i and ends[i - 1] > b:
                    break
                parts.append([(s, t) for s, e, t in zip(starts[i : i + 200], ends[i : i + 200], ids[i : i + 200], strict=True) if e < high])
            if len(parts) == 2:
                n = min(map(len, parts)) if max(map(len, parts)) >= 200 else max(map(len, parts))
                if parts[0][:n] == parts[1][:n]:
                    return b
        return None

    def long(self, text: str) -> int:
        """Tokens of a text by chunks."""
        total, at, step = 0, 0, self.chunk
        end = min(len(text), self.chunk)
        left, done = self.thin(text, 0, 0, end), 0  # done: where the counted tokens end
        while end < len(text):
            wide = self.overlap
            while True:
                low = max(at, end - wide)
                stop = min(len(text), end + step)
                if low < left[4]:
                    left = *self.tokens(text[at:end], at), 0, at
                right = self.thin(text, low, end, stop)
                b = self.boundary(text, max(low, done), end, left[:3], right[:3])
                if b is not None or low <= at:
                    break
                wide *= 4
            if b is None:  # no boundary in all of the left chunk: encode both as one
                left, end = (*self.tokens(text[at:stop], at), 0, at), stop
                step = max(step, end - at)
                continue
            step = self.chunk
            total += bisect_left(left[0], b) - bisect_left(left[0], done) + left[3]
            left, at, done, end = right, low, b, stop
        return total + len(left[0]) - bisect_left(left[0], done) + left[3]

    def short(self, batch: list[str]) -> list[int]:
        """Tokens of texts of at most a chunk each."""
        parts = [self.blank.split(x) for x in batch]
        fresh = list({p for own in parts for p in own if p not in self.known})
        found = {p: len(e) for p, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        if len(self.known) > MEMORY:
            found |= {p: self.known[p] for own in parts for p in own if p in self.known}
            self.known.clear()
        self.known.update(found)
        out = [sum(map(self.known.__getitem__, own)) for own in parts]
        for p in fresh:
            if len(p) > PART:
                del self.known[p]
        return out

    def count(self, batch: list[str]) -> list[int]:
        out = [0] * len(batch)
        short = [i for i, x in enumerate(batch) if len(x) <= self.chunk]
        for i, n in zip(short, self.short([batch[i] for i in short]), strict=True):
            out[i] = n
        for i, x in enumerate(batch):
            if len(x) > self.chunk:
                out[i] = self.long(x)
        return out


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).
    A null text counts as empty. Special strings inside texts are handled as the library does by default."""
    with open(tokenizer_file, encoding="utf-8") as f:
        held = session(docs).sparkContext.broadcast({"spec": f.read()})  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value  # stays with a worker from one task to the next
        if "counter" not in own:
            own["counter"] = Counter(own["spec"], chunk, overlap)
        counter = own["counter"]
        for batch in batches:
            rows = [x or "" for x in column(batch, "text")]
            n = counter.count(rows)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": column(batch, "doc_id"), "n_bytes": [len(x.encode()) for x in rows], "n_tokens": n, "over_limit": [x > limit for x in n]},
                schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]),
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
