"""Repeated byte strings by prefix-free parsing.

Rolling hashes choose triggers in the text by its content alone: the smallest hash of each window. The text between
the first and the last window that one trigger serves is a phrase; phrases overlap by a window, so the parse of
each document into phrases loses nothing, and equal text gives equal phrases. The distinct phrases are the
dictionary, each with its first place in corpus order (doc_id, then start). The parse is settled first: a phrase
that came before is a repeat as a whole. Then suffixes of the dictionary are compared, each to the length of a
window, once for each distinct phrase however often the corpus repeats it, and only around triggers that several
phrases share; equal suffixes take the earliest of their phrases' first places. Both orders together say for each
window whether it also starts earlier. Order within a class of equal suffixes is all that the question needs, so
classes are sorted by hash, which Spark can deal out, and not by their letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import as_bytes, column
from scholia.llm.repeats import Rule, covered, tagged, with_spans

#: Bytes of a repeated string, and of a trigger.
LENGTH, TRIGGER = 100, 24


def _mapped(docs: DataFrame, length: int, trigger: int, kind: pa.Schema, ddl: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, los, his, data in zip(*(column(batch, c) for c in ("doc_id", "los", "his")), as_bytes(batch), strict=True):
                gone = covered(len(data), los, his)
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes() if los else data
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append(make(doc, len(data), len(data) - len(rest), runs, rest))
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(kind.names)}, schema=kind)

    found = with_spans(tagged(docs), Rule("bytes", length, min(trigger, length), True))
    return found.select("doc_id", "los", "his", "text").mapInArrow(run, ddl)


def report(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed (bytes covered by a string of `length` bytes that also
    starts earlier), n_spans (maximal removed runs), kept_sha256 (of the bytes left).

    A null text counts as empty. Rows without an id come last. Rows that share an id are ordered by a hash of
    their texts; two with the same text stand at one place, so neither is later.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return _mapped(docs, length, trigger, kind, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda doc, n, m, s, rest: (doc, n, m, s, hashlib.sha256(rest).hexdigest()))


def dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(doc_id, text): the bytes left of each row of docs; a cut through a character leaves U+FFFD."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return _mapped(docs, length, trigger, kind, "doc_id long, text string", lambda doc, n, m, s, rest: (doc, rest.decode("utf-8", "replace")))


#: report() for DuckDB: bytes as pairs of hex digits.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
firsts AS (SELECT md5(g) AS g, min((doc_id, i)) AS f FROM starts GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS j FROM starts JOIN firsts ON md5(starts.g) = firsts.g WHERE (doc_id, i) > f),
bytes AS (SELECT doc_id, substr(h, 2 * j + 1, 2) AS x, j FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM d)),
marked AS (
  SELECT bytes.doc_id, x, bytes.j, gone.j IS NOT NULL AS cut, lag(gone.j IS NOT NULL) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.j) AS before
  FROM bytes LEFT JOIN gone ON gone.doc_id = bytes.doc_id AND gone.j = bytes.j),
kept AS (
  SELECT doc_id, string_agg(x, '' ORDER BY j) FILTER (WHERE NOT cut) AS t, count(*) FILTER (WHERE cut) AS n_removed,
         count(*) FILTER (WHERE cut AND NOT coalesce(before, false)) AS n_spans
  FROM marked GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
