"""Substring dedup, seed and extend: documents join on winnowed word anchors, anchors extend to both sides, and maximal
repeats of at least the threshold go, wherever they stand. repeats.py says how the joins stay linear."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import as_bytes, column
from scholia.llm.repeats import Rule, covered, tagged, with_spans, word_bounds

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 35, 8


def _kept(data: bytes, los, his) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by a space."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(raw)
    gone = covered(len(starts), los, his)
    rest = ~gone
    return len(starts), int(gone.sum()), b" ".join(data[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True))


def _mapped(docs: DataFrame, window: int, anchor: int, kind: pa.Schema, ddl: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(doc, *_kept(data, los, his)) for doc, los, his, data in zip(*(column(batch, c) for c in ("doc_id", "los", "his")), as_bytes(batch), strict=True)]
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(kind.names)}, schema=kind)

    found = with_spans(tagged(docs), Rule("words", window, min(anchor, window), False))
    return found.select("doc_id", "los", "his", "text").mapInArrow(run, ddl)


def report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed (words covered by a window whose words also start
    anywhere else, the same document included), kept_sha256 (of the words left, joined by a space).

    Null and empty texts have no words. Rows that repeat an id are separate documents, and so repeat one another.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return _mapped(docs, window, anchor, kind, "doc_id long, n_words long, n_removed long, kept_sha256 string", lambda doc, n, m, rest: (doc, n, m, hashlib.sha256(rest).hexdigest()))


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text): the words left of each row of docs, joined by a space."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return _mapped(docs, window, anchor, kind, "doc_id long, text string", lambda doc, n, m, rest: (doc, rest.decode()))


#: report() for DuckDB.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM starts GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM starts SEMI JOIN twice USING (g)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS t, count(gone.j) AS n_removed
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
