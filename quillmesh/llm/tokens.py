"""Token counts by offset-mapped attribution.

A document's fields or sections are spans of one whole text, which is encoded once. Each token covers a span of
its bytes; token spans are interval-joined to the section spans, and tokens that cross a boundary are
allocated by an explicit rule:

- ``start``: all of the token to the section that holds its first byte;
- ``majority``: all of it to the section that holds most of its bytes, the earlier of two that hold as many;
- ``split``: to each section the share of its bytes that lie in it.

The section spans partition the text (a separator belongs to the section before it), so by any rule the
sections' counts sum to the document's count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "majority", "split")


class Encoder:
    """A byte-pair encoder with the byte length of every token."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte where each token of the text ends."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and the number of crossing tokens. ``ends``: the tokens' byte ends; ``cuts``: the
    sections' byte ends, the last one the text's. Empty sections get nothing."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(cuts, starts, "right")
    last = np.searchsorted(cuts, ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    n = len(cuts)
    if rule == "start" or not len(crossing):
        return np.bincount(first, minlength=n).astype(np.float64), len(crossing)
    counts = np.bincount(np.delete(first, crossing), minlength=n).astype(np.float64)
    for t in crossing.tolist():
        a, b = int(first[t]), int(last[t])
        inside = np.diff(np.clip(np.concatenate(([starts[t]], cuts[a : b + 1])), starts[t], ends[t]))
        if rule == "majority":
            counts[a + int(inside.argmax())] += 1
        else:
            counts[a : b + 1] += inside / (ends[t] - starts[t])
    return counts, len(crossing)


def line_cuts(text: str) -> np.ndarray:
    """Byte ends of the text's lines, each with its line end; none for an empty text."""
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = np.flatnonzero(data == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(data) or not len(data) else np.append(cuts, len(data))


def count(text: str, cuts: np.ndarray, own: Encoder, rule: str) -> tuple[int, np.ndarray, int]:
    ends = own.ends(text)
    counts, crossing = attribute(ends, cuts, rule) if len(cuts) else (np.zeros(0), 0)
    return len(ends), counts, crossing


OUT = "n_tokens long, n_sections long, section_tokens array<double>, crossing long"


def run_over(slim: DataFrame, id_col: str, id_type: str, fields: bool, sep: str, rule: str, vocabulary: str, pattern: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        shared = slim.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            rows = []
            for cells in zip(*(batch.column(k) for k in range(1, batch.num_columns))):
                texts = [c.as_py() or "" for c in cells]
                if fields:
                    parts = [t + sep * (k + 1 < len(texts)) for k, t in enumerate(texts)]
                    found = count("".join(parts), np.cumsum([len(p.encode()) for p in parts]), own, rule)
                else:
                    found = count(texts[0], line_cuts(texts[0]), own, rule)
                rows.append(found)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "n_sections", "section_tokens", "crossing"])

    return slim.mapInArrow(run, f"`{id_col}` {id_type}, {OUT}")


def count_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Per row ``id_col``, ``n_tokens`` of the whole text, ``n_sections`` (its lines), ``section_tokens`` (tokens
    of each line in order) and ``crossing`` (tokens over a boundary).

    Null and empty texts have no tokens and no sections. Rows stay one to one, repeats too; columns that are
    not named are not looked at. An empty table gives an empty result."""
    slim = docs.select(id_col, F.col(text_col).cast("string"))
    return run_over(slim, id_col, docs.schema[id_col].dataType.simpleString(), False, "", rule, vocabulary, pattern)


def count_fields(docs: DataFrame, fields: list[str], id_col: str = "doc_id", sep: str = "\n", rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """As :func:`count_lines` for several columns, joined by ``sep`` in the order given and encoded as one
    text; ``section_tokens`` has a place for each field.

    A null field is empty, and empty fields have no tokens but the separator after them; rows stay one to one, repeats
    too; columns that are not named are not looked at; an empty table gives an empty result."""
    slim = docs.select(F.col(id_col), *[F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)])
    return run_over(slim, id_col, docs.schema[id_col].dataType.simpleString(), True, sep, rule, vocabulary, pattern)
