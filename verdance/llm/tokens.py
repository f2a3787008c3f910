"""Token counts by offset-mapped attribution.

A document is encoded once as a whole; the tokens' byte lengths give their spans, which an interval join within the document
assigns to its sections. A token that crosses a section boundary goes where the rule says.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The word pattern that the byte-level vocabularies were made with (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RULES = ("start", "end", "most", "share")
_encoders: dict = {}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a vocabulary file of base64 tokens and ranks; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def encoder(tokens: list[bytes]):
    """(encode, token lengths), built once for each vocabulary in a Python worker."""
    key = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).digest()
    if key not in _encoders:
        import tiktoken

        made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        _encoders[key] = made.encode_ordinary, np.array([len(t) for t in tokens], np.int64)
    return _encoders[key]


def lines(text: bytes) -> np.ndarray:
    """Starts of a text's lines and its end, in bytes; a line break belongs to the line that it ends."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    inner = breaks[breaks < len(text)]
    return np.concatenate([[0], inner, [len(text)]]) if text else np.zeros(1, np.int64)


def allocate(edges: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [edges[k], edges[k+1]), and the number of tokens that cross an edge.

    start: to the section of a token's first byte; end: of its last; most: to the section that holds most of its bytes, the
    earlier one of equals; share: to each section the share of the token's bytes that it holds.
    """
    n, starts = len(edges) - 1, np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), len(crossing)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), len(crossing)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for k in crossing:
        over = np.arange(first[k], last[k] + 1)
        held = np.minimum(edges[over + 1], ends[k]) - np.maximum(edges[over], starts[k])
        if rule == "most":
            out[over[held.argmax()]] += 1
        else:
            out[over] += held / (ends[k] - starts[k])
    return out, len(crossing)


def _count(tokens, rule: str, with_sections: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(tokens.value)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            cuts = batch.column(2).to_pylist() if with_sections else None
            total, crossing, sections = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = data[offs[k] : offs[k + 1]]
                if with_sections:
                    at = np.flatnonzero((raw & 0xC0) != 0x80)  # code points' first bytes
                    inner = sorted({int(at[c]) for c in cuts[k] or () if c is not None and 0 < c < len(at)})
                    edges = np.array([0, *inner, len(raw)]) if len(raw) else np.zeros(1, np.int64)
                else:
                    edges = lines(raw.tobytes())
                ends = np.cumsum(lengths[np.array(encode(text or ""), np.int64)])
                each, cross = allocate(edges, ends, rule) if len(ends) else (np.zeros(0), 0)
                total.append(len(ends)), crossing.append(cross), sections.append(each)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sections])]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *sections])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array([len(x) for x in sections], pa.int64()), pa.array(crossing, pa.int64()), flat], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return run


def token_counts(docs: DataFrame, rule: str = "start", sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_sections, n_crossing (tokens across a boundary) and section_tokens, which add up to n_tokens.

    Sections are the text's lines, or lie between the code-point offsets of the array column `sections_col` (null: one
    section; offsets outside the text and repeats are passed over). Null and empty texts have no tokens and no sections. Ids
    may be of any type, null or repeat; each row is counted, its text of any length encoded whole; other columns are ignored,
    and an empty table gives no rows. The vocabulary, of a fixed size, is read by the driver and broadcast.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(os.path.join(tokenizers, vocabulary)))
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(sections_col).cast("array<long>").alias("cuts")] if sections_col else [])]
    rows = docs.select(*columns)
    return rows.mapInArrow(_count(tokens, rule, bool(sections_col)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
