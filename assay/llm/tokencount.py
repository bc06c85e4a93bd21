"""Token counts of sections, attributed by character offsets.

A whole document is encoded once. Each token covers a span of the text's bytes; each section (a field, a line, a
paragraph) covers another; the two sorted lists of spans are interval-joined. A token that crosses sections
goes by an explicit rule:

* `first`: to the section that holds its first byte;
* `last`: to the section that holds its last byte;
* `most`: to the section that holds most of its bytes, the earlier one on a tie.

Each token is given to exactly one section, so a document's sections sum to its tokens. A separator belongs to the
section it ends. The vocabulary is a file of ranks, named by a parameter and read by each worker; nothing is
trained and nothing is copied.

Null or empty text: one empty section without tokens. Repeated rows each give their own rows. Very long texts are
encoded whole; a run of white space that the pattern's engine cannot hold is encoded as the one piece that the pattern
makes of it. Rows go out a bounded number at a time, however many lines a document has. Extra columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import aliased
from assay.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The fixed splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
#: White space of the pattern (\\s of its engine). Runs this long are encoded apart.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 10_000
#: Section rows in one batch.
OUT_ROWS = 20_000


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the byte length of each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lens[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lens


def encode(encoding: tiktoken.Encoding, text: str, long_run: int = LONG_RUN) -> list[int]:
    """The tokens of a text; those of the encoding itself, but a run of white space of any length is no burden.

    The pattern's engine keeps a state for each character of a run of white space. A run before other text is one
    piece without its last character, which goes with what follows; a run at the end is one piece. No other piece
    reaches over the start of a run, so the text may be cut there.
    """
    out, at = [], 0
    for run in re.finditer(f"[{SPACES}]{{{long_run},}}", text):
        stop = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        if run.start() < stop:
            out += encoding._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def line_starts(raw: bytes) -> np.ndarray:
    """Start offsets of the lines; a newline belongs to the line it ends."""
    return np.r_[0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1]


def attribute(lens: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, given the tokens' byte lengths and the sections' starts."""
    stop = np.cumsum(lens)
    begin = stop - lens
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, stop - 1, "right") - 1
    to = {"first": first, "last": last}.get(rule, first).copy()
    crossing = first != last
    if rule == "most":
        edges = np.r_[starts, size]
        for i in np.flatnonzero(crossing):  # few: only tokens over a section's end
            own = np.arange(first[i], last[i] + 1)
            share = np.minimum(edges[own + 1], stop[i]) - np.maximum(edges[own], begin[i])
            to[i] = own[np.argmax(share)]
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def section_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each line of each document: key and other columns, section, n_tokens, n_crossing, n_bytes, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    new = ["section", "n_tokens", "n_crossing", "n_bytes", "doc_tokens"]
    others = [c for c in docs.columns if c not in (text, *new)]
    taken, own = aliased(others)
    shape = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(own, others, strict=True))
    shape += "section int, n_tokens long, n_crossing long, n_bytes long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load(vocabulary)
        for batch in batches:
            rows, parts, held = [], [], 0

            def flush(rows: list, parts: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                take = pa.array(np.concatenate(rows))
                counts = [np.concatenate([p[i] for p in parts]) for i in range(5)]
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in own), *map(pa.array, counts)], [*own, *new])

            for i, x in enumerate(batch.column("__text")):
                t = x.as_py() or ""
                raw = t.encode()
                starts = line_starts(raw)
                lens = sizes[np.array(encode(encoding, t), np.int64)] if raw else np.empty(0, np.int64)
                n, crossing = attribute(lens, starts, len(raw), rule)
                every = (np.arange(len(starts), dtype=np.int32), n, crossing, np.diff(np.r_[starts, len(raw)]), np.full(len(starts), len(lens)))
                for lo in range(0, len(starts), OUT_ROWS):
                    part = tuple(c[lo : lo + OUT_ROWS] for c in every)
                    rows.append(np.full(len(part[0]), i))
                    parts.append(part)
                    held += len(part[0])
                    if held >= OUT_ROWS:
                        yield flush(rows, parts)
                        rows, parts, held = [], [], 0
            if rows:
                yield flush(rows, parts)

    ship(docs.sparkSession)
    return docs.select(*taken, F.col(text).alias("__text")).mapInArrow(run, shape).toDF(*others, *new)
