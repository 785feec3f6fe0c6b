"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

An example has a demand in several dimensions at once (tokens, segments, loss-bearing tokens)
and a sequence a limit in each. A sequence takes, while anything fits, the example whose
demand has the largest dot product with what is left of the limits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import small_batches

GROUP_ROWS = 4096
SPECIAL = "<|endoftext|>"


def place(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each example, turn in it) for whole-number ``demands`` (n x dimensions).

    Dimensions are weighted by their total demand. Examples with equal demands are one class,
    so a step looks at classes. Ties go to the larger demand, then to the earlier example. An
    example above a limit is an error.
    """
    if (demands > limits).any():
        raise ValueError("an example is larger than a sequence")
    kinds, which = np.unique(demands, axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(kinds)))
    next_ = ends - np.bincount(which, minlength=len(kinds))
    share = kinds / np.maximum(limits, 1)
    weights = (demands / np.maximum(limits, 1)).sum(axis=0)
    weights = weights / max(weights.sum(), 1e-12)
    sequence, turn = np.zeros(len(demands), np.int64), np.zeros(len(demands), np.int64)
    left, at, number, placed = limits.astype(float), 0, 0, 0
    while placed < len(demands):
        fits = (next_ < ends) & (kinds <= left).all(axis=1)
        if not fits.any():
            left, at, number = limits.astype(float), 0, number + 1
            continue
        score = np.where(fits, share @ (weights * left / np.maximum(limits, 1)), -1.0)
        best = len(score) - 1 - int(np.argmax(score[::-1]))
        item = order[next_[best]]
        next_[best] += 1
        sequence[item], turn[item] = number, at
        left, at, placed = left - kinds[best], at + 1, placed + 1
    return sequence, turn


def pack(examples: DataFrame, limits: Mapping[str, int], along: str, order: Sequence[str] = (),
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """``examples`` with ``sequence_id`` and ``offset``, the sum of ``along`` before an example
    in its sequence. Columns of these names are replaced.

    ``limits``: demand column -> limit of a sequence. Examples are dealt evenly, by a running
    number and not by a key, to groups of about ``group_rows``; each is packed by one task
    whose memory that bounds, and leaves one sequence part-filled. ``order`` settles the order
    of equal demands. Null demands count as 0. The examples are written once, so their number
    is known and a lost executor repeats no work before this.
    """
    rest = [c for c in examples.columns if c not in ("sequence_id", "offset", "_group")]
    held = cut_lineage(examples.select(rest))
    groups = max(1, -(-held.count() // group_rows))
    dealt = held.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names, tops = list(limits), np.array(list(limits.values()), np.int64)
    by = list(order) or rest[:1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by, kind="stable", ignore_index=True)
        sequence, turn = place(rows[names].fillna(0).to_numpy(np.int64), tops)
        rows["sequence_id"] = rows["_group"] * (1 << 32) + sequence
        by_turn = np.lexsort((turn, sequence))
        steps = rows[along].fillna(0).to_numpy(np.int64)[by_turn]
        before = np.cumsum(steps) - steps
        starts = np.r_[True, np.diff(sequence[by_turn]) > 0] if len(rows) else np.zeros(0, bool)
        before -= np.maximum.accumulate(np.where(starts, before, 0))
        rows["offset"] = 0
        rows.loc[by_turn, "offset"] = before
        return rows

    return dealt.groupBy("_group").applyInPandas(run, schema).drop("_group")


_ENCODING: dict[str, object] = {}


def encoder(path: str):
    """Function text -> ids (uint32) for a byte-level BPE file of the tokenizers library.

    The file is read by ``tokenizers`` and its vocabulary run by ``tiktoken``, whose ids are
    the same at about four times the speed; a text that its pattern engine refuses goes to
    ``tokenizers`` itself. Kept per worker.
    """
    if path not in _ENCODING:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = plain.get_vocab()
        fast = tiktoken.Encoding(
            "byte_bpe", pat_str=PATTERN, special_tokens={SPECIAL: vocabulary[SPECIAL]},
            mergeable_ranks={bytes(byte[c] for c in token): i
                             for token, i in vocabulary.items() if token != SPECIAL})

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special={SPECIAL})
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001  a panic of the pattern engine
                return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODING[path] = encode
    return _ENCODING[path]


def tokenise(docs: DataFrame, text: str, path: str, keep: Sequence[str], end: int = 1,
             limit: int = 2048) -> DataFrame:
    """Pieces of at most ``limit`` ids: the ``keep`` columns, ``start, length, doc_tokens`` and
    ``ids`` (binary, little-endian unsigned 32-bit).

    A document's ids are its text's and then ``end``; null counts as empty. All pieces but the
    last are full. Whole texts, one at a time, in the stage that reads them.
    """
    fields = [docs.schema[c] for c in keep]
    added = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()),
             ("ids", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in added])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)

        def made(batch, picks, starts, lengths, totals, blobs):
            kept = batch.take(pa.array(picks, pa.int32())).columns[:n_keep]
            return pa.RecordBatch.from_arrays(
                [*kept, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(blobs, pa.binary())],
                names=[*batch.schema.names[:n_keep], *[n for n, _ in added]])

        for batch in batches:
            picks, starts, lengths, totals, blobs, size = [], [], [], [], [], 0
            for row, value in enumerate(batch.column(n_keep)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), limit):
                    piece = ids[at:at + limit]
                    picks.append(row), starts.append(at), lengths.append(len(piece))
                    totals.append(len(ids)), blobs.append(piece.tobytes())
                    size += len(piece)
                if size > 1 << 21:
                    yield made(batch, picks, starts, lengths, totals, blobs)
                    picks, starts, lengths, totals, blobs, size = [], [], [], [], [], 0
            if picks:
                yield made(batch, picks, starts, lengths, totals, blobs)

    return small_batches(docs).select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(run, schema)
