"""Exact token counts of whole texts, huge ones included, by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks, each on its own, so no library
call ever holds more than a chunk. A chunk that starts anywhere begins with wrong
pre-tokens, but the pre-tokenizer only looks ahead: from a boundary of the whole text on,
pre-tokens depend on nothing before it. So the boundaries of a chunk are proven up to its
end less MARGIN once one of them is, and a boundary that the proven left chunk and the right
chunk share is proven in the right chunk too. There the two are spliced. If the overlap has
no such boundary (a long run without any), the right chunk starts earlier, twice as far
back each time; when it would start at or before the left chunk's proven part, both become
one chunk. Nothing is guessed at any point.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Characters past the end of a pre-token that can decide it: a contraction or white space
#: look-ahead (3), then a special string that begins there, seen whole.
LOOKAHEAD = 3


class Counter:
    """Counts with the tokenizers library. chunk_chars and overlap_chars bound what is encoded
    at once; batch_chars bounds what one call for many texts gets."""

    def __init__(self, path: str, chunk_chars: int = 16_384, overlap_chars: int = 256, batch_chars: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.margin = LOOKAHEAD + max([0, *(len(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        self.chunk, self.overlap, self.batch = chunk_chars, overlap_chars, batch_chars
        self.widened = 0

    def encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    @staticmethod
    def boundaries(encoding, base: int, low: int, high: int) -> dict[int, int]:
        """Starts of pre-tokens in [low, high) of the whole text -> tokens of the chunk before
        them. A start counts only where all before it in the text lies before it in the chunk."""
        out, last = {}, None
        for k, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
            if word != last:
                last = word
                if low <= base + at < high:
                    out[base + at] = k
        return out

    def count_huge(self, text: str) -> int:
        n, step = len(text), self.chunk - self.overlap
        # [at, end) has been encoded as `left`; from `proven` on its boundaries are the text's,
        # and `skip` of its tokens lie before proven.
        at, end = 0, min(n, self.chunk)
        left, skip, proven, total = self.encode(text[at:end]), 0, 0, 0
        while end < n:
            back = self.overlap
            while True:
                begin = end - back
                if begin <= proven:  # no common boundary in all that is proven: one longer chunk
                    at, end = proven, min(n, end + max(step, end - proven))
                    left, skip = self.encode(text[at:end]), 0
                    break
                stop = min(n, end + step)
                right = self.encode(text[begin:stop])
                ours = self.boundaries(left, at, begin, end - self.margin)
                theirs = self.boundaries(right, begin, begin + 1, end - self.margin)
                common = [p for p in ours if p in theirs and p > proven]
                if common:
                    p = common[-1]
                    total += ours[p] - skip
                    at, end, left, skip, proven = begin, stop, right, theirs[p], p
                    break
                self.widened += 1
                back *= 2
        return total + len(left) - skip

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        held: list[int] = []
        size = 0

        def flush():
            for k, e in zip(held, self.tok.encode_batch_fast([texts[k] for k in held], add_special_tokens=False), strict=True):
                out[k] = len(e)
            held.clear()

        for k, text in enumerate(texts):
            if len(text) > self.chunk:
                out[k] = self.count_huge(text)
            elif text:
                held.append(k)
                size += len(text)
                if size >= self.batch:
                    flush()
                    size = 0
        flush()
        return out


@lru_cache(maxsize=4)
def counter_of(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    """One for each worker process: reused workers don't load the file again."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Counter(path, chunk_chars, overlap_chars)


def count_tokens(
    df: DataFrame,
    path: str,
    limit: int = 1024,
    text_col: str = "text",
    keep: list[str] | None = None,
    chunk_chars: int = 16_384,
    overlap_chars: int = 256,
) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row.

    A null text counts as empty: 0, 0, false. Texts of any length are counted whole. Rows are
    independent, so repeated rows and ties give equal counts and an empty table gives an empty
    one. Input columns with the names of the new ones (in any case) are replaced.
    """

    def make():
        counter = counter_of(path, chunk_chars, overlap_chars)

        def run(cols):
            got = pa.array(counter.count([t or "" for t in cols[0].to_pylist()]), pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(cols[0]), pa.int64()), 0)
            return [size, got, pc.greater(got, limit)]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(df, make, [text_col], fields, keep)
