"""Byte-level BPE by walking the trie of distinct words.

The encoding of a prefix is fixed by its last token alone: strip that token and what
remains is the encoding of a shorter prefix. So one token is stored for each trie node,
found from the states above it, and words that share a prefix share the work.

A token t may end a prefix exactly if t follows the last token of the rest *compatibly*:
merging by rank never joins anything across the seam before both sides are complete.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

# The public pre-tokenization pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> dict[str, int]:
    """The character by which each byte is written in vocabulary files: itself if it is
    visible Latin-1, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_supported(spec: dict) -> None:
    """Raises ValueError if a vocabulary file (tokenizers JSON) asks for anything that Codec doesn't do."""
    model, before, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    asked = {
        "model": model.get("type") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True),
        "decoder": decoder.get("type") != "ByteLevel",
        **{k: bool(model.get(k)) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        **{f"added token with {k}": any(t.get(k) for t in spec.get("added_tokens", [])) for k in ("lstrip", "rstrip", "single_word", "normalized")},
    }
    if other := [k for k, v in asked.items() if v]:
        raise ValueError(f"the vocabulary file asks for what this codec doesn't do: {', '.join(other)}")


class Codec:
    """Encodes and decodes as the vocabulary file (tokenizers JSON) says.

    Ids of words are kept in two generations: words met once (young), and words met in two
    batches or more (cache). cache_words and young_words bound them, most_seams the verdicts on
    pairs of tokens; one that is full is emptied, so memory is bounded whatever the texts hold. Words over longest_cached characters aren't kept.
    """

    def __init__(self, path: str, cache_words: int = 200_000, young_words: int = 60_000, longest_cached: int = 64, most_seams: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        to_byte = printable_bytes()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.vocab = {raw(s): i for s, i in vocab.items() if all(c in to_byte for c in s)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.text_of = [str(i) for i in range(size)]
        # rank of the merge that makes a token; -1 for single bytes
        self.rank = [-1] * size
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[(pair[0] + pair[1]) if isinstance(pair, list) else pair.replace(" ", "")]
            self.merge[a, b] = r
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = r, (a, b)
        # length of the longest token with these last four bytes; others have three at most
        self.reach: dict[bytes, int] = {}
        for b in self.vocab:
            if len(b) > 3:
                self.reach[b[-4:]] = max(len(b), self.reach.get(b[-4:], 0))
        self.missing = {b for b in range(256) if bytes([b]) not in self.vocab}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.seams: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.cache_words, self.young_words, self.longest_cached, self.most_seams = cache_words, young_words, longest_cached, most_seams

    def compatible(self, left: int, right: int) -> bool:
        """Whether left followed by right stays so under the merges. Undoes the merges of
        both sides from the last to the first and looks, at each step, for a merge across
        the seam that would have come before the one that is undone."""
        known = self.seams.get((left, right))
        if known is not None:
            return known
        a, b, merge, rank, parts = left, right, self.merge, self.rank, self.parts
        before = 1 << 60  # a merge across the seam with a rank below this breaks it
        answer = True
        while True:
            r = merge.get((a, b))
            if r is not None and r < before:
                answer = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left side's merge came last; at equal ranks the left one is first
                a, before = parts[a][1], ra
            else:
                # across the seam an equal rank would be met first from the left
                b, before = parts[b][0], rb + 1
        if len(self.seams) > self.most_seams:
            self.seams.clear()
        self.seams[left, right] = answer
        return answer

    def encode_words(self, words: Iterable[str]) -> None:
        """Puts the ids of distinct words into the cache. Sorted words visit their trie depth
        first; `state` holds the last tokens along the path from the root to the current node, as far
        as the words needed them: few prefixes of a word end where one of its candidate tokens starts."""
        get, reach, seams, compatible, cache, width = self.vocab.get, self.reach.get, self.seams, self.compatible, self.cache, self.bytes_of
        path, state = b"", [-1]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            if self.missing and not self.missing.isdisjoint(raw):
                raise ValueError("a byte is missing in the vocabulary")
            n, shared = len(raw), 0
            for x, y in zip(raw, path, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            state += [None] * (n - shared)
            # What is asked for, and from which start to look on; states that nothing asks for stay open.
            asked = [(n, n - reach(raw[-4:], 3))] if state[n] is None else []
            while asked:
                end, first = asked.pop()
                for start in range(max(0, first), end):
                    token = get(raw[start:end])
                    if token is None:
                        continue
                    if start:
                        before = state[start]
                        if before is None:
                            asked += ((end, start), (start, start - reach(raw[max(0, start - 4) : start], 3)))
                            break
                        known = seams.get((before, token))
                        if not (compatible(before, token) if known is None else known):
                            continue
                    state[end] = token
                    break
                else:
                    raise ValueError("no token ends here")
            path, end, ids = raw, n, []
            while end:
                ids.append(state[end])
                end -= len(width[state[end]])
            cache[word] = tuple(reversed(ids))

    def pieces(self, text: str) -> list[str]:
        """Special strings and pre-tokens, in order."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.pieces(t) for t in texts]
        cache, young = self.cache, self.young
        if len(cache) > self.cache_words:
            cache.clear()
        if not cache:
            cache.update({s: (i,) for s, i in self.specials.items()})
        fresh = set().union(*pieces).difference(cache)
        again = fresh.intersection(young)
        cache.update((w, young.pop(w)) for w in again)
        fresh -= again
        self.encode_words(fresh)
        out = [list(chain.from_iterable(map(cache.__getitem__, p))) for p in pieces]
        if len(young) > self.young_words:
            young.clear()
        for w in fresh:
            ids = cache.pop(w)
            if len(w) <= self.longest_cached:
                young[w] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec_of(path: str) -> Codec:
    """One codec for each worker process and file: reused workers keep their word cache."""
    return Codec(path)


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_tokens and ids for each row. A null text counts as empty: no ids. Input
    columns named n_tokens or ids are replaced. Rows are independent: repeats and ties give
    equal results; an empty table gives an empty one. Texts of any length are encoded whole."""

    def make():
        codec = codec_of(path)

        def run(cols):
            got = codec.encode_batch([t or "" for t in cols[0].to_pylist()])
            return [pa.array(map(len, got), pa.int64()), pa.array(got, pa.list_(pa.int32()))]

        return run

    return map_texts(df, make, [text_col], FIELDS, keep, rows=256)


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    text decoded from the ids, in UTF-8) and, if asked for, ids. Nulls, long texts and clashes as in encode()."""

    def make():
        codec = codec_of(path)
        digest = lambda b: hashlib.sha256(b).hexdigest()

        def run(cols):
            got = codec.encode_batch([t or "" for t in cols[0].to_pylist()])
            text_of = codec.text_of.__getitem__
            out = [
                pa.array(map(len, got), pa.int64()),
                pa.array([digest(",".join(map(text_of, ids)).encode()) for ids in got], pa.string()),
                pa.array([digest(codec.decode(ids).encode()) for ids in got], pa.string()),
            ]
            return [*out, pa.array(got, pa.list_(pa.int32()))] if with_ids else out

        return run

    fields = [FIELDS[0], T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(df, make, [text_col], fields + FIELDS[1:] * with_ids, keep, rows=256)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with decoded (string) from a column of id arrays; null ids give an empty string."""

    def make():
        codec = codec_of(path)
        return lambda cols: [pa.array([codec.decode(ids or []) for ids in cols[0].to_pylist()], pa.string())]

    return map_texts(df, make, [ids_col], [T.StructField("decoded", T.StringType())], keep)
