"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A byte-level BPE first splits the text into pre-tokens and merges inside each. No pre-token
holds a non-space character followed by white space, so every such place is a pre-token
boundary whatever stands around it: a *proven stable boundary*. Short texts are cut there, each
distinct segment is encoded once per worker, and a document's tokens are its segments'.

Huge documents become chunks that may run on different executors. Neighbours overlap by
``overlap`` characters on either side of their border, and each encodes all of its text, overlaps
included, with the byte offsets of its tokens. They splice at the first stable boundary of the
overlap where a token begins in both, and only if both have the same tokens from there to the
last such boundary. Where there is none, or the tokens differ, the document runs again with wider
overlaps and chunks, at last as one chunk.

That is so for byte-level BPE files. For other vocabularies no boundary is proven, and every
text is encoded at once.

Defined results: a null text counts as empty (0 tokens); a null or repeated ``doc_id`` keeps
one row per input row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, materialize

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
WIDEN = 8
LIMIT = 512
#: Distinct segments a worker remembers; a full memory starts anew.
CACHE_SEGMENTS = 200_000
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STABLE = re.compile(r"(?<=\S)(?= )")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids(text) as the library gives them, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache: dict[str, bytes | None] = {}
        self.merge = self._sizes = None
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.stable = False
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.stable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                       and not spec.get("normalizer") and model.get("type") == "BPE")
        self.stable = self.stable and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.added = [t["content"] for t in spec["added_tokens"]]
        if self.stable and not model.get("ignore_merges") and not model.get("dropout"):
            self.merge = self._ranked(model["vocab"], model["merges"])

    def _ranked(self, vocab: dict[str, int], merges: list):
        """A faster merger over the same vocabulary, if its ids are in the order of the merges."""
        import tiktoken

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        order = [vocab[a + b] for a, b in pairs]
        letters = _byte_letters()
        if order != sorted(set(order)) or order[0] < 256:
            return None
        own = [t for t in vocab if t not in set(self.added)]
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in own}
        if len(own) != 256 + len(order):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        if self.piece:
            return array("I", self.library.encode(text)).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def sizes(self) -> np.ndarray:
        """Bytes that each id of a byte-level vocabulary stands for."""
        if self._sizes is None:
            vocab = self.library.get_vocab(with_added_tokens=True)
            self._sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, k in vocab.items():
                self._sizes[k] = len(token.encode()) if token in self.added else len(token)
        return self._sizes

    def _segment(self, segment: str) -> bytes:
        if self.merge is not None and max(segment) < "ɐ" and not any(a in segment for a in self.added):
            return array("I", self.merge.encode_ordinary(segment)).tobytes()
        return self._library(segment)

    def segments(self, text: str) -> list[bytes]:
        """Ids of the segments between stable boundaries."""
        if not self.stable:
            return [self._library(text)] if text else []
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            cache = self.cache
            try:
                found = list(map(cache.__getitem__, rest))
            except KeyError:
                if len(cache) > CACHE_SEGMENTS:
                    cache.clear()
                for s in set(rest).difference(cache):
                    cache[s] = self._segment(" " + s) if s and not s[-1].isspace() else None
                found = list(map(cache.__getitem__, rest))
            if None not in found[:-1]:
                if found and found[-1] is None:
                    found[-1] = self._segment(" " + rest[-1])
                return [self._segment(first), *found]
        return [self._segment(s) for s in _STABLE.split(text) if s]

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.segments(text)) if text else b""

    def count(self, text: str | None) -> int:
        return sum(map(len, self.segments(text))) // 4 if text else 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _count_whole(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [e.count(t) for t in b["text"]]})

    return run


_CHUNK = "key string, j long, last long, text string"
_BOUNDARIES = "array<struct<p:long,n:long>>"


def _chunks(chunk: int, overlap: int):
    """Rows (key, j, last, text): characters [j * chunk, (j + 1) * chunk) and the overlaps around them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                n = len(text)
                many = -(-n // chunk) if n > chunk + overlap else 1
                for j in range(many):
                    a, z = (max(0, j * chunk - overlap), min(n, (j + 1) * chunk + overlap)) if many > 1 else (0, n)
                    yield pd.DataFrame({"key": [key], "j": [j], "last": [many - 1], "text": [text[a:z]]})

    return run


def _boundaries(text: str, starts: np.ndarray, ids: np.ndarray, a: int, z: int, base: int) -> tuple[list[tuple[int, int]], int]:
    """Stable boundaries in text[a:z] where a token begins: (place in the document, tokens before it);
    and a checksum of the tokens from the first to the last of them."""
    out, place, at = [], len(text[:a].encode()), a
    for m in _STABLE.finditer(text, a, z):
        if m.start() == a:  # the neighbour may not see the character before it
            continue
        place += len(text[at : m.start()].encode())
        at = m.start()
        k = int(np.searchsorted(starts, place))
        if starts[k] == place:
            out.append((at + base, k))
    return out, zlib.crc32(ids[out[0][1] : out[-1][1]].tobytes()) if out else 0


def _encode_chunk(path: str, chunk: int, overlap: int):
    """(key, j, last, n_tokens, and for the overlaps on the left and right: boundaries and checksum)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            rows = []
            for key, j, last, text in zip(b["key"], b["j"], b["last"], b["text"]):
                ids = np.frombuffer(e._library(text), np.uint32)
                starts = np.concatenate(([0], np.cumsum(e.sizes()[ids])))
                base = max(0, j * chunk - overlap)
                left = _boundaries(text, starts, ids, 0, 2 * overlap, base) if j else ([], 0)
                right = _boundaries(text, starts, ids, (j + 1) * chunk - overlap - base, (j + 1) * chunk + overlap - base, base) if j < last else ([], 0)
                rows.append((key, j, last, len(ids), *left, *right))
            yield pd.DataFrame(rows, columns=["key", "j", "last", "n_tokens", "left", "left_sum", "right", "right_sum"])

    return run


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """n_tokens by key of the huge texts."""
    done, kind = None, f"key string, j long, last long, n_tokens long, left {_BOUNDARIES}, left_sum long, right {_BOUNDARIES}, right_sum long"
    while True:
        chunks = huge.mapInPandas(_chunks(chunk, overlap), _CHUNK).repartition(F.col("key"), F.col("j"))
        parts = materialize(map_slices(chunks, _encode_chunk(path, chunk, overlap), kind), "chunks")
        before = parts.where("j < last").select("key", (F.col("j") + 1).alias("j"), "right", "right_sum")
        pairs = parts.where("j > 0").select("key", "j", "left", "left_sum").join(before, ["key", "j"])
        both = F.filter("left", lambda x: F.exists("right", lambda y: y["p"] == x["p"]))
        pairs = pairs.withColumn("here", F.get(both, 0))
        there = F.get(F.filter("right", lambda y: y["p"] == F.col("here.p")), 0)
        # Tokens of a document: the last chunk's, and at each splice those before it in the one chunk less those in the other.
        splice = pairs.select("key", (there["n"] - F.col("here.n")).alias("n"), (F.col("here").isNotNull() & (F.col("left_sum") == F.col("right_sum"))).alias("good"))
        ends = parts.where("j = last").select("key", F.col("n_tokens").alias("n"), F.lit(True).alias("good"))
        whole = materialize(splice.unionByName(ends).groupBy("key").agg(F.sum("n").alias("n_tokens"), F.every("good").alias("good")), "spliced")
        discard(parts)
        good, bad = whole.where("good").drop("good"), whole.where("NOT good")
        done = good if done is None else done.unionByName(good)
        if bad.isEmpty():
            return done
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
        huge = huge.join(bad.select("key"), "key", "left_semi")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = path or default_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long"
    huge = F.length("text") > 2 * chunk
    if encoder(path).stable:
        counts = rows.where(~huge).mapInPandas(_count_whole(path), kind)
        large = rows.where(huge).withColumn("key", F.sha2("text", 256))
        if not large.isEmpty():
            spliced = _spliced(large.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
            counts = counts.unionByName(large.select("doc_id", "n_bytes", "key").join(spliced, "key").drop("key"))
    else:
        counts = rows.mapInPandas(_count_whole(path), kind)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
