import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from folia.llm import packing, tokens

from .conftest import words

TRICKY = ["a  b", "a\n b <|endoftext|> c　 d", "  x é​ y  ", "don't you're", "\t x", " ", "日本語 テキスト 😀 ok", "it's  \n\n  it", "a  b", "x" * 50, "1 2  3\n\n\n4 "]


def test_ids_are_the_librarys():
    e = tokens.encoder(tokens.default_path())
    for t in TRICKY:
        assert np.frombuffer(e.ids(t), np.uint32).tolist() == e.library.encode(t, add_special_tokens=False).ids, t


def test_counts_with_chunks_and_widening(make, edge_texts):
    e = tokens.encoder(tokens.default_path())
    texts = edge_texts + [(20 + i, t) for i, t in enumerate(TRICKY)] + [(40, "longword" * 900), (41, ("ab " * 50 + "q" * 700) * 4)]
    got = tokens.token_counts(make(texts), chunk=256, overlap=16).collect()
    want = Counter((i, len((t or "").encode()), len(e.library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_neighbours_splice_at_common_boundaries():
    """Both chunks of a border have the same boundaries and tokens, whatever the cut; a false one is told by its checksum."""
    e = tokens.encoder(tokens.default_path())
    text = " ".join(words(5, 400)) + " x é​ y <|endoftext|> " + "don't you're 日本 語 " * 20
    ids = np.array(e.library.encode(text, add_special_tokens=False).ids)
    rows = [r for f in tokens._encode_chunk(tokens.default_path(), 700, 60)(tokens._chunks(700, 60)(iter([pd.DataFrame({"key": ["k"], "text": [text]})]))) for r in f.itertuples()]
    assert len(rows) > 3
    total = rows[-1].n_tokens
    for a, b in zip(rows, rows[1:]):
        assert [p for p, _ in a.right] == [p for p, _ in b.left] and a.right and a.right_sum == b.left_sum
        assert all(text[p - 1] != " " == text[p] for p, _ in a.right)
        total += a.right[0][1] - b.left[0][1]
    assert total == len(ids)


def test_other_vocabularies(make):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [(i, t) for i, t in enumerate(TRICKY)]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("json"):
            t = Tokenizer.from_file(path)
            count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
        else:
            p = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda x: len(p.encode(x))
        got = {r.doc_id: r.n_tokens for r in tokens.token_counts(make(texts), path=path).collect()}
        assert got == {i: count(x) for i, x in texts}


def check_packed(rows, texts, capacity=1024):
    e = tokens.encoder(tokens.default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = 0
    for i, t in texts:
        ids = e.ids(t) + (2).to_bytes(4, "little")
        n = len(ids) // 4
        total += n
        found = sorted((r for r in by_doc[i]), key=lambda r: (r.piece, r.sequence_id))
        copies = sum(1 for j, u in texts if j == i)
        assert sum(r.length for r in found) == n * copies
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
            assert r.length == capacity or r.piece == 0
    return len(by_sequence), total


def test_packing_round_trip(make, edge_texts):
    rows = packing.query(make(edge_texts)).collect()
    used, total = check_packed(rows, edge_texts)
    assert used <= total / 1024 * 1.2 + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5.5, 0.9, 20000).astype(int), 1, 1024)
    histogram = Counter(lengths.tolist())
    sequences = packing.plan(histogram)
    placed = Counter()
    for n, content in sequences:
        assert sum(k * m for k, m in content.items()) <= 1024
        for k, m in content.items():
            placed[k] += n * m
    assert placed == histogram
    assert sum(n for n, _ in sequences) <= 1.005 * -(-int(lengths.sum()) // 1024)


def test_sequences_hold_the_ids(make):
    texts = [(i, "some words " * (i + 1)) for i in range(30)]
    e = tokens.encoder(tokens.default_path())
    parts = packing.pieces(make(texts), capacity=64, keep_ids=True)
    packed = packing.pack(parts, capacity=64).cache()
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = e.ids(texts[r.doc_id][1]) + (2).to_bytes(4, "little")
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == ids[4 * r.start : 4 * (r.start + r.length)]


def test_empty(make):
    assert packing.query(make([])).count() == 0
    assert tokens.query(make([])).count() == 0
