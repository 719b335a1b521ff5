import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folia.llm import ngram_join, suffix_dedup
from folia.llm.components import components

from .conftest import words


def brute_removed(texts, length):
    seen = Counter()
    for _, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([False], gone)).view(np.int8)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup_is_exact(make, edge_texts, length):
    r = random.Random(9)
    passage = " ".join(words(77, 120))
    texts = edge_texts + [(30 + i, " ".join(words(50 + i, r.randrange(5, 90))) + passage[r.randrange(200) : 300 + r.randrange(400)] + " ".join(words(90 + i, 40))) for i in range(12)]
    got = suffix_dedup.suffix_dedup(make(texts), length).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_removed(texts, length)


def test_suffix_dedup_returns_the_kept_bytes(make, edge_texts):
    for x in suffix_dedup.suffix_dedup(make(edge_texts), 400, with_text=True).collect():
        assert hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256
        assert len(x.kept) == x.n_bytes - x.n_removed


def removed_locally(passages, length):
    """Bytes removed from each of many pairs of texts, by the rounds of the operator without Spark, each pair a corpus of its own."""
    out = []
    for pair in passages:
        ranked = Counter()
        for data in pair:
            ranked.update(suffix_dedup.anchors(data, length)[1].tolist())
        state = []
        for data in pair:
            at, rank = suffix_dedup.anchors(data, length)
            again = np.array([x for x, k in zip(at, rank.tolist()) if ranked[k] > 1], np.int64)
            state.append(suffix_dedup.open_blocks(data, again, length, suffix_dedup.BLOCKS[0]))
        gone, before = [np.zeros(len(x), bool) for x in pair], suffix_dedup.BLOCKS[0]
        for size in suffix_dedup.BLOCKS:
            cores, wholes, rows = defaultdict(set), defaultdict(set), []  # the places of each rank
            for k, data in enumerate(pair):
                f, z, s = suffix_dedup._split(*state[k], before, size)
                core = suffix_dedup._ranks(data, s + size - 1, s + length)[0].tolist()
                inside = (s >= 0) & (s + size - 1 + length <= len(data))
                whole = dict(zip(np.flatnonzero(inside).tolist(), suffix_dedup._ranks(data, s[inside], s[inside] + size - 1 + length)[0].tolist())) if inside.any() else {}
                for c, at in zip(core, s.tolist()):
                    cores[c].add((k, at))
                for i, w in whole.items():
                    wholes[w].add((k, int(s[i])))
                rows.append((f, z, s, core, whole))
            settled = [np.array([len(wholes[whole[i]]) > 1 if i in whole else False for i in range(len(f))], bool) for f, _, _, _, whole in rows]
            wanted = {c for (_, _, _, core, _), done in zip(rows, settled) for c, d in zip(core, done) if len(cores[c]) > 1 and not d}
            for k, ((f, z, s, core, _), done) in enumerate(zip(rows, settled)):
                if size == 1:
                    done = np.array([len(cores[c]) > 1 for c in core], bool)
                gone[k] |= suffix_dedup.removed_mask(len(pair[k]), f[done], z[done], length)
                more = np.array([c in wanted for c in core], bool)
                state[k] = f[more], z[more], s[more]
            before = size
        out.append([int(g.sum()) for g in gone])
    return out


def test_passages_at_random_places_are_found():
    """Starts of blocks need not ascend: several thousand passages at the query's own length."""
    r = np.random.default_rng(5)
    letters = lambda n: r.integers(97, 123, n, np.uint8).tobytes()
    pairs, want = [], []
    for _ in range(1500):
        passage = letters(int(r.integers(450, 1600)))
        # Digits around it, other ones in each text, so that just the passage repeats.
        pairs.append([b"0" + letters(int(r.integers(0, 400))) + b"1" + passage + b"2" + letters(60), b"3" + letters(int(r.integers(0, 400))) + b"4" + passage + b"5"])
        want.append([len(passage)] * 2)
    assert removed_locally(pairs, suffix_dedup.LENGTH) == want


def test_ranks_follow_their_own_ranges():
    r = np.random.default_rng(6)
    data = r.integers(97, 123, 3000, np.uint8).tobytes()
    start = np.array([700, 660, 1200, 0, 1190], np.int64)
    one = [suffix_dedup._ranks(data, start[i : i + 1], start[i : i + 1] + 400)[0][0] for i in range(len(start))]
    assert suffix_dedup._ranks(data, start, start + 400)[0].tolist() == one


def brute_components(texts, k, percent):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.append((i, s))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_is_exact(make, edge_texts, k, percent):
    r = random.Random(3)
    texts = list(edge_texts)
    for g in range(6):
        base = words(200 + g, [8, 14, 25, 60, 150, 400][g])
        for c in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append((100 + 20 * g + c, " ".join(w)))
    got = ngram_join.ngram_join(make(texts), k, percent).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(texts, k, percent)


@pytest.mark.parametrize("turn,name_bits", [(1, 63), (-1, 63), (1, 3)])
def test_join_of_shared_and_null_ids(make, turn, name_bits):
    """Sets go by their own name: rows that share an id, or have none, and names that several sets share."""
    base = {g: words(300 + g, 40) for g in range(5)}
    near = {g: [*w[:20], f"n{g}", *w[21:]] for g, w in base.items()}
    text = lambda w: " ".join(w)
    rows = [(1, text(base[0])), (1, text(base[1])), (2, text(near[0])), (3, text(near[1])), (None, text(base[2])), (None, text(base[3])), (None, text(near[2])), (8, text(near[3])),
            (9, text(base[4])), (9, text(near[4])), (9, text(near[4]))]
    rows += [(20 + i, text(words(700 + i, 30))) for i in range(30)]
    got = ngram_join.ngram_join(make(rows[::turn]), 3, 80, name_bits).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows, 3, 80)


def test_linked_heavy_sets_share_a_list():
    """Whatever the counts say, and for the least overlap that still links."""
    r = np.random.default_rng(5)
    for percent in (80, 90):
        scheme = ngram_join.Scheme(percent, 9)
        for n in [*range(11, 60), 500]:
            counts = r.integers(0, 4, ngram_join.COUNTERS).astype(np.uint8)
            x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            for m in range(math.ceil(n * percent / 100), n + 1):
                both = max(math.ceil(percent * (n + m) / (100 + percent)), 0)
                if m <= 9 or both > m:
                    continue
                y = np.unique(np.append(r.choice(x, both, replace=False), r.integers(1 << 62, 1 << 63, m - both).astype(np.uint64)))
                assert 100 * both >= percent * (n + m - both)
                assert len(np.intersect1d(ngram_join.signatures(x, scheme, counts), ngram_join.signatures(y, scheme, counts)))


def test_keep_one(make, edge_texts):
    kept = sorted((x.doc_id is None, x.doc_id or 0) for x in ngram_join.keep_one(make(edge_texts)).collect())
    ids = [i for none, i in kept if not none]
    assert len(ids) == len(set(ids))
    assert {0, 1, 2, 3, 4, 5, 8, 9, 10, 12, 13} <= set(ids) and not {6, 7, 11} & set(ids)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: v for n, v in label.items() if n in got}
    assert all(n in got for a, b in edges if a != b for n in (a, b))


def test_empty(make):
    assert suffix_dedup.query(make([])).count() == 0
    assert ngram_join.query(make([])).count() == 0


def test_suffix_dedup_says_which_documents_lose_bytes(make, edge_texts):
    """A passage of over 50 words and 400 bytes in two documents, a whole copy, and texts that repeat nothing."""
    passage = " ".join(words(77, 120))
    texts = [*edge_texts, (40, " ".join(words(41, 60)) + " " + passage), (42, passage + " " + " ".join(words(43, 60))), (44, " ".join(words(45, 150)))]
    got = suffix_dedup.query(make(texts)).collect()
    assert all(x.any_removed is (x.n_removed > 0) for x in got)
    assert {40, 42, 5, 7, 10, 11} <= {x.doc_id for x in got if x.any_removed}
    assert {0, 1, 2, 3, 4, 44} <= {x.doc_id for x in got if not x.any_removed}
