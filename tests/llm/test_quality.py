import re
from collections import Counter

from folia.llm import quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rule(make, edge_texts):
    got = quality_rules.query(make(edge_texts)).collect()
    assert len(got) == len(edge_texts)
    want = Counter((i, *brute(t)) for i, t in edge_texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_adaptive_fence_drops_symbols_and_keeps_clean(make):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(60))) for i in range(60)]
    junk = [(100 + i, " ".join(f"word{i}y{j}***" for j in range(60))) for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.query(make(clean + junk)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_empty(make):
    assert quality_rules.query(make([])).count() == 0


def test_plan_is_native(make, edge_texts):
    plan = quality_rules.features(make(edge_texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
