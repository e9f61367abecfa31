import random
import re

import pytest

from cohortia.llm import minhash


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, make, size):
    rng = random.Random(size)
    base = [f"v{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for k in range(150):  # one large family with every degree of likeness, so chains appear
        rows.append((k, " ".join(edited(rng, base, rng.randrange(0, 14)))))
    for k in range(150, 260):
        rows.append((k, " ".join(f"u{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))))
    chain = list(base[:60])
    for k in range(260, 300):
        chain = edited(rng, chain, 2)
        rows.append((k, " ".join(chain)))
    rows += [(300, rows[5][1].upper()), (301, rows[5][1].replace(" ", "\n")), (302, None), (303, ""), (304, "x"), (305, "X")]
    want = brute(rows, size)
    got = {r.doc_id: r for r in minhash.near_duplicates(make(rows), size=size).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_odd_rows(make, odd_rows):
    got = minhash.near_duplicates(make(odd_rows).toDF("doc_id", "text", "node", "key", "comp"), size=5).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6 and not by[7].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[8].component_id == 8 and by[8].kept
    assert by[None].component_id is None and by[None].kept


def test_one_id_with_two_texts(make):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(make([(1, a), (2, a), (2, b), (3, b)]), size=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(make):
    assert minhash.near_duplicates(make([])).count() == 0


def test_tables_share_hash_values():
    assert minhash.N_HASHES < minhash.M1 * minhash.M2 * (minhash.K1 + minhash.K2) ** 0.5
    recall = (1 - (1 - 0.8**minhash.K1) ** minhash.M1) * (1 - (1 - 0.8**minhash.K2) ** minhash.M2)
    assert recall > 0.999
