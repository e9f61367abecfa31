import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortia.llm import segments, substrings


def brute(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(2)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(8, 30))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((rng.randrange(1000) if k % 7 else k, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("counters", [4, 0])
def test_against_all_windows(make, monkeypatch, counters):
    # With hardly any counters the sketch lets everything through; the exact pass decides.
    monkeypatch.setattr(substrings, "COUNTERS", counters)
    monkeypatch.setattr(segments, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(segments, "SEGMENTS_PER_FOLDER", 2)
    rows = sample()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(make(rows), size=8).collect()), key=str)
    assert got == brute(rows, 8)


@pytest.mark.parametrize("counters", [(1 << 41) + 5, substrings.MAX_COUNTERS - (1 << 20)])
def test_sketches_wider_than_small_inputs_need(make, counters):
    """Above 2^40 counters (1.6 TB of text) as below: no repeat is lost."""
    rows = sample()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(make(rows), size=8, counters=counters).collect()), key=str)
    assert got == brute(rows, 8)


def test_sketches_that_do_not_fit_are_refused(make):
    with pytest.raises(ValueError, match="64 bits"):
        substrings.remove_repeats(make(sample()), size=8, counters=substrings.MAX_COUNTERS)


def test_kept_text_and_columns(make):
    shared = " ".join(f"s{k}" for k in range(12))
    docs = make([(1, f"start {shared} end"), (2, f"  other\n{shared}\nlast line"), (3, None), (4, shared)])
    docs = docs.withColumnRenamed("source", "seg").withColumnRenamed("lang", "h1")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, size=12, keep_text=True).collect()}
    assert got[1].text == f"start {shared} end"
    assert got[2].text == "  other\nlast line"
    assert got[3].text is None and got[4].text == ""
    assert got[2].seg == "web" and got[2].h1 == "en" and got[2]["__n_removed"] == 12


def test_odd_rows(make, odd_rows):
    want = brute([(r[0], r[1]) for r in odd_rows], 50)
    got = substrings.remove_repeats(make(odd_rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert substrings.remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("top", [3, 60, 5000, 10**6, 10**9])
def test_sorted_code(top):
    import numpy as np

    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 50, 3000):
        values = np.unique(rng.integers(0, top, n))
        assert substrings.decode_sorted(substrings.encode_sorted(values)).tolist() == values.tolist()


def peak_bytes(run, batches):
    """Most bytes allocated while ``run`` works through ``batches``, its results dropped one by one."""
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def segment_batches(batches, texts, words):
    rng = np.random.default_rng(3)
    for k in range(batches):
        text = [" ".join(map(str, rng.integers(0, 10**6, words))) for _ in range(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k * texts, (k + 1) * texts), pa.int64()), pa.array(text), pa.array([1] * texts, pa.int64())], ["doc_id", "text", "__seg"])


def test_a_sketch_task_holds_few_bytes_a_window():
    batches = list(segment_batches(8, 200, 500))
    windows = 8 * 200 * (500 - substrings.WINDOW + 1)
    _, peak = peak_bytes(substrings._sketch(substrings.WINDOW, 4 << substrings.BLOCK_BITS), batches)
    assert peak < 64 * windows


def test_candidates_of_a_segment_are_sent_in_bounded_pieces(monkeypatch):
    class All:
        def find(self, x):
            return np.zeros(len(x), np.int64)

    monkeypatch.setattr(substrings, "_hot_slots", lambda *_: [All(), All()])
    monkeypatch.setattr(substrings, "SEGMENT_CANDIDATES", 50_000, raising=False)
    run = substrings._candidates(substrings.WINDOW, 1 << substrings.BLOCK_BITS, "", 1)
    few, many = (peak_bytes(run, list(segment_batches(n, 200, 500))) for n in (4, 16))
    assert many[0] == 4 * few[0]
    assert many[1] < 1.5 * few[1]


def test_pieces_of_a_segment_say_what_the_whole_says(monkeypatch):
    class All:
        def find(self, x):
            return np.zeros(len(x), np.int64)

    monkeypatch.setattr(substrings, "_hot_slots", lambda *_: [All(), All()])
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k + 1, None]), pa.array(["a b c d", "b c d e a b c", "b c d"]), pa.array([7] * 3)], ["doc_id", "text", "__seg"]) for k in (5, 6, 2)]

    def windows(most):
        monkeypatch.setattr(substrings, "SEGMENT_CANDIDATES", most, raising=False)
        out = {}
        for batch in substrings._candidates(3, 1 << substrings.BLOCK_BITS, "", 1)(iter(batches)):
            for r in batch.to_pylist():
                out.setdefault((r["h1"], r["h2"]), []).append((r["low"], r["several"]))
        return out

    whole, pieces = windows(1000), windows(2)
    assert all(len(rows) == 1 for rows in whole.values()) and max(map(len, pieces.values())) > 1 and set(whole) == set(pieces)
    for key, [(low, several)] in whole.items():
        lows = [x for x, _ in pieces[key]]
        assert min(lows) == low and (min(lows) < max(lows) or any(x for _, x in pieces[key])) == several
