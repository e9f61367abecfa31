import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import spelling, tokencounts, whitening
from cohortia.llm.queries import tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def library_counts(name, texts):
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


TRICKY = ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "A<|ENDOFTEXT|>B", "É", "É", "é", "a  b", "a b", "A B", "a\r\nb", "<s>x</s>", "<|startoftext|>"]


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_the_library(make, odd_rows, name):
    rows = odd_rows + [(100 + k, t, "en", "web", len(t)) for k, t in enumerate(TRICKY * 2)]
    got = tokencounts.count_tokens(make(rows), tokenizer_path(name), limit=3).collect()
    texts = [r[1] or "" for r in rows]
    want = Counter((r[0], len(t.encode()), n, n > 3) for r, t, n in zip(rows, texts, library_counts(name, texts)))
    assert Counter(tuple(r)[:4] for r in got) == want


def test_second_call_encodes_only_new_texts(spark, make, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    stored = lambda: spark.read.parquet(cache).count()
    tokencounts.count_tokens(make([(1, "one"), (2, "two words"), (3, "one")]), path, cache=cache).count()
    assert stored() == 2
    again = tokencounts.count_tokens(make([(4, "one"), (5, "three"), (6, None)]), path, cache=cache)
    assert {(r.doc_id, r.n_tokens) for r in again.collect()} == {(4, 1), (5, 1), (6, 0)}
    assert stored() == 4
    # another version of the tokenizer starts its own column of the cache
    tokencounts.count_tokens(make([(1, "one")]), tokenizer_path("word_bpe_49k.json"), cache=cache).count()
    assert stored() == 5 and spark.read.parquet(cache).select("version").distinct().count() == 2


def test_stored_counts_are_used(spark, make, tmp_path):
    """A planted count comes back, so a known digest is really not encoded again."""
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    version = tokencounts.load_counter(path).version
    planted = spark.createDataFrame([("known",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    planted.write.parquet(f"{cache}/version={version}")
    got = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(make([(1, "known"), (2, "new")]), path, cache=cache).collect()}
    assert got == {1: 77, 2: 1}


def test_one_digest_may_hold_most_rows(make):
    rows = [(k, "the same text") for k in range(3000)] + [(5000 + k, f"text {k}") for k in range(2000)]
    got = tokencounts.count_tokens(make(rows), tokenizer_path("byte_bpe_50k.json"))
    assert got.count() == 5000 and got.where("n_tokens is null").count() == 0
    assert got.select("doc_id").distinct().count() == 5000


def test_counts_of_an_empty_table_and_clashing_names(spark, make):
    path = tokenizer_path("byte_bpe_50k.json")
    assert tokencounts.count_tokens(make([]), path).count() == 0
    names = ["digest", "n_tokens", "n_bytes", "__seg", "__at", "version", "n"]
    clashing = make([(1, "one two")]).withColumns({c: F.lit("x") for c in names})
    assert tokencounts.count_tokens(clashing, path).first()[:3] == (1, 7, 2)


def test_many_segments(make, monkeypatch):
    from cohortia.llm import segments

    monkeypatch.setattr(segments, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(segments, "SEGMENTS_PER_FOLDER", 3)
    rows = [(k, f"words of {k % 90} here") for k in range(200)]
    got = tokencounts.count_tokens(make(rows), tokenizer_path("byte_bpe_50k.json")).collect()
    want = dict(zip((r[0] for r in rows), library_counts("byte_bpe_50k.json", [r[1] for r in rows])))
    assert {r.doc_id: r.n_tokens for r in got} == want


def matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 130):
        a = rng.standard_normal((n, n))
        yield a @ a.T
        yield a[:, : max(1, n // 4)] @ a[:, : max(1, n // 4)].T
        yield np.diag(rng.integers(1, 4, n).astype(float))
        q = np.linalg.qr(a)[0]
        for values in (np.r_[np.full(min(n, 3), 5.0), np.ones(max(0, n - 3))], 1 + 1e-9 * np.arange(n), 10.0 ** -np.arange(n).clip(0, 12)):
            c = (q * values) @ q.T
            yield (c + c.T) / 2
        yield np.kron(np.eye(max(1, n // 2)), np.array([[2.0, 1.0], [1.0, 2.0]]))


def test_components_of_matrices():
    for c in matrices():
        values, vectors = whitening.leading_components(c, 8)
        want = np.linalg.eigvalsh(c)[::-1]
        assert len(values) >= min(8, np.sum(want > 1e-11 * want[0]))
        assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0])
        assert np.max(np.abs(c @ vectors - vectors * values)) < 1e-13 * want[0] * len(c)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(20), rng.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.r_[-10, (values[1:] + values[:-1]) / 2, 10]
    assert whitening.sturm_counts(d, e, at).tolist() == list(range(21))


def test_whitened_rows_against_numpy(spark):
    rng = np.random.default_rng(11)
    c = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(k, [float(v) for v in r], "x", 5) for k, r in enumerate(c)]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 11 + [None]), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (1005, [1.0, 2.0]), (1006, [1e300] + [0.0] * 11)]
    rows += [(k, v, "x", 5) for k, v in odd] + [(None, rows[7][1], "x", 5), (7, rows[7][1], "x", 5)]
    # names of the result among the inputs are no matter
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n long").repartition(5)
    out = whitening.whiten(df, whitening.fit(df)).toPandas()
    x = np.floor(np.vstack([c, c[7], c[7]]).astype(float) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    want = y @ q / np.sqrt(e)
    assert len(out) == 402 * 8 and (out.n == 402).all() and out.identity_error.max() < 1e-9
    for k in range(400):
        mine = out[out.vec_id == k].sort_values("component")
        assert len(mine) == (16 if k == 7 else 8)
        if k != 7:
            assert mine.component.tolist() == list(range(1, 9))
            assert np.allclose(np.abs(mine.whitened), np.abs(want[k]), atol=1e-9)
            assert np.allclose(mine.explained, e / np.trace(v), rtol=1e-9)
            assert set(mine.deviation) == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total))}
    assert out.vec_id.isna().sum() == 8
    signs = out[out.component == 3].drop_duplicates("vec_id").set_index("vec_id").whitened
    assert len(set(np.sign(signs.loc[range(400)].to_numpy() * want[:400, 2]))) == 1


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        out = whitening.whiten(df, whitening.fit(df))
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])], schema)
    assert {r.component for r in whitening.whiten(df, whitening.fit(df)).collect()} == {1}


def test_deviation_beyond_a_long():
    model = whitening.Whitening(10**9, [0, 0], np.ones(1), np.ones((2, 1)), 1.0, 1024, 100_000)
    assert whitening._deviations(model)(np.array([[3, 1], [10, 0], [0, 0]])) == [None, None, 0]
    small = whitening.Whitening(10**8, [5, 0], np.ones(1), np.ones((2, 1)), 1.0, 1024, 100_000)
    assert whitening._deviations(small)(np.array([[3, 1]])) == [(3 * 10**8 - 5) ** 2 + 10**16]


def brute_variants(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    n = {w: k for w, k in seen.items() if k >= 2}
    near = brute_near(n)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: best[w] if w in best and n[best[w]] >= 10 * n[w] else None for w in n}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def brute_near(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if a < b:
                if len(a) == len(b):
                    one = sum(x != y for x, y in zip(a, b)) == 1
                else:
                    s, t = sorted((a, b), key=len)
                    one = len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))
                if one:
                    near[a].add(b)
                    near[b].add(a)
    return near


@pytest.mark.parametrize("most", [1, 2, 5, 10_000])
def test_every_near_pair_once_however_partitions_are_split(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(220)} | {"a" * k for k in range(7, 14)}
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(table, partition_words=most).collect()]
    near = brute_near(words)
    assert len(got) == sum(map(len, near.values())) // 2
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in near for b in near[a]}


def test_variants_against_brute_force(make):
    rng = random.Random(2)
    base = ["general", "generals", "recieve", "receive", "receives", "Überfluß", "überfluss", "Receive", "multiplication×table", "naïvement", "inte"]
    rows = [(k, " ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "1", "_x"])) for k in range(60)]
    rows += [(None, "general generals"), (3, None), (4, ""), (5, "x" * 40_000), (6, "X" * 40_000), (7, "y" + "x" * 40_000 + " " + "Y" + "x" * 40_000), (8, "receive " * 900)]
    rows += [rows[-1]]
    got = {r.word: tuple(r) for r in spelling.spelling_variants(make(rows)).collect()}
    want = brute_variants(rows)
    assert got == want
    assert any(f for _, f, *_ in want.values())


def test_forms_are_followed_to_the_last(make):
    counts = {"abcdefghijk": 2, "abcdefghij": 25, "abcdefghi": 260, "abcdefgh": 2700}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items(), 1)]
    got = {r.word: r for r in spelling.spelling_variants(make(rows), delete_every=None).collect()}
    assert {r.root for r in got.values()} == {"abcdefgh"}
    assert [got[w].form for w in counts] == [*list(counts)[1:], None]


def test_variants_of_an_empty_table_and_clashing_names(make):
    assert spelling.spelling_variants(make([])).count() == 0
    rows = make([(1, "general general")]).withColumns({c: F.lit("x") for c in ("word", "n", "h", "raw", "s", "lo", "hi", "form")})
    assert spelling.spelling_variants(rows, delete_every=None).first()[:4] == ("general", None, "general", 2)


def test_acceptor_is_minimal_and_exact():
    words = sorted({"ab" + x + y for x in "abc" for y in "cde"})
    part = spelling.Acceptor()
    start = part.add(words)
    assert sorted(part.common(start, start)) == words
    assert len(part.arcs) == 5  # one chain: the three middles share one state
