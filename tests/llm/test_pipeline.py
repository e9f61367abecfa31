import hashlib
import re

import corpus_pipeline
from cohortia.llm import decontaminate, pieces, toxicity
from cohortia.llm.queries import tokenizer_path
from cohortia.llm.tables import read


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def test_stages_against_brute_force(spark, sf):
    """Every stage on the small tables: what it keeps, and that its decision takes effect."""
    docs = read(spark, sf, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        rows = docs.collect()
        if k == 0:
            scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.train(before, read(spark, sf, "labels"))).collect()}
            want = {i: t for i, t in kept.items() if scores[i] < toxicity.THRESHOLD}
        elif k == 1:
            sets, root = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}

            def top(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for i in sorted(sets):
                for j in sorted(sets):
                    if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = top(i), top(j)
                        root[max(a, b)] = min(a, b)
            want = {i: t for i, t in kept.items() if top(i) == i}
        elif k == 2:
            first = {}
            for i in sorted(kept):
                words = (kept[i] or "").encode().split()
                for p in range(len(words) - 49):
                    first.setdefault(tuple(words[p : p + 50]), i)
            want = {}
            for i, t in kept.items():
                words = (t or "").encode().split()
                gone = {p + q for p in range(len(words) - 49) if first[tuple(words[p : p + 50])] < i for q in range(50)}
                want[i] = b" ".join(w for p, w in enumerate(words) if p not in gone)
            assert {r.doc_id: b" ".join((r.text or "").encode().split()) for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows if r.text != kept[r.doc_id])
            want = {r.doc_id: r.text for r in rows}
        elif k == 3:
            bad = {r.doc_id for r in decontaminate.find_leaks(before, read(spark, sf, "benchmark")).collect()}
            want = {i: t for i, t in kept.items() if i not in bad}
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            for r in rows:
                ids = [*sp.encode(kept[r.doc_id] or ""), sp.eos_id()]
                assert list(r.ids) == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
            assert {r.doc_id for r in rows} == set(kept)
            continue
        assert docs.columns == columns and {r.doc_id: r.text for r in rows} == want, name
        kept = want


def test_stages_take_odd_and_empty_tables(spark, make, odd_rows, sf):
    for docs in (make(odd_rows), make([])):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert "ids" in docs.columns and docs.count() <= len(odd_rows)


def test_run_is_the_stages_in_a_row(spark, sf):
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
    assert sorted(docs.drop("ids").collect()) == sorted(corpus_pipeline.run(spark, sf).drop("ids").collect())


def test_vocabulary_is_not_in_the_repository():
    assert pieces.load_model(tokenizer_path("piece_bpe_32k.model")).end_id == 2
