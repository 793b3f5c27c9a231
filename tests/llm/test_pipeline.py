import hashlib
import re

import pytest

from tests.llm.test_ops import brute_simhash

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_pipeline_against_brute_force(spark):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as cp
    from codeloom.llm import language, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    known = {r.id for r in language.predict(docs, language.train(docs)).where(f"lang_pred <> 'und' AND score >= {cp.LEAST_LANGUAGE_SCORE}").collect()}
    kept = {i: t for i, t in kept.items() if i in known}
    kept = {i: kept[i] for i, (_, c) in brute_simhash(kept.items()).items() if i == c}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)}

    def contaminated(t):
        w = words(t)
        hit = {j for i in range(len(w)) for m in {len(x) for x in windows} if tuple(w[i : i + m]) in windows for j in range(i, i + m)}
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = {i: t for i, t in kept.items() if not contaminated(t)}
    left = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")
    for r in secrets.scan(left).collect():
        out, at = "", 0
        for s in r.spans:
            if s.start >= at:
                out += kept[r.id][at : s.start] + "[SECRET]"
            at = max(at, s.end)
        kept[r.id] = out + kept[r.id][at:]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.PIECES))
    want = {}
    for i, t in kept.items():
        ids = sp.encode(t, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in cp.run(spark, SF).collect()} == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, "Hello there, this is a text.", "en", "s", 28)] * 2 + [(2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id here but words", None, "s", 5), (4, "1 2 3", "de", None, 5), (5, "x " * 20000 + "password=abcdefgh1", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(cp.STAGES):
            d = cp.materialise(stage(spark, d, str(tmp_path)))
            assert k == len(cp.STAGES) - 1 or d.columns == docs.columns
        assert {r.doc_id for r in d.collect()} == (set() if empty else {1, None, 5})
