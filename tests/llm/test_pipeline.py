import corpus_pipeline
from llm_data import awkward, empty

from gleaner.llm.queries import ORACLES, QUERIES


def test_stages_take_awkward_rows_and_keep_columns(spark):
    for frame in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            if name == "byte_bpe":
                assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                assert out.columns == frame.columns
            assert len(out.collect()) <= frame.count()


def test_one_row_of_each_group_of_copies_stays(spark):
    frame = awkward(spark)
    out = corpus_pipeline.ngram_jaccard(spark, frame, "/root/testdata/sf0.001")
    kept = [r for r in out.collect() if r["doc_id"] == 14]
    assert len(kept) == 1
    empties = [r for r in out.collect() if not (r["text"] or "").strip()]
    assert len(empties) == len([r for r in frame.collect() if not (r["text"] or "").strip()])


def test_run_equals_brute_force_stages(spark):
    """Rows of run() against the stages' operators, held apart against brute force in their own tests."""
    from test_jaccard import shingles
    from test_substring import brute as cut

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r["doc_id"] for r in docs.select("doc_id").collect()} - {
        r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, folder).collect()
    }
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected)
    sets, kept, parent = [shingles(t) for _, t in rows], [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = [rows[i] for i in range(len(rows)) if find(i) == i]
    shortened = {k: (gone, text) for k, _, gone, text in cut(kept, 35)}
    texts = {k: (shortened[k][1] if shortened[k][0] else t) for k, t in kept if not (shortened[k][0] and not shortened[k][1])}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {k for k, t in texts.items() if not any(i in " ".join(t.lower().split()) for i in items)}
    result = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert result <= clean and len(clean - result) <= 2  # passages within the error budget, but not the same


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_language_id_reads_small_batches(spark):
    """Its executors keep what they took, and the next stage sorts beside it."""
    import corpus_pipeline
    from gleaner.llm.scan import SMALL_BATCH_BYTES

    docs = spark.createDataFrame([(1, "de", "ein Wort")], "doc_id long, lang string, text string")
    corpus_pipeline.language_id(spark, docs, "")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(SMALL_BATCH_BYTES)
