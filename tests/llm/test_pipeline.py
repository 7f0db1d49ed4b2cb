"""The pipeline's stages on a small table: decisions take effect, clean documents stay."""

import corpus_pipeline
from tallyrack.llm import queries


def test_stages(spark, tmp_path):
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(body)]
    rows += [(40, body[3] + " tail", "en", "src", 1), (41, body[5], "en", "src", 1), (42, body[7] + " token = abcdefgh12345678", "en", "src", 1)]
    rows += [(43, " ".join(f"q{j}" for j in range(50)) + " " + " ".join(f"bench{j}" for j in range(20)), "en", "src", 1), (44, None, None, None, None), (45, "", "en", "src", 0)]
    rows += [(50 + i, " ".join(f"u{i}v{j}" for j in range(30)) + " villainous", "en", "src", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(50 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"bench{j}" for j in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 42 is a copy of 7 but for its end, as 40 is of 3
    assert got == {*range(40), 44, 45}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    blanked = corpus_pipeline.blank_secrets(spark, docs, str(tmp_path)).where("doc_id = 42").first()
    assert blanked["text"].endswith("[SECRET]") and blanked["n_chars"] == len(blanked["text"])


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_whatever_the_names_of_further_columns(spark, tmp_path):
    clashing = ["odd.name", "tick`s", "score", "slot", "fp", "gone", "c0", "C1", "base_spans", "a b", "item_id", "toxic"]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "src", 1, *[i] * len(clashing)) for i in range(12)]
    rows += [(20, rows[3][1], "en", "src", 1, *[20] * len(clashing)), (21, None, None, None, None, *[None] * len(clashing))]
    rows += [(22, "see " + " ".join(f"bench{j}" for j in range(20)), "en", "src", 1, *[22] * len(clashing)), (23, "key token = abcdefgh12345678", "en", "src", 1, *[23] * len(clashing))]
    rows += [(30 + i, f"villainous words {i}", "en", "src", 1, *[30] * len(clashing)) for i in range(8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join("`" + c.replace("`", "``") + "` int" for c in clashing)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 0) for i in range(12)] + [(30 + i, 1) for i in range(8)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"bench{j}" for j in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"toxicity": {*range(12), 20, 21, 22, 23}, "near_duplicates": {*range(12), 21, 22, 23}, "decontamination": {*range(12), 21, 23}, "secrets": {*range(12), 21, 23}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert {r["doc_id"] for r in got} == left[name], name
        assert all(r[c] == (30 if r["doc_id"] >= 30 else None if r["doc_id"] == 21 else r["doc_id"]) for r in got for c in clashing)
        docs = spark.createDataFrame(got, docs.schema)
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == 14


def test_ids_and_texts_whatever_their_names(spark):
    from tallyrack.llm import byte_pairs, license_scans, near_duplicates, secret_scans, sentencepieces, source_audit, token_counts, vector_codes, vector_links

    df = spark.createDataFrame([(1, "some words token=abcdefgh1234", "en", "a", [1.0, 2.0])], "`my.id` bigint, `te``xt` string, `la.ng` string, `so.urce` string, `v.v` array<double>")
    names = {"id_col": "my.id", "text_col": "te`xt"}
    assert byte_pairs.encoding_digests(df, **names).count() == sentencepieces.encode_documents(df, **names).count() == 1
    assert token_counts.count_tokens(df, **names).first()["n_tokens"] > 3 and license_scans.scan_licences(df, **names).count() == 1
    assert near_duplicates.near_duplicate_classes(df, **names).first()["class_id"] == 1
    assert secret_scans.find_secrets(df, **names).first()["n_assign"] == 1
    assert source_audit.audit_sources(df, text_col="te`xt", lang_col="la.ng", source_col="so.urce").count() == 0
    vectors = {"id_col": "my.id", "vector_col": "v.v", "label_col": "la.ng"}
    assert vector_codes.code_rows(df, **vectors).first()["vec_id"] == vector_links.link_vectors(df, **vectors).first()["vec_id"] == 1
