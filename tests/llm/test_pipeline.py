import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, exact_dedup, quality, simhash
from lectern.llm.common import fold_ascii_py, table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        out.append(docs)
    return out


def test_stages_match_brute_force(spark, steps):
    source = table(spark, DATA, "documents")
    rows = {r.doc_id: r.text for r in source.collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    for s in steps[:-1]:
        assert s.columns == source.columns

    model = quality.learn(source, table(spark, DATA, "labels").where(~quality.held_out("doc_id", 3, 1)))
    scores = {i: model.score(quality.np.array([quality.statistics((t or "").encode())]))[0] for i, t in rows.items()}
    assert ids[0] == {i for i, s in scores.items() if s >= 0.5}

    last = {}
    for i in ids[0]:
        key = fold_ascii_py(rows[i])
        last[key] = max(i, last.get(key, i))
    assert ids[1] == set(last.values())

    sets = {i: set(simhash.shingle_hashes((rows[i] or "").encode(), 5).tolist()) for i in ids[1]}
    alike = lambda a, b: not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    least = {i: i for i in ids[1]}  # the smallest id of each group, over all pairs

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in ids[1]:
        for j in ids[1]:
            if i < j and alike(i, j):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    assert ids[2] == {i for i in ids[1] if top(i) == i}

    hit = {r.doc_id for r in decontaminate.contamination(steps[2], table(spark, DATA, "benchmark")).collect()}
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    assert {i for i in ids[2] if any(x in rows[i] for x in items)} <= hit
    assert ids[3] == ids[2] - hit

    codec = bpe.Bpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for r in steps[4].select("doc_id", "ids").collect():
        assert codec.decode(r.ids) == rows[r.doc_id]
    assert ids[4] == ids[3]


def test_run_and_nulls(spark, tmp_path):
    table(spark, DATA, "documents").union(spark.createDataFrame([(None, None, None, None, None)] * 2, table(spark, DATA, "documents").schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, DATA, name).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where(F.col("doc_id").isNotNull()).count() > 50
    assert exact_dedup.exact_dedup(out.select("doc_id", F.lit("x").alias("text"))).where("kept").count() == 1


def test_empty_tables_clashing_columns_and_a_very_long_text(spark, tmp_path):
    source = {n: table(spark, DATA, n) for n in ("documents", "labels", "benchmark")}
    for name, df in source.items():
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
        df.withColumns({c: F.lit(7) for c in ("f0", "node", "item_id", "keep_id", "h", "label", "__id") if c not in df.columns}).write.parquet(f"{tmp_path}/more/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    long = source["documents"].limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.repeat("text", 300)})
    long.withColumns({c: F.lit(7) for c in ("f0", "node", "item_id", "keep_id", "h", "label", "__id")}).write.mode("append").parquet(f"{tmp_path}/more/documents.parquet")
    plain = {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/more").select("doc_id").collect()} - {10**9} == plain
