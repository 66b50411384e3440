import corpus_pipeline
import public_tokenizers
from conftest import TESTDATA
from odd import empty_documents
from pyspark.sql import functions as F
from test_packing import cut, gapless
from test_similar import groups
from tokenizers import Tokenizer

SF = f"{TESTDATA}/sf0.01"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        assert kept[-1].columns == docs.columns, name
        assert kept[-1].join(kept[-2], docs.columns, "left_anti").count() == 0
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    for after, before, bad in ((ids[1], ids[0], "quality"), (ids[2], ids[1], "toxic")):
        known = [i for i in before if i in labels]
        right = [(i in after) == (labels[i].quality == 1 if bad == "quality" else labels[i].toxic == 0) for i in known]
        assert sum(right) > 0.93 * len(right), bad
    # the third stage, judged on its own input: the first document of each class, no class joins what brute force keeps apart
    rows = [(r.doc_id, r.text or "") for r in kept[2].collect()]
    exact = groups(rows)
    assert ids[3] >= {min(g) for g in exact}
    extra = len(ids[3]) - len(exact)
    assert extra <= 0.1 * (len(rows) - len(exact))
    # the last: every piece of what is left, and what run() gives
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    packed = corpus_pipeline.run(spark, SF).collect()
    want = cut(tokenizer, [(r.doc_id, r.text or "") for r in kept[3].collect()])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    gapless(packed, 2048)


def test_odd_columns_and_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({"label": F.lit(1), "fp": F.lit(None).cast("bigint"), "_gone": F.lit(3), "score": F.lit(0.5)})
    docs = docs.union(docs.limit(3)).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, empty_documents(spark), SF).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).count() >= docs.count()
